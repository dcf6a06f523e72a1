"""Snapshots of repositories: listing, incremental refresh, storage."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, SparkRuntimeException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.text import summarize
from lodestone.schemas import FILES, conform

from .buckets import WriterConflict
from .config import SnapshotConfig
from .listing import listing, with_contents


def list_files(spark: SparkSession, root: str, config: SnapshotConfig, rules: str = "") -> DataFrame:
    """(path, mtime_ms, size): the repository's text files that are included and not excluded or
    ignored; the first max_files by path if that is above 0. No file is opened.

    `rules` are lines as of a .gitignore at the root; files of rules in the tree count as well, those
    named .gitignore if the root is that of a git repository.
    """
    found = listing(spark, root, config.include, config.exclude, rules).filter(F.col("extension").isin(*config.text_extensions)).select("path", "mtime_ms", "size")
    return found.orderBy("path").limit(config.max_files) if config.max_files > 0 else found


def _state(same: Column, equal: Column) -> Column:
    """What became of a file: same (by what the listing tells), touched (its content is what it was) or
    changed, which files that are new are too. Nulls don't hold."""
    return F.when(same, "same").when(equal, "touched").otherwise("changed")


def refresh(files: DataFrame, previous: DataFrame | None, config: SnapshotConfig, root: str) -> DataFrame:
    """The new snapshot of listed files with a column changed.

    A file with the size, time, mode and configuration of before is kept as it was, unread. One with
    other times but the same content keeps its summary. All others are read and summarised anew and
    count as changed. Files that are gone, or can't be read, are absent.
    """
    old = conform(previous, FILES) if previous is not None else files.sparkSession.createDataFrame([], FILES)
    old = old.select(*(F.col(c).alias(f"_{c}") for c in old.columns))
    both = files.select("path", "mtime_ms", "size").join(old, F.col("path") == F.col("_path"), "left").drop("_path")
    # what a row is made of besides the file; old snapshots don't tell and are made anew
    made_alike = F.coalesce((F.col("_mode") == config.mode) & (F.col("_config_hash") == config.row_hash()), F.lit(False))
    same = F.coalesce(made_alike & (F.col("mtime_ms") == F.col("_mtime_ms")) & (F.col("size") == F.col("_size")), F.lit(False))
    both = both.withColumn("_alike", made_alike).withColumn("_same", same)
    read = with_contents(both, root, ~F.col("_same")).filter("_same OR raw IS NOT NULL")
    digest = F.sha2("raw", 256)
    content = F.make_valid_utf8(F.col("raw").cast("string"))
    kept = content if config.mode == "full" else F.lit(None).cast("string")
    staged = read.withColumn("_state", _state(F.col("_same"), F.col("_alike") & (digest == F.col("_hash"))))
    return staged.select(
        "path",
        F.when(F.col("_state") == "same", F.col("_hash")).otherwise(digest).alias("hash"),
        "mtime_ms",
        "size",
        F.lit(config.mode).alias("mode"),
        F.when(F.col("_state") == "same", F.col("_content")).otherwise(kept).alias("content"),
        F.when(F.col("_state") == "changed", summarize(content, "path", config.max_file_chars)).otherwise(F.col("_summary")).alias("summary"),
        F.lit(config.row_hash()).alias("config_hash"),
        (F.col("_state") == "changed").alias("changed"),
    )


def compare_listing(new: DataFrame, old: DataFrame) -> DataFrame:
    """(path, state) of two listings (path, hash, mtime_ms, size, mode): same, touched, changed (or
    new) or removed."""
    before = old.select(*(F.col(c).alias(f"_{c}") for c in old.columns))
    both = new.join(before, F.col("path") == F.col("_path"), "full_outer")
    same = (F.col("mtime_ms") == F.col("_mtime_ms")) & (F.col("size") == F.col("_size")) & (F.col("mode") == F.col("_mode"))
    state = F.when(F.col("path").isNull(), "removed").otherwise(_state(same, F.col("hash") == F.col("_hash")))
    return both.select(F.coalesce("path", "_path").alias("path"), state.alias("state"))


def _path(spark: SparkSession, at: str):
    """(file system, path) of a place, and the path's class."""
    kind = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    path = kind(at)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path, kind


def _marks(spark: SparkSession, at: str) -> list[int]:
    """The numbers of a store's complete generations, the newest first."""
    fs, path, _ = _path(spark, at)
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted((int(n.removeprefix("complete-")) for n in names if n.startswith("complete-")), reverse=True)


def current_generation(spark: SparkSession, at: str) -> int | None:
    """The number of the newest complete generation in a store, from its mark."""
    return next(iter(_marks(spark, at)), None)


def generation_dir(spark: SparkSession, at: str) -> str | None:
    """Where the newest complete generation of a store is: its mark names the folder. A mark that its
    writer hasn't ended yet doesn't count."""
    fs, _, kind = _path(spark, at)
    for number in _marks(spark, at):
        mark = fs.open(kind(f"{at}/complete-{number}"))
        try:
            if named := bytes(mark.readAllBytes()).decode():
                return f"{at}/{named}"
        finally:
            mark.close()
    return None


def save_generation(spark: SparkSession, at: str, write: Callable[[str], None], keep: int = 2) -> None:
    """Lets write() fill a new folder of the store and marks it as complete, which is one step: readers
    see the generation before until then, and a write that fails leaves it as it was. What is written
    may be read from the generation before. Older ones than the last `keep` are removed.

    Of two writers that begin at one generation the second to end fails, and its folder goes.
    """
    number = (current_generation(spark, at) or 0) + 1
    fs, _, kind = _path(spark, at)
    named = f"generation-{number}-{uuid.uuid4().hex}"
    try:
        write(f"{at}/{named}")
        try:
            mark = fs.create(kind(f"{at}/complete-{number}"), False)
        except Exception as e:  # noqa: BLE001  the file system's own error for files that exist
            if fs.exists(kind(f"{at}/complete-{number}")):
                raise WriterConflict(f"generation {number} of {at} was made by another writer") from e
            raise
    except BaseException:
        fs.delete(kind(f"{at}/{named}"), True)
        raise
    mark.write(bytearray(named.encode()))
    mark.close()
    for status in fs.listStatus(kind(at)):
        name = status.getPath().getName()
        prefix, _, of = name.partition("-")
        of = of.partition("-")[0]
        if prefix in ("complete", "generation") and of.isdigit() and int(of) <= number - keep:
            fs.delete(status.getPath(), True)


def load_tables(spark: SparkSession, at: str, *names: str) -> tuple[DataFrame, ...] | None:
    """Tables of a store's newest generation; None if there is no store."""
    held = generation_dir(spark, at)
    return None if held is None else tuple(spark.read.parquet(f"{held}/{n}") for n in names)


def save_snapshot(snapshot: DataFrame, at: str) -> None:
    """Stores a snapshot; a reader sees the old or the new one."""
    save_generation(snapshot.sparkSession, at, lambda to: snapshot.write.parquet(f"{to}/files"))


def load_snapshot(spark: SparkSession, at: str) -> DataFrame | None:
    """A stored snapshot; None if there is none or it can't be read."""
    held = generation_dir(spark, at)
    if held is None:
        return None
    try:
        found = spark.read.parquet(f"{held}/files")
        found.limit(1).collect()  # what only looks like Parquet fails here
        return conform(found, FILES)
    except (AnalysisException, SparkRuntimeException, Py4JJavaError):
        return None
