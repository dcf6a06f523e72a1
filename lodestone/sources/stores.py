"""Small stores: the registry of repositories, wiki pages, renamed files, snapshot status."""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.columns import page_name
from lodestone.schemas import REPOS, conform


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """The registry's rows (see schemas.REPOS); empty if there is no file yet, an error if it can't
    be parsed."""
    if not Path(path).exists():
        return spark.createDataFrame([], REPOS)
    return conform(spark.read.schema(REPOS).option("mode", "FAILFAST").option("multiLine", "true").json(path), REPOS)


def save_registry(registry: DataFrame, path: str) -> None:
    """Writes a JSON list through a file beside; a registry has a row for each repository."""
    rows = registry.orderBy("alias").toJSON().collect()
    part = Path(f"{path}.tmp")
    part.write_text("[\n" + ",\n".join(rows) + "\n]\n")
    part.replace(path)


def write_wiki(pages: DataFrame, folder: str, force: bool = False) -> int:
    """Writes (page, body) rows, 200 at most, as Markdown files; existing ones stay unless `force`.
    Returns how many were written."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    written = 0
    for r in pages.toLocalIterator():
        at = Path(folder, f"{r['page']}.md")
        if force or not at.exists():
            at.write_text(r["body"])
            written += 1
    return written


def read_wiki_page(spark: SparkSession, folder: str, name: str) -> str:
    """A page by its name, made a file name like those of pages; an error if there is none."""
    page = spark.range(1).select(page_name(F.lit(name)).alias("p")).first()["p"]
    return Path(folder, f"{page}.md").read_text()


def write_refactored(rewritten: DataFrame, root: str) -> int:
    """Writes (path, new_content) rows into a working tree, file by file; files that are gone are
    left out. Returns how many were written."""
    written = 0
    for r in rewritten.toLocalIterator():
        at = Path(root, r["path"])
        if at.is_file():
            at.write_text(r["new_content"])
            written += 1
    return written


def snapshot_status(snapshot: DataFrame | None, spark: SparkSession) -> DataFrame:
    """One row: exists, file_count, total_size, modes."""
    if snapshot is None:
        return spark.createDataFrame([(False, 0, 0, [])], "exists boolean, file_count long, total_size long, modes array<string>")
    return snapshot.agg(F.lit(True).alias("exists"), F.count("*").alias("file_count"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"), F.array_sort(F.collect_set("mode")).alias("modes"))


def merged(old: DataFrame, new: DataFrame, keys: Iterable[str]) -> DataFrame:
    """old with the rows of new in place of those with their keys: an upsert for tables without one."""
    keys = list(keys)
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)
