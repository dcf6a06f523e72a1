"""What git tells of changes, as DataFrames. Git itself runs on the driver."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def git_lines(root: str, *arguments: str) -> list[str]:
    """The lines of a git command's output; none if it fails."""
    try:
        done = subprocess.run(["git", *arguments], cwd=root, capture_output=True, check=True)
    except (OSError, subprocess.CalledProcessError):
        return []
    return done.stdout.decode(errors="replace").splitlines()


def _numbered(spark: SparkSession, lines: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(lines)), "ord long, line string")


def changed_paths(lines: DataFrame) -> DataFrame:
    """(file_path, ord) of name-only lines (ord, line); blank ones drop out."""
    return lines.select(F.translate(F.trim("line"), "\\", "/").alias("file_path"), "ord").filter("file_path <> ''")


def numstat(lines: DataFrame) -> DataFrame:
    """(file_path, added, deleted) of numstat lines; binary files have 0, other shapes drop out, and
    of two lines for a file the last counts."""
    parts = F.split("line", "\t", -1)
    number = lambda i: F.coalesce(F.get(parts, F.lit(i)).try_cast("long"), F.lit(0).cast("long"))
    rows = lines.filter(F.size(parts) == 3).select(F.translate(F.trim(F.get(parts, F.lit(2))), "\\", "/").alias("file_path"), F.struct("ord", number(0).alias("added"), number(1).alias("deleted")).alias("_n"))
    return rows.groupBy("file_path").agg(F.max("_n").alias("_n")).select("file_path", "_n.added", "_n.deleted")


def changes(spark: SparkSession, root: str, base: str = "HEAD") -> tuple[DataFrame, DataFrame]:
    """(changes, diff lines) of a working tree against a base: (file_path, added, deleted), files
    without line counts having 0, and (ord, line)."""
    names = changed_paths(_numbered(spark, git_lines(root, "diff", "--name-only", base)))
    counts = numstat(_numbered(spark, git_lines(root, "diff", "--numstat", base)))
    diff = _numbered(spark, git_lines(root, "diff", "--unified=0", base))
    return names.select("file_path").distinct().join(counts, "file_path", "left").fillna(0, ["added", "deleted"]), diff
