"""What the operators share: the shared folder, durable cuts, and word patterns."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.cluster import durable, fresh_dir, shared_dir, ship

__all__ = ["GAP", "TOKEN", "durable", "fresh_dir", "hex_bits", "release_memory", "remove_dir", "shared_dir", "ship", "table", "text_or_empty", "token_count"]

#: A run of anything but ASCII white space.
TOKEN = r"[^\x20\x09-\x0D]+"
#: ASCII white space between tokens.
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release_memory() -> None:
    """Gives what a Python worker has freed back to the system at the end of a task: workers outlive
    tasks, and several of them share an executor's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # only some C libraries have it
        trim(0)


def remove_dir(spark: SparkSession, path: str) -> None:
    """Remove a folder made by fresh_dir()."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def text_or_empty(text: str | Column) -> Column:
    """Null texts count as empty ones."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def token_count(text: str | Column) -> Column:
    """The number of tokens in a text; null has none."""
    return F.regexp_count(text_or_empty(text), F.lit(TOKEN)).cast("long")


def hex_bits(of: Column, at: int, n: int) -> Column:
    """n hexadecimal digits (15 at most) of a hex string from position at (1-based), as a long."""
    return F.conv(F.substring(of, at, n), 16, 10).cast("long")
