"""Stored lines with postings of their words, for previews of renames and queries for a symbol.

A word is a maximal run of letters, digits and underscores; lines are stored in buckets by file, apart
from contents, and postings name the buckets that hold a word, as a bucket is what is read at once. A
symbol's words all stand on any line that holds it, so their postings are read and intersected, those
buckets of lines are read, and the symbol itself is compared. A symbol without any word compares all
lines. Case counts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.cluster import durable
from lodestone.functions.columns import posix, word_pattern
from lodestone.sources.buckets import BucketStore, Change, Table

from .text import preview_of, symbol_of, totals_of

TABLES = {"lines": Table("file_path", "file_path"), "places": Table("word", "place")}
WORD = r"[\p{L}\p{N}_]+"


def _lines(files: DataFrame) -> DataFrame:
    """(file_path, line, text) of lines that aren't empty."""
    split = files.filter("content <> ''").select(posix("path").alias("file_path"), F.posexplode(F.split("content", "\n")).alias("at", "text"))
    return split.filter("text <> ''").select("file_path", (F.col("at") + 1).cast("long").alias("line"), "text")


def _postings(lines: DataFrame, place: Column) -> DataFrame:
    """(word, place): the buckets of lines that hold a word."""
    words = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    return lines.select(words.alias("word"), place.alias("place")).distinct()


def words_of(symbol: str) -> list[str]:
    return sorted({w for w in re.split(r"[^\w]+", symbol) if w})


class WordIndex:
    """What a store at a place holds; see build() and load()."""

    def __init__(self, store: BucketStore):
        self.store = store

    @classmethod
    def load(cls, spark: SparkSession, at: str) -> WordIndex | None:
        store = BucketStore(spark, at, TABLES)
        return cls(store) if store.exists and store.manifest["tables"].keys() == TABLES.keys() else None

    @classmethod
    def build(cls, files: DataFrame, at: str) -> WordIndex:
        """Stores the index of files (path, content), paths being unique; null contents have no lines."""
        store = BucketStore(files.sparkSession, at, TABLES)
        # lines are about as large as the files, so postings read them from the store
        store.replace({"lines": _lines(files), "places": lambda written, n: _postings(written["lines"], store.bucket(F.col("file_path"), n))})
        return cls(store)

    def updated(self, files: DataFrame, gone: DataFrame) -> WordIndex:
        """With files (path, content) new or in place of those of their paths, and without those of gone
        (file_path); buckets of files, and of words that come into those buckets or leave them, are written."""
        lines = durable(_lines(files))
        owners = durable(files.select(posix("path").alias("file_path")).union(gone.select("file_path")).distinct())
        touched = self.store.buckets_of(owners)
        held, place = self.store.read("lines", touched), self.store.bucket(F.col("file_path"))
        old = durable(_postings(held, place))
        new = durable(_postings(held.join(owners, "file_path", "left_anti").unionByName(lines), place))
        words = new.exceptAll(old).union(old.exceptAll(new)).select("word").distinct()
        places = self.store.spark.createDataFrame([(b,) for b in touched], "place int")
        self.store.apply({"lines": Change(owners, lines, owners), "places": Change(places, new, durable(words))})
        return WordIndex(self.store)

    def symbol_lines(self, symbol: str) -> DataFrame:
        """(file_path, line, _line) of the lines that hold a symbol as a word, no content being read."""
        wanted = words_of(symbol)
        if not wanted:
            lines = self.store.read("lines")
        else:
            keys = self.store.spark.createDataFrame([(w,) for w in wanted], "word string")
            places = self.store.rows("places", keys).groupBy("place").agg(F.count("*").alias("n")).filter(F.col("n") == len(wanted))
            # at most as many as there are buckets
            lines = self.store.read("lines", [r.place for r in places.collect()])
        return lines.filter(F.col("text").rlike(word_pattern(symbol))).select("file_path", "line", F.col("text").alias("_line"))

    def refactor_preview(self, symbol: str, limit: int = 100) -> DataFrame:
        return preview_of(self.symbol_lines(symbol), limit)

    def refactor_totals(self, symbol: str, limit: int = 100) -> DataFrame:
        return totals_of(self.symbol_lines(symbol), limit)

    def query_symbol(self, symbol: str) -> tuple[DataFrame, DataFrame]:
        return symbol_of(self.symbol_lines(symbol), symbol)
