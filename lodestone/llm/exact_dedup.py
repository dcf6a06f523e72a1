"""Exact duplicates: rows grouped by a 128-bit hash of their content, bytes compared inside groups.

A text's content is what is left without ASCII white space. The hash only deals rows out: texts of
one hash are compared byte by byte by an aggregation whose key holds the content itself, which every
task does for its own rows before anything is shuffled, so a group of copies arrives as one text a
task. Contents of one hash that differ are numbered, and the pair (hash, number) names a group.

After that only ids, lengths and hashes move. The row that stays is a minimum, made map-side first.
Rows meet their group's result in a join; groups of so many rows that there can be only a few of
them are known to every task, and both sides of those are dealt out over SALTS parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Groups with more than one in HOT of all rows are salted: there are fewer than HOT of them.
HOT = 1000
SALTS = 64

# ASCII white space, which doesn't count.
SPACE = " \t\n\x0b\x0c\r"


def content_of(text: str | Column) -> Column:
    """A text without ASCII white space; null counts as empty."""
    return F.translate(common.text_or_empty(text), SPACE, "")


def content_hash(content: Column) -> Column:
    """128 bits."""
    return F.unhex(F.md5(content))


def _numbered(contents: DataFrame) -> DataFrame | None:
    """(hash, content, twin) of contents (hash, content) whose hash stands for several, twin counting
    them from 0; None if no hash does."""
    # the content is part of the key, so this compares bytes
    shared = common.durable(contents.distinct().groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash"))
    if not shared.take(1):
        return None
    again = contents.join(shared, "hash", "left_semi").distinct()
    # a content's number is how many of its hash are smaller; hashes stand for two contents if at all
    other = again.select("hash", F.col("content").alias("other"))
    return again.join(other, "hash").groupBy("hash", "content").agg(F.count_if(F.col("other") < F.col("content")).cast("int").alias("twin"))


def _prints(docs: DataFrame, text: str, key: str, hashed: Callable[[Column], Column]) -> DataFrame:
    """(key, hash, twin, sha256, length, look, row) for every row, kept in the shared folder; look
    tells texts of one content apart, row is a number of the row."""
    content = content_of(text)
    # the content is cut out once and then hashed
    rows = docs.select(F.col(key).alias("key"), common.text_or_empty(text).alias("text")).withColumn("content", content)
    rows = rows.select("key", "text", "content", hashed(F.col("content")).alias("hash"))
    twins = _numbered(rows.select("hash", "content"))
    if twins is None:
        rows = rows.withColumn("twin", F.lit(0))
    else:
        rows = rows.join(twins, ["hash", "content"], "left").withColumn("twin", F.coalesce("twin", F.lit(0)))
    return common.durable(rows.select("key", "hash", "twin", F.sha2("content", 256).alias("sha256"), F.char_length("text").cast("long").alias("length"), F.xxhash64("text").alias("look"), F.monotonically_increasing_id().alias("row")))


def _groups(prints: DataFrame) -> DataFrame:
    """(hash, twin, group_size, best) for each group; best is the row that stays."""
    best = F.min(F.struct((-F.col("length")).alias("shorter"), F.col("key").isNull().alias("nameless"), "key", "look", "row"))
    return common.durable(prints.groupBy("hash", "twin").agg(F.count("*").alias("group_size"), best.alias("best")))


def exact_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256) for every row.

    Texts are equal when they are identical without ASCII white space (tab to carriage return, and
    space); other white space counts. Of equal texts the row with the most code points stays, then
    the one with the least key; rows without a key come after those with one. keep_id is the key of
    the row that stays, null if it has none. Null texts count as empty, and all texts of white space
    alone are equal. Of rows alike in key and length, the one with the least hash of its text stays,
    and of rows alike in that too any one: exactly one row of a group is kept. Repeated rows count
    in group_size. Other columns are dropped, so their names can't clash. No rows give none.

    hashed: the hash of a content; results are the same for any.
    """
    prints = _prints(docs, text, key, hashed)
    groups = _groups(prints)
    most = prints.count() // HOT
    hot = groups.filter(F.col("group_size") > most + 1).select("hash", "twin", F.lit(True).alias("hot"))
    on = ["hash", "twin"]
    deal = F.when(F.col("hot"), F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).otherwise(0)
    rows = prints.join(F.broadcast(hot), on, "left").withColumn("salt", deal)
    salts = F.when(F.col("group_size") > most + 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    met = rows.join(groups.withColumn("salt", F.explode(salts)), [*on, "salt"])
    return met.select(F.col("key").alias(key), F.col("best.key").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), F.col("sha256").alias("text_sha256"))


def drop_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """The documents, of equal texts only the row that exact_duplicates keeps, with all columns.

    Rows alike in key and text but not in other columns: the one with the least hash of them stays.
    """
    columns = docs.columns
    look = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()])
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("doc"), F.col(key).alias("key"), common.text_or_empty(text).alias("text"), look.alias("other")).withColumn("content", content_of("text"))
    rows = rows.withColumn("hash", hashed(F.col("content")))
    twins = _numbered(rows.select("hash", "content"))
    rows = rows.withColumn("twin", F.lit(0)) if twins is None else rows.join(twins, ["hash", "content"], "left").withColumn("twin", F.coalesce("twin", F.lit(0)))
    place = F.struct((-F.char_length("text")).alias("shorter"), F.col("key").isNull().alias("nameless"), "key", F.xxhash64("text").alias("look"), "other")
    placed = rows.select("doc", "hash", "twin", place.alias("place"))
    best = placed.groupBy("hash", "twin").agg(F.min("place").alias("place"))
    # what stays has a name of its own; rows that share it are alike, so one of them is enough
    names = lambda df: df.withColumn("name", F.xxhash64("hash", "twin", "place.shorter", "place.key", "place.look", "place.other"))
    chosen = names(best).select("name", "hash", "twin")
    kept = names(placed).join(chosen, ["name", "hash", "twin"], "left_semi").dropDuplicates(["name", "hash", "twin"])
    return kept.select("doc.*")


def op11_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """The group of every document and the one of it that stays."""
    return exact_duplicates(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


#: op11_exact_dedup in DuckDB SQL.
OP11_SQL = """
WITH told AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS content FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY content) AS group_size, row_number() OVER w = 1 AS kept, sha256(content) AS text_sha256
FROM told WINDOW w AS (PARTITION BY content ORDER BY length(text) DESC, doc_id NULLS LAST)
"""
