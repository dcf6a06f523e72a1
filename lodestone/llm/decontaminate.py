"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the benchmark's windows of WINDOW consecutive words; an item of fewer words is one
window. Patterns of one length m form a matcher: a shift table says for each block of words how far
the window may move before a pattern could end on it, so that a block of no pattern moves it by
m - BLOCK + 1 words at once; where the shift is 0, the block's bucket holds the patterns that end
with it, and comparing whole windows confirms an occurrence.

The benchmark is cut into parts of PART_WORDS words. Each part is broadcast on its own, so what
executors hold is bounded however large the benchmark is, and is matched against all documents.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 13
#: Words of a block, the unit of the shift tables. Shorter patterns are one block.
BLOCK = 2
#: Words of benchmark items that are matched in one go: an item more at most.
PART_WORDS = 2_000_000
#: The least share of a document's words that are hit for it to be contaminated: 1 in so many.
SHARE = 20

#: Windows are hashed as polynomials of their word ids by this factor, modulo 2^64.
_FACTOR, _ALL = 0x9E3779B97F4A7C15, (1 << 64) - 1

#: A-Z to a-z; whatever isn't in a word to a space. Words are runs of 0-9, a-z and non-ASCII.
_FOLD = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class WuManber:
    """Windows of one length over word ids, in flat arrays: some 60 bytes for each window.

    A block is a number made of its word ids. `blocks` are the known ones in order, `shifts` says
    how far each lets the window move. Windows stand by the block they end with, so that those of
    block k are the bucket from `buckets[k]` to `buckets[k + 1]`, by hash within it.
    """

    def __init__(self, items: list[tuple[int, np.ndarray]], length: int, n_words: int):
        self.length, self.block, self.base = length, min(BLOCK, length), n_words + 1
        self.default = length - self.block + 1
        ids = np.concatenate([w for _, w in items])
        sizes = np.array([len(w) for _, w in items])
        # the place of each word in its item, and the words that end a block or a window there
        place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        code = ids.astype(np.uint64)
        for k in range(1, self.block):
            code[k:] += ids[:-k].astype(np.uint64) * np.uint64(self.base**k)
        ends = place >= self.block - 1
        # the latest that a window can end on a block: the item's first windows are at its front
        known, at = np.unique(code[ends], return_inverse=True)
        shifts = np.full(len(known), self.default)
        np.minimum.at(shifts, at, np.maximum(length - 1 - place[ends], 0))
        hashes = np.zeros(len(ids), np.uint64)
        for k in range(length - 1, -1, -1):
            hashes = hashes * np.uint64(_FACTOR) + np.concatenate([np.zeros(k, np.uint64), ids[: len(ids) - k].astype(np.uint64)])
        last = np.flatnonzero(place >= length - 1)
        bucket = np.searchsorted(known, code[last])
        order = np.lexsort((hashes[last], bucket))
        owner = np.repeat(np.array([n for n, _ in items]), sizes)[last][order]
        self.blocks, self.shifts = array("Q", known.tobytes()), array("i", shifts.astype(np.int32).tobytes())
        self.buckets = array("q", np.searchsorted(bucket[order], np.arange(len(known) + 1)).astype(np.int64).tobytes())
        self.hashes, self.owners = array("Q", hashes[last][order].tobytes()), array("q", owner.astype(np.int64).tobytes())
        self.starts, self.ids = array("q", (last[order] - length + 1).astype(np.int64).tobytes()), array("i", ids.astype(np.int32).tobytes())

    def occurrences(self, ids: list[int]) -> Iterator[tuple[int, set[int]]]:
        """(start, numbers of the items) of all occurrences in a text's word ids, 0 being a word of
        no item, by start."""
        m, b, base, blocks = self.length, self.block, self.base, self.blocks
        end, n = m, len(ids)
        while end <= n:
            code = 0
            for w in ids[end - b : end]:
                code = code * base + w
            at = bisect_left(blocks, code)
            move = self.shifts[at] if at < len(blocks) and blocks[at] == code else self.default
            if move:
                end += move
                continue
            window = array("i", ids[end - m : end])
            digest = 0
            for w in window:
                digest = (digest * _FACTOR + w) & _ALL
            last = self.buckets[at + 1]
            first = bisect_left(self.hashes, digest, self.buckets[at], last)
            found = set()
            while first < last and self.hashes[first] == digest:
                if self.ids[self.starts[first] : self.starts[first] + m] == window:
                    found.add(self.owners[first])
                first += 1
            if found:
                yield end - m, found
            end += 1


class Matcher:
    """The windows of a part of the benchmark, by length. Made once on the driver and sent as flat
    arrays; a worker keeps what it was sent."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int):
        self.words: dict[bytes, int] = {}
        self.names: list[str] = []
        by_length: dict[int, list] = defaultdict(list)
        for name, words in items:
            if words:
                ids = np.fromiter((self.words.setdefault(w, len(self.words) + 1) for w in words), np.int64, len(words))
                by_length[min(window, len(words))].append((len(self.names), ids))
                self.names.append(name)
        self.matchers = [WuManber(own, size, len(self.words)) for size, own in sorted(by_length.items())]

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """The hit stretches (start, end) and the names of the items that occur."""
        stretches, numbers = [], set()
        known = self.words.get
        ids = [known(w, 0) for w in words]
        for matcher in self.matchers:
            for start, found in matcher.occurrences(ids):
                end = start + matcher.length
                if stretches and stretches[-1][0] <= start <= stretches[-1][1]:
                    stretches[-1] = (stretches[-1][0], max(end, stretches[-1][1]))
                else:
                    stretches.append((start, end))
                numbers |= found
        return stretches, {self.names[i] for i in numbers}


def merged(stretches: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of stretches, disjoint and in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(stretches):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _parts(benchmark: DataFrame, item: str, text: str, part_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The benchmark in lists of (item, words); the driver holds one list and a task's rows."""
    part, size = [], 0
    for name, words in ((r[0], words_of(r[1])) for r in benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")), text).toLocalIterator()):
        part.append((name, words))
        size += len(words)
        if size >= part_words:
            yield part
            part, size = [], 0
    if part:
        yield part


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, part_words: int = PART_WORDS) -> DataFrame:
    """Every document with n_words, n_hit, stretches and items.

    stretches: the hit words as disjoint [start, end) word positions in order; n_hit: how many
    words those are; items: the names of the items that have an occurring window, as sorted strings.
    Null or wordless texts have no words, no hits. Null item names count as an empty name; equal
    names are one item; items without words have no window. Columns that have one of the added
    names are replaced. No row is moved: each document is matched where it is read.
    """
    made = ["n_words", "n_hit", "stretches", "items"]
    spark = docs.sparkSession
    columns = [c for c in docs.columns if c not in made]
    out = docs.select(*columns, F.lit(None).cast("array<struct<start:long,end:long>>").alias("stretches"), F.lit(None).cast("array<string>").alias("items"))
    many = False
    for part in _parts(benchmark, item, item_text, part_words) if window > 0 else []:
        if many:  # one part's tables in a task's memory at a time
            out = common.durable(out)
        out, many = _matched(spark, out, part, text, window), True
    if not many:
        out = _matched(spark, out, [], text, window)
    hit = F.aggregate("stretches", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select(*columns, "n_words", hit.alias("n_hit"), "stretches", "items")


def _matched(spark: SparkSession, out: DataFrame, part: list, text: str, window: int) -> DataFrame:
    """out with what the part adds to stretches and items, and with n_words."""
    common.ship(spark)
    # of PART_WORDS words and an item at most
    sent = spark.sparkContext.broadcast(Matcher(part, window))

    def match(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        matcher = sent.value
        for texts, stretches, items in batches:
            rows = []
            for t, before, names in zip(texts, stretches, items):
                words = words_of(t)
                found, occurring = matcher.match(words)
                before = [] if before is None else [(s["start"], s["end"]) for s in before]
                both = merged([*before, *found])
                rows.append((len(words), [{"start": s, "end": e} for s, e in both], sorted({*(() if names is None else names), *occurring})))
            yield pd.DataFrame(rows, columns=["n_words", "stretches", "items"])
        common.release_memory()

    kind = "n_words long, stretches array<struct<start:long,end:long>>, items array<string>"
    udf = F.pandas_udf(match, kind)
    others = [c for c in out.columns if c not in ("n_words", "stretches", "items")]
    return out.select(*others, udf(F.col(text), F.col("stretches"), F.col("items")).alias("_m")).select(*others, "_m.n_words", "_m.stretches", "_m.items")


def contaminated(n_words: str = "n_words", n_hit: str = "n_hit") -> Column:
    """At least one word is hit, and at least 1 in SHARE."""
    return (F.col(n_hit) > 0) & (SHARE * F.col(n_hit) >= F.col(n_words))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that aren't contaminated, with their own columns."""
    return contamination(docs.withColumns({f"_own_{c}": F.col(c) for c in docs.columns}), benchmark).filter(~contaminated()).select(*(F.col(f"_own_{c}").alias(c) for c in docs.columns))


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    """What each document shares with the benchmark."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"), contaminated().alias("contaminated"))


#: op2_decontamination in DuckDB SQL.
OP2_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w
  FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark
), p AS (
  SELECT DISTINCT item, least(13, len(w)) AS m, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s
  FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS u(i) WHERE len(w) > 0
), m AS (SELECT DISTINCT m FROM p),
dw AS (
  SELECT r, i, m.m, array_to_string(w[i:i + m.m - 1], ' ') AS s
  FROM d, m, unnest(range(1, len(w) - m.m + 2)) AS u(i)
), hits AS (
  SELECT r, i, p.m, item FROM dw JOIN p ON dw.m = p.m AND dw.s = p.s
), covered AS (
  SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT r, i, m FROM hits) h, unnest(range(i, i + m)) AS u(k) GROUP BY r
), named AS (
  SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hits GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""
