"""Stored postings of character trigrams, for queries by part of a name.

A term is a string that a query may ask for part of: a node's name or qualified name, an edge's
source or target. Postings name the terms that hold a trigram; nodes and edges are stored by their
terms as well. A LIKE pattern's literal stretches give trigrams that its matches must hold: postings
of the rarest few are read and intersected, what is left is compared with the pattern, and nodes and
edges of those terms are read. Patterns without a stretch of three characters compare all terms.
Case is ignored for A-Z, as it is by LIKE.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.cluster import durable
from lodestone.functions.columns import ascii_lower, like
from lodestone.sources.buckets import BucketStore, Table

from .query import PATTERNS, clamp, target_name
from .search import lexical_score

TABLES = {"terms": Table("term", "term"), "postings": Table("gram", "term"), "grams": Table("gram", "gram"), "nodes": Table("term", "file_path"), "ends": Table("term", "file_path")}
GRAM = 3
#: Trigrams of a pattern whose postings are intersected at most, the rarest; all matches hold them,
#: and the pattern itself is compared after that.
MOST_GRAMS = 4


def grams_of(term: Column) -> Column:
    """The different trigrams of a term; none of a shorter one."""
    folded = ascii_lower(term)
    places = F.sequence(F.lit(1), F.char_length(folded) - (GRAM - 1))
    return F.when(F.char_length(folded) >= GRAM, F.array_distinct(F.transform(places, lambda i: F.substring(folded, i, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))


def grams_of_pattern(pattern: str) -> list[str]:
    """The trigrams that all matches of a LIKE pattern hold."""
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in pattern)
    return sorted({s[i : i + GRAM] for s in re.split("[%_]", folded) for i in range(len(s) - GRAM + 1)})


class GramIndex:
    """What a store at a place holds; see build() and load()."""

    def __init__(self, store: BucketStore):
        self.store = store
        #: Trigrams whose postings the last query read; none if it compared all terms.
        self.grams_read: list[str] = []

    @classmethod
    def load(cls, spark: SparkSession, at: str) -> GramIndex | None:
        store = BucketStore(spark, at, TABLES)
        return cls(store) if store.exists else None

    @property
    def of(self) -> str | None:
        return self.store.manifest["meta"]["of"]

    @classmethod
    def build(cls, nodes: DataFrame, edges: DataFrame, at: str, of: str | None = None) -> GramIndex:
        """Stores the index of a graph; `of` says which."""
        nodes = durable(nodes.select("kind", "name", "qualified_name", "file_path"))
        edges = durable(edges.select("kind", "source", "target", "file_path"))
        named = nodes.select(F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias("term"), *nodes.columns)
        ends = edges.select(F.explode(F.array(*(F.struct(F.lit(e).alias("end"), F.col(e).alias("term")) for e in ("source", "target")))).alias("e"), *edges.columns)
        ends = ends.select("e.term", "e.end", *edges.columns).filter("term IS NOT NULL")
        terms = durable(named.select("term").union(ends.select("term")).filter("term IS NOT NULL").distinct())
        postings = durable(terms.select(F.explode(grams_of(F.col("term"))).alias("gram"), "term"))
        store = BucketStore(nodes.sparkSession, at, TABLES)
        store.replace({"terms": terms, "postings": postings, "grams": postings.groupBy("gram").agg(F.count("*").alias("n")), "nodes": named.filter("term IS NOT NULL"), "ends": ends}, {"of": of})
        return cls(store)

    def terms_like(self, pattern: str) -> DataFrame:
        """(term) that a LIKE pattern matches."""
        spark, wanted = self.store.spark, grams_of_pattern(pattern)
        keys = lambda grams: spark.createDataFrame([(g,) for g in grams], "gram string")
        self.grams_read = []
        if not wanted:
            return self.store.read("terms").filter(like("term", pattern))
        known = {r.gram: r.n for r in self.store.rows("grams", keys(wanted)).collect()}  # as many as the pattern has
        if len(known) < len(wanted):
            return self.store.read("terms", [])
        self.grams_read = sorted(wanted, key=lambda g: (known[g], g))[:MOST_GRAMS]
        held = self.store.rows("postings", keys(self.grams_read)).groupBy("term").agg(F.count("*").alias("n"))
        return held.filter((F.col("n") == len(self.grams_read)) & like("term", pattern)).select("term")

    def query_graph(self, pattern: str, target: str, limit: int = 50) -> DataFrame:
        """query.query_graph() for the patterns that go by edges, reading only edges that match."""
        kinds, ends = PATTERNS.get(pattern.strip(), PATTERNS["related"])
        found = self.store.rows("ends", durable(self.terms_like(f"%{target}%"))).filter(F.col("end").isin(*ends))
        if kinds:
            found = found.filter(F.col("kind").isin(*kinds))
        near = lambda end: F.coalesce((F.col(end) == target_name(target)) | like(end, f"%{target}%"), F.lit(False))
        if len(ends) == 2:  # an edge that both ends find is one
            found = found.filter((F.col("end") == ends[0]) | ~near(ends[0]))
        return found.select("source", "target", "kind", "file_path").orderBy("source", "target", "kind", "file_path").limit(clamp(limit, 1, 500))

    def lexical_search(self, query: str, kind: str | None = None, limit: int = 20) -> DataFrame:
        """search.lexical_search(), reading only nodes that match."""
        found = self.store.rows("nodes", durable(self.terms_like(f"%{query.strip()}%")))
        if kind is not None:
            found = found.filter(F.col("kind") == kind)
        # a node that both of its names find has both rows
        first = found.select("kind", "qualified_name", "file_path", "name").distinct().orderBy("kind", "qualified_name").limit(limit)
        return first.select("qualified_name", "kind", "file_path", lexical_score("name", query).alias("score")).orderBy(F.desc("score"), "kind", "qualified_name")
