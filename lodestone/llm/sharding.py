"""Sharding by a hierarchical weighted hash tree.

A tree has regions, racks and shards. Each leaf has a weight, each inner node the sum of its
leaves'. A row starts at the root and at each level draws -ln(u) / weight for every child, u being
a hash of its key and the child's name in (0, 1]; it descends to the child with the least draw. As
each child's draw depends on the row and that child alone, a child whose weight grows only gains
rows and one whose weight shrinks only loses them; rows move nowhere but into or out of subtrees
whose weight changes.

Only the key column decides, so a plan is a projection: no shuffle, no state, the same shard on
every rerun. Everything is DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Bits of a hash that cut a shard's rows into the pieces that are numbered apart.
PIECE_BITS = 12


@dataclass(frozen=True)
class HashTree:
    """regions[r][k] lists the (shard, weight) leaves of rack k in region r.

    Names of nodes are their positions, so that a tree that gains a region keeps all others' names.
    """

    regions: tuple[tuple[tuple[tuple[int, float], ...], ...], ...]

    @classmethod
    def regular(cls, shards: int, racks: int = 4, per_rack: int = 2) -> HashTree:
        """Shards of weight 1 in full regions of racks x per_rack; what is left over forms a
        last region, its racks filled in turn."""
        if min(shards, racks, per_rack) < 1:
            raise ValueError("a tree has at least one shard, rack and shard of a rack")
        leaves = [(s, 1.0) for s in range(shards)]
        rack_list = [tuple(leaves[i : i + per_rack]) for i in range(0, shards, per_rack)]
        return cls(tuple(tuple(rack_list[i : i + racks]) for i in range(0, len(rack_list), racks)))

    def grown(self, weight: float = 1.0) -> HashTree:
        """With one more shard, in a region of its own: no other subtree's weight changes, so
        rows only move into the new shard."""
        shard = 1 + max(s for region in self.regions for rack in region for s, _ in rack)
        return HashTree((*self.regions, (((shard, weight),),)))

    def reweighted(self, shard: int, weight: float) -> HashTree:
        """With another weight for one shard."""
        return HashTree(tuple(tuple(tuple((s, weight if s == shard else w) for s, w in rack) for rack in region) for region in self.regions))


def _nested(values: object) -> Column:
    """Nested tuples of numbers as nested array literals."""
    return F.array(*map(_nested, values)) if isinstance(values, tuple) else F.lit(values)


def _draws(key: Column, level: str, path: list[Column], weights: Column) -> Column:
    """The draws -ln(u) / weight of a node's children; the first of the least is taken.

    u comes from 52 bits of a hash of the key and the child's name; a child without weight draws
    infinity.
    """

    def draw(weight: Column, i: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(level), *path, i, key), 12)
        u = (bits + F.lit(1.0)) / F.lit(float(2**52))
        return F.when(weight > 0, -F.ln(u) / F.when(weight > 0, weight)).otherwise(F.lit(float("inf")))

    return F.transform(weights, draw)


def with_shard(df: DataFrame, key: Column, tree: HashTree, shard: str) -> DataFrame:
    """The rows with the shard that the key descends to, level by level: as many draws as the
    nodes on the way have children, however many leaves there are."""
    leaf = lambda i: tuple(tuple(tuple(x[i] for x in rack) for rack in region) for region in tree.regions)
    shards, per_shard = leaf(0), leaf(1)
    per_rack = tuple(tuple(float(sum(rack)) for rack in region) for region in per_shard)
    per_region = tuple(sum(region) for region in per_rack)
    if not sum(per_region) > 0:
        raise ValueError("no leaf has a weight above 0")
    region, rack = F.col("_region"), F.col("_rack")
    least = (F.array_position("_draws", F.array_min("_draws")) - 1).cast("int")
    out = df.withColumn("_draws", _draws(key, "region", [], _nested(per_region))).withColumn("_region", least)
    out = out.withColumn("_draws", _draws(key, "rack", [region], F.get(_nested(per_rack), region))).withColumn("_rack", least)
    out = out.withColumn("_draws", _draws(key, "shard", [region, rack], F.get(F.get(_nested(per_shard), region), rack)))
    found = F.get(F.get(F.get(_nested(shards), region), rack), least)
    return out.withColumn(shard, found.cast("int")).drop("_draws", "_region", "_rack")


def assign_shards(df: DataFrame, key: str, tree: HashTree, shard: str = "shard") -> DataFrame:
    """The rows with the shard that each row's key decides.

    A null key counts as one key of its own, repeated keys go together, and a column that already
    has the name is replaced. An empty table stays empty.
    """
    return with_shard(df, F.col(key), tree, shard)


def number_slots(df: DataFrame, key: str, shard: str = "shard", slot: str = "slot", order: list[str] | None = None) -> DataFrame:
    """The rows with a number within their shard: gapless from 0.

    Each shard's rows are dealt to 2 ** PIECE_BITS pieces by a hash of the key; a piece's rows follow
    the smaller pieces' by the count of theirs, so no task has to sort a shard. The counts are
    made from the key and shard columns alone. Rows with one key lie in one piece in the order of
    the given columns; equal rows take any order among themselves.
    """
    spread = [*df.columns]
    pieces = df.withColumn("_piece", F.shiftrightunsigned(F.xxhash64(F.lit("slot"), F.col(key)), 64 - PIECE_BITS))
    counts = pieces.groupBy(shard, "_piece").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(shard, "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(shard, "_piece").orderBy(key, *(order or []))
    numbered = pieces.withColumn("_inside", F.row_number().over(inside) - 1).join(starts, [shard, "_piece"])
    return numbered.select(*[c for c in spread if c != slot], (F.col("_start") + F.col("_inside")).cast("long").alias(slot))


def op5_hash_tree_shards(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23 by the law `key`, and their shard once there is one more.

    Texts are read once, for their size and checksum, and go through no shuffle; a null text has
    size 8 and the checksum of the empty text.
    """
    tree = HashTree.regular(24)
    text = common.text_or_empty("text")
    docs = common.table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    placed = assign_shards(assign_shards(docs, "doc_id", tree), "doc_id", tree.grown(), "grown_shard")
    return number_slots(placed, "doc_id", order=["text_crc32", "size"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
