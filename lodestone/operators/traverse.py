"""Breadth-first searches over edges, for many starting points at once.

Each hop is one join of the frontier with the edges, a distinct and an anti-join with what was
visited, cut by a checkpoint: the plan doesn't grow, and nothing goes through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.cluster import durable
from lodestone.functions.columns import file_of


def bfs(seeds: DataFrame, edges: DataFrame, depth: int, keys: tuple[str, ...] = (), edge_keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, node, depth) of what is reached from (keys, node) seeds in `depth` hops at most.

    edges has source and target; edge_keys, among the keys, are those that edges have as well.
    """
    seen = durable(seeds.select(*keys, "node").distinct().withColumn("depth", F.lit(0)))
    frontier, parts = seen, [seen]
    along = edges.select(*edge_keys, F.col("source").alias("node"), F.col("target").alias("_next"))
    for hop in range(1, depth + 1):
        reached = frontier.join(along, [*edge_keys, "node"]).select(*keys, F.col("_next").alias("node")).distinct()
        visited = parts[0]
        for p in parts[1:]:
            visited = visited.union(p)
        frontier = durable(reached.join(visited.select(*keys, "node"), [*keys, "node"], "left_anti").withColumn("depth", F.lit(hop)))
        if not frontier.take(1):
            break
        parts.append(frontier)
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def both_ways(edges: DataFrame, *keys: str) -> DataFrame:
    forth = edges.select(*keys, "source", "target")
    return forth.union(edges.select(*keys, F.col("target").alias("source"), F.col("source").alias("target"))).distinct()


def impact_radius(edges: DataFrame, changed: DataFrame, max_depth: int = 2, keys: tuple[str, ...] = (), contains: bool = False) -> DataFrame:
    """(keys, file_path) of all files within max_depth (1 to 10) of the changed ones, which are
    among them, known or not.

    Undirected, over imports and calls. As calls join symbols and the search starts at files, calls
    only matter with `contains`, which adds the hop between a file and its symbols.
    """
    kinds = ("imports_from", "calls", "contains") if contains else ("imports_from", "calls")
    around = both_ways(edges.filter(F.col("kind").isin(*kinds)), *keys)
    seeds = changed.select(*keys, F.concat(F.lit("file::"), F.translate("file_path", "\\", "/")).alias("node"))
    found = bfs(seeds, around, min(max(max_depth, 1), 10), keys, keys)
    return found.select(*keys, file_of("node").alias("file_path")).filter("file_path IS NOT NULL").distinct()


def reverse_import_impact(imports: DataFrame, changed: DataFrame, max_depth: int = 3) -> DataFrame:
    """(file_path, depth): files that import the changed ones, directly or not, and the least number
    of steps; changed ones have 0. imports has source and target paths. A depth of 0 or less is 1."""
    back = imports.select(F.col("target").alias("source"), F.col("source").alias("target"))
    return bfs(changed.select(F.col("file_path").alias("node")), back, max(max_depth, 1)).select(F.col("node").alias("file_path"), "depth")
