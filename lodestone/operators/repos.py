"""Many repositories: repo_alias is one more key of the same operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .traverse import impact_radius


def upsert(registry: DataFrame, entry: DataFrame) -> DataFrame:
    """The registry with the entries in place of those with their aliases."""
    return registry.join(entry.select("alias"), "alias", "left_anti").unionByName(entry)


def remove(registry: DataFrame, alias: str) -> DataFrame:
    """The registry without an alias, which must be there."""
    if not registry.filter(F.col("alias") == alias).take(1):
        raise KeyError(alias)
    return registry.filter(F.col("alias") != alias)


def with_counts(registry: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The registry with current numbers of nodes and edges."""
    count = lambda df, name: df.groupBy(F.col("repo_alias").alias("alias")).agg(F.count("*").alias(name))
    out = registry.drop("node_count", "edge_count").join(count(nodes, "node_count"), "alias", "left").join(count(edges, "edge_count"), "alias", "left")
    return out.fillna(0, ["node_count", "edge_count"])


def cross_repo_impact(edges: DataFrame, changed: DataFrame, max_depth: int = 2, aliases: tuple[str, ...] = ()) -> DataFrame:
    """(repo_alias, file_path): the impact radius of (repo_alias, file_path) within each repository."""
    if aliases:
        edges, changed = (df.filter(F.col("repo_alias").isin(*aliases)) for df in (edges, changed))
    return impact_radius(edges, changed, max_depth, ("repo_alias",))
