"""Structural queries over nodes and edges. Every limit has a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.columns import in_test_path, like, lines_of

from .traverse import impact_radius

#: Edge patterns: the kinds of edge, all if empty, and the ends that the target may match.
PATTERNS = {
    "imports_of": (("imports_from",), ("source",)),
    "importers_of": (("imports_from",), ("target",)),
    "callees_of": (("calls",), ("source",)),
    "callers_of": (("calls",), ("target",)),
    "container_of": (("contains",), ("source",)),
    "depends_on": (("imports_from", "calls"), ("source",)),
    "inheritance_of": (("inherits",), ("source", "target")),
    "implemented_by": (("implements",), ("target",)),
    "related": ((), ("source", "target")),
}


def clamp(value: int, low: int, high: int) -> int:
    return min(max(value, low), high)


def target_name(target: str) -> str:
    """What a target is compared with; a bare name gets a prefix that never equals a node."""
    return target if "::" in target else f"%::{target}"


def query_graph(nodes: DataFrame, edges: DataFrame, pattern: str, target: str, limit: int = 50) -> DataFrame:
    """(source, target, kind, file_path) for a pattern, by source, target, kind and path; unknown
    patterns are `related`. The target's % and _ are wildcards, its case is ignored for A-Z. `limit`
    is clamped to 1 to 500."""
    pattern = pattern.strip()
    if pattern == "tests_for":
        found = nodes.filter((F.col("kind") == "function") & in_test_path("file_path") & like("name", f"%{target}%"))
        rows = found.select(F.col("qualified_name").alias("source"), F.lit(target_name(target)).alias("target"), F.lit("tests_for").alias("kind"), "file_path")
    else:
        kinds, ends = PATTERNS.get(pattern, PATTERNS["related"])

        def near(end: str) -> Column:
            return (F.col(end) == target_name(target)) | like(end, f"%{target}%")

        found = edges.filter(F.col("kind").isin(*kinds)) if kinds else edges
        rows = found.filter(near(ends[0]) if len(ends) == 1 else near(ends[0]) | near(ends[1])).select("source", "target", "kind", "file_path")
    return rows.orderBy("source", "target", "kind", "file_path").limit(clamp(limit, 1, 500))


def large_symbols(nodes: DataFrame, min_lines: int = 50, kind: str | None = None, path: str | None = None, limit: int = 50) -> DataFrame:
    """Symbols of min_lines or more, longest first, then by name."""
    lines = F.when(F.col("line_end") >= F.col("line_start"), F.col("line_end") - F.col("line_start") + 1).otherwise(F.lit(0))
    found = nodes.filter(F.col("kind") != "file").withColumn("line_count", lines).filter(F.col("line_count") >= max(min_lines, 1))
    if kind is not None:
        found = found.filter(F.col("kind") == kind)
    if path is not None:
        found = found.filter(like("file_path", f"%{path}%"))
    return found.select("kind", "qualified_name", "file_path", "line_start", "line_end", "line_count").orderBy(F.desc("line_count"), "qualified_name").limit(clamp(limit, 1, 500))


def graph_status(nodes: DataFrame | None, edges: DataFrame | None, path: str | None = None, updated_at: str | None = None, spark: SparkSession | None = None) -> DataFrame:
    """One row: exists, node_count, edge_count, and with a path graph_path and updated_at. Without
    tables (then spark is needed) there is no graph."""
    if nodes is None or edges is None:
        counts = spark.createDataFrame([(False, 0, 0)], "exists boolean, node_count long, edge_count long")
    else:
        counts = nodes.agg(F.lit(True).alias("exists"), F.count("*").alias("node_count")).join(edges.agg(F.count("*").alias("edge_count")))
    told = [] if path is None else [F.lit(path).alias("graph_path"), F.lit(updated_at).cast("string").alias("updated_at")]
    return counts.select("exists", "node_count", "edge_count", *told)


def review_context(edges: DataFrame, files: DataFrame, changed: DataFrame, max_depth: int = 2, include_source: bool = True, max_lines: int = 80, most: int = 30) -> DataFrame:
    """(file_path, snippet) of the files in the impact radius: the first lines, 10 at least, of the
    first `most` files, by path, that have content; null snippets without include_source."""
    impacted = impact_radius(edges, changed, max_depth)
    if not include_source:
        return impacted.select("file_path", F.lit(None).cast("string").alias("snippet"))
    body = F.array_join(F.slice(lines_of("content"), 1, max(max_lines, 10)), "\n")
    found = impacted.join(files.select(F.translate("path", "\\", "/").alias("file_path"), "content"), "file_path").filter("content IS NOT NULL")
    return found.select("file_path", F.concat(F.lit("### "), "file_path", F.lit("\n"), body).alias("snippet")).orderBy("file_path").limit(most)
