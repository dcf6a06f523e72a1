"""Communities of files by the first part of their paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.columns import file_of, like, page_name, top_segment

from .query import clamp

COUPLING_WARNING, SINGLETON_WARNING = 200, 80


def communities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, file_count, node_count, coupling): coupling counts imports into other communities, for
    the importing one."""
    counted = nodes.groupBy(top_segment("file_path").alias("name")).agg(F.countDistinct("file_path").alias("file_count"), F.count("*").alias("node_count"))
    ends = edges.filter("kind = 'imports_from'").select(top_segment(file_of("source")).alias("name"), top_segment(file_of("target")).alias("_to"))
    coupled = ends.filter("name <> _to").groupBy("name").agg(F.count("*").alias("coupling"))
    return counted.join(coupled, "name", "left").withColumn("coupling", F.coalesce("coupling", F.lit(0)))


def list_communities(nodes: DataFrame, edges: DataFrame, limit: int = 50) -> DataFrame:
    return communities(nodes, edges).orderBy(F.desc("node_count"), F.desc("file_count"), "name").limit(clamp(limit, 1, 200))


def community_detail(nodes: DataFrame, edges: DataFrame, name: str, members: bool = True) -> DataFrame:
    """The largest community whose name contains `name`, with its first 500 members by name."""
    chosen = communities(nodes, edges).filter(like("name", f"%{name}%")).orderBy(F.desc("node_count"), "name").limit(1)
    if not members:
        return chosen.withColumn("members", F.array().cast("array<string>"))
    inside = nodes.join(F.broadcast(chosen.select("name").withColumnRenamed("name", "_name")), (F.col("file_path") == F.col("_name")) | F.col("file_path").startswith(F.concat("_name", F.lit("/"))), "left_semi")
    first = inside.select("qualified_name").orderBy("qualified_name").limit(500).agg(F.array_sort(F.collect_list("qualified_name")).alias("members"))
    return chosen.join(first)


def architecture_warnings(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, warning) of the 50 largest communities; one row without a name if there is none."""
    listed = list_communities(nodes, edges, 50)
    both = F.array_compact(
        F.array(
            F.when(F.col("coupling") > COUPLING_WARNING, F.format_string("High coupling in %s (%d cross-community edges)", "name", "coupling")),
            F.when((F.col("file_count") == 1) & (F.col("node_count") > SINGLETON_WARNING), F.format_string("Large singleton community %s (%d nodes)", "name", "node_count")),
        )
    )
    warnings = listed.select("name", F.explode(both).alias("warning"))
    none = warnings.agg(F.count("*").alias("n")).filter("n = 0").select(F.lit(None).cast("string").alias("name"), F.lit("No major architecture warnings detected").alias("warning"))
    return warnings.union(none)


def wiki_top_files(nodes: DataFrame, edges: DataFrame, limit: int = 200, most: int = 20) -> DataFrame:
    """(name, file_path, symbols, rank): for each listed community the files with most nodes among
    those whose path begins with its name, other communities' included."""
    named = list_communities(nodes, edges, limit).select("name")
    per_file = nodes.groupBy("file_path").agg(F.count("*").alias("symbols"))
    # 200 names at most
    found = per_file.join(F.broadcast(named), F.lower("file_path").startswith(F.lower("name")))
    rank = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("symbols"), "file_path")).cast("long")
    return found.withColumn("rank", rank).filter(F.col("rank") <= most).select("name", "file_path", "symbols", "rank")


def wiki_pages(nodes: DataFrame, edges: DataFrame, limit: int = 200) -> DataFrame:
    """(page, body): a Markdown page for each community."""
    top = wiki_top_files(nodes, edges, limit).groupBy("name").agg(F.array_sort(F.collect_list(F.struct("rank", "file_path", "symbols"))).alias("top"))
    listed = F.array_join(F.transform("top", lambda t: F.concat(F.lit("- "), t["file_path"], F.lit(" ("), t["symbols"].cast("string"), F.lit(" symbols)"))), "\n")
    body = F.format_string("# %s\n\n- Files: %d\n- Nodes: %d\n- Coupling: %d\n\n## Top Files\n%s\n", "name", "file_count", "node_count", "coupling", F.coalesce(listed, F.lit("- (none)")))
    return list_communities(nodes, edges, limit).join(top, "name", "left").select(page_name("name").alias("page"), body.alias("body"))
