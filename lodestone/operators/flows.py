"""Execution flows: what entry functions reach over calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.columns import like, path_of_symbol

from .query import clamp
from .traverse import bfs

HINTS = ("main", "handler", "route", "page")
MOST_FLOWS, STORED_DEPTH, DETAIL_DEPTH = 300, 4, 5


def flow_entries(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(entry, name, hinted): functions that nothing calls, and those whose name hints at an entry."""
    functions = nodes.filter("kind = 'function'").select(F.col("qualified_name").alias("entry"), "name")
    hint: Column = F.lit(False)
    for h in HINTS:
        hint = hint | F.lower("name").contains(h)
    called = edges.filter("kind = 'calls'").select(F.col("target").alias("entry")).distinct()
    marked = functions.join(called.withColumn("_called", F.lit(True)), "entry", "left")
    # those without callers come before the others
    return marked.filter(F.col("_called").isNull() | hint).select("entry", "name", F.col("_called").isNotNull().alias("hinted")).dropDuplicates(["entry"])


def _traced(entries: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    calls = edges.filter("kind = 'calls'").select("source", "target").distinct()
    return bfs(entries.select("entry", F.col("entry").alias("node")), calls, depth, ("entry",))


def flows(nodes: DataFrame, edges: DataFrame, most: int = MOST_FLOWS) -> tuple[DataFrame, DataFrame]:
    """(flows, memberships) of the first entries. Flow ids count the entries in order: those without
    callers first, then the hinted, each by name."""
    chosen = flow_entries(nodes, edges).orderBy("hinted", "entry").limit(most)
    chosen = chosen.withColumn("id", F.row_number().over(Window.orderBy("hinted", "entry")).cast("long"))
    reached = _traced(chosen, edges, STORED_DEPTH).withColumn("file_path", path_of_symbol("node"))
    counted = reached.groupBy("entry").agg(F.countDistinct("file_path").alias("file_count"), F.count("*").alias("node_count"))
    listed = chosen.join(counted, "entry").select("id", F.concat(F.lit("flow:"), "name").alias("name"), "entry", "file_count", "node_count", (F.col("node_count") + 1.5 * F.col("file_count")).alias("criticality"))
    members = reached.filter("file_path IS NOT NULL").select("entry", "file_path").distinct().join(chosen.select("entry", "id"), "entry")
    return listed, members.select(F.col("id").alias("flow_id"), "file_path")


def list_flows(listed: DataFrame, limit: int = 50) -> DataFrame:
    return listed.orderBy(F.desc("criticality"), F.desc("node_count"), "id").limit(clamp(limit, 1, 200))


def flow_detail(listed: DataFrame, edges: DataFrame, name: str | None = None, id: int | None = None) -> DataFrame:
    """One flow by id, or the most critical whose name contains `name`, with its nodes and files
    traced a step further than it was stored with."""
    chosen = listed.filter(F.col("id") == id) if id is not None else listed.filter(like("name", f"%{name}%"))
    chosen = chosen.orderBy(F.desc("criticality"), "id").limit(1)
    reached = _traced(chosen, edges, DETAIL_DEPTH)
    lists = reached.groupBy("entry").agg(F.array_sort(F.collect_set("node")).alias("nodes"), F.array_sort(F.collect_set(path_of_symbol("node"))).alias("files"))
    return chosen.join(lists, "entry").select("id", "name", "entry", "file_count", "node_count", "criticality", "nodes", "files")


def affected_flows(listed: DataFrame, members: DataFrame, changed: DataFrame, limit: int = 50) -> DataFrame:
    """Flows through changed files, (file_path, ord): taken file by file in order, the more critical
    first, until there are `limit`; then by criticality, in the order taken."""
    hits = members.join(changed, "file_path").join(listed, members["flow_id"] == listed["id"])
    place = F.min(F.struct("ord", (-F.col("criticality")).alias("c"), (-F.col("node_count")).alias("n"), "id")).alias("_place")
    first = hits.groupBy("id").agg(place)
    taken = first.join(listed, "id").orderBy("_place").limit(clamp(limit, 1, 200))
    return taken.orderBy(F.desc("criticality"), "_place").drop("_place")
