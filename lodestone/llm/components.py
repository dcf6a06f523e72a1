"""Connected components of a graph given as links, by alternating stars.

Large star: every node passes the least node it knows to its larger neighbours. Small star: every
node passes it to its smaller ones. Both only use minima per node and joins on a node, so no task
holds a node's neighbours and no driver holds a component. When nothing changes, each node links
to the least node of its component. Each round is cut by a checkpoint in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

#: Rounds after which something must be wrong: the number grows with the logarithm of the longest path.
MOST_ROUNDS = 100


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return moved.union(least.select("u", F.col("m").alias("v")))


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node that has a link to another; component is the least node.

    links has two columns of one orderable type, the ends of undirected links; repeated links,
    links of a node to itself and null ends are ignored. No links give an empty frame.
    """
    u, v = links.columns[:2]
    now = links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter("u <> v").distinct()
    now = durable(now)
    state = _state(now)
    for _ in range(MOST_ROUNDS):
        if not state[0]:
            break
        now = durable(_small_star(_large_star(now).distinct()).distinct())
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v")).distinct())
