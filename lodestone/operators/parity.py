"""Which tool best fits each command, by the words of their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Words of tool names that don't count.
STOP_WORDS = ("or", "the", "and", "to", "of", "a", "an")


def best_matches(commands: DataFrame, tools: DataFrame) -> DataFrame:
    """(command, tool): for each command (command) the tool (tool, ord) that shares most words, at
    least half of the shorter name's; the first of equals; null for none.

    Commands meet the tools they share a word with, by a join on the word.
    """
    words = commands.select("command", F.array_distinct(F.filter(F.split("command", "-"), lambda w: w != "")).alias("_c"))
    other = tools.select("tool", "ord", F.array_distinct(F.filter(F.split("tool", "_"), lambda w: ~w.isin(*STOP_WORDS))).alias("_t"))
    met = words.withColumn("_w", F.explode("_c")).join(other.withColumn("_w", F.explode("_t")), "_w").groupBy("command", "tool", "ord").agg(F.count("*").alias("_n"), F.first(F.least(F.size("_c"), F.size("_t"))).alias("_least"))
    fitting = met.filter(F.col("_n") >= F.col("_least") * 0.5)
    best = fitting.withColumn("_r", F.row_number().over(Window.partitionBy("command").orderBy(F.desc("_n"), "ord"))).filter("_r = 1")
    return commands.join(best.select("command", "tool"), "command", "left").select("command", "tool")


def unmatched_tools(matches: DataFrame, tools: DataFrame) -> DataFrame:
    return tools.join(matches.filter("tool IS NOT NULL"), "tool", "left_anti").select("tool")
