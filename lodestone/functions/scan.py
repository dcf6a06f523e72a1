"""Running values over a whole order without one task that sees all rows.

Rows are dealt into ranges of the order, each range says in one value what it hands on, those values
(a row for each range) are run through on the driver, and each range then goes on from its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .cluster import durable

RANGE = "_range"


def in_ranges(rows: DataFrame, *order: str) -> DataFrame:
    """The rows with the number of their range of the order, kept in the shared folder so that numbers
    stay what they are."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return durable(rows.repartitionByRange(parts, *order).withColumn(RANGE, F.spark_partition_id()))


def within_range(*order: str) -> WindowSpec:
    return Window.partitionBy(RANGE).orderBy(*order)


def carried(ranged: DataFrame, handed_on: Column, start: object, go_on: Callable[[object, object], object], kind: str) -> tuple[Column, dict[int, object]]:
    """What reaches each row's range from those before it, as a column of a type and by range.

    handed_on aggregates a range to one value; go_on(what came in, that value) is what goes out.
    """
    told = {r[0]: r[1] for r in ranged.groupBy(RANGE).agg(handed_on).collect()}
    reaches, now = {}, start
    for number in sorted(told):
        reaches[number], now = now, go_on(now, told[number])
    pairs = [F.lit(x) for number, value in reaches.items() for x in (number, value)]
    column = F.element_at(F.create_map(*pairs), F.col(RANGE)) if pairs else F.lit(start)
    return column.cast(kind), reaches
