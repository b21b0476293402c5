"""Numbers inside groups, given by many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.session import cut_lineage

#: Lower bits of an increasing id: the row's number in its partition.
ROW_BITS = 33


def numbered(rows: DataFrame, group: list[str], order: list[str], label: str = "numbered") -> DataFrame:
    """``rows`` with ``place``: 1, 2, 3 … inside each group, in the given order.

    The cuts are quantiles that Spark samples from (group, order), so a group with a
    third of all rows, whatever its keys look like, spreads over a third of the tasks.
    Each task numbers its own sorted rows; the few totals per (group, partition) give
    the rest. Null keys are a group. Rows that are equal in group and order are
    numbered in any order. The sorted rows are written once.
    """
    spread = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    held = cut_lineage(spread.withColumn("at", F.monotonically_increasing_id()), label)
    held = held.withColumn("part", F.shiftright("at", ROW_BITS)).withColumn("at", F.col("at").bitwiseAND(F.lit((1 << ROW_BITS) - 1)))
    totals = held.groupBy(*group, "part").agg(F.count("*").alias("n"), F.min("at").alias("low"))
    ahead = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select(*_named(group), F.col("part").alias("their_part"), (F.coalesce(F.sum("n").over(ahead), F.lit(0)) - F.col("low") + 1).alias("shift"))
    same: Column = F.col("part") == F.col("their_part")
    for name in group:
        same = same & F.col(name).eqNullSafe(F.col(f"their_{name}"))
    placed = held.join(shift, same).withColumn("place", (F.col("at") + F.col("shift")).cast("long"))
    return placed.select(*rows.columns, "place")


def _named(group: list[str]) -> list[Column]:
    return [F.col(name).alias(f"their_{name}") for name in group]
