"""Packing evidence into a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pack(df: DataFrame, group: str, order: list[str], cost: str, budget: int, payload: list[str]) -> DataFrame:
    """The rows that a greedy walk takes: one that does not fit is skipped and the walk goes on.

    Returns group, payload, used (the budget spent with the row). A fold over the sorted rows of a group
    in the JVM. The budget bounds what is taken, not what is read.
    """
    rows = df.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in (cost, *payload) if c not in order]))).alias("rows"))
    item = rows.schema["rows"].dataType.elementType
    kept = f"array<struct<row:{item.simpleString()},used:bigint>>"
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(kept).alias("kept"))

    def step(acc: Column, r: Column) -> Column:
        total = acc["used"] + r[cost]
        fits = total <= budget
        return F.struct(F.when(fits, total).otherwise(acc["used"]).alias("used"), F.when(fits, F.array_append(acc["kept"], F.struct(r.alias("row"), total.alias("used")))).otherwise(acc["kept"]).alias("kept"))

    taken = rows.select(group, F.explode(F.aggregate("rows", start, step)["kept"]).alias("k"))
    return taken.select(group, *(F.col(f"k.row.{c}").alias(c) for c in payload), F.col("k.used").alias("used"))


def neighbours(rows: DataFrame, hits: DataFrame, group: str, pos: str, radius: int) -> DataFrame:
    """rows within radius of a hit of their group, with priority = distance to the nearest hit. Each hit asks for 2 radius + 1 places."""
    asked = hits.select(group, F.col(pos).alias("__hit"), F.explode(F.sequence(F.col(pos) - radius, F.col(pos) + radius)).alias(pos))
    best = asked.groupBy(group, pos).agg(F.min(F.abs(F.col(pos) - F.col("__hit"))).cast("long").alias("priority"))
    return rows.join(best, [group, pos])
