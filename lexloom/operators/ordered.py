"""Ordered operators that never gather a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 8192  # positions in a block; only block totals are ever ordered across blocks


def running_total(df: DataFrame, part: list[str], order: list[str], value: str, out: str, block: int = BLOCK) -> DataFrame:
    """``df`` with the inclusive running sum of ``value`` in ``out``, by ``order`` within ``part``.

    The first column of ``order`` must be an integer position. Rows are summed inside blocks of positions, and the
    few block totals are carried forward, so one huge group spreads over many tasks. Null positions sort first, as one
    block; null values count as 0.
    """
    blocked = df.withColumn("_block", F.floor(F.col(order[0]) / F.lit(block)))
    inside = Window.partitionBy(*part, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = blocked.groupBy(*part, "_block").agg(F.sum(value).alias("_total"))
    ahead = Window.partitionBy(*part).orderBy(F.col("_block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*part, "_block", F.coalesce(F.sum("_total").over(ahead), F.lit(0)).alias("_carried"))
    same: Column = F.lit(True)
    left, right = blocked.alias("l"), carried.alias("r")
    for c in [*part, "_block"]:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    joined = left.join(right, same, "left").select("l.*", F.col("r._carried"))
    return joined.withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)) + F.coalesce("_carried", F.lit(0))).drop("_block", "_carried")
