"""Running sums over ordered groups of any size.

Rows are dealt out by ranges of (group, order), so a group that holds much of a table
lies in many partitions of like size. Windows run inside a partition and one row for
each (group, partition) carries the sums across. Rows that are equal in all order
columns are told apart by their place in the written input, so not even they gather.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.session import materialise


def lay(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """``df``, a written table, in ranges of group and order; ``_g`` is the group as a struct, which joins nulls too."""
    key = F.struct(F.lit(0).alias("_"), *[F.col(g) for g in group])
    df = df.withColumn("_row", F.monotonically_increasing_id()).withColumn("_g", key)
    spread = df.repartitionByRange(*[F.col(c) for c in (*group, *order, "_row")])
    return materialise(spread.withColumn("_part", F.spark_partition_id()), name)


def totals(laid: DataFrame, value: Column) -> DataFrame:
    """``_g`` and ``total`` of each group."""
    return laid.groupBy("_g").agg(F.sum(value).alias("total"))


def running(laid: DataFrame, order: Sequence[str], value: Column, groups: DataFrame | None = None) -> DataFrame:
    """``laid`` with ``before`` (the sum of ``value`` before the row), the group's ``total`` and columns of ``groups`` by ``_g``."""
    laid = laid.withColumn("_place", F.struct("_g", "_part")).withColumn("_value", value)
    across = W.partitionBy("_place._g").orderBy("_place._part")
    sums = laid.groupBy("_place").agg(F.sum("_value").alias("_sum"))
    carried = sums.select(
        "_place",
        F.coalesce(F.sum("_sum").over(across.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_carried"),
        F.sum("_sum").over(W.partitionBy("_place._g")).alias("total"),
    )
    if groups is not None:
        carried = carried.withColumn("_g", F.col("_place._g")).join(groups, "_g").drop("_g")
    inside = W.partitionBy("_place").orderBy(*order, "_row").rowsBetween(W.unboundedPreceding, -1)
    out = laid.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0))).join(carried, "_place")
    return out.withColumn("before", F.col("_carried") + F.col("_inside")).drop("_place", "_value", "_carried", "_inside", "_part", "_row")
