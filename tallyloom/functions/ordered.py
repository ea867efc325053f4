"""Ordered per-group computations that split hot groups.

A plain window puts a whole group into one task. Here a group is cut into
chunks by a function of its ordering column (rows ``0 .. size-1``, ``size ..
2*size-1`` and so on), the window runs per (group, chunk), and one small
summary row per chunk carries state between chunks. A group of any size is thus
spread over ``rows / size`` tasks, and only the summaries meet in one place.

The ordering column must be an integer that is unique inside its group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

CHUNK = 1 << 16
_CHUNK = "_chunk"


def _split(df: DataFrame, keys: Sequence[str], order: str, size: int) -> DataFrame:
    """Add the place (group, chunk) that windows and joins are dealt out by, so rows move once.

    Group and chunk are one struct: structs with equal null fields are equal, so
    groups with null keys need no null-safe join, which would not fit the window's
    partitioning.
    """
    chunk = F.floor(F.col(order) / F.lit(size)).cast("long")
    place = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], chunk.alias("chunk"))
    return df.withColumn(_CHUNK, place)


def _across(keys: Sequence[str]) -> WindowSpec:
    """Window over the chunks of a group, in order."""
    return W.partitionBy(*[F.col(f"{_CHUNK}.k{i}") for i in range(len(keys))]).orderBy(f"{_CHUNK}.chunk")


def _attach(df: DataFrame, carried: DataFrame) -> DataFrame:
    """Join chunk state back; ``df`` already lies by (group, chunk)."""
    return df.join(carried, _CHUNK, "left")


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    values: dict[str, Column],
    *,
    inclusive: bool = True,
    size: int = CHUNK,
) -> DataFrame:
    """Add ``name -> running sum`` columns, without (``inclusive=False``) or with the row itself."""
    df = _split(df, keys, order, size)
    for name, value in values.items():
        df = df.withColumn(f"_v_{name}", value)
    totals = df.groupBy(_CHUNK).agg(
        *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values]
    )
    across = _across(keys).rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(
        _CHUNK, *[F.sum(f"_t_{n}").over(across).alias(f"_c_{n}") for n in values]
    )
    last = W.currentRow if inclusive else -1
    inside = W.partitionBy(_CHUNK).orderBy(order).rowsBetween(W.unboundedPreceding, last)
    df = df.select("*", *[F.sum(f"_v_{n}").over(inside).alias(f"_s_{n}") for n in values])
    df = _attach(df, carried)
    for name in values:
        both = F.coalesce(F.col(f"_s_{name}"), F.lit(0)) + F.coalesce(F.col(f"_c_{name}"), F.lit(0))
        df = df.withColumn(name, both)
    drop = [_CHUNK] + [f"{p}{n}" for n in values for p in ("_v_", "_s_", "_c_")]
    return df.drop(*drop)


def row_numbers(
    df: DataFrame, keys: Sequence[str], order: str, name: str = "rn", *, size: int = CHUNK
) -> DataFrame:
    """Dense position from 1 inside each group."""
    return running_sum(df, keys, order, {name: F.lit(1).cast("long")}, size=size)


def carry_forward(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    values: dict[str, Column],
    *,
    inclusive: bool = True,
    size: int = CHUNK,
) -> DataFrame:
    """Add ``name -> latest non-null value`` at or before the row."""
    df = _split(df, keys, order, size)
    for name, value in values.items():
        df = df.withColumn(f"_v_{name}", value)
    ends = df.groupBy(_CHUNK).agg(
        *[
            F.max_by(F.col(f"_v_{n}"), F.when(F.col(f"_v_{n}").isNotNull(), F.col(order))).alias(f"_t_{n}")
            for n in values
        ]
    )
    across = _across(keys).rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(
        _CHUNK,
        *[F.last(f"_t_{n}", ignorenulls=True).over(across).alias(f"_c_{n}") for n in values],
    )
    last = W.currentRow if inclusive else -1
    inside = W.partitionBy(_CHUNK).orderBy(order).rowsBetween(W.unboundedPreceding, last)
    df = df.select(
        "*",
        *[F.last(f"_v_{n}", ignorenulls=True).over(inside).alias(f"_s_{n}") for n in values],
    )
    df = _attach(df, carried)
    for name in values:
        df = df.withColumn(name, F.coalesce(F.col(f"_s_{name}"), F.col(f"_c_{name}")))
    drop = [_CHUNK] + [f"{p}{n}" for n in values for p in ("_v_", "_s_", "_c_")]
    return df.drop(*drop)


def first_since(
    df: DataFrame, keys: Sequence[str], order: str, reset: Column, value: Column, name: str, *, size: int = CHUNK
) -> DataFrame:
    """Add ``name``: the first non-null ``value`` after the latest row with ``reset``, at or before the row.

    ``reset`` must not be null. A chunk carries whether it has a reset and the first
    value after its last one, or the first of all when it has none.
    """
    df = _split(df, keys, order, size).withColumn("_reset", reset.cast("int")).withColumn("_value", value)
    inside = W.partitionBy(_CHUNK).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    df = df.withColumn("_span", F.sum("_reset").over(inside))
    within = W.partitionBy(_CHUNK, "_span").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    df = df.withColumn("_own", F.first("_value", ignorenulls=True).over(within))
    ends = df.groupBy(_CHUNK).agg(
        F.max("_span").alias("_resets"), F.max_by("_own", order).alias("_last")
    )
    across = _across(keys)
    upto = across.rowsBetween(W.unboundedPreceding, W.currentRow)
    ends = ends.withColumn("_span", F.sum("_resets").over(upto))
    same = W.partitionBy(*[F.col(f"{_CHUNK}.k{i}") for i in range(len(keys))], "_span").orderBy(f"{_CHUNK}.chunk")
    ends = ends.withColumn("_after", F.first("_last", ignorenulls=True).over(same.rowsBetween(W.unboundedPreceding, W.currentRow)))
    carried = ends.select(_CHUNK, F.lag("_after").over(across).alias("_before"))
    df = _attach(df, carried)
    before = F.when(F.col("_span") == 0, F.col("_before"))
    df = df.withColumn(name, F.coalesce(before, "_own"))
    return df.drop(_CHUNK, "_reset", "_value", "_span", "_own", "_before")


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    columns: Sequence[str],
    *,
    previous: str | None = "prev",
    following: str | None = "next",
    size: int = CHUNK,
) -> DataFrame:
    """Add structs holding ``columns`` of the row before and after (null at the ends)."""
    df = _split(df, keys, order, size).withColumn("_row", F.struct(*columns))
    ends = df.groupBy(_CHUNK).agg(
        F.max_by("_row", order).alias("_last"), F.min_by("_row", order).alias("_first")
    )
    across = _across(keys)
    inside = W.partitionBy(_CHUNK).orderBy(order)
    edge, local, drop = [], [], [_CHUNK, "_row"]
    if previous:
        edge.append(F.lag("_last").over(across).alias("_c_prev"))
        local.append(F.lag("_row").over(inside).alias("_s_prev"))
    if following:
        edge.append(F.lead("_first").over(across).alias("_c_next"))
        local.append(F.lead("_row").over(inside).alias("_s_next"))
    carried = ends.select(_CHUNK, *edge)
    df = _attach(df.select("*", *local), carried)
    if previous:
        df = df.withColumn(previous, F.coalesce("_s_prev", "_c_prev"))
        drop += ["_s_prev", "_c_prev"]
    if following:
        df = df.withColumn(following, F.coalesce("_s_next", "_c_next"))
        drop += ["_s_next", "_c_next"]
    return df.drop(*drop)


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """The first ``k`` rows of each group.

    Spark limits each map task's groups to ``k`` rows before the shuffle, so a
    hot group sends at most ``k`` rows per map task.
    """
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per group, the smallest in ``order``."""
    return first_rows(df, keys, order, 1)
