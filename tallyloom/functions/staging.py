"""Evaluate costly expressions once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def staged(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add ``columns`` so that later filters and projections refer to their values.

    A filter on an ordinary derived column is pushed below it and carries a copy
    of its expression, and of everything that one is built from. The columns
    pass through a one-row generator here, which no filter crosses.
    """
    one = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    out = df.select("*", F.explode_outer(one).alias("_stage"))
    return out.select(*df.columns, *[F.col(f"_stage.{n}").alias(n) for n in columns])
