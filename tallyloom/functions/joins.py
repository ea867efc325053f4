"""Joins of a large table with a small one on few, hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 32


def salted_join(df: DataFrame, small: DataFrame, keys: Sequence[str], spread: Column | str, how: str = "left") -> DataFrame:
    """Join on ``keys`` with every key cut into ``SALTS`` parts by the hash of ``spread``.

    A key that holds a large share of ``df`` is thus met by many tasks; the rows
    of ``small`` are repeated once per part. Spark may still broadcast ``small``
    when it finds it small enough at run time.
    """
    salt = F.pmod(F.xxhash64(spread), F.lit(SALTS))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return df.withColumn("_salt", salt).join(right, [*keys, "_salt"], how).drop("_salt")
