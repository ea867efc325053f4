"""Roll-ups of test runs and expectations on tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import half_up

PASS, FAIL, SKIP, ERROR = "pass", "fail", "skip", "error"


def _counts() -> list:
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == PASS).alias("passed"),
        F.count_if(F.col("status").isin(FAIL, ERROR)).alias("failed"),
        F.count_if(F.col("status") == SKIP).alias("skipped"),
        half_up(F.coalesce(F.sum("duration"), F.lit(0.0)), 2).alias("duration"),
    ]


def run_summary(runs: DataFrame, *by: str) -> DataFrame:
    """Counts, duration and pass rate in percent (0 for no runs), overall or per group."""
    df = runs.groupBy(*by).agg(*_counts())
    rate = F.when(F.col("total") > 0, half_up(F.col("passed") / F.col("total") * 100, 1)).otherwise(0.0)
    return df.withColumn("pass_rate", rate)


def runs_by_type(runs: DataFrame) -> DataFrame:
    """Results per test type."""
    return run_summary(runs, "type")


def regression(runs: DataFrame) -> DataFrame:
    """Per project: regression passes when every result of an old feature passed."""
    old = F.col("cohort") == "old"
    return runs.groupBy("project").agg(
        F.coalesce(F.bool_and(F.when(old, F.col("status") == PASS)), F.lit(True)).alias("regression_passed"),
        F.count_if(old).alias("old_results"),
        F.count_if(~old).alias("new_results"),
    )


def expectations(tables: Mapping[str, DataFrame], checks: Sequence[tuple[str, str, int | None]]) -> DataFrame:
    """Pass or fail per ``(table, check, bound)``: ``required``, ``min_rows`` or ``columns``.

    Row counts are aggregates of the tables; nothing is collected.
    """
    if not tables:
        raise ValueError("no tables given")
    spark = next(iter(tables.values())).sparkSession
    known = set(tables)
    counts = None
    for name in {t for t, check, _ in checks if check == "min_rows" and t in known}:
        one = tables[name].agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        counts = one if counts is None else counts.unionByName(one)
    listed = [(t, c, b, t in known, len(tables[t].columns) if t in known else None) for t, c, b in checks]
    df = spark.createDataFrame(listed, "table_name string, check string, bound bigint, present boolean, width bigint")
    if counts is None:
        df = df.withColumn("rows", F.lit(None).cast("long"))
    else:
        df = df.join(counts, "table_name", "left")
    actual = (
        F.when(F.col("check") == "required", F.col("present").cast("long"))
        .when(F.col("check") == "min_rows", F.coalesce("rows", F.lit(0)))
        .when(F.col("check") == "columns", F.col("width"))
    )
    passed = (
        F.when(F.col("check") == "required", F.col("present"))
        .when(F.col("check") == "min_rows", F.coalesce(F.col("rows") >= F.col("bound"), F.lit(False)))
        .when(F.col("check") == "columns", F.coalesce(F.col("width") == F.col("bound"), F.lit(False)))
    )
    return df.select("table_name", "check", "bound", actual.cast("long").alias("actual"), passed.alias("passed"))
