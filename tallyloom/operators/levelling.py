"""Weekly load levelling of planned tasks.

Tasks of a project and role fill the weeks in order. Without dependencies the
position of a task is a running sum of effort, so the filling is a closed form
over a chunked running sum and never a loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ordered
from ..functions.text import contains_any, first_match, half_up
from ..rules import effort as R


def weekly_capacity(people: Column, availability: Column) -> Column:
    """Working days per week."""
    return people * F.lit(5) * availability / F.lit(100.0)


def with_effort(tasks: DataFrame) -> DataFrame:
    """Add ``effort`` days (words, plus half a day per dependency) and ``role``."""
    low = F.lower("description")
    days = first_match([(contains_any(low, words), F.lit(d)) for d, words in R.PLAN_EFFORT], F.lit(R.PLAN_DEFAULT))
    links = F.coalesce(F.size("dependencies"), F.lit(0))
    role = F.when(contains_any(low, R.TEST_WORDS), "test").otherwise("backend")
    return tasks.withColumns({"effort": days + F.greatest(links, F.lit(0)) * F.lit(R.PLAN_PER_DEPENDENCY), "role": role})


def _capacity(backend: float, test: float) -> Column:
    return F.when(F.col("role") == "test", F.lit(float(test))).otherwise(F.lit(float(backend)))


def _place(df: DataFrame) -> DataFrame:
    """Start and end offset in days of every task inside its project and role."""
    df = ordered.running_sum(df, ["project", "role"], "seq", {"_end": F.col("effort")})
    return df.withColumn("_start", F.col("_end") - F.col("effort"))


def _weeks(df: DataFrame, capacity: Column) -> DataFrame:
    """One row per task and week; a role without capacity keeps one row with a NULL week."""
    df = df.withColumn("_cap", capacity)
    first = F.floor(F.col("_start") / F.col("_cap"))
    last = F.greatest(first, F.ceil(F.col("_end") / F.col("_cap")) - 1)
    weeks = F.when(F.col("_cap") > 0, F.sequence(F.when(F.col("_cap") > 0, first), F.when(F.col("_cap") > 0, last)))
    df = df.withColumn("_week", F.explode_outer(weeks))
    share = F.least((F.col("_week") + 1) * F.col("_cap"), F.col("_end")) - F.greatest(
        F.col("_week") * F.col("_cap"), F.col("_start")
    )
    return df.withColumns({"week": (F.col("_week") + 1).cast("long"), "week_effort": share})


def level_weeks(tasks: DataFrame, backend: float = 15.0, test: float = 5.0) -> DataFrame:
    """Rows (task, week, effort) when tasks fill the weeks in order, dependencies aside.

    ``tasks``: project, seq, description, dependencies.
    """
    df = _weeks(_place(with_effort(tasks)), _capacity(backend, test))
    return df.select("project", "seq", "role", "effort", "week", "week_effort")


def weekly_load(levelled: DataFrame, start: str, backend: float = 15.0, test: float = 5.0) -> DataFrame:
    """Load and load rate per project and week, with the project's length and end date."""
    cap_b, cap_t = F.lit(float(backend)), F.lit(float(test))
    by_week = levelled.filter(F.col("week").isNotNull()).groupBy("project", "week").agg(
        F.sum(F.when(F.col("role") == "backend", F.col("week_effort")).otherwise(0.0)).alias("backend_load"),
        F.sum(F.when(F.col("role") == "test", F.col("week_effort")).otherwise(0.0)).alias("test_load"),
        F.countDistinct("seq").alias("tasks"),
    )
    total = levelled.groupBy("project").agg(F.max("week").alias("total_weeks"))
    rate = F.least(
        F.when(cap_b > 0, F.col("backend_load") / cap_b), F.when(cap_t > 0, F.col("test_load") / cap_t).otherwise(0.0)
    )
    return by_week.join(total, "project").select(
        "project",
        "week",
        half_up("backend_load", 1).alias("backend_load"),
        half_up("test_load", 1).alias("test_load"),
        "tasks",
        half_up(F.when(cap_b > 0, rate) * 100, 1).alias("load_rate"),
        "total_weeks",
        F.date_add(F.lit(start).cast("date"), (F.col("total_weeks") * 7).cast("int")).alias("end_date"),
    )


def staffing_scenarios(tasks: DataFrame, staffing=R.STAFFING) -> DataFrame:
    """Length of every project under each staffing; offsets are computed once for all of them."""
    totals = with_effort(tasks).groupBy("project", "role").agg(F.sum("effort").alias("_days"), F.count(F.lit(1)).alias("_n"))
    cases = F.array(
        *[
            F.struct(F.lit(n).alias("scenario"), F.lit(float(b * 5)).alias("backend"), F.lit(float(t * 5)).alias("test"))
            for n, b, t in staffing
        ]
    )
    df = totals.withColumn("c", F.explode(cases))
    capacity = F.when(F.col("role") == "test", F.col("c.test")).otherwise(F.col("c.backend"))
    df = df.withColumn("_weeks", F.ceil(F.col("_days") / capacity))
    return df.groupBy("project", F.col("c.scenario").alias("scenario")).agg(
        F.max("_weeks").cast("long").alias("weeks"),
        F.sum("_n").alias("tasks"),
        F.sum("_days").alias("effort"),
    )
