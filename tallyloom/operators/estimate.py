"""Effort estimates and their calibration from past records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.joins import salted_join
from ..functions.text import contains_any, first_match, half_up, matches, strip
from ..rules import effort as R
from ..session import materialise


# Distinct ratios of a type that one task ranks.
RANKED = 1 << 16


def _entity(low: Column, content: Column, name: str) -> Column:
    """Whether an entry of the entity list applies."""
    _, _, need, without = next(e for e in R.ENTITIES if e[0] == name)
    if need == "table":
        found = matches(content, R.TABLE_WORD)
    else:
        found = contains_any(low, need[0])
        for words in need[1:]:
            found = found & contains_any(low, words)
    if isinstance(without, str):
        return found & ~_entity(low, content, without)
    return found & ~contains_any(low, without) if without else found


def features(df: DataFrame, content: str = "content") -> DataFrame:
    """Add ``feature_score``, ``iteration`` and ``features`` (names) per task."""
    low, text = F.lower(content), F.col(content)
    hits = [(n, s, _entity(low, text, n)) for n, s, _, _ in R.ENTITIES]
    hits += [(n, s, contains_any(low, words)) for n, s, words in R.SPECIALS]
    found = F.filter(
        F.array(*[F.when(c, F.struct(F.lit(n).alias("name"), F.lit(s).alias("score"))) for n, s, c in hits]),
        lambda h: h.isNotNull(),
    )
    df = df.withColumn("_hits", found)
    iteration = first_match([(contains_any(low, words), F.lit(f)) for f, words in R.ITERATION], F.lit(1.0))
    return df.withColumns(
        {
            "feature_score": F.aggregate("_hits", F.lit(0.0), lambda t, h: t + h["score"]),
            "features": F.transform("_hits", lambda h: h["name"]),
            "iteration": iteration,
        }
    ).drop("_hits")


def _medians(ratios: DataFrame, buckets: int) -> DataFrame:
    """``task_type`` and exact ``median_ratio``. ``ratios``: task_type, ratio (distinct), n.

    A type with up to ``RANKED`` distinct ratios is ranked. The range of a larger one is cut into ``buckets``
    parts, by logarithm first and evenly then, and only the bucket that holds the wanted rank goes on.
    Buckets follow the order of the ratios whatever is lost in rounding, so the ranks stay exact.
    """
    total = ratios.groupBy("task_type").agg(
        F.sum("n").alias("_records"), F.count("*").alias("rows"), F.min("ratio").alias("lo"), F.max("ratio").alias("hi")
    )
    wanted = F.array_distinct(F.array(F.floor((F.col("_records") - 1) / 2), F.floor(F.col("_records") / 2)))
    spec = total.select("task_type", "rows", "lo", "hi", F.posexplode(wanted).alias("target", "rank"))
    rows, keys, scale = ratios, ["task_type"], lambda c: F.signum(c) * F.log1p(F.abs(c))
    while (spec.agg(F.max("rows")).first()[0] or 0) > RANKED:
        met = salted_join(rows, spec.drop("rows"), keys, "ratio", "inner")
        width = scale(F.col("hi")) - scale(F.col("lo"))
        share = F.when(width > 0, (scale(F.col("ratio")) - scale(F.col("lo"))) / width).otherwise(0.0)
        met = materialise(met.withColumn("bucket", F.floor(share * buckets)), "calibration_rows")
        keys = ["task_type", "target"]
        counts = met.groupBy(*keys, "bucket").agg(
            F.first("rank").alias("rank"), F.sum("n").alias("n"), F.count("*").alias("rows"), F.min("ratio").alias("lo"), F.max("ratio").alias("hi")
        )
        sums = W.partitionBy(*keys).orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
        counts = counts.withColumn("rank", F.col("rank") - F.sum("n").over(sums) + F.col("n"))
        spec = materialise(counts.filter((F.col("rank") >= 0) & (F.col("rank") < F.col("n"))).drop("n"), "calibration_buckets")
        rows = salted_join(met.drop("rank", "lo", "hi"), spec.select(*keys, "bucket"), [*keys, "bucket"], "ratio", "inner").drop("bucket")
        spec, scale = spec.drop("bucket"), lambda c: c
    inside = W.partitionBy(*keys).orderBy("ratio").rowsBetween(W.unboundedPreceding, -1)
    ranked = rows.withColumn("_start", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    ranked = ranked.join(spec.drop("rows", "lo", "hi"), keys)
    hit = ranked.filter((F.col("_start") <= F.col("rank")) & (F.col("_start") + F.col("n") > F.col("rank")))
    middle = hit.groupBy("task_type").agg(F.max("ratio").alias("_up"), F.min("ratio").alias("_low"))
    return middle.select("task_type", ((F.col("_low") + F.col("_up")) / 2).alias("median_ratio"))


def calibration_factors(records: DataFrame, precision: int = 4) -> DataFrame:
    """Records, median of actual/predicted, smallest and largest ratio per type.

    The median is exact and no type is gathered, see ``_medians``; equal ratios are counted first. A round
    of the search tells ``10 ** precision`` buckets apart.
    """
    ratios = (
        records.filter((F.col("predicted_days") > 0) & F.col("actual_days").isNotNull())
        .select(
            F.coalesce("task_type", F.lit("功能任务")).alias("task_type"),
            (F.col("actual_days") / F.col("predicted_days")).alias("ratio"),
        )
        .groupBy("task_type", "ratio")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ratios = materialise(ratios, "calibration_ratios")
    found = ratios.groupBy("task_type").agg(
        F.sum("n").alias("records"), F.min("ratio").alias("min_ratio"), F.max("ratio").alias("max_ratio")
    )
    found = found.join(_medians(ratios, 10**precision), "task_type")
    enough = F.col("records") >= R.MIN_RECORDS
    return found.select(
        "task_type",
        "records",
        F.when(enough, half_up("median_ratio", 2)).otherwise(F.lit(1.0)).alias("factor"),
        "min_ratio",
        "max_ratio",
    )


def precision_of(records: Column) -> Column:
    return first_match([(records >= n, F.lit(p)) for n, p in R.PRECISION[:-1]], F.lit(R.PRECISION[-1][1]))


def calibration_stats(records: DataFrame) -> DataFrame:
    """Factor, precision, ratio range and direction per type."""
    f = calibration_factors(records)
    off = F.abs(half_up((F.lit(1) - F.col("factor")) * 100, 0)).cast("int").cast("string")
    direction = F.when(F.col("factor") < 1.0, "too high by ").otherwise("too low by ")
    note = F.when(F.col("records") >= R.MIN_RECORDS, F.concat(direction, off, F.lit("%"))).otherwise("too few records")
    return f.select(
        "task_type",
        "records",
        "factor",
        precision_of(F.col("records")).alias("precision"),
        half_up("min_ratio", 2).alias("min_ratio"),
        half_up("max_ratio", 2).alias("max_ratio"),
        note.alias("note"),
    )


def estimate_days(tasks: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """Add recommended ``days``; the factor of the task's type applies when records are given."""
    df = features(tasks)
    if records is not None:
        factors = calibration_factors(records).select("task_type", "factor", "records")
        df = salted_join(df, factors, ["task_type"], "content")
        factor = F.coalesce("factor", F.lit(1.0))
    else:
        df = df.withColumn("records", F.lit(0).cast("long"))
        factor = F.lit(1.0)
    fallback = first_match([(F.col("task_type") == t, F.lit(d)) for t, d in R.FALLBACK.items()], F.lit(R.FALLBACK_DEFAULT))
    base = F.when(F.col("feature_score") > 0, F.col("feature_score")).otherwise(fallback)
    days = half_up(F.greatest(F.lit(R.SMALLEST), base * F.col("iteration") * factor), 1)
    keep = [c for c in tasks.columns]
    return df.select(
        *keep,
        "features",
        "iteration",
        factor.alias("factor"),
        F.coalesce("records", F.lit(0).cast("long")).alias("records"),
        days.alias("days"),
    )


def estimate_ranges(estimated: DataFrame) -> DataFrame:
    """Add lower and upper days at the precision of the records, and a flag for tasks to split."""
    p = precision_of(F.col("records"))
    return estimated.withColumns(
        {
            "lower_days": half_up(F.col("days") * (F.lit(1.0) - p), 1),
            "upper_days": half_up(F.col("days") * (F.lit(1.0) + p), 1),
            "split_advised": F.col("days") > R.LARGEST,
        }
    )


def ingest_records(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """New calibration records: text present, actual days positive, (content, actual) not known yet.

    Actual days are kept to one place; a record is compared in that form, so the
    same file can be read twice.
    """
    df = incoming.withColumns(
        {"task_content": strip("task_content"), "actual_days": half_up("actual_days", 1)}
    )
    df = df.filter((F.col("task_content") != "") & (F.col("actual_days") > 0))
    df = df.withColumns(
        {
            "task_type": F.coalesce("task_type", F.lit("功能任务")),
            "module": F.coalesce("module", F.lit("")),
            "predicted_days": F.coalesce("predicted_days", F.lit(1.0)),
        }
    )
    once = df.groupBy("task_content", "actual_days").agg(
        F.min_by(F.struct("task_type", "module", "predicted_days", "recorded_at"), F.struct("recorded_at", "predicted_days", "task_type", "module")).alias("r")
    )
    fresh = once.join(existing.select("task_content", "actual_days"), ["task_content", "actual_days"], "left_anti")
    return fresh.select("task_content", "r.task_type", "r.module", "r.predicted_days", "actual_days", "r.recorded_at")


def rollup_days(estimated: DataFrame) -> DataFrame:
    """Tasks and days per module, per project and in total."""
    base = estimated.groupBy("project", "module").agg(F.count(F.lit(1)).alias("_n"), F.sum("days").alias("_d"))
    return base.rollup("project", "module").agg(
        F.sum("_n").alias("tasks"), half_up(F.sum("_d"), 1).alias("days"), F.grouping_id().cast("int").alias("level")
    )
