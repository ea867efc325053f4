"""Mixing sources to target weights along a curriculum.

Every source has a weight schedule over training time, from 0 to 1, linear between its
knots. Its integral is the source's share of the budget; a source gives at most
``MAX_EPOCHS`` times its words, and what it cannot give is shared out again by weight.
A source's words are laid out in a shuffled order of its documents, as often as its
target asks. The demand for a source at a time is its target times the part of the
integral up to there; inverting that curve says at which time a word comes up. Sorting
all documents by that time in ranges gives the training order: at any point the sources
come in the proportions of their schedules.

Shuffled order, running sums and the sort deal out rows by ranges, so a source of any
size lies in many tasks. What is known about a source travels with one row for each
source and range. Nothing is drawn at random, so reruns agree.

The document in which a source's target ends is cut to the words still wanted, so
targets are met to the word.

Nulls and edge cases: a null text has no words and is not taken; a null source is a
source of its own, last in order; rows with one ``doc_id`` are documents each, a null
``doc_id`` is one too; a source without words gets nothing; an empty table has no rows;
further columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.prefix import lay, running, totals
from tallyloom.session import materialise

# Schedules as knots (time, weight), dealt out to the sources in turn. They integrate to 3, 1 and 2.
SCHEDULES = (((0.0, 4.5), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.0), (1.0, 3.0)))
BUDGET = 1.5
MAX_EPOCHS = 2

Schedule = Sequence[tuple[float, float]]


def integral(schedule: Schedule) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]))


def choose(kind: Column, values: Sequence[Column]) -> Column:
    """The value of place ``kind``."""
    out = values[-1]
    for k in reversed(range(len(values) - 1)):
        out = F.when(kind == k, values[k]).otherwise(out)
    return out


def time_of(schedule: Schedule, share: Column) -> Column:
    """The time by which ``share`` (0 to 1) of a schedule's integral has passed."""
    y, out, below = share * F.lit(integral(schedule)), F.lit(float(schedule[-1][0])), integral(schedule)
    for (t0, w0), (t1, w1) in reversed(list(zip(schedule, schedule[1:]))):
        above, below = below, below - (t1 - t0) * (w0 + w1) / 2
        slope, rest = (w1 - w0) / (t1 - t0), y - F.lit(below)
        root = F.lit(w0) + F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * rest, F.lit(0.0)))
        here = F.lit(t0) + F.when(root > 0, F.lit(2.0) * rest / root).otherwise(F.lit(0.0))
        out = F.when(y <= F.lit(above), here).otherwise(out)
    return out


def targets(sources: DataFrame, schedules: Sequence[Schedule], budget: float, epochs: int) -> DataFrame:
    """``sources`` (``_g``, ``source``, ``total``) with ``kind`` (the place of its schedule) and ``target``.

    Each round shares what is left among the sources below their limit; the shares only grow, so a
    source that reached its limit stays there. A round is one sum over the sources.
    """
    by_order = sources.withColumn("_last", F.col("source").isNull())
    placed = running(lay(by_order.drop("_g"), [], ["_last", "source"], "sources"), ["_last", "source"], F.lit(1).cast("long"))
    kind = F.col("before") % len(schedules)
    weights = choose(kind, [F.lit(float(integral(s))) for s in schedules])
    placed = placed.select(F.struct(F.lit(0).alias("_"), "source").alias("_g"), "words", kind.alias("kind"), weights.alias("weight"))
    placed = materialise(placed, "sources")
    limit = F.col("words") * epochs
    wanted = budget * float(placed.agg(F.sum("words")).first()[0] or 0)
    share, full = 0.0, -1
    while True:
        over = F.col("weight") * share > limit
        count, given, weight = placed.agg(
            F.count_if(over), F.sum(F.when(over, limit)), F.sum(F.when(~over, F.col("weight")))
        ).first()
        if count == full or not weight:
            break
        full, share = count, (wanted - float(given or 0)) / float(weight)
    amount = F.col("weight") * F.lit(float(share))
    target = F.when(amount > limit, limit.cast("double")).otherwise(amount)
    return placed.select("_g", "kind", target.alias("target"))


def mix(
    docs: DataFrame, schedules: Sequence[Schedule] = SCHEDULES, budget: float = BUDGET, epochs: int = MAX_EPOCHS
) -> DataFrame:
    """Every document with ``size``, ``source_size``, ``target``, ``taken`` and its ``uses``, in order of its first position.

    A use is a pass over the document's first ``words`` words at training time ``position``; documents
    that are not used come last. Rows lie in ranges of ``position``.
    """
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    sized = docs.select("doc_id", "source", words.alias("size"), F.md5(F.col("doc_id").cast("string").cast("binary")).alias("_shuffled"))
    laid = lay(materialise(sized, "mix_sizes"), ["source"], ["_shuffled", "doc_id", "size"], "mix_laid")
    sources = totals(laid, F.col("size")).select(F.col("_g.source").alias("source"), F.col("total").alias("words"))
    wanted = targets(materialise(sources.withColumn("_g", F.lit(0)), "mix_sources"), schedules, budget, epochs)
    out = running(laid, ["_shuffled", "doc_id", "size"], F.col("size"), wanted)

    whole = F.floor(F.col("target") + 0.5)
    passes = F.sequence(F.lit(0).cast("long"), F.lit(epochs - 1).cast("long"))
    start = lambda k: k * F.col("total") + F.col("before")
    taken = lambda k: F.greatest(F.least(F.col("size"), whole - start(k)), F.lit(0).cast("long"))
    at = lambda k: choose(F.col("kind"), [time_of(s, F.try_divide(start(k), F.col("target"))) for s in schedules])
    uses = F.transform(passes, lambda k: F.struct(k.alias("epoch"), taken(k).alias("words"), at(k).alias("position")))
    out = out.withColumn("uses", F.filter(uses, lambda u: u["words"] > 0))
    out = out.withColumn("taken", F.coalesce(F.aggregate("uses", F.lit(0).cast("long"), lambda n, u: n + u["words"]), F.lit(0)))
    position = F.get("uses", 0)["position"]
    out = out.select("doc_id", "source", "size", F.col("total").alias("source_size"), "target", "taken", position.alias("position"), "uses")
    return in_order(out, [F.col("position").isNull(), F.col("position")])


def in_order(df: DataFrame, first: Sequence[Column]) -> DataFrame:
    """``df`` in ranges of its training order, rows in order inside a range."""
    by = [*first, F.xxhash64("doc_id"), F.col("doc_id")]
    return df.repartitionByRange(*by).sortWithinPartitions(*by)


def sequence(mixed: DataFrame) -> DataFrame:
    """One row for each use of a document, in training order: ``doc_id``, ``source``, ``epoch``, ``words``, ``position``."""
    return in_order(mixed.select("doc_id", "source", F.inline("uses")), [F.col("position")])


def op12_curriculum(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source", "uses")


QUERIES = {"op12_curriculum": op12_curriculum}
ORACLES: dict[str, str] = {
    "op12_curriculum": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS words, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source
), w AS (
  SELECT *, k % 3 AS kind, (ARRAY[3, 1, 2])[k % 3 + 1]::DOUBLE AS weight, sum(words) OVER ()::BIGINT AS everything FROM s
), o AS (
  -- Sources in the order in which they reach twice their size; the share if those before have reached it.
  SELECT *, 2 * words / weight AS reach,
         (1.5::DOUBLE * everything - coalesce(sum(2 * words) OVER b, 0)::BIGINT::DOUBLE) / sum(weight) OVER a AS share
  FROM w
  WINDOW b AS (ORDER BY 2 * words / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         a AS (ORDER BY 2 * words / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), l AS (
  SELECT share FROM o WHERE share <= reach ORDER BY reach, k LIMIT 1
), t AS (
  SELECT source, kind, words, least(2 * words, weight * l.share)::DOUBLE AS target FROM o CROSS JOIN l
), b AS (
  SELECT d.doc_id, d.size, t.words AS source_size, t.target, t.kind, floor(t.target + 0.5)::BIGINT AS whole,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(CAST(d.doc_id AS VARCHAR)), d.doc_id, d.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), u AS (
  SELECT *, greatest(least(size, whole - start), 0) AS one, greatest(least(size, whole - source_size - start), 0) AS two FROM b
)
SELECT doc_id, size, source_size, target, one + two AS taken,
       CASE WHEN one = 0 THEN NULL
            WHEN kind = 0 THEN 0.0::DOUBLE + 2.0::DOUBLE * (start / target * 3.0::DOUBLE) / (4.5::DOUBLE + sqrt(20.25::DOUBLE + -6.0::DOUBLE * (start / target * 3.0::DOUBLE)))
            WHEN kind = 1 THEN 0.0::DOUBLE + 2.0::DOUBLE * (start / target * 1.0::DOUBLE) / (1.0::DOUBLE + sqrt(1.0::DOUBLE))
            ELSE 0.0::DOUBLE + 2.0::DOUBLE * (start / target * 2.0::DOUBLE) / (1.0::DOUBLE + sqrt(1.0::DOUBLE + 4.0::DOUBLE * (start / target * 2.0::DOUBLE)))
       END AS position
FROM u
"""
}
