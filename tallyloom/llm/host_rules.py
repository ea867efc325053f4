"""Host-level quality rules.

Every document is tested by simple rules; failures are counted by host (the
document's source). A rate measured on few documents is unreliable, so the rates
are shrunk towards the corpus with a beta prior estimated from all hosts by the
method of moments (empirical Bayes). Hosts whose shrunk rate passes a threshold
are rejected, and the verdict is joined back to their documents.

Nulls and edge cases: a null text has no words and fails; a document without a
source belongs to no host and is judged by the rules alone; repeated rows count
as often as they occur; an empty table gives an empty result; further columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.shipping import by_value
from tallyloom.llm.common import texts
from tallyloom.session import materialise

WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
MAX_HOST_RATE = 0.5
SALTS = 32

MEASURES = "doc_id long, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words covered by a window of ``window`` words that occurs twice or more.

    Windows are compared exactly: words get numbers, and the number of a window
    twice as long is the rank of its pair of halves.
    """
    if len(words) < window + 1:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    width = 1
    while width < window:
        pair = ids[:-width] * np.int64(int(ids.max()) + 1) + ids[width:]
        ids = np.unique(pair, return_inverse=True)[1]
        width *= 2
    starts = np.flatnonzero(np.bincount(ids)[ids] > 1)
    if not len(starts):
        return 0
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + window, -1)
    return int((np.cumsum(change)[:-1] > 0).sum())


def measure(text: bytes) -> tuple[int, int, int, int, int]:
    """Words, their code points, symbols, repeated lines, words in repeated windows."""
    words = text.split()
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode())
    symbols = sum(joined.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))
    lines = [x for x in text.split(b"\n") if x.split()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [measure(t) for t in texts(batch)]
        cols = [pa.array([r[i] for r in found], pa.int64()) for i in range(5)]
        names = ["doc_id", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), *cols], names)


def measure_documents(docs: DataFrame) -> DataFrame:
    """Rule inputs and ``base_failed`` of every document."""
    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("source").cast("string"))
    few = F.col("n_words") < MIN_WORDS
    repeats = 100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")
    return chosen.mapInArrow(_measure_batches, MEASURES).withColumn("base_failed", few | repeats)


def host_verdicts(measured: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per host: documents, failures, shrunk rate and whether the host is rejected.

    The prior's mean is the mean rate of the hosts and its strength follows from
    how far the rates spread beyond what sampling alone gives. Hosts that do not
    spread at all share one rate.
    """
    hosts = (
        measured.filter(F.col("source").isNotNull())
        .groupBy("source")
        .agg(F.count("*").alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed"))
    )
    rate = F.col("host_failed") / F.col("host_docs")
    prior = hosts.agg(
        F.avg(rate).alias("_mean"),
        F.coalesce(F.var_samp(rate), F.lit(0.0)).alias("_var"),
        F.avg(1 / F.col("host_docs")).alias("_inv"),
    )
    within = F.col("_mean") * (1 - F.col("_mean"))
    # Spread between hosts, without what host sizes explain; the beta's alpha + beta is within / between - 1.
    between = F.greatest((F.col("_var") - within * F.col("_inv")) / (1 - F.col("_inv")), F.lit(1e-6))
    strength = F.greatest(within / between - 1, F.lit(1e-3))
    between_known = F.when(F.col("_inv") >= 1, F.lit(1.0)).otherwise(strength)
    mean, weight = prior.select("_mean", between_known).first()
    mean, weight = float(mean or 0.0), float(weight or 1.0)
    shrunk = (F.col("host_failed") + mean * weight) / (F.col("host_docs") + weight)
    return hosts.select(
        "source", "host_docs", "host_failed", shrunk.alias("host_rate"), (shrunk > max_rate).alias("host_rejected")
    )


def judge(docs: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Documents with their measures, the host's shrunk rate and ``kept``.

    The measures are written once because the host counts and the final join both
    read them. A host may hold a large share of all documents: its counts are
    combined before the shuffle and its documents are salted in the join.
    """
    measured = materialise(measure_documents(docs), "host_measures")
    salted = measured.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "n_words"), F.lit(SALTS)))
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    hosts = host_verdicts(measured, max_rate).withColumn("_salt", salts)
    out = salted.join(hosts, ["source", "_salt"], "left").drop("_salt")
    kept = ~F.col("base_failed") & ~F.coalesce(F.col("host_rejected"), F.lit(False))
    return out.select(
        "doc_id", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        kept.alias("kept"), "host_docs", "host_failed", "host_rate",
    )


def op2_host_rules(spark, sf_dir: str) -> DataFrame:
    out = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


QUERIES = {"op2_host_rules": op2_host_rules}
ORACLES = {
    "op2_host_rules": r"""
WITH t AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), w AS (
  SELECT doc_id, len(words) AS n_words, words,
         list_transform(range(1, len(words) - 6), lambda i: array_to_string(words[i:i+7], ' ')) AS wins
  FROM t WHERE len(words) >= 9
), u AS (
  SELECT doc_id, unnest(wins) AS win, unnest(range(1, len(wins) + 1)) AS pos FROM w
), d AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, win) AS c FROM u) WHERE c > 1
), r AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(pos, pos + 8)) AS p FROM d) GROUP BY doc_id
), m AS (
  SELECT t.doc_id, t.source, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
            - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))))
            AS BIGINT) AS n_dup_lines,
         CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM t LEFT JOIN r USING (doc_id)
), b AS (
  SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM m
), h AS (
  SELECT source, count(*) AS n, sum(base_failed::INT) AS f FROM b WHERE source IS NOT NULL GROUP BY source
), p AS (
  SELECT avg(f / n) AS mu, coalesce(var_samp(f / n), 0) AS v, avg(1 / n) AS inv FROM h
), q AS (
  SELECT mu, CASE WHEN inv >= 1 THEN 1.0
    ELSE greatest(mu * (1 - mu) / greatest((v - mu * (1 - mu) * inv) / (1 - inv), 1e-6) - 1, 1e-3) END AS s FROM p
)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND coalesce((h.f + q.mu * q.s) / (h.n + q.s) <= 0.5, true)) AS kept
FROM b LEFT JOIN h USING (source) CROSS JOIN q
"""
}

by_value(__name__)
