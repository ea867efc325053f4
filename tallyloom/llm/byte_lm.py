"""Cross-entropy difference: matched n-gram language models of a target and of the whole corpus.

Both models predict every byte of a text from the ``ORDER - 1`` bytes before it and
share one vocabulary, the 256 byte values, so no model gains by leaving tokens
out. Orders are interpolated by Witten and Bell's rule. A document's score is its
mean loss per byte under the target model minus that under the corpus model; low
scores are like the target.

Counts are exact and cover all documents: an n-gram of five bytes is an integer, so
its contexts and shorter n-grams are found by shifts and masks, and the tables of
all orders are sums over the longest one. The table of losses grows with the
corpus. Up to ``BROADCAST_GRAMS`` rows it is sent to the tasks; beyond that the
documents' own n-gram counts are joined with it. Both ways give the same scores.

Nulls and edge cases: a null or empty text has no tokens and a null score; without
a target document the target model is uniform; a repeated row counts as often as
it occurs; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.shipping import by_value
from tallyloom.llm.common import small_side, texts
from tallyloom.session import materialise

ORDER = 5
BROADCAST_GRAMS = 4_000_000
FLUSH = 4 << 20


def grams(text: bytes) -> np.ndarray:
    """One integer per byte: the byte and the ``ORDER - 1`` before it, zeros before the start."""
    raw = np.frombuffer(bytes(ORDER - 1) + text, np.uint8).astype(np.int64)
    out = np.zeros(len(text), np.int64)
    for k in range(ORDER):
        out = (out << 8) | raw[k : k + len(text)]
    return out


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-gram counts of a task, added up in memory for a few MB of text at a time."""

    def counted(parts: dict[bool, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        both = [np.unique(np.concatenate(parts[t]), return_counts=True) if parts[t] else (np.empty(0, np.int64),) * 2 for t in (False, True)]
        for target, (gram, n) in zip((False, True), both):
            for at in range(0, len(gram), 1 << 17):
                g, c = gram[at : at + (1 << 17)], n[at : at + (1 << 17)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g), pa.array(c.astype(np.int64)), pa.array(c.astype(np.int64) * target)], ["gram", "n", "n_target"]
                )

    parts, size = {False: [], True: []}, 0
    for batch in batches:
        for text, target in zip(texts(batch), batch.column("target").to_pylist()):
            parts[bool(target)].append(grams(text))
            size += len(text)
            if size >= FLUSH:
                yield from counted(parts)
                parts, size = {False: [], True: []}, 0
    yield from counted(parts)


def count_grams(docs: DataFrame) -> DataFrame:
    """``gram``, ``n`` (all documents) and ``n_target`` from columns ``text`` and ``target``."""
    counts = docs.select("text", "target").mapInArrow(_count_batches, "gram long, n long, n_target long")
    return counts.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target"))


def losses(counts: DataFrame) -> DataFrame:
    """``gram``, ``loss`` (corpus) and ``loss_target``: minus the log of the interpolated probabilities.

    From order 1 up: p(byte | context) = (n(context, byte) + kinds(context) * p(byte | shorter context)) /
    (n(context) + kinds(context)). A context has at most 256 continuations, so no join key is hot.
    """
    lower = None
    for order in range(1, ORDER + 1):
        mask = (1 << (8 * order)) - 1
        here = counts.groupBy(F.col("gram").bitwiseAND(F.lit(mask)).alias("gram")).agg(
            F.sum("n").alias("n"), F.sum("n_target").alias("n_target")
        )
        if order == ORDER:
            here = counts
        context = F.shiftright("gram", 8)
        seen = here.groupBy(context.alias("context")).agg(
            F.sum("n").alias("all_n"),
            F.sum("n_target").alias("all_target"),
            F.count("*").alias("kinds"),
            F.count_if(F.col("n_target") > 0).alias("kinds_target"),
        )
        here = here.withColumn("context", context).join(seen, "context")
        if lower is None:
            here = here.withColumns({"p0": F.lit(1 / 256), "t0": F.lit(1 / 256)})
        else:
            short = F.col("gram").bitwiseAND(F.lit(mask >> 8)).alias("short")
            here = here.select("*", short).join(lower, "short")
        p = (F.col("n") + F.col("kinds") * F.col("p0")) / (F.col("all_n") + F.col("kinds"))
        total = F.col("all_target") + F.col("kinds_target")
        t = F.when(total > 0, (F.col("n_target") + F.col("kinds_target") * F.col("t0")) / total).otherwise(F.col("t0"))
        lower = here.select(F.col("gram").alias("short"), p.alias("p0"), t.alias("t0"))
    return lower.select(F.col("short").alias("gram"), (-F.log("p0")).alias("loss"), (-F.log("t0")).alias("loss_target"))


class Table:
    """Losses by n-gram in an open hash table of numpy arrays."""

    def __init__(self, gram: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(gram) + 1).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros((1 << self.bits, values.shape[1]), np.float32)
        rest = np.arange(len(gram))
        spot = self._spot(gram)
        while len(rest):
            free = self.keys[spot] < 0
            self.keys[spot[free]] = gram[rest[free]]  # of several for one place the last one stays
            won = self.keys[spot] == gram[rest]
            self.values[spot[won]] = values[rest[won]]
            rest, spot = rest[~won], (spot[~won] + 1) & ((1 << self.bits) - 1)

    def _spot(self, gram: np.ndarray) -> np.ndarray:
        return ((gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def sums(self, gram: np.ndarray) -> np.ndarray:
        """Sums of the values of all n-grams; each must be in the table."""
        spot, out = self._spot(gram), np.zeros(self.values.shape[1])
        while len(gram):
            hit = self.keys[spot] == gram
            out += self.values[spot[hit]].sum(0, dtype=float)
            gram, spot = gram[~hit], (spot[~hit] + 1) & ((1 << self.bits) - 1)
        return out


def _by_broadcast(docs: DataFrame, model: DataFrame) -> DataFrame:
    rows = model.toArrow()
    values = np.stack([rows.column("loss").to_numpy(), rows.column("loss_target").to_numpy()], 1)
    gram, values = rows.column("gram").to_numpy(), values.astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast((gram, values))

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(*shared.value)
        for batch in source:
            found, sizes = [], []
            for text in texts(batch):
                total = np.zeros(2)
                for at in range(0, len(text), FLUSH):
                    start = max(0, at - ORDER + 1)
                    total += table.sums(grams(text[start : at + FLUSH])[at - start :])
                found.append(total)
                sizes.append(len(text))
            sums = np.array(found).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(sums[:, 0]), pa.array(sums[:, 1])],
                ["doc_id", "n_tokens", "sum_loss", "sum_target"],
            )

    return docs.mapInArrow(batches, "doc_id long, n_tokens long, sum_loss double, sum_target double")


def _by_join(docs: DataFrame, model: DataFrame) -> DataFrame:
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for doc_id, row, text in zip(batch.column("doc_id").to_pylist(), batch.column("_row").to_pylist(), texts(batch)):
                gram, n = np.unique(grams(text), return_counts=True) if text else (np.array([-1]), np.array([0]))
                for at in range(0, len(gram), 1 << 17):
                    g, c = gram[at : at + (1 << 17)], n[at : at + (1 << 17)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc_id] * len(g), pa.int64()), pa.array([row] * len(g), pa.int64()), pa.array(g), pa.array(c)],
                        ["doc_id", "_row", "gram", "k"],
                    )

    own = docs.withColumn("_row", F.monotonically_increasing_id()).mapInArrow(batches, "doc_id long, _row long, gram long, k long")
    return (
        own.join(model, "gram", "left")
        .groupBy("_row")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.sum("k").alias("n_tokens"),
            F.coalesce(F.sum(F.col("k") * F.col("loss")), F.lit(0.0)).alias("sum_loss"),
            F.coalesce(F.sum(F.col("k") * F.col("loss_target")), F.lit(0.0)).alias("sum_target"),
        )
        .drop("_row")
    )


def score(docs: DataFrame, target_ids: DataFrame, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``loss``, ``loss_target`` and their difference ``score`` per document.

    ``target_ids`` (``doc_id``) names the target documents, which also are part of the corpus.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    target = small_side(target_ids.filter("doc_id is not null").select("doc_id").distinct().withColumn("_t", F.lit(True)), 16)
    flagged = docs.join(target, "doc_id", "left").select("text", F.coalesce("_t", F.lit(False)).alias("target"))
    model = materialise(losses(materialise(count_grams(flagged), "gram_counts")), "gram_losses")
    way = _by_broadcast if model.count() <= broadcast_grams else _by_join
    some = F.col("n_tokens") > 0
    return way(docs, model).select(
        "doc_id",
        "n_tokens",
        F.when(some, F.col("sum_loss") / F.col("n_tokens")).alias("loss"),
        F.when(some, F.col("sum_target") / F.col("n_tokens")).alias("loss_target"),
        F.when(some, (F.col("sum_target") - F.col("sum_loss")) / F.col("n_tokens")).alias("score"),
    )


def op9_byte_lm(spark, sf_dir: str) -> DataFrame:
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1")
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), good)


QUERIES = {"op9_byte_lm": op9_byte_lm}
ORACLES: dict[str, str] = {}

by_value(__name__)
