"""Quality classifier: a factorisation machine.

Inputs are hashed words, statistics of a text's structure and metadata columns.
The machine adds to a linear score one low-rank weight for every pair of inputs;
``1/2 * sum((sum v x)^2 - sum (v x)^2)`` gives all pairs in one pass over the
inputs. It is fitted by AdaGrad on a bounded sample of labelled documents
(``SAMPLE`` rows, both classes equally), every text is then read as a whole.

Nulls and edge cases: a null text counts as empty and gets a score from its
statistics alone; null metadata counts as 0; documents without a label are scored
like all others; without labels of both classes every score is 0.5 (predicted 1);
repeated rows get equal scores; an empty table gives an empty result; columns of
the input are carried along or left out, never read unless named.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.shipping import by_value
from tallyloom.llm.common import fold, texts
from tallyloom.llm.samples import choose, features, sums, take
from tallyloom.llm.words import windows, word_hashes

SAMPLE = 8000
WORD_BUCKETS = 1 << 16
RANK = 8
EPOCHS = 6
BATCH = 128
RATE = 0.1
DECAY = 1e-5
THRESHOLD = 0.5
STATISTICS = 14


def statistics(text: bytes, hashes: np.ndarray) -> list[float]:
    """Structure of a text: size, repetition, and shares of kinds of characters."""
    n = max(1, len(hashes))
    size = max(1, len(text))
    kinds = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    triples = windows(hashes, 3)
    lines = [x for x in text.split(b"\n") if x.strip()]
    counts = np.unique(hashes, return_counts=True)[1]
    return [
        np.log1p(len(hashes)),
        np.log1p(size) - np.log1p(n),
        kinds[65:91].sum() / size,
        kinds[48:58].sum() / size,
        kinds[[35, 36, 37, 38, 42, 60, 62, 64, 94, 126]].sum() / n,
        kinds[33] / n,
        kinds[124] / n,
        kinds[[44, 46]].sum() / n,
        kinds[10] / n,
        len(counts) / n,
        counts.max() / n if len(counts) else 0.0,
        len(np.unique(triples)) / max(1, len(triples)),
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        float(len(hashes) == 0),
    ]


def inputs(batch: pa.RecordBatch, metadata: Sequence[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sparse inputs of each row: word buckets (log counts, scaled to length 1), then statistics and metadata."""
    extra = [[np.log1p(max(0.0, float(v or 0))) for v in batch.column(m).to_pylist()] for m in metadata]
    out = []
    for row, text in enumerate(texts(batch)):
        hashes = word_hashes(text)
        index, n = np.unique(hashes % np.uint64(WORD_BUCKETS), return_counts=True)
        value = np.log1p(n)
        dense = np.array(statistics(text, hashes) + [m[row] for m in extra])
        value = np.concatenate([value / max(1e-9, np.sqrt((value**2).sum())), dense])
        out.append((np.concatenate([index.astype(np.int64), WORD_BUCKETS + np.arange(len(dense))]), value))
    return out


class Machine:
    """Weights of a fitted machine and the scaling of its dense inputs."""

    def __init__(self, dense: int, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.size = WORD_BUCKETS + dense
        self.bias = 0.0
        self.linear = np.zeros(self.size)
        self.factors = draw.normal(0, 0.01, (self.size, RANK))
        self.mean, self.scale = np.zeros(dense), np.ones(dense)

    def scaled(self, index: np.ndarray, value: np.ndarray) -> np.ndarray:
        at = index - WORD_BUCKETS
        dense = at >= 0
        out = value.astype(float)
        out[dense] = np.clip((out[dense] - self.mean[at[dense]]) / self.scale[at[dense]], -4, 4)
        return out

    def raw(self, index: np.ndarray, x: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        vx = self.factors[index] * x[:, None]
        total = sums(owner, vx, n)
        pairs = 0.5 * (total**2 - sums(owner, vx**2, n)).sum(1)
        return self.bias + np.bincount(owner, self.linear[index] * x, n) + pairs, total, vx

    def fit(self, y: np.ndarray, borders: np.ndarray, index: np.ndarray, value: np.ndarray, seed: int = 11) -> None:
        at = index - WORD_BUCKETS
        for j in range(len(self.mean)):
            v = value[at == j]
            self.mean[j], self.scale[j] = v.mean(), max(1e-6, v.std())
        x = self.scaled(index, value)
        draw = np.random.default_rng(seed)
        seen_linear, seen_factors, seen_bias = np.full(self.size, 1e-6), np.full((self.size, RANK), 1e-6), 1e-6
        for _ in range(EPOCHS):
            order = draw.permutation(len(y))
            for at in range(0, len(order), BATCH):
                rows = order[at : at + BATCH]
                place, owner = take(rows, borders)
                i, xi = index[place], x[place]
                score, total, vx = self.raw(i, xi, owner, len(rows))
                error = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - y[rows]
                pull = error[owner] / len(rows)
                used, spot = np.unique(i, return_inverse=True)
                slope = np.bincount(spot, pull * xi, len(used)) + DECAY * self.linear[used]
                seen_linear[used] += slope**2
                self.linear[used] -= RATE * slope / np.sqrt(seen_linear[used])
                slope = sums(spot, (pull * xi)[:, None] * (total[owner] - vx), len(used)) + DECAY * self.factors[used]
                seen_factors[used] += slope**2
                self.factors[used] -= RATE / 4 * slope / np.sqrt(seen_factors[used])
                slope = error.mean()
                seen_bias += slope**2
                self.bias -= RATE * slope / np.sqrt(seen_bias)

    def scores(self, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.empty(len(found))
        for k, (index, value) in enumerate(found):
            x = self.scaled(index, value)
            raw = self.raw(index, x, np.zeros(len(index), np.int64), 1)[0][0]
            out[k] = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
        return out


def fit(docs: DataFrame, labels: DataFrame, label: str, metadata: Sequence[str] = (), sample: int = SAMPLE) -> Machine | None:
    """A machine fitted to at most ``sample`` labelled documents; None without both classes."""
    chosen = choose(labels.filter(F.col(label).isin(0, 1)), label, (0, 1), sample)
    columns = [F.col("text").cast("string"), *[F.col(m).cast("double") for m in metadata]]
    y, borders, index, value = features(docs, chosen, lambda b: inputs(b, metadata), columns)
    y = np.array(y, float)
    if len(set(y)) < 2:
        return None
    machine = Machine(STATISTICS + len(metadata))
    machine.fit(y, borders, index.astype(np.int64), value.astype(float))
    machine.linear, machine.factors = machine.linear.astype(np.float32), machine.factors.astype(np.float32)
    return machine


def score(
    docs: DataFrame,
    machine: Machine | None,
    metadata: Sequence[str] = (),
    threshold: float = THRESHOLD,
    names: tuple[str, str] = ("score", "predicted"),
) -> DataFrame:
    """``docs`` with a score and a prediction under ``names``; all its columns are carried through."""
    if machine is None:
        return docs.withColumn(names[0], F.lit(0.5)).withColumn(names[1], F.lit(1))
    parts = (machine.bias, machine.linear, machine.factors, machine.mean, machine.scale)
    shared = docs.sparkSession.sparkContext.broadcast(parts)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = Machine(len(shared.value[3]))
        here.bias, here.linear, here.factors, here.mean, here.scale = shared.value
        for batch in source:
            s = here.scores(inputs(batch, metadata))
            yield batch.append_column(names[0], pa.array(s, pa.float64())).append_column(
                names[1], pa.array((s >= threshold).astype(np.int32), pa.int32())
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(batches, f"{kinds}, `{names[0]}` double, `{names[1]}` int")


def learnable(labels: DataFrame) -> DataFrame:
    """Labels outside the held-out third."""
    return labels.filter(fold("doc_id", 3) != 1)


def op7_quality_fm(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "n_chars")
    machine = fit(docs, learnable(spark.read.parquet(f"{sf_dir}/labels.parquet")), "quality", ("n_chars",))
    held_out = (fold("doc_id", 3) == 1).alias("held_out")
    return score(docs, machine, ("n_chars",)).select("doc_id", held_out, "score", "predicted")


QUERIES = {"op7_quality_fm": op7_quality_fm}
ORACLES: dict[str, str] = {}

by_value(__name__)
