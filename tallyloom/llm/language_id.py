"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased; n-grams of one to ``MAX_N`` characters are hashed to
``BUCKETS`` features with sublinear term counts, inverse document frequencies and
length 1. The weights are trained by follow-the-regularised-leader with an elastic
net, so most of them are exactly zero; a temperature fitted on documents that the
training left out makes the probabilities honest.

Document frequencies cover all learnable documents; the weights are fitted to a
bounded sample (``SAMPLE`` rows, the same share of each language). Every text is
read as a whole.

Nulls and edge cases: a null text, or one without a letter, is ``und`` with score
0; documents without ``lang`` are not learned from; without any learnable document
all are ``und``; repeated rows get equal results; an empty table gives an empty
result; further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.shipping import by_value
from tallyloom.llm.common import fold
from tallyloom.llm.samples import choose, features

SAMPLE = 4000
MAX_N = 3
BUCKETS = 1 << 16
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 2e-4, 1e-4
CALIBRATION_SHARE = 5
BLOCK = 1 << 20
UNKNOWN = "und"


def has_letter(text: str | None) -> bool:
    return any(m.group().isalpha() for m in re.finditer(r"[^\W\d_]", text or ""))


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of a text and how often each occurs; blocks overlap so that no n-gram is lost."""
    total = np.zeros(BUCKETS, np.int64)
    text = (text or "").lower()
    for at in range(0, len(text), BLOCK):
        part = np.frombuffer(text[max(0, at - MAX_N + 1) : at + BLOCK].encode("utf-32-le", "surrogatepass"), np.uint32)
        new = len(part) - (at - max(0, at - MAX_N + 1))
        code = np.zeros(len(part), np.uint64)
        for n in range(1, MAX_N + 1):
            # The n-gram that ends here, as a polynomial of its characters.
            code = part.astype(np.uint64) + np.uint64(n)
            for k in range(1, n):
                code[k:] += part[:-k].astype(np.uint64) * np.uint64(pow(1_000_003, k, 1 << 64))
            ends = code[max(len(part) - new, n - 1) :] if at == 0 else code[len(part) - new :]
            total += np.bincount(((ends * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 16)).astype(np.int64), minlength=BUCKETS)
    index = np.flatnonzero(total)
    return index, total[index]


def _frequency_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's document frequencies, one row per feature; feature -1 counts documents."""
    total, n = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for text in batch.column("text").to_pylist():
            total[counts(text)[0]] += 1
            n += 1
    index = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([[-1], index])), pa.array(np.concatenate([[n], total[index]]))], ["feature", "n"]
    )


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """Smoothed inverse document frequencies; ``BUCKETS + 1`` rows at most reach the driver."""
    found = docs.select("text").mapInArrow(_frequency_batches, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    found = {int(r["feature"]): int(r["n"]) for r in found.toLocalIterator()}
    df = np.zeros(BUCKETS)
    for k, n in found.items():
        if k >= 0:
            df[k] = n
    return np.log((1 + found.get(-1, 0)) / (1 + df)) + 1


def weighted(index: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    value = (1 + np.log(np.maximum(n, 1))) * idf[index]
    return value / max(1e-12, float(np.sqrt((value**2).sum())))


class Leader:
    """Follow-the-regularised-leader, per coordinate and class, with elastic net."""

    def __init__(self, classes: int):
        self.z = np.zeros((BUCKETS + 1, classes))
        self.n = np.zeros((BUCKETS + 1, classes))

    def weights(self, index: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[index], self.n[index]
        pulled = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
        return -pulled / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def learn(self, index: np.ndarray, value: np.ndarray, label: int) -> None:
        w = self.weights(index)
        logits = value @ w
        p = np.exp(logits - logits.max())
        p /= p.sum()
        p[label] -= 1
        slope = value[:, None] * p
        sigma = (np.sqrt(self.n[index] + slope**2) - np.sqrt(self.n[index])) / ALPHA
        self.z[index] += slope - sigma * w
        self.n[index] += slope**2


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log loss."""
    if not len(y):
        return 1.0
    best = (np.inf, 1.0)
    for t in np.geomspace(0.1, 20, 200):
        z = logits / t
        z = z - z.max(1, keepdims=True)
        loss = float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(len(y)), y]))
        best = min(best, (loss, float(t)))
    return best[1]


class Model:
    """Languages, sparse weights (last row: bias), inverse document frequencies and temperature."""

    def __init__(self, languages: list[str], weights: np.ndarray, idf: np.ndarray, heat: float):
        self.languages, self.idf, self.heat = languages, idf, heat
        self.weights = weights.astype(np.float32)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not has_letter(text):
            return UNKNOWN, 0.0
        index, n = counts(text)
        z = (weighted(index, n, self.idf) @ self.weights[index] + self.weights[-1]) / self.heat
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def fit(docs: DataFrame, learnable: Column, sample: int = SAMPLE) -> Model | None:
    """A model from the documents where ``learnable`` holds and ``lang`` is known."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"), learnable.alias("_use"))
    known = docs.filter("_use and lang is not null and text is not null")
    # One row per language reaches the driver.
    languages = sorted(r[0] for r in known.select("lang").distinct().collect())
    if not languages:
        return None
    idf = inverse_frequencies(known)
    chosen = choose(known.select("doc_id", "lang"), "lang", languages, sample)
    names, borders, index, n = features(known.select("doc_id", "text"), chosen, lambda b: [counts(t) for t in b.column("text").to_pylist()])
    y = np.array([languages.index(x) for x in names])
    leader, order = Leader(len(languages)), np.random.default_rng(3)
    rows = [(np.append(index[a:b].astype(np.int64), BUCKETS), np.append(weighted(index[a:b].astype(np.int64), n[a:b], idf), 1.0)) for a, b in zip(borders[:-1], borders[1:])]
    left_out = np.arange(len(y)) % CALIBRATION_SHARE == 0 if len(y) >= 10 * CALIBRATION_SHARE else np.zeros(len(y), bool)
    for _ in range(EPOCHS):
        for k in order.permutation(np.flatnonzero(~left_out)):
            leader.learn(*rows[k], int(y[k]))
    w = leader.weights()
    logits = np.array([rows[k][1] @ w[rows[k][0]] for k in np.flatnonzero(left_out)]).reshape(-1, len(languages))
    return Model(languages, w, idf, temperature(logits, y[left_out]))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` of every document."""
    docs = docs.select("doc_id", F.col("text").cast("string"))
    if model is None:
        return docs.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.weights, model.idf, model.heat))

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = Model(*shared.value)
        for batch in source:
            found = [here.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return docs.mapInArrow(batches, "doc_id long, lang_pred string, score double")


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, fold("doc_id", 4) != 2)
    return predict(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


QUERIES = {"op6_language_id": op6_language_id}
ORACLES: dict[str, str] = {}

by_value(__name__)
