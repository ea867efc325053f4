"""Toxicity: averaged subword embeddings with a linear softmax, trained jointly.

A word is the bag of its character n-grams (``MIN_N`` to ``MAX_N`` bytes, word ends
marked), hashed to ``BUCKETS`` vectors. A word is the mean of its n-gram vectors, a
passage (one starts at every word of a document) the mean of its words, and a softmax layer reads that mean; a
document is as toxic as its most toxic passage. Vectors and layer are trained
together, so a misspelling never seen before still has most of the n-grams of the
word that it stands for. Fitted on a bounded sample of labelled
documents (``SAMPLE`` rows, both classes equally); every text is scored as a whole.

Nulls and edge cases: a null, empty or blank text has no words and gets the
probability that the bias alone gives; without labels of both classes every score
is 0; repeated rows get equal scores; an empty table gives an empty result;
further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.shipping import by_value
from tallyloom.llm.common import fold
from tallyloom.llm.samples import choose, features, sums, take

SAMPLE = 6000
MIN_N, MAX_N = 3, 5
BUCKETS = 1 << 17
WIDTH = 8
EPOCHS = 6
BATCH = 64
RATE = 0.2
SCALE = 30.0
DECAY = 1e-6
THRESHOLD = 0.7
BLOCK = 1 << 20
PASSAGE = 16
PASSAGE_ROUNDS = 2


def split(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").split()


def hashed(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """N-gram buckets of words and the word of each."""
    raw = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    before = np.concatenate([[0], np.cumsum(raw == 32)])
    code, buckets, owners = raw.astype(np.uint64), [], []
    for n in range(2, MAX_N + 1):
        code = code[:-1] * np.uint64(1000003) + raw[n - 1 :] + np.uint64(1)
        if n < MIN_N or not len(code):
            continue
        i = np.arange(len(code))
        inner = np.flatnonzero(before[i + n - 1] == before[i + 1])
        mixed = (code[inner] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 17)
        buckets.append(mixed.astype(np.int64))
        owners.append(before[inner + 1] - 1)
    return np.concatenate(buckets), np.concatenate(owners)


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights of the mean over the words of a text; the weights add up to 1.

    Words are taken ``PASSAGE`` at a time without repeats, so one repeated word cannot fill a text.
    """
    words, total, n, at = split(text), np.zeros(BUCKETS), 0, 0
    while at < len(words):
        block, size = [], 0
        while at < len(words) and size < BLOCK:
            part = dict.fromkeys(words[at : at + PASSAGE])
            block.extend(part)
            size += sum(map(len, part))
            at += PASSAGE
        bucket, owner = hashed(block)
        per_word = np.bincount(owner, minlength=len(block))
        total += np.bincount(bucket, 1 / per_word[owner], BUCKETS)
        n += len(block)
    index = np.flatnonzero(total)
    return index, total[index] / max(1, n)


def passages(text: str | None, weights: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Per block of a text: mean weight of the passage from each word on, then buckets, words, n-gram counts.

    A passage is ``PASSAGE`` words in a row of which repeats count once, so one
    repeated word cannot fill it; with fewer words it counts as filled up with
    words of weight 0, so a few words alone do not weigh more. Blocks overlap by
    what a passage needs. The last column is the place of the same word before.
    """
    words, at = split(text), 0
    while at < len(words):
        stop, size = at, 0
        while stop < len(words) and (size < BLOCK or stop - at < 2 * PASSAGE):
            size += len(words[stop])
            stop += 1
        block, seen = words[at:stop], {}
        n, k = len(block), np.arange(len(block))
        bucket, owner = hashed(block)
        count = np.maximum(1, np.bincount(owner, minlength=n))
        per_word = np.bincount(owner, weights[bucket], n) / count
        earlier = np.empty(n, np.int64)
        for i, word in enumerate(block):
            earlier[i] = seen.get(word, -1)
            seen[word] = i
        # Word k counts in the passages that start behind its repeat, at most PASSAGE - 1 words back, and up to k.
        first = np.maximum(np.maximum(k - PASSAGE + 1, earlier + 1), 0)
        means = np.cumsum(np.bincount(first, per_word, n + 1) - np.bincount(k + 1, per_word, n + 1))[:n] / PASSAGE
        whole = n if stop == len(words) else n - PASSAGE + 1
        yield means[:whole], bucket, owner, count, earlier
        at = at + whole


def strongest_passage(text: str | None, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights of the passage with the highest mean."""
    best, out = -np.inf, (np.empty(0, np.int64), np.empty(0))
    for means, bucket, owner, count, earlier in passages(text, weights):
        k = int(means.argmax())
        if means[k] > best:
            best, chosen = means[k], (owner >= k) & (owner < k + PASSAGE) & (earlier[owner] < k)
            index, spot = np.unique(bucket[chosen], return_inverse=True)
            out = index, np.bincount(spot, 1 / count[owner[chosen]]) / PASSAGE
    return out


def train(y: np.ndarray, borders: np.ndarray, index: np.ndarray, value: np.ndarray, seed: int = 5) -> tuple[np.ndarray, float]:
    """Log-odds weight of every bucket and the bias, from jointly trained vectors and softmax layer (AdaGrad)."""
    draw = np.random.default_rng(seed)
    vectors = draw.normal(0, 0.1, (BUCKETS, WIDTH))
    layer, bias = draw.normal(0, 0.1, (WIDTH, 2)), np.zeros(2)
    seen_v, seen_l, seen_b = np.full((BUCKETS, WIDTH), 1e-6), np.full((WIDTH, 2), 1e-6), np.full(2, 1e-6)
    target = np.eye(2)[y.astype(int)]
    for _ in range(EPOCHS):
        order = draw.permutation(len(y))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            place, owner = take(rows, borders)
            i, x = index[place], value[place] * SCALE
            hidden = sums(owner, vectors[i] * x[:, None], len(rows))
            logits = hidden @ layer + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            error = (p / p.sum(1, keepdims=True) - target[rows]) / len(rows)
            used, spot = np.unique(i, return_inverse=True)
            slope = sums(spot, x[:, None] * (error @ layer.T)[owner], len(used)) + DECAY * vectors[used]
            layer_slope, bias_slope = hidden.T @ error, error.sum(0)
            seen_v[used] += slope**2
            vectors[used] -= RATE * slope / np.sqrt(seen_v[used])
            seen_l += layer_slope**2
            layer -= RATE / 4 * layer_slope / np.sqrt(seen_l)
            seen_b += bias_slope**2
            bias -= RATE / 4 * bias_slope / np.sqrt(seen_b)
    odds = layer[:, 1] - layer[:, 0]
    return (SCALE * vectors @ odds).astype(np.float32), float(bias[1] - bias[0])


def log_odds(text: str | None, weights: np.ndarray, bias: float) -> float:
    """Log-odds of the most toxic passage; that of the bias alone for a text without words.

    The softmax layer is linear, so each word adds the mean weight of its n-grams.
    """
    return bias + max((float(means.max()) for means, *_ in passages(text, weights)), default=0.0)


def fit(docs: DataFrame, labels: DataFrame, label: str, sample: int = SAMPLE) -> tuple[np.ndarray, float] | None:
    """Bucket weights and bias.

    The first model learns from means over whole documents. Labels hold for
    documents, but a few words make one toxic, so the next models learn from the
    passage of each document that the model before found most toxic: the toxic
    words of the one class, the most misleading words of the other.
    """
    chosen = choose(labels.filter(F.col(label).isin(0, 1)), label, (0, 1), sample)
    model, parts = None, []
    for step in range(1 + PASSAGE_ROUNDS):
        weights = None if model is None else model[0]

        def make(batch: pa.RecordBatch, weights=weights) -> list:
            rows = batch.column("text").to_pylist()
            return [bag(t) if weights is None else strongest_passage(t, weights) for t in rows]

        y, borders, index, value = features(docs, chosen, make, [F.col("text").cast("string")])
        if len(set(y)) < 2:
            return None
        if step:  # passages of all rounds, so that no round forgets what misled the one before
            parts.append((np.array(y, float), np.diff(borders), index, value))
            y, sizes, index, value = (np.concatenate(x) for x in zip(*parts))
            borders = np.concatenate([[0], np.cumsum(sizes)])
        model = train(np.array(y, float), borders, index.astype(np.int64), value.astype(float))
    return model


def score(docs: DataFrame, model: tuple[np.ndarray, float] | None, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``score`` and ``predicted`` of every document."""
    docs = docs.select("doc_id", F.col("text").cast("string"))
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            raw = np.array([log_odds(t, *shared.value) for t in batch.column("text").to_pylist()], float)
            s = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())],
                ["doc_id", "score", "predicted"],
            )

    return docs.mapInArrow(batches, "doc_id long, score double, predicted int")


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(fold("doc_id", 3) != 1)
    held_out = (fold("doc_id", 3) == 1).alias("held_out")
    return score(docs, fit(docs, labels, "toxic")).select("doc_id", held_out, "score", "predicted")


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLES: dict[str, str] = {}

by_value(__name__)
