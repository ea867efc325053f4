"""URL filter by character language models.

Two variable-order Markov models over URL bytes, one of accepted and one of
rejected URLs, predict every byte from the ``ORDERS - 1`` bytes before it; each
order is smoothed by the next shorter one. A URL's score is the difference of its
log-likelihoods per byte. A logistic curve fitted to labelled URLs that the
models did not count turns the score into a probability of acceptance.

The counts live in hashed tables of a fixed size (``BUCKETS`` per order), counted
over all labelled URLs: each task adds up its own tables and Spark adds the tables
of all tasks, so the models' size does not depend on the number of URLs or hosts.

Nulls and edge cases: a null or empty URL has empty host and path, matches no rule
and is scored as the empty string; repeated URLs count as often as they occur;
without labelled URLs of both kinds every score is 0.5 and accepted; an empty
table gives an empty result; further columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.shipping import by_value
from tallyloom.llm.common import texts
from tallyloom.llm.words import mix
from tallyloom.session import materialise

ORDERS = 5
BUCKETS = 1 << 17
STRENGTH = 2.0
HELD_OUT = 5
START, END = 1, 3

RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (ASCII lower case) and path of a URL; both empty without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    known = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(known, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(known, pattern, 2)


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule whose host and path prefix fit, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def keys(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Table places of every predicted byte: ``(orders, bytes)`` for contexts and for contexts with
    their byte, and the URL that each byte belongs to."""
    pad = bytes([START]) * (ORDERS - 1)
    raw = np.frombuffer(b"".join(pad + u + bytes([END]) for u in urls), np.uint8).astype(np.uint64)
    sizes = np.array([len(u) + 1 for u in urls], np.int64)
    owner = np.repeat(np.arange(len(urls)), sizes)
    at = np.arange(len(owner)) + (owner + 1) * (ORDERS - 1)
    contexts, grams, context = [], [], np.zeros(len(at), np.uint64)
    for order in range(ORDERS):
        if order:
            context = context | (raw[at - order] << np.uint64(8 * (order - 1)))
        place = np.uint64(order * BUCKETS)
        tagged = context + np.uint64((order + 1) << 56)
        contexts.append(mix(tagged) % np.uint64(BUCKETS) + place)
        grams.append(mix(mix(tagged) + raw[at]) % np.uint64(BUCKETS) + place)
    return np.array(contexts, np.int64), np.array(grams, np.int64), owner


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up a task's tables; a row per filled place."""
    size = ORDERS * BUCKETS
    tables = np.zeros((2, 2, size), np.int64)
    for batch in batches:
        urls = texts(batch, "url")
        if not urls:
            continue
        good = np.array(batch.column("accepted").to_pylist(), bool)
        contexts, grams, owner = keys(urls)
        for kind in (0, 1):
            chosen = good[owner] == bool(kind)
            tables[kind, 0] += np.bincount(contexts[:, chosen].ravel(), minlength=size)
            tables[kind, 1] += np.bincount(grams[:, chosen].ravel(), minlength=size)
    flat = tables.ravel()
    filled = np.flatnonzero(flat)
    for at in range(0, len(filled), 1 << 17):
        part = filled[at : at + (1 << 17)]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(flat[part])], ["place", "n"])


def count_tables(labelled: DataFrame) -> np.ndarray:
    """The models: ``(rejected/accepted, context/gram, orders * BUCKETS)`` counts of columns ``url``, ``accepted``.

    At most ``4 * ORDERS * BUCKETS`` rows come to the driver, whatever the input.
    """
    found = (
        labelled.select("url", "accepted").mapInArrow(_count_batches, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    ).toArrow()
    out = np.zeros(4 * ORDERS * BUCKETS, np.int32)
    out[found.column("place").to_numpy()] = np.minimum(found.column("n").to_numpy(), np.iinfo(np.int32).max)
    return out.reshape(2, 2, ORDERS * BUCKETS)


def scores(urls: list[bytes], tables: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio per byte of each URL."""
    if not urls:
        return np.empty(0)
    contexts, grams, owner = keys(urls)
    ratio = np.zeros(len(owner))
    for kind, sign in ((1, 1.0), (0, -1.0)):
        p = np.full(len(owner), 1 / 256)
        for order in range(ORDERS):
            seen, hits = tables[kind, 0][contexts[order]], tables[kind, 1][grams[order]]
            p = (hits + STRENGTH * p) / (np.maximum(seen, hits) + STRENGTH)
        ratio += sign * np.log(p)
    return np.bincount(owner, ratio, len(urls)) / np.bincount(owner, minlength=len(urls))


def calibrate(bins: list[tuple[float, int, int]], steps: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic curve through ``(score, rejected, accepted)`` counts, by Newton steps."""
    s, bad, good = (np.array(x, float) for x in zip(*bins)) if bins else (np.empty(0),) * 3
    if not bad.sum() or not good.sum():
        return 1.0, 0.0
    x, w = np.stack([s, np.ones_like(s)], 1), np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (good - (good + bad) * p) - 1e-3 * w
        curve = (x * ((good + bad) * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def score_urls(pages: DataFrame, tables: np.ndarray) -> DataFrame:
    """``pages`` (with ``url``) and a ``ratio`` column."""
    shared = pages.sparkSession.sparkContext.broadcast(tables)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            yield batch.append_column("ratio", pa.array(scores(texts(batch, "url"), shared.value), pa.float64()))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)
    return pages.mapInArrow(batches, f"{kinds}, ratio double")


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, threshold: float = 0.5) -> DataFrame:
    """Judges every ``url`` of ``pages`` (``page_id``, ``url``).

    Rules decide first, and the URLs that they decide are the labels: the models
    count them but for one in ``HELD_OUT`` (by hash of the URL), which calibrate
    the curve. URLs without a rule get the models' verdict.
    """
    host, path = host_and_path(F.col("url"))
    known = pages.select(F.col("page_id"), F.col("url").cast("string"), host.alias("host"), path.alias("path"))
    rule, says = longest_rule(F.col("host"), F.col("path"), rules)
    known = known.select("*", rule.alias("rule"), says.alias("ruled"))
    held = F.pmod(F.xxhash64("url"), F.lit(HELD_OUT)) == 0
    labelled = known.filter("ruled is not null").select("url", (F.col("ruled") == "allow").alias("accepted"))
    scored = materialise(score_urls(known, count_tables(labelled.filter(~held))), "url_scores")
    # Scores are counted in steps of 0.01 from -10 to 10, so the driver gets 2,001 rows at most.
    step = F.round(F.least(F.greatest("ratio", F.lit(-10.0)), F.lit(10.0)), 2)
    counted = scored.filter(held & F.col("ruled").isNotNull()).groupBy(step.alias("s")).agg(
        F.count_if(F.col("ruled") == "block").alias("bad"), F.count_if(F.col("ruled") == "allow").alias("good")
    )
    slope, offset = calibrate([tuple(r) for r in counted.collect()])
    chance = 1 / (1 + F.exp(-(slope * F.col("ratio") + offset)))
    modelled = F.when(chance >= threshold, "allow").otherwise("block")
    return scored.select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", modelled).alias("verdict"), "ratio", chance.alias("chance")
    )


def op1_url_model(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op1_url_model": op1_url_model}
ORACLES: dict[str, str] = {}

by_value(__name__)
