"""Benchmark decontamination by greedy string tiling.

A benchmark item is a list of words. Documents that share a run of ``MIN_MATCH``
words with it are candidates; for each candidate the longest common runs of words
that do not overlap earlier ones are marked again and again until none of
``MIN_MATCH`` words is left. The share of the item's words under such tiles is its
coverage. Tiles may lie in any order, so passages that were cut up and reordered
are caught as well. An item covered to ``MIN_COVERAGE`` makes the document
contaminated.

The benchmark is taken in slices of at most ``SLICE_WORDS`` words, so what a task
holds is bounded whatever its size; each slice is compared with all documents.
Within a slice, documents meet items through a table of the items' word runs.

Nulls and edge cases: null and empty texts match nothing; items without words are
left out, items shorter than ``MIN_MATCH`` words must occur as a whole; items with
equal words are compared each; repeated rows each give their result rows; an empty
table on either side gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.shipping import by_value
from tallyloom.llm.common import slices as row_slices
from tallyloom.llm.common import texts
from tallyloom.llm.words import windows, word_hashes

MIN_MATCH = 5
MIN_COVERAGE = 0.5
SLICE_WORDS = 1 << 20
FILTER_BITS = 22


def hashed(text: bytes) -> np.ndarray:
    """Word hashes, ASCII letters in lower case and punctuation at word ends left out."""
    return word_hashes(b" ".join(w for w in (x.strip(PUNCTUATION) for x in text.lower().split()) if w))


PUNCTUATION = b".,;:!?\"'()[]{}*_"


def matches(item: np.ndarray, doc: np.ndarray, item_free: np.ndarray, doc_free: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """Maximal common runs of at least ``length`` unmarked words, as ``(words, item start, document start)``.

    Karp and Rabin: the hashes of all unmarked windows of ``length`` words of the
    item are looked up by those of the document, and each hit is compared and
    extended word by word.
    """

    def open_windows(x: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        run = np.concatenate([[0], np.cumsum(free)])
        at = np.flatnonzero(run[length:] - run[:-length] == length)
        return at, (windows(x, length)[at] if len(at) else np.empty(0, np.uint64))

    if len(item) < length or len(doc) < length:
        return []
    at, hashes = open_windows(item, item_free)
    where: dict[int, list[int]] = {}
    for i, h in zip(at.tolist(), hashes.tolist()):
        where.setdefault(h, []).append(i)
    out = []
    at, hashes = open_windows(doc, doc_free)
    hit = np.isin(hashes, np.fromiter(where, np.uint64, len(where)))
    for d, h in zip(at[hit].tolist(), hashes[hit].tolist()):
        for i in where[h]:
            before = i and d and item_free[i - 1] and doc_free[d - 1] and item[i - 1] == doc[d - 1]
            if before:  # part of a run that started earlier
                continue
            n = 0
            while i + n < len(item) and d + n < len(doc) and item_free[i + n] and doc_free[d + n] and item[i + n] == doc[d + n]:
                n += 1
            if n >= length:
                out.append((n, i, d))
    return out


def tiles(item: np.ndarray, doc: np.ndarray, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy tiling: the longest common runs first, none overlapping another, as ``(words, item start, document start)``.

    The search length starts at the item's length and is halved down to ``min_match``.
    Runs are marked in order of falling length; a run that an earlier one of its
    round cut into is left to a later search.
    """
    item_free, doc_free = np.ones(len(item), bool), np.ones(len(doc), bool)
    shortest = min(min_match, len(item))
    length, out = len(item), []
    while shortest and item_free.any():
        found = matches(item, doc, item_free, doc_free, length)
        marked = False
        for n, i, d in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
            if item_free[i : i + n].all() and doc_free[d : d + n].all():
                item_free[i : i + n] = doc_free[d : d + n] = False
                out.append((n, i, d))
                marked = True
        if not marked:
            if length == shortest:
                break
            length = max(shortest, length // 2)
    return out


class Slice:
    """Items of a slice: their words, and the items in which each run of ``min_match`` words occurs."""

    def __init__(self, items: list[tuple[int, bytes]], min_match: int):
        self.min_match = min_match
        self.items = [(i, w) for i, w in ((i, hashed(t)) for i, t in items) if len(w)]
        # Runs of each width that an item asks for: the minimum, or the whole of a shorter item.
        self.seeds: dict[int, dict[int, list[int]]] = {}
        for k, (_, words) in enumerate(self.items):
            width = min(min_match, len(words))
            for seed in set(windows(words, width).tolist()):
                self.seeds.setdefault(width, {}).setdefault(seed, []).append(k)
        self.filters = {}
        for width, seeds in self.seeds.items():
            table = np.zeros(1 << FILTER_BITS, bool)
            table[(np.fromiter(seeds, np.uint64, len(seeds)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
            self.filters[width] = table

    def candidates(self, doc: np.ndarray) -> dict[int, np.ndarray]:
        """Items that share a seed with the document, and the document's words near shared seeds."""
        near: dict[int, list[tuple[int, int]]] = {}
        for width, table in self.filters.items():
            if len(doc) < width:
                continue
            hashes = windows(doc, width)
            for at in np.flatnonzero(table[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]).tolist():
                for k in self.seeds[width].get(int(hashes[at]), ()):
                    near.setdefault(k, []).append((at, at + width))
        out = {}
        for k, spans in near.items():
            keep = np.zeros(len(doc) + 1, np.int64)
            for a, b in spans:
                keep[a] += 1
                keep[b] -= 1
            inside = np.cumsum(keep[:-1]) > 0
            out[k] = inside
        return out

    def check(self, text: bytes) -> Iterator[tuple[int, int, float, int, int]]:
        """``(item_id, words, coverage, tiles, longest)`` of every candidate item."""
        doc = hashed(text)
        for k, inside in self.candidates(doc).items():
            item_id, item = self.items[k]
            # Words outside shared seeds cannot be part of a tile; a gap of one word keeps runs apart.
            keep = inside | np.concatenate([[False], inside[:-1]])
            part = np.where(inside, doc, np.uint64(0))[keep]
            found = tiles(item, part, self.min_match)
            if found:
                yield item_id, len(item), sum(n for n, *_ in found) / len(item), len(found), max(n for n, *_ in found)


def slices(benchmark: DataFrame, words: int) -> Iterator[list[tuple[int, bytes]]]:
    """The items in slices of at most ``words`` words (or one longer item), as the driver reads them."""
    sized = benchmark.select(
        F.col("item_id").cast("long").alias("item_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    part, size = [], 0
    for row in sized.orderBy("item_id", "text").toLocalIterator(prefetchPartitions=True):
        text = row["text"].encode("utf-8", "replace")
        n = len(text.split())
        if part and size + n > words:
            yield part
            part, size = [], 0
        part.append((row["item_id"], text))
        size += n
    if part:
        yield part


def overlaps(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, slice_words: int = SLICE_WORDS) -> DataFrame:
    """``doc_id``, ``item_id``, ``item_words``, ``coverage``, ``n_tiles`` and ``longest`` of all pairs that share a tile."""
    spark = docs.sparkSession
    kinds = "doc_id long, item_id long, item_words long, coverage double, n_tiles long, longest long"
    types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
    names = ["doc_id", "item_id", "item_words", "coverage", "n_tiles", "longest"]
    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = None
    for items in slices(benchmark, slice_words):
        shared = spark.sparkContext.broadcast(items)

        def batches(source: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            here = Slice(shared.value, min_match)
            for batch in row_slices(source):
                rows = [(i, *r) for i, t in zip(batch.column("doc_id").to_pylist(), texts(batch)) for r in here.check(t)]
                columns = zip(*rows) if rows else [[]] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types)], names)

        part = chosen.mapInArrow(batches, kinds)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], kinds) if out is None else out


def contaminated(docs: DataFrame, benchmark: DataFrame, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """Pairs of documents and items with at least ``min_coverage`` of the item in the document."""
    return overlaps(docs, benchmark).filter(F.col("coverage") >= min_coverage)


def clean(docs: DataFrame, benchmark: DataFrame, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """``docs``, with all columns, without the contaminated documents; one pass per slice, no join."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    for items in slices(benchmark, SLICE_WORDS):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def batches(source: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            here = Slice(shared.value, MIN_MATCH)
            for batch in row_slices(source):
                good = [all(r[2] < min_coverage for r in here.check(t)) for t in texts(batch)]
                yield batch.filter(pa.array(good, pa.bool_()))

        docs = docs.mapInArrow(batches, kinds)
    return docs


def op5_tiling(spark, sf_dir: str) -> DataFrame:
    """One row per contaminated document and item."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op5_tiling": op5_tiling}
ORACLES: dict[str, str] = {}

by_value(__name__)
