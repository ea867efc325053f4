"""Which texts contain which others, without comparing all pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .shipping import by_value

# Long texts that are gone through at a time and that one row names, at most.
HOT = 20_000
# Bytes of long texts that are gone through at a time, and of parts found there; a single text may have more.
CHUNK = 1 << 19
FOUND = 1 << 24
# Characters of a listed text up to which its parts were once joined one by one; listed texts of any length meet alike now.
LISTED = 80
# 64-bit words of the filter that holds the short texts, at most.
COUNTERS = 1 << 22
# Words of the filter that travel in one row.
BLOCK = 1 << 14
# Entries of the filter that a task holds before it sends them.
HELD = 1 << 20

BASE = 0x9E3779B97F4A7C15
BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256, np.uint64)
WHOLE, BEGIN = np.uint64(0x2545F4914F6CDD1D), np.uint64(0xD6E8FEB86659FD93)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Texts:
    """Texts of a batch as one run of characters: row ``r`` has those from ``first[r]`` to ``first[r + 1]``."""

    def __init__(self, texts: pa.Array, seeds: pa.Array | None):
        texts = texts.cast(pa.string())
        at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        self.raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        at -= at[0]
        begins = (self.raw & 0xC0) != 0x80
        begins[at[:-1][at[:-1] < at[1:]]] = True
        self.places = np.append(np.flatnonzero(begins), len(self.raw))
        self.first = np.searchsorted(self.places, at)
        self.chars = np.diff(self.first)
        powers = lambda base: np.cumprod(np.append(np.uint64(1), np.full(len(self.raw), base, np.uint64)))
        sums = np.append(np.uint64(0), np.cumsum(BYTES[self.raw] * powers(BASE)[:-1]))
        self._sums, self._back = sums[self.places], powers(pow(BASE, -1, 1 << 64))[self.places]
        self.seeds = np.zeros(len(texts), np.uint64) if seeds is None else _mixed(seeds.to_numpy(zero_copy_only=False).view(np.uint64))

    def codes(self, begin: np.ndarray, end: np.ndarray, rows: np.ndarray, kind: np.uint64) -> np.ndarray:
        """Hashes of the parts from ``begin`` to ``end``; equal parts with equal keys have equal ones."""
        h = (self._sums[end] - self._sums[begin]) * self._back[begin]
        return _mixed((h + (end - begin).astype(np.uint64) * kind) ^ self.seeds[rows])

    def parts(self, begin: np.ndarray, end: np.ndarray) -> pa.Array:
        """The parts themselves."""
        start = self.places[begin]
        sizes = self.places[end] - start
        to = np.append(0, np.cumsum(sizes))
        raw = self.raw[np.arange(to[-1]) + np.repeat(start - to[:-1], sizes)]
        return pa.StringArray.from_buffers(len(begin), pa.py_buffer(to.astype(np.int32)), pa.py_buffer(raw))


def _widths(chars: np.ndarray) -> np.ndarray:
    """The largest power of two up to each length."""
    return np.int64(1) << (np.frexp(chars.astype(np.float64))[1].astype(np.int64) - 1)


def _spots(codes: np.ndarray) -> np.ndarray:
    """The three bits of a word that a hash sets."""
    one, six = np.uint64(1), np.uint64(63)
    return (one << (codes & six)) | (one << ((codes >> np.uint64(6)) & six)) | (one << ((codes >> np.uint64(12)) & six))


def _held(codes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Which hashes the filter may hold; never misses one that was put in."""
    spots = _spots(codes)
    return (words[((codes >> np.uint64(32)) & np.uint64(len(words) - 1)).astype(np.int64)] & spots) == spots


def _filter(shorts: DataFrame, keyed: bool) -> tuple[np.ndarray, np.ndarray]:
    """A filter of fixed size that holds all short texts and their beginnings (a power of two long), and the lengths
    that occur. Only blocks of bits come to the driver."""
    count = shorts.count()
    size = 1
    while size < min(count, COUNTERS):
        size *= 2

    def sent(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        found = np.unique(np.concatenate(held))
        block = (found >> np.uint64(32)).astype(np.int64)
        starts = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else np.zeros(0, np.int64)
        for a, b in zip(starts, np.append(starts[1:], len(found))):
            data = (found[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([block[a]], pa.int32()), pa.array([data], pa.binary())], ["block", "data"])

    def entries(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, lengths = [], 0, np.zeros(0, np.int64)
        for part in _chunks(source, "s_text"):
            texts = _Texts(part.column("s_text"), part.column("_seed") if keyed else None)
            begin, rows = texts.first[:-1], np.arange(part.num_rows)
            codes = texts.codes(begin, texts.first[1:], rows, WHOLE), texts.codes(begin, begin + _widths(texts.chars), rows, BEGIN)
            codes = np.concatenate(codes)
            word = (codes >> np.uint64(32)) & np.uint64(size - 1)
            # block of the filter, then word of the block, then the bits that tell the three spots
            held.append((word // np.uint64(BLOCK) << np.uint64(32)) | (word % np.uint64(BLOCK) << np.uint64(18)) | (codes & np.uint64(0x3FFFF)))
            n, lengths = n + len(codes), np.union1d(lengths, texts.chars)
            if n > HELD:
                yield from sent(held)
                held, n = [], 0
        if held:
            yield from sent(held)
        if len(lengths):
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([lengths.tobytes()], pa.binary())], ["block", "data"])

    def merged(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, lengths = {}, np.zeros(0, np.int64)
        for batch in source:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data")):
                if block < 0:
                    lengths = np.union1d(lengths, np.frombuffer(data.as_buffer(), np.int64))
                    continue
                found = np.frombuffer(data.as_buffer(), np.uint32).astype(np.uint64)
                words = blocks.setdefault(block, np.zeros(BLOCK, np.uint64))
                np.bitwise_or.at(words, (found >> np.uint64(18)).astype(np.int64), _spots(found))
        if len(lengths):
            blocks[-1] = lengths
        for block, data in blocks.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([data.tobytes()], pa.binary())], ["block", "data"])

    kind = "block int, data binary"
    found = shorts.mapInArrow(entries, kind).repartition("block").mapInArrow(merged, kind).toArrow()
    words, lengths = np.zeros(max(size, BLOCK), np.uint64), np.zeros(0, np.int64)
    for block, data in zip(found.column("block").to_pylist(), found.column("data").to_pylist()):
        if block < 0:
            lengths = np.frombuffer(data, np.int64)
        else:
            words[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(data, np.uint64)
    return words[:size], lengths


def _chunks(source: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Batches cut to ``HOT`` rows and about ``CHUNK`` bytes of text."""
    for batch in source:
        sizes = np.cumsum(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = sizes[at - 1] if at else 0
            to = min(max(int(np.searchsorted(sizes, before + CHUNK, "right")), at + 1), at + HOT)
            yield batch.slice(at, to - at)
            at = to


def _found(texts: _Texts, words: np.ndarray, lengths: np.ndarray, longest: float | None, equal: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows, begins and ends of the parts that the filter holds, about ``FOUND`` bytes at a time."""
    every = np.arange(texts.first[-1])
    rows = np.repeat(np.arange(len(texts.chars)), texts.chars)
    room = texts.first[1:][rows] - every
    out, size = [], 0
    for width in np.unique(_widths(lengths)).tolist():
        some = lengths[(lengths >= width) & (lengths < 2 * width)]
        fits = room >= some[0]
        if longest is not None:
            fits &= texts.chars[rows] <= some[-1] * longest
        at = every[fits]
        at = at[_held(texts.codes(at, at + width, rows[at], BEGIN), words)]
        for n in some[some <= room[at].max(initial=0)].tolist():
            whole = texts.chars[rows[at]]
            fits = room[at] >= n
            if longest is not None:
                fits &= whole <= n * longest
            if not equal:
                fits &= whole > n
            begin = at[fits]
            codes = texts.codes(begin, begin + n, rows[begin], WHOLE)
            hit = _held(codes, words)
            begin, codes = begin[hit], codes[hit]
            if len(begin) * n > FOUND:  # the same part over and over in one text
                begin = begin[np.sort(np.unique(np.stack([rows[begin].astype(np.uint64), codes]), axis=1, return_index=True)[1])]
            if len(begin):
                out.append((rows[begin], begin, begin + n))
                size += len(begin) * n
            if size > FOUND:
                yield tuple(np.concatenate(x) for x in zip(*out))
                out, size = [], 0
    if out:
        yield tuple(np.concatenate(x) for x in zip(*out))


def _hits(shorts: DataFrame, longs: DataFrame, keys: Sequence[str], longest: float | None, equal: bool) -> DataFrame:
    """Parts of long texts that may be short texts: keys, s_text, the long texts that hold it (``l_ids``), ``_batch``.

    A batch of long texts is gone through at once and names a part once, however many of its texts hold it.
    Every long text is in one batch.
    """
    seed = [F.xxhash64(*keys).alias("_seed")] if keys else []
    words, lengths = _filter(shorts.filter(F.col("s_text") != "").select("s_text", *seed), bool(keys))
    shared: Broadcast = longs.sparkSession.sparkContext.broadcast(words)
    for k in keys:
        longs = longs.filter(F.col(k).isNotNull())
    longs = longs.filter(F.col("l_text") != "").select(*keys, "l_id", "l_text", *seed)
    kept = [longs.schema[k] for k in keys]
    to = StructType([*kept, StructField("s_text", StringType()), StructField("l_ids", ArrayType(longs.schema["l_id"].dataType)), StructField("_batch", LongType())])

    def named(part: pa.RecordBatch, number: int, found: pa.Array, rows: np.ndarray) -> pa.RecordBatch:
        coded = found.dictionary_encode()
        group = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        for k in keys:
            key = part.column(k).dictionary_encode()
            _, group = np.unique(group * len(key.dictionary) + key.indices.to_numpy(zero_copy_only=False)[rows], return_inverse=True)
        _, some = np.unique(group, return_index=True)
        pairs = np.unique(group * part.num_rows + rows)
        ids = part.column("l_id").take(pa.array(pairs % part.num_rows))
        ends = np.append(0, np.cumsum(np.bincount(pairs // part.num_rows, minlength=len(some))))
        columns = [part.column(k).take(pa.array(rows[some])) for k in keys]
        columns += [found.take(pa.array(some)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids), pa.array(np.full(len(some), number))]
        return pa.RecordBatch.from_arrays(columns, to.names)

    def hits(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, number = shared.value, TaskContext.get().partitionId() << 33
        for number, part in enumerate(_chunks(source, "l_text"), number):
            texts = _Texts(part.column("l_text"), part.column("_seed") if keys else None)
            for rows, begin, end in _found(texts, words, lengths, longest, equal):
                yield named(part, number, texts.parts(begin, end), rows)

    return longs.mapInArrow(hits, to)


def _met(hits: DataFrame, shorts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hits that are short texts, with ``s_id``; those of a batch of long texts lie together, so that no short text
    however frequent makes all its pairs in one task."""
    met = hits.join(shorts.filter(F.col("s_text") != "").select(*keys, "s_id", "s_text").hint("merge"), [*keys, "s_text"])
    return met.drop("s_text").repartition("_batch")


def contained_pairs(
    shorts: DataFrame, longs: DataFrame, keys: Sequence[str] = (), longest: float | None = None, *, equal: bool = True
) -> DataFrame:
    """Pairs where ``s_text`` occurs in ``l_text``, as (keys, s_id, l_id); both sides should hold distinct texts.

    ``shorts``: keys, s_id, s_text; ``longs``: keys, l_id, l_text. A filter of fixed size holds the short texts and
    their beginnings. Every long text is gone through once: where a beginning may start, the parts of the lengths
    that occur are looked up, and what the filter may hold is joined with the short texts as text, so what
    it holds by chance is told apart. Neither pieces nor pairs that only might meet are shuffled.
    ``longest`` limits the long text to a multiple of the short one; without ``equal``, equal texts make no pair.
    Neither side is sent to the driver or whole to the tasks. The short side is read more than once.
    """
    met = _met(_hits(shorts, longs, list(keys), longest, equal), shorts, keys)
    return met.select(*keys, "s_id", F.explode("l_ids").alias("l_id"))


def _in_list(texts: DataFrame, listed: DataFrame, value: str, longest: float | None, equal: bool) -> DataFrame:
    """``texts`` with the smallest ``value`` of a listed text that contains them."""
    shorts = texts.select(F.col("text").alias("s_text"))
    hits = _hits(shorts, listed.select(F.struct(value).alias("l_id"), "l_text"), (), longest, equal)
    hits = hits.select(F.col("s_text").alias("text"), F.array_min("l_ids")[value].alias(value))
    hits = hits.groupBy("text").agg(F.min(value).alias(value))
    return texts.filter(F.col("text") != "").join(hits.hint("merge"), "text")


def contained_in_list(texts: DataFrame, listed: DataFrame, value: str, longest: float | None = None) -> DataFrame:
    """``text`` and the smallest ``value`` of a listed text that contains it.

    ``texts``: text (distinct); ``listed``: l_text, ``value``. ``longest`` as in ``contained_pairs``.
    """
    return _in_list(texts.select("text"), listed.filter(F.col(value).isNotNull()), value, longest, True)


def _least(value: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The first ``value`` of every long text; rows come sorted by batch of long texts and value."""

    def least(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, np.zeros(0, np.int64)
        for batch in source:
            if not batch.num_rows:
                continue
            lists, number = batch.column("l_ids"), batch.column("_batch").to_numpy(zero_copy_only=False)
            ids, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
            at = np.repeat(np.arange(batch.num_rows), sizes)
            if number[0] != last:
                seen = np.zeros(0, np.int64)
            new, first = np.unique(ids, return_index=True)
            first = first[~np.isin(new, seen)]
            seen = np.union1d(ids[number[at] == number[-1]], seen if number[0] == number[-1] else seen[:0])
            last = number[-1]
            yield pa.RecordBatch.from_arrays([pa.array(ids[first]), batch.column("s_id").take(pa.array(at[first]))], ["id", value])

    return least


def list_matches(texts: DataFrame, listed: DataFrame, value: str, longest: float | None = None) -> DataFrame:
    """``id`` and the smallest ``value`` of a listed text that contains the text or lies in it.

    ``texts``: id (bigint, one of its own for every row), text (distinct); ``listed``: l_text, ``value``. Both are read
    more than once and should be written. ``longest`` as in ``contained_pairs``.
    """
    listed = listed.filter(F.col(value).isNotNull())
    shorts = listed.select(F.col(value).alias("s_id"), F.col("l_text").alias("s_text"))
    longs = texts.select(F.col("id").alias("l_id"), F.col("text").alias("l_text"))
    met = _met(_hits(shorts, longs, (), longest, True), shorts, ()).sortWithinPartitions("_batch", "s_id")
    within = met.select("_batch", "s_id", "l_ids").mapInArrow(
        _least(value), StructType([StructField("id", LongType()), StructField(value, listed.schema[value].dataType)])
    )
    around = _in_list(texts, listed, value, longest, False).select("id", value)
    return within.unionByName(around).groupBy("id").agg(F.min(value).alias(value))


def one_edit_pairs(texts: DataFrame, keys: Sequence[str], longest: int) -> DataFrame:
    """Pairs of texts up to ``longest`` characters at edit distance one, as (a_id, b_id) with a_id < b_id.

    ``texts``: keys, id, text. Two texts one edit apart share a form with at
    most one character left out, so only rows with a common form meet.
    """
    keys = list(keys)
    n = F.length("text")
    left_out = F.transform(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda i: F.concat(F.substring(F.col("text"), F.lit(1), i - 1), F.substring(F.col("text"), i + 1, n)),
    )
    forms = F.array_distinct(F.concat(F.array("text"), left_out))
    forms = F.transform(forms, lambda f: F.xxhash64(f))  # texts that meet by chance are told apart by their distance
    df = texts.filter(n <= longest).select(*keys, "id", "text", F.explode(forms).alias("form"))
    a = df.withColumnsRenamed({"id": "a_id", "text": "a_text"})
    b = df.withColumnsRenamed({"id": "b_id", "text": "b_text"})
    near = (F.col("a_id") < F.col("b_id")) & (F.levenshtein("a_text", "b_text") <= 1)
    return a.join(b.hint("merge"), [*keys, "form"]).filter(near).select(*keys, "a_id", "b_id").distinct()


by_value(__name__)
