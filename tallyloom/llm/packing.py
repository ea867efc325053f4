"""Packing documents into token sequences by best-fit decreasing.

A document longer than a sequence is first cut into full windows; what is left is
packed from the longest piece down, each into the open sequence whose remaining
room is the tightest that still holds it. A segment tree indexed by remaining room
finds it.

Pieces of one length are interchangeable, so the packing only needs to know how
many there are of each: at most ``size`` numbers, whatever the corpus. The plan
that comes out says for ranges of pieces of a length which sequences they fill.
Spark counts the lengths, numbers the pieces of each length (in buckets, so that a
frequent length is spread over many tasks) and looks up their places.

Nulls and edge cases: a null text counts as empty and becomes the end id alone;
repeated rows are packed as often as they occur; a text of any length is cut, runs of
white space of any length included; an empty table gives an empty result; further
columns are not read.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions.shipping import by_value
from tallyloom.llm.common import held
from tallyloom.session import materialise

SIZE = 1024
END_ID = 0
VOCABULARY = "byte_bpe_50k.tiktoken"
BUCKET_ROWS = 20_000

LONG_RUN = 1 << 16  # characters of white space that are split off before the pattern, whose backtracking ends near a million
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"  # what the pattern takes as white space
LONG_SPACE = re.compile(f"(?<![{SPACES}])[{SPACES}]{{{LONG_RUN},}}")


def encoder(vocabulary: str = VOCABULARY):
    """A byte-level BPE from a public vocabulary file of ranks, loaded once per process.

    It gives the ids of the ``tokenizers`` file of the same name, several times
    faster; the strings of special tokens are ordinary text.
    """
    import tiktoken

    def load():
        with open(public_tokenizers.path(vocabulary), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        return tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    return held(f"encoder-{vocabulary}", load)


def encoded(bpe, text: str) -> np.ndarray:
    """The ids of a text.

    The pattern makes one piece of a run of white space, without its last character
    if more text follows. Long runs are cut out as that piece, so it never sees them.
    """
    if len(text) < LONG_RUN:
        return bpe.encode_to_numpy(text)
    parts, start = [], 0
    for run in LONG_SPACE.finditer(text):
        end = run.end() - (run.end() < len(text))
        parts += [bpe.encode_to_numpy(text[start : run.start()]), np.array(bpe._encode_single_piece(text[run.start() : end]), np.uint32)]
        start = end
    return np.concatenate([*parts, bpe.encode_to_numpy(text[start:])])


def cut(ids: bytes, size: int = SIZE) -> list[tuple[int, int, int]]:
    """Start, length and CRC-32 of full windows and the rest."""
    n = len(ids) // 4
    return [(s, min(size, n - s), zlib.crc32(ids[4 * s : 4 * (s + size)])) for s in range(0, n, size)]


def pieces(docs: DataFrame, size: int = SIZE, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id``, ``start``, ``length``, ``ids_crc32`` and ``doc_tokens`` of every piece of every document."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in source:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                whole = encoded(bpe, text or "").astype("<u4").tobytes() + end
                rows += [(doc_id, *p, len(whole) // 4) for p in cut(whole, size)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 5, names)

    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return chosen.mapInArrow(batches, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


class Rooms:
    """Segment tree over remaining room 0..size: the tightest room that is open and large enough."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.open = [False] * (2 * self.width)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]

    def _mark(self, room: int) -> None:
        node = room + self.width
        self.open[node] = bool(self.ranges[room])
        while node > 1:
            node //= 2
            self.open[node] = self.open[2 * node] or self.open[2 * node + 1]

    def add(self, room: int, first: int, n: int) -> None:
        """``n`` sequences from ``first`` on now have ``room`` left."""
        if n and room:
            self.ranges[room].append((first, n))
            self._mark(room)

    def take(self, room: int, most: int) -> tuple[int, int]:
        """Removes up to ``most`` sequences with exactly ``room`` left."""
        first, n = self.ranges[room].pop()
        used = min(n, most)
        if used < n:
            self.ranges[room].append((first + used, n - used))
        self._mark(room)
        return first, used

    def tightest(self, need: int) -> int | None:
        """The smallest open room of at least ``need``."""
        node = need + self.width
        while not self.open[node]:
            while node & 1:  # a right child: go up to where a right neighbour exists
                node //= 2
                if node <= 1:
                    return None
            node += 1
            if node & (node - 1) == 0:
                return None
        while node < self.width:
            node = 2 * node if self.open[2 * node] else 2 * node + 1
        return node - self.width


def best_fit_decreasing(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """The packing of ``counts[length]`` pieces of each length.

    Returns rows ``(length, rank, n, sequence, offset)``: the pieces ``rank .. rank + n - 1``
    of that length go to sequences ``sequence .. sequence + n - 1`` at ``offset``.
    """
    rooms, plan, sequences = Rooms(size), [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = rooms.tightest(length)
            per = (size if room is None else room) // length
            whole = left // per
            if room is None:
                room, first, n = size, sequences, max(1, whole)
                sequences += n
            else:
                first, n = rooms.take(room, max(1, whole))
            layers = min(per, left // n)
            for k in range(layers):
                plan.append((length, rank, n, first, size - room + k * length))
                rank += n
            left -= layers * n
            rooms.add(room - layers * length, first, n)
    return plan


def pack(docs: DataFrame, size: int = SIZE, vocabulary: str = VOCABULARY) -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset`` there."""
    spark = docs.sparkSession
    found = materialise(pieces(docs, size, vocabulary), "pieces")
    # At most ``size`` rows.
    counts = {int(r["length"]): int(r["n"]) for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = np.array(best_fit_decreasing(counts, size), np.int64).reshape(-1, 5)
    places = spark.sparkContext.broadcast({int(n): plan[plan[:, 0] == n] for n in counts})

    buckets = max(1, sum(counts.values()) // BUCKET_ROWS)
    numbered = found.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    sizes = numbered.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy("length").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("length", "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("length", "_bucket").orderBy("doc_id", "start", "ids_crc32"))
    ranked = numbered.withColumn("_inside", inside).join(offsets, ["length", "_bucket"])
    ranked = ranked.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("_before") + F.col("_inside") - 1).alias("_rank")
    )

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for n in np.unique(length):
                rows, spans = np.flatnonzero(length == n), places.value[int(n)]
                k = np.searchsorted(spans[:, 1], rank[rows], "right") - 1
                sequence[rows] = spans[k, 3] + rank[rows] - spans[k, 1]
                offset[rows] = spans[k, 4]
            out = batch.drop_columns(["_rank"])
            yield out.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return ranked.mapInArrow(batches, kinds)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op8_packing": op8_packing}
ORACLES: dict[str, str] = {}

by_value(__name__)
