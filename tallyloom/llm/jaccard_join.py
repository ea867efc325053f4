"""N-gram Jaccard join by T-occurrence search.

Documents are sets of word shingles; two link when the Jaccard similarity of their
sets reaches ``num / den``. A document of ``a`` shingles can only link with one that
shares at least ``T = ceil(a * num / den)`` of them, so links are found by T-occurrence
search in inverted lists: with DivideSkip, the longest lists are set aside, the short
ones are merged with a heap, and what occurs often enough there is looked up in the
long ones by binary search. Each hit is checked exactly.

Spark brings those documents together that can link at all:

1. Equal sets form a class, found by fingerprint; one member stands for it.
2. Each set is cut into more parts than two linking sets can have differences, so
   linking sets agree in a whole part. Parts that say nothing (empty, or of common
   shingles only) are left out where enough others remain; a document with
   too few of them gives all. Sets that link agree in several parts, so a document of which
   fewer parts occur elsewhere is done: what shares a phrase by chance goes here. Two of the others
   are candidates if they share as many parts, or a part that more than ``FEW`` documents have.
3. Connected candidates form a block. A block with more shingles than ``BLOCK_SHINGLES``
   is taken apart: shingles are ordered by how often its documents have them, two that link share
   one of their rarest, and only what connects that way stays together. If a block is still too
   large, all its documents are compared with the one that most others met, and
   those that did not link with it are searched in every chunk of the block.
4. Links are reduced to connected components.

All links between different sets are found. What is common is estimated on a
bounded sample (``SAMPLE`` documents); that only decides how documents are routed, not
which links are found.

Nulls and edge cases: a null text or one without words has an empty set, links with
nothing and is its own component; fewer words than a shingle count as one shingle;
rows with one ``doc_id`` are one document; a null ``doc_id`` links with nothing and
has no component; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.shipping import by_value
from tallyloom.llm.common import groups, slices, small_side, texts
from tallyloom.llm.components import components, forest
from tallyloom.llm.words import mix, window_lists
from tallyloom.session import materialise

BLOCK_SHINGLES = 400_000
SAMPLE = 10_000
COMMON_SHARE = 0.0005
SPARE_PARTS = 1.2
# Parts that a map task collects before it sends them, and parts of a slice of the hash range, which one task compares.
BLOCK_PARTS = 1 << 19
SLICE_PARTS = 1 << 20
TASK_SLICES = 4
TASK_NODES = 500_000
# Parts of so many documents are counted for each pair; those of more connect all that have them.
FEW = 8
# Ranges of documents in which the shared parts are summed up.
SUM_RANGES = 64
SKETCH_BITS = 24


def shingles(texts: Sequence[bytes], n: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's word shingles; ASCII letters in lower case."""
    for found in window_lists([t.lower() for t in texts], n):
        found = np.sort(found)
        yield found[np.concatenate([[True], found[1:] != found[:-1]])] if len(found) else found


class Bands:
    """Size bands such that linking sets lie in one band or in neighbouring ones."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.first = [1]

    def last(self, band: int) -> int:
        self.upto(band + 1)
        return self.first[band + 1] - 1

    def upto(self, band: int) -> None:
        while len(self.first) <= band:
            self.first.append(self.first[-1] * self.den // self.num + 1)

    def of(self, size: int) -> int:
        while self.first[-1] <= size:
            self.upto(len(self.first))
        return bisect_right(self.first, size) - 1

    def differences(self, band: int) -> int:
        """Most shingles in which two linking sets differ, the larger one in ``band``."""
        return (self.den - self.num) * 2 * self.last(band) // (self.den + self.num)


def signatures(found: np.ndarray, bands: Bands, common: np.ndarray) -> np.ndarray:
    """Hashes of the parts of a sorted set, for its band and the next."""
    return signed(found, bands, common)[0]


def signed(found: np.ndarray, bands: Bands, common: np.ndarray) -> tuple[np.ndarray, int]:
    """``signatures``, and how many of them a set that links with this one has too, at least."""
    out, least, own = [], [], bands.of(len(found))
    place = np.minimum(np.searchsorted(common, found), max(0, len(common) - 1))
    rare = common[place] != found if len(common) else np.ones(len(found), bool)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(found + np.uint64(0x5851F42D4C957F2D)))])
    rares = np.concatenate([[0], np.cumsum(rare)])
    for band in (own, own + 1):
        differences = bands.differences(band)
        k = int((differences + 1) * SPARE_PARTS) + 2
        # Parts are equal ranges of hash values, so each is a run of the sorted set.
        borders = np.searchsorted(found >> np.uint64(24), np.arange(k + 1, dtype=np.uint64) * np.uint64((1 << 40) // k))
        borders[0], borders[k] = 0, len(found)
        telling = np.diff(rares[borders]) > 0
        # A difference spoils one part. Of a set that gives all, the other one may give only what tells.
        least.append(max(1, int(telling.sum()) - differences))
        if telling.sum() <= differences:
            telling[:] = True
        sums = total[borders[1:]] - total[borders[:-1]]
        part = np.arange(k, dtype=np.uint64) + np.uint64(band << 32)
        out.append(mix(sums ^ mix(part + np.uint64(1)))[telling])
    return np.concatenate(out), min(least)


def occurrences(
    query: list[int],
    lists: dict[int, list[int]],
    least: int,
    heads: dict[int, list[int]] | None = None,
    settled: Callable[[int], bool] = lambda entry: False,
    need: Callable[[int], int] | None = None,
) -> Iterator[int]:
    """Entries that occur in at least ``least`` of the query's inverted lists, by DivideSkip.

    ``query`` is ordered from the shortest list to the longest. The ``least - 1``
    longest lists are set aside, so what is wanted occurs in one of the short ones;
    these are merged with a heap and each entry is looked up in the others by
    binary search until it has occurred often enough or missed too often. ``heads``
    may hold shorter lists for the merge, entries with ``settled`` are left out, and
    ``need`` may ask more than ``least`` of an entry.
    """
    heads = lists if heads is None else heads
    short = [heads[t] for t in query[: max(0, len(query) - least + 1)] if t in heads]
    probes, last = [lists.get(t, ()) for t in query], -1
    for entry in heapq.merge(*short):
        if entry == last or settled(entry):
            continue
        last, missing = entry, len(query) - (need(entry) if need else least)
        for x in probes:
            at = bisect_left(x, entry)
            if at == len(x) or x[at] != entry:
                missing -= 1
                if missing < 0:
                    break
        else:
            yield entry


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return den * shared >= num * (len(a) + len(b) - shared)


class Lists:
    """Inverted lists of the held sets: a number for each shingle and the sets that have it.

    A shingle that could not be met in a second set has no list; it counts as missing.
    """

    def __init__(self, sets: list[np.ndarray], held: np.ndarray, alike: bool):
        of = [i for i in range(len(sets)) if held[i]]
        shingle = np.concatenate([sets[i] for i in of]) if of else np.empty(0, np.uint64)
        owner = np.repeat(np.array(of, np.int32), [len(sets[i]) for i in of])
        order = np.lexsort((owner, shingle))
        shingle, owner = shingle[order], owner[order]
        starts = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1]])) if len(shingle) else np.empty(0, np.int64)
        self.names, self.sizes = shingle[starts], np.diff(np.append(starts, len(shingle)))
        if alike:
            wanted = self.sizes > 1
        else:
            asked = [sets[i] for i in range(len(sets)) if not held[i]]
            wanted = np.isin(self.names, np.concatenate(asked)) if asked else np.zeros(len(self.names), bool)
        self.lists = {k: owner[starts[k] : starts[k] + self.sizes[k]].tolist() for k in np.flatnonzero(wanted).tolist()}

    def ordered(self, found: np.ndarray) -> list[int]:
        """The numbers of a set's shingles, from the shortest list on; -1 where there is none."""
        if not len(self.names):
            return [-1] * len(found)
        at = np.minimum(np.searchsorted(self.names, found), len(self.names) - 1)
        known = self.names[at] == found
        size = np.where(known, self.sizes[at], 0)
        return np.where(known, at, -1)[np.lexsort((found, size))].tolist()


def search(rows: list[dict], num: int, den: int) -> list[tuple[int, int]]:
    """Links found in a block, reduced to a spanning forest.

    ``role`` 0 rows are only indexed, 1 rows only asked, 2 rows both.
    """
    rows = sorted(rows, key=lambda r: (len(r["found"]), r["node"]))
    sets = [np.frombuffer(r["found"], "<u8") for r in rows]
    parent: dict[int, int] = {r["node"]: r["node"] for r in rows}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    # Where all rows ask and are held, each is compared with the smaller ones before it, which must share more of
    # their own shingles than the larger one of its.
    alike = all(r["role"] == 2 for r in rows)
    index = Lists(sets, np.array([r["role"] != 1 for r in rows], bool), alike)
    lists = index.lists
    heads: dict[int, list[int]] = {}

    def hold(i: int, ordered: list[int]) -> None:
        # Two sets that share T shingles share one of the first a - T + 1 of both, from the rarest shingle on.
        a = len(sets[i])
        least = -(-2 * num * a // (num + den)) if alike else -(-num * a // den)
        for t in ordered[: a - max(1, least) + 1]:
            if t in lists:
                heads.setdefault(t, []).append(i)

    if not alike:
        for i, r in enumerate(rows):
            if r["role"] != 1:
                hold(i, index.ordered(sets[i]))
    out = []
    for i, r in enumerate(rows):
        if r["role"] == 0:
            continue
        own, a, ordered = r["node"], len(sets[i]), index.ordered(sets[i])
        found = occurrences(
            ordered,
            lists,
            max(1, -(-num * a // den)),
            heads,
            lambda j: root(rows[j]["node"]) == root(own),
            lambda j: -(-num * (a + len(sets[j])) // (num + den)),
        )
        for j in found:
            x, y = root(own), root(rows[j]["node"])
            if x != y and linked(sets[i], sets[j], num, den):
                parent[max(x, y)] = min(x, y)
                out.append((own, rows[j]["node"]))
        if alike:
            hold(i, ordered)
    return out


def measure(docs: DataFrame, n: int) -> DataFrame:
    """``doc_id``, set size and 128-bit fingerprint of every document's set."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(source):
            found = list(shingles(texts(batch), n))
            prints = np.frombuffer(b"".join(hashlib.blake2b(f.tobytes(), digest_size=16).digest() for f in found), "<i8")
            sizes = pa.array([len(f) for f in found], pa.int64())
            prints = prints.reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), sizes, pa.array(prints[:, 0]), pa.array(prints[:, 1])], ["doc_id", "size", "h1", "h2"]
            )

    return docs.mapInArrow(batches, "doc_id long, size long, h1 long, h2 long")


def common_shingles(docs: DataFrame, ids: DataFrame, n: int) -> np.ndarray:
    """Sorted shingles that many of the sampled documents have; ``ids`` is bounded by ``SAMPLE``."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(source):
            found = list(shingles(texts(batch), n))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).astype(np.int64))], ["shingle"])

    rows = docs.join(F.broadcast(ids), "doc_id").select("text").mapInArrow(batches, "shingle long")
    often = rows.groupBy("shingle").agg(F.count("*").alias("k")).filter(F.col("k") > max(4, int(SAMPLE * COMMON_SHARE)))
    found = often.select("shingle").toArrow().column("shingle").to_numpy()
    return np.sort(found.astype(np.uint64))


def slice_count(shingles_held: int, num: int, den: int) -> int:
    """Slices of the hash range, such that each holds about ``SLICE_PARTS`` of all parts."""
    parts = shingles_held * 6 * (den - num) * SPARE_PARTS / (den + num)
    return max(16, int(parts / SLICE_PARTS))


def planes(x: np.ndarray) -> bytes:
    """The bytes of an array, first all lowest ones: high bytes of small numbers are runs of zeros, which compress."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def from_planes(data: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def heads_of(part: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Parts in order with their documents, the first row of each part, and the document there."""
    order = np.lexsort((doc, part))
    part, doc = part[order], doc[order]
    first = np.concatenate([[True], part[1:] != part[:-1]])
    return part, doc, first, doc[first][np.cumsum(first) - 1]


def blobs_of(part: np.ndarray, doc: np.ndarray, count: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """Sorted parts as one blob for each slice: document ids, how many parts each has, 32 bits of each part."""
    names, starts = np.unique((part >> np.uint64(32)) * np.uint64(count) >> np.uint64(32), return_index=True)
    prints = part.astype("<u4")
    for name, a, b in zip(names.tolist(), starts.tolist(), [*starts[1:].tolist(), len(part)]):
        by_doc = np.argsort(doc[a:b], kind="stable")
        ids, counts = np.unique(doc[a:b], return_counts=True)
        yield name, planes(np.diff(ids, prepend=0).astype("<i8")), planes(counts.astype("<u4")), prints[a:b][by_doc].tobytes()


def of_blobs(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """The prints of a slice's blobs and their documents."""
    doc = [np.repeat(np.cumsum(from_planes(r["ids"], "<i8")), from_planes(r["counts"], "<u4")) for r in rows]
    return np.concatenate([np.frombuffer(r["prints"], "<u4") for r in rows]), np.concatenate(doc)


def packed(part: np.ndarray, doc: np.ndarray, count: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """Parts of a block of documents, one blob for each slice; documents that meet within the block as pairs.

    Of the documents that share a part only the first is sent with it, so a part of very many
    documents is a few rows for a block. The others follow as pairs, under negative slices.
    """
    part, doc, first, heads = heads_of(part, doc)
    other = doc != heads
    pairs = forest(doc[other], heads[other])
    if pairs.shape[1]:
        yield -1 - int(pairs[0, 0] & 0xFFFF), pairs[0].tobytes(), b"", pairs[1].tobytes()
    yield from blobs_of(part[first], doc[first], count)


def tallied(part: np.ndarray, doc: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, Iterator[tuple[int, bytes, bytes, bytes]]]:
    """Documents of a block with the number of parts that they share there, and the blobs of ``packed``."""
    part, doc, first, heads = heads_of(part, doc)
    return *shared_parts(part, doc), blobs_of(part[first], doc[first], count)


def shared_parts(part: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The documents of which a part occurs in another one too, and in how many parts."""
    part, doc, first, heads = heads_of(part, doc)
    once = first | np.concatenate([[True], doc[1:] != doc[:-1]])
    part, doc, first = part[once], doc[once], first[once]
    sizes = np.diff(np.append(np.flatnonzero(first), len(part)))
    return np.unique(doc[np.repeat(sizes, sizes) > 1], return_counts=True)


def meetings(rows: list[dict], parent: dict[int, int] | None = None) -> np.ndarray:
    """Pairs that connect the documents with equal parts, from a slice's blobs; see ``forest``."""
    prints, doc, _, heads = heads_of(*of_blobs(rows))
    other = doc != heads
    return forest(doc[other], heads[other], parent)


def in_tasks(blobs: DataFrame, count: int) -> DataFrame:
    """A task takes several slices, one after the other."""
    tasks = -(-count // TASK_SLICES)
    return blobs.repartition(tasks, F.floor(F.col("slice") / TASK_SLICES)).sortWithinPartitions("slice")


def in_batches(row: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([row[0]], pa.int64()), *[pa.array([x], pa.binary()) for x in row[1:]]], ["slice", "ids", "counts", "prints"]
    )


def blocks_of(source: Iterator[pa.RecordBatch], make: Callable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Parts and documents of what ``make`` gives for the batches, in blocks of about ``BLOCK_PARTS``."""
    parts, ids, size = [], [], 0
    for batch in slices(source):
        for doc_id, own in make(batch):
            parts.append(own)
            ids.append(np.full(len(own), doc_id, "<i8"))
            size += len(own)
            if size >= BLOCK_PARTS:
                yield np.concatenate(parts), np.concatenate(ids)
                parts, ids, size = [], [], 0
    if size:
        yield np.concatenate(parts), np.concatenate(ids)


def meet(df: DataFrame, start: Callable[[], Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray]]]], count: int) -> DataFrame:
    """``doc_id`` and ``first``: pairs that connect all documents with equal parts.

    ``start`` gives for each task what makes the documents and parts of a batch. Parts travel in
    blobs of about five bytes a part. Their 32 bits and the slice's name may
    agree by chance for different parts, which adds a candidate and loses none.
    """

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, doc in blocks_of(source, start()):
            yield from map(in_batches, packed(part, doc, count))

    def met(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}
        for (name,), rows in groups(source, ["slice"]):
            if len(parent) > TASK_NODES:  # what was found stays found, it may only come again
                parent = {}
            if name < 0:
                both = np.concatenate([np.stack([np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["prints"], "<i8")]) for r in rows], 1)
                found = forest(*both, parent)
            else:
                found = meetings(rows, parent)
            for at in range(0, found.shape[1], 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found[:, at : at + (1 << 16)]], ["doc_id", "first"])

    blobs = df.mapInArrow(batches, "slice long, ids binary, counts binary, prints binary")
    # Each task tells a connection once.
    return in_tasks(blobs, count).mapInArrow(met, "doc_id long, first long").distinct()


def linkable(docs: DataFrame, n: int, num: int, den: int, common: np.ndarray, count: int) -> DataFrame:
    """Documents that share so many parts of their sets with others that they may link, and what they need (``signed``).

    A part that a block holds several times counts there and may count once more in its slice.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, common, least = Bands(num, den), shared.value, {}

        def make(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
            for doc_id, found in zip(batch.column("doc_id").to_pylist(), shingles(texts(batch), n)):
                if len(found):
                    parts, needed = signed(found, bands, common)
                    least[doc_id] = min(needed, least.get(doc_id, needed))
                    yield doc_id, parts

        for part, doc in blocks_of(source, make):
            ids, here, rows = tallied(part, doc, count)
            asked = np.fromiter(least, "<i8", len(least))
            needed = np.fromiter(least.values(), "<u4", len(least))
            least.clear()
            # Under negative slices: what each document needs, and what it shares within the block.
            yield in_batches((-1 - int(asked[0] & 0xFFFF), asked.tobytes(), needed.tobytes(), b""))
            if len(ids):
                yield in_batches((-1 - int(ids[0] & 0xFFFF), ids.astype("<i8").tobytes(), b"", here.astype("<u4").tobytes()))
            yield from map(in_batches, rows)

    def told(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (name,), rows in groups(source, ["slice"]):
            if name < 0:
                asked = [r for r in rows if r["counts"]]
                needed = [(np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["counts"], "<u4")) for r in asked]
                here = [(np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["prints"], "<u4")) for r in rows if r["prints"]]
            else:
                needed, here = [], [shared_parts(*of_blobs(rows))]
            for column, found in ((2, needed), (3, here)):
                for ids, counts in found:
                    yield from map(in_batches, in_ranges(ids, counts, column))

    def summed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups(source, ["slice"]):
            ids = np.concatenate([np.cumsum(from_planes(r["ids"], "<i8")) for r in rows])
            names, at = np.unique(ids, return_inverse=True)
            needed, here, start = np.full(len(names), 1 << 40), np.zeros(len(names), np.int64), 0
            for r in rows:
                data = from_planes(r["counts"] or r["prints"], "<u4").astype(np.int64)
                own = at[start : start + len(data)]  # a document comes once in a row
                start += len(data)
                if r["counts"]:
                    needed[own] = np.minimum(needed[own], data)
                else:
                    here[own] += data
            may = here >= needed
            yield pa.RecordBatch.from_arrays([pa.array(names[may]), pa.array(needed[may])], ["doc_id", "needed"])

    blobs = docs.mapInArrow(batches, "slice long, ids binary, counts binary, prints binary")
    rows = in_tasks(blobs, count).mapInArrow(told, "slice long, ids binary, counts binary, prints binary")
    rows = rows.repartition(SUM_RANGES, "slice").sortWithinPartitions("slice")
    return rows.mapInArrow(summed, "doc_id long, needed long")


def in_ranges(ids: np.ndarray, counts: np.ndarray, column: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """Counts of documents as one row for each of ``SUM_RANGES``, in the given column."""
    place = mix(ids.astype(np.uint64)) % np.uint64(SUM_RANGES)
    order = np.lexsort((ids, place))
    ids, counts, place = ids[order], counts[order], place[order]
    names, starts = np.unique(place, return_index=True)
    for name, a, b in zip(names.tolist(), starts.tolist(), [*starts[1:].tolist(), len(ids)]):
        data = planes(np.diff(ids[a:b], prepend=0).astype("<i8")), planes(counts[a:b].astype("<u4"))
        yield (name, data[0], data[1], b"") if column == 2 else (name, data[0], b"", data[1])


def with_few(part: np.ndarray, doc: np.ndarray, count: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """As ``packed``, but parts of up to ``FEW`` documents go with all of them; of the others, the first document goes twice."""
    part, doc, first, heads = heads_of(part, doc)
    once = first | np.concatenate([[True], doc[1:] != doc[:-1]])
    part, doc, first, heads = part[once], doc[once], first[once], heads[once]
    sizes = np.diff(np.append(np.flatnonzero(first), len(part)))
    many = np.repeat(sizes, sizes) > FEW
    other = many & ~first
    pairs = forest(doc[other], heads[other])
    if pairs.shape[1]:
        yield -1 - int(pairs[0, 0] & 0xFFFF), pairs[0].tobytes(), b"", pairs[1].tobytes()
    times = np.where(many, np.where(first, 2, 0), 1)
    yield from blobs_of(np.repeat(part, times), np.repeat(doc, times), count)


def pairs_and_stars(rows: list[dict], parent: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From a slice's blobs of ``with_few``: pairs with the number of parts of few documents that they share, and
    the pairs that connect the documents of all other parts; see ``forest``."""
    part, doc, first, heads = heads_of(*of_blobs(rows))
    starts = np.flatnonzero(first)
    sizes = np.diff(np.append(starts, len(part)))
    twice = np.concatenate([[False], (doc[1:] == doc[:-1]) & ~first[1:]])
    few = np.repeat((sizes <= FEW) & (np.add.reduceat(twice, starts, dtype=np.int64) == 0), sizes)
    left = np.repeat(starts + sizes, sizes) - np.arange(len(part))
    found = [np.empty((2, 0), "<i8")]
    for step in range(1, FEW):
        at = np.flatnonzero(few & (left > step))
        found.append(np.stack([doc[at + step], doc[at]]))
    a, b = np.concatenate(found, 1)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)])
    other = ~few & (doc != heads)
    return np.stack([a[new], b[new]]), np.diff(np.append(new, len(a))), forest(doc[other], heads[other], parent)


def candidates(docs: DataFrame, able: DataFrame, n: int, num: int, den: int, common: np.ndarray, count: int) -> DataFrame:
    """``doc_id`` and ``first``: pairs that connect the documents of ``able`` (see ``linkable``) that may link."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, common = Bands(num, den), shared.value

        def make(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
            for doc_id, found in zip(batch.column("doc_id").to_pylist(), shingles(texts(batch), n)):
                if len(found):
                    yield doc_id, signatures(found, bands, common)

        for part, doc in blocks_of(source, make):
            yield from map(in_batches, with_few(part, doc, count))

    def met(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}
        for (name,), rows in groups(source, ["slice"]):
            if len(parent) > TASK_NODES:
                parent = {}
            if name < 0:
                both = np.concatenate([np.stack([np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["prints"], "<i8")]) for r in rows], 1)
                pairs, often, stars = np.empty((2, 0), "<i8"), np.empty(0, "<i8"), forest(*both, parent)
            else:
                pairs, often, stars = pairs_and_stars(rows, parent)
            columns = [*np.concatenate([pairs, stars], 1), np.concatenate([often, np.full(stars.shape[1], 1 << 40)])]
            for at in range(0, len(columns[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 16)]) for c in columns], ["doc_id", "first", "k"])

    rows = docs.join(small_side(able, 16).select("doc_id"), "doc_id", "left_semi").select("doc_id", "text")
    blobs = rows.mapInArrow(batches, "slice long, ids binary, counts binary, prints binary")
    pairs = in_tasks(blobs, count).mapInArrow(met, "doc_id long, first long, k long")
    pairs = pairs.groupBy("doc_id", "first").agg(F.sum("k").alias("k"))
    for end in ("doc_id", "first"):
        needs = able.select(F.col("doc_id").alias(end), "needed")
        pairs = pairs.join(small_side(needs, 16), end).filter("k >= needed").drop("needed")
    return pairs.select("doc_id", "first")


def often(sets: DataFrame, held: int) -> np.ndarray:
    """For each hash range of a shingle how often its most frequent one occurs in ``sets``, as the bits of that number;
    0 where every shingle occurs once. ``held``: shingles of all sets. 16 MB whatever the input."""
    bits = min(SKETCH_BITS - 4, max(6, (held >> 20).bit_length()))
    columns = ["slice", "shingle", "n"]

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(source, 512):
            found = [np.frombuffer(x, "<u8") for x in batch.column("found").to_pylist()]
            names, counts = np.unique(np.concatenate(found), return_counts=True)
            cuts = np.searchsorted(names, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
            rows = [(k, a, c) for k, (a, c) in enumerate(zip(np.split(names, cuts), np.split(counts, cuts))) if len(a)]
            arrays = [[k for k, *_ in rows], [a.tobytes() for _, a, _ in rows], [c.astype("<u4").tobytes() for *_, c in rows]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(arrays, (pa.int64(), pa.binary(), pa.binary()))], columns)

    def summed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (name,), rows in groups(source, ["slice"]):
            shingle = np.concatenate([np.frombuffer(r["shingle"], "<u8") for r in rows])
            n = np.concatenate([np.frombuffer(r["n"], "<u4") for r in rows])
            names, at = np.unique(shingle, return_inverse=True)
            total = np.bincount(at, n)
            place = (names[total > 1] >> np.uint64(64 - SKETCH_BITS)).astype(np.int64) & ((1 << (SKETCH_BITS - bits)) - 1)
            out = np.zeros(1 << (SKETCH_BITS - bits), np.uint8)
            np.maximum.at(out, place, np.ceil(np.log2(total[total > 1])).astype(np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([out.tobytes()], pa.binary())], ["slice", "most"])

    rows = sets.select("found").mapInArrow(batches, "slice long, shingle binary, n binary")
    rows = rows.repartition(1 << bits, "slice").sortWithinPartitions("slice").mapInArrow(summed, "slice long, most binary")
    out = np.zeros((1 << bits, 1 << (SKETCH_BITS - bits)), np.uint8)
    for r in rows.collect():
        out[r["slice"]] = np.frombuffer(bytes(r["most"]), np.uint8)
    return out.reshape(-1)


def rare_prefix(found: np.ndarray, sketch: np.ndarray, num: int, den: int) -> np.ndarray:
    """The shingles of which two linking sets share one: the rarest ``a - T + 1`` of each, in one order for all sets.

    Those that no other set has are left out.
    """
    a = len(found)
    seen = sketch[(found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    first = np.lexsort((found, seen))[: a - max(1, -(-num * a // den)) + 1]
    return found[first[seen[first] > 0]]


def rare_candidates(sets: DataFrame, num: int, den: int, held: int) -> DataFrame:
    """Documents (``node``) of ``sets`` that share one of their rarest shingles, see ``meet``."""
    shared = sets.sparkSession.sparkContext.broadcast(often(sets, held))

    def start():
        def make(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
            for node, found in zip(batch.column("node").to_pylist(), batch.column("found").to_pylist()):
                yield node, mix(rare_prefix(np.frombuffer(found, "<u8"), shared.value, num, den))

        return make

    return meet(sets.select("node", "found"), start, max(16, held * (den - num) // den // SLICE_PARTS))


def in_blocks(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """``node``, ``block`` (the component) and into how many ``chunks`` a block of that many shingles is cut."""
    blocks = components(edges).select("node", F.col("component").alias("block")).join(sizes, "node")
    totals = blocks.groupBy("block").agg(F.sum("size").alias("total"))
    chunks = F.ceil(F.col("total") / BLOCK_SHINGLES).cast("long").alias("chunks")
    return blocks.join(totals.select("block", chunks), "block").select("node", "block", "chunks")


def sets_of(docs: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """``nodes`` (with ``node`` = a document's id) and the sets ``found`` of those documents."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(source, 64):
            found = [x.astype("<u8").tobytes() for x in shingles(texts(batch), n)]
            yield batch.drop_columns(["text"]).append_column("found", pa.array(found, pa.binary()))

    rows = docs.withColumnRenamed("doc_id", "node").join(small_side(nodes, 32), "node").select(*nodes.columns, "text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema)
    return rows.mapInArrow(batches, f"{kinds}, found binary")


def _links(blocks: DataFrame, keys: list[str], num: int, den: int) -> DataFrame:
    """T-occurrence search in every block of ``keys``.

    A row with ``role`` 3 carries the set from which the sets of its block differ, see ``difference``.
    """

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups(source, keys):
            base = next((np.frombuffer(r["found"], "<u8") for r in rows if r["role"] == 3), None)
            if base is not None:
                rows = [r | {"found": restored(base, r["found"])} for r in rows if r["role"] != 3]
            found = search(rows, num, den)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])

    return blocks.repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(batches, "a long, b long")


def difference(base: np.ndarray, found: np.ndarray) -> bytes:
    """``found`` as what it lacks of ``base`` (places) and what it has besides; short for near copies."""
    lacks = np.flatnonzero(~np.isin(base, found, assume_unique=True)).astype("<u4")
    return np.array([len(lacks)], "<u4").tobytes() + lacks.tobytes() + np.setdiff1d(found, base, assume_unique=True).tobytes()


def restored(base: np.ndarray, change: bytes) -> bytes:
    n = int(np.frombuffer(change, "<u4", 1)[0])
    kept = np.delete(base, np.frombuffer(change, "<u4", n, 4))
    return np.sort(np.concatenate([kept, np.frombuffer(change, "<u8", -1, 4 + 4 * n)])).astype("<u8").tobytes()


def _pivot_links(blocks: DataFrame, num: int, den: int) -> DataFrame:
    """Whether each ``node`` links with its block's ``pivot``, and its set as the difference from the pivot's."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(source, 64):
            both = zip(batch.column("found").to_pylist(), batch.column("pivot_found").to_pylist())
            both = [(np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")) for a, b in both]
            kept = batch.select(["block", "node", "pivot", "chunks"])
            kept = kept.append_column("settled", pa.array([linked(a, b, num, den) for a, b in both], pa.bool_()))
            yield kept.append_column("found", pa.array([difference(b, a) for a, b in both], pa.binary()))

    return blocks.mapInArrow(batches, "block long, node long, pivot long, chunks long, settled boolean, found binary")


def join(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` (the smallest ``doc_id`` reachable by links) of every row."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    measured = materialise(measure(docs, n), "sets")
    filled = measured.filter("size > 0 and doc_id is not null")
    classes = filled.groupBy("h1", "h2").agg(F.min("doc_id").alias("node"), F.first("size").alias("size"))
    members = materialise(measured.join(classes.drop("size"), ["h1", "h2"], "left").drop("h1", "h2"), "members")
    members = members.withColumn("node", F.when(F.col("size") > 0, F.col("node")))

    named = docs.filter("doc_id is not null")
    sampled = members.filter("doc_id = node").select("doc_id").distinct().orderBy(F.xxhash64("doc_id")).limit(SAMPLE)
    common = common_shingles(named, sampled, n)
    held = classes.agg(F.sum("size")).first()[0] or 0
    nodes = members.filter("node is not null").select("doc_id", "node").distinct()
    # One document of each class is enough.
    surplus = nodes.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("node")).alias("own")).filter("not own").select("doc_id")
    named = named.join(small_side(surplus, 16), "doc_id", "left_anti").select("doc_id", "text")
    able = materialise(linkable(named, n, num, den, common, slice_count(held, num, den)), "linkable")
    held = members.join(able, "doc_id", "left_semi").agg(F.sum("size")).first()[0] or 0
    met = materialise(candidates(named, able, n, num, den, common, slice_count(held, num, den)), "candidates")
    # From documents to their classes.
    met = met.join(nodes, "doc_id").select("first", F.col("node").alias("a"))
    met = met.join(nodes.withColumnRenamed("doc_id", "first"), "first").select("a", F.col("node").alias("b")).filter("a != b")
    met = materialise(met.distinct(), "candidates")

    sizes = members.filter("doc_id = node").groupBy("node").agg(F.max("size").alias("size"))
    found = materialise(sets_of(named, in_blocks(met, sizes), n), "block_sets")
    small, large = found.filter("chunks = 1"), found.filter("chunks > 1")
    wide = large.agg(F.sum(F.length("found") / 8)).first()[0]
    if wide:
        # What only hangs together by passages comes apart when documents have to share one of their rarest shingles.
        met = materialise(rare_candidates(large, num, den, int(wide)), "rare_candidates")
        met = met.select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
        finer = large.select("node", "found").join(in_blocks(met, sizes), "node").select(*found.columns)
        finer = materialise(finer, "finer_sets")
        small, large = small.unionByName(finer.filter("chunks = 1")), finer.filter("chunks > 1")
    links = _links(small.select("block", "node", F.lit(2).alias("role"), "found"), ["block"], num, den)
    if large.limit(1).count():
        degree = met.groupBy("b").agg(F.count("*").alias("k")).withColumnRenamed("b", "node")
        pivots = large.select("block", "node").join(degree, "node").groupBy("block").agg(
            F.max_by("node", F.struct("k", -F.col("node"))).alias("pivot")
        )
        pivot_sets = large.select(F.col("node").alias("pivot"), F.col("found").alias("pivot_found"))
        pivots = pivot_sets.join(small_side(pivots, 32), "pivot").dropDuplicates(["block"])
        compared = _pivot_links(
            large.join(pivots, "block").select("block", "node", "pivot", "chunks", "found", "pivot_found"), num, den
        )
        compared = materialise(compared, "pivot_links")
        large = compared.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
        place = ["block", "held", "asked", "node", "found"]
        held = large.withColumn("asked", every).withColumn("held", F.col("chunk")).select(*place, F.lit(0).alias("role"))
        asking = large.filter("not settled").withColumn("held", every).withColumn("asked", F.col("chunk"))
        asking = asking.select(*place, F.lit(1).alias("role"))
        # A chunk that nobody asks about is not sent.
        held = held.join(asking.select("block", "asked").distinct(), ["block", "asked"], "left_semi").select(held.columns)
        bases = asking.select("block", "held", "asked").distinct().join(pivots, "block")
        bases = bases.select("block", "held", "asked", F.col("pivot").alias("node"), F.col("pivot_found").alias("found"), F.lit(3).alias("role"))
        wide = _links(held.unionByName(asking).unionByName(bases), ["block", "held", "asked"], num, den)
        star = compared.filter("settled and node != pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
        links = links.unionByName(star).unionByName(wide)
    joined = components(links)
    out = members.join(joined, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id"))
    return out.select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"))


def op4_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=3, num=90, den=100)


QUERIES = {"op4_jaccard_join": op4_jaccard_join}
ORACLES: dict[str, str] = {}

by_value(__name__)
