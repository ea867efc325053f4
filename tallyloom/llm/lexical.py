"""Ranked lexical search of many items at once, with shared partial scores.

Every document is scored for every item by its terms; terms that several items share
are added up once. Items are grouped by a common hash of their terms, and for each
group the term lists, rarest last, are searched for pairs of neighbouring symbols that
occur in more than one item. Such a pair becomes a symbol of its own, which may pair up
again, until nothing is shared: a graph of partial sums in which each node adds two
others. For a batch of documents the partial sums are made once, level by level, and an
item adds up the few nodes that are left of its list.

1. The items' plans (terms, pairs, lists) are made by Spark tasks, one group in a task.
2. One pass over the whole texts writes each document's length and its counts of terms that
   items ask for, not the other words.
3. Document frequencies come from those rows; a term's weight goes to the tasks with the plans.
4. Each task keeps the best rows of every item; these are reduced by Spark in two steps.

Items come in slices of at most ``SLICE_TERMS`` terms (or one longer item), so the plans
that a task holds are bounded whatever the size of the benchmark; steps 2 to 4 are one
pass for each slice.

Nulls and edge cases: a null or empty text has no terms, counts for nothing and is not
ranked; a null ``doc_id`` counts in all statistics but cannot be named and is not ranked;
rows with one ``doc_id`` are documents each; equal items count once, different texts of one
``item_id`` (a null one too) are one item with the terms of all; an item without terms
has no rows; a very long text is taken in pieces; an empty table on either side gives an
empty result; further columns are not read.
"""

from __future__ import annotations

import collections
import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions.shipping import by_value
from tallyloom.llm.common import groups, slices, texts
from tallyloom.llm.prefix import lay, running
from tallyloom.session import materialise

TOP = 10
GROUP_TERMS = 1 << 13
SLICE_TERMS = 1 << 18
# How far apart in an item's list two symbols may lie to become a pair.
REACH = 8
BATCH = 256
PIECE = 1 << 20
SALTS = 256
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _bytes_table() -> bytes:
    """Letters A-Z to lower case, all that is not part of a term to a space."""
    keep = re.compile(rb"[0-9A-Za-z\x80-\xff]")
    return bytes(ord(chr(c).lower()) if c < 128 and keep.match(bytes([c])) else c if c >= 128 else 32 for c in range(256))


TABLE = _bytes_table()


def count_terms(text: bytes) -> collections.Counter:
    """How often each term occurs; a long text is taken in pieces that end between terms."""
    plain = text.translate(TABLE)
    if len(plain) <= PIECE:
        return collections.Counter(plain.split())
    found, at = collections.Counter(), 0
    while at < len(plain):
        end = plain.find(b" ", at + PIECE) if at + PIECE < len(plain) else -1
        end = len(plain) if end < 0 else end
        found.update(plain[at:end].split())
        at = end
    return found


def shared_pairs(lists: Sequence[Sequence[int]], symbols: int, reach: int = REACH) -> tuple[list[list[int]], list[tuple[int, int]]]:
    """Lists in which pairs that occur more than once are symbols of their own, from ``symbols`` on, and these pairs.

    A list holds a symbol once. Frequent symbols come first, so what lists share lies side by side.
    """
    lists, pairs = [list(x) for x in lists], []
    while True:
        support = collections.Counter(s for x in lists for s in x)
        for x in lists:
            x.sort(key=lambda s: (-support[s], s))
        seen: dict[tuple[int, int], list[int]] = {}
        for i, x in enumerate(lists):
            for a in range(len(x)):
                if support[x[a]] < 2:
                    break
                for b in range(a + 1, min(a + 1 + reach, len(x))):
                    if support[x[b]] < 2:
                        break
                    seen.setdefault((x[a], x[b]), []).append(i)
        members, found = [set(x) for x in lists], False
        for (a, b), where in sorted(((p, w) for p, w in seen.items() if len(w) > 1), key=lambda e: (-len(e[1]), e[0])):
            here = [i for i in where if a in members[i] and b in members[i]]
            if len(here) > 1:
                new, found = symbols + len(pairs), True
                pairs.append((a, b))
                for i in here:
                    members[i] -= {a, b}
                    members[i].add(new)
        if not found:
            return lists, pairs
        lists = [sorted(m) for m in members]


PLAN = "slice long, terms array<binary>, times array<long>, a array<int>, b array<int>, items array<long>, nulls array<boolean>, sums array<array<int>>"


def _plans(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (_, group), rows in groups(source, ["slice", "group"]):
        symbol: dict[tuple[bytes, int], int] = {}
        lists = [[symbol.setdefault((t["term"], t["k"]), len(symbol)) for t in r["terms"]] for r in rows]
        sums, pairs = shared_pairs(lists, len(symbol))
        columns = [
            [rows[0]["slice"]], [[t for t, _ in symbol]], [[k for _, k in symbol]], [[a for a, _ in pairs]], [[b for _, b in pairs]],
            [[r["item_id"] or 0 for r in rows]], [[r["item_id"] is None for r in rows]], [sums],
        ]
        kinds = [
            pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()),
            pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.list_(pa.int32())),
        ]
        names = ["slice", "terms", "times", "a", "b", "items", "nulls", "sums"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def plans(benchmark: DataFrame) -> DataFrame:
    """One row for each group of items: its terms with their repeats, the shared pairs and what each item adds up."""
    words = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    words = words.select("item_id", F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0))).alias("term"))
    terms = words.groupBy("item_id", "term").agg(F.count("*").alias("k"))
    listed = F.sort_array(F.collect_list(F.struct(F.col("term").cast("binary").alias("term"), "k")))
    items = terms.groupBy("item_id").agg(listed.alias("terms"), F.min(F.xxhash64("term")).alias("alike"))
    laid = lay(materialise(items, "search_items"), [], ["alike", "item_id"], "search_laid")
    placed = running(laid, ["alike", "item_id"], F.size("terms").cast("long"))
    place = [F.floor(F.col("before") / n).cast("long").alias(name) for n, name in ((SLICE_TERMS, "slice"), (GROUP_TERMS, "group"))]
    placed = placed.select("item_id", "terms", *place).repartition("slice", "group").sortWithinPartitions("slice", "group", "item_id")
    return materialise(placed.mapInArrow(_plans, PLAN), "search_plans")


def term_counts(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """``doc_id``, ``n`` (terms with repeats), places in ``vocabulary`` and counts of the terms found there."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: k for k, t in enumerate(shared.value)}
        for batch in slices(source):
            n, ids, counts = [], [], []
            for text in texts(batch):
                found = count_terms(text)
                n.append(found.total())
                known = [t for t in found if t in place]
                ids.append(np.array([place[t] for t in known], np.int32))
                counts.append(np.array([found[t] for t in known], np.int64))
            cols = [pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], ["doc_id", "n", "ids", "counts"])

    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return chosen.mapInArrow(batches, "doc_id long, n long, ids array<int>, counts array<long>")


class Group:
    """The plan of a group of items, ready for batches of documents."""

    def __init__(self, row: dict, place: dict[bytes, int]):
        known, self.terms = np.unique(np.array([place[t] for t in row["terms"]], np.int64), return_inverse=True)
        self.local, self.known = np.full(len(place), -1, np.int32), len(known)
        self.local[known] = np.arange(len(known))
        self.times = np.array(row["times"], np.int64)
        first = len(self.terms)
        # Pairs level by level: a level adds nodes of the levels below.
        depth = [0] * first
        for a, b in zip(row["a"], row["b"]):
            depth.append(1 + max(depth[a], depth[b]))
        by_level: dict[int, list[int]] = {}
        for k, d in enumerate(depth[first:]):
            by_level.setdefault(d, []).append(k)
        a, b = np.array(row["a"], np.int64), np.array(row["b"], np.int64)
        self.levels = [(np.array(k) + first, a[k], b[k]) for _, k in sorted(by_level.items())]
        self.size = len(depth)
        self.items = [None if null else i for i, null in zip(row["items"], row["nulls"])]
        self.sums = [np.array(x, np.int64) for x in row["sums"]]

    def scores(self, ids: np.ndarray, owner: np.ndarray, part: np.ndarray, documents: int) -> np.ndarray:
        """Scores (items x documents) from what single terms give: places of terms, documents, values."""
        here = self.local[ids]
        own = here >= 0
        parts = np.zeros((self.known, documents), np.int64)
        parts[here[own], owner[own]] = part[own]
        nodes = np.zeros((self.size, documents), np.int64)
        np.multiply(parts[self.terms], self.times[:, None], out=nodes[: len(self.terms)])
        for own, a, b in self.levels:
            nodes[own] = nodes[a] + nodes[b]
        return np.stack([nodes[x].sum(0) for x in self.sums])


def best_rows(counted: DataFrame, plan: list[dict], vocabulary: list[bytes], weights: dict[int, int], documents: int, terms: int, top: int) -> DataFrame:
    """``item_id``, ``doc_id`` and ``score`` of the best rows of each task."""
    shared = counted.sparkSession.sparkContext.broadcast((plan, vocabulary, weights))

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, vocabulary, weights = shared.value
        place = {t: k for k, t in enumerate(vocabulary)}
        made = [Group(r, place) for r in plan]
        weight = np.array([weights.get(k, 0) for k in range(len(vocabulary))], np.int64)
        best: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for batch in slices(source, BATCH):
            doc = batch.column("doc_id").to_numpy(zero_copy_only=False)
            n = batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
            ids, counts = batch.column("ids"), batch.column("counts")
            owner = np.repeat(np.arange(len(n)), ids.value_lengths().to_numpy(zero_copy_only=False))
            ids, tf = ids.flatten().to_numpy(), counts.flatten().to_numpy()
            m = 100 - 75 + (75 * n * documents) // terms
            part = weight[ids] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[owner]))
            for g, group in enumerate(made):
                found = group.scores(ids, owner, part, len(n))
                least = np.array([best[g, i][-1][0] * -1 if len(best.get((g, i), ())) == top else 1 for i in range(len(found))])
                for i in np.flatnonzero((found >= least[:, None]).any(1)).tolist():
                    hits = np.flatnonzero(found[i] >= least[i])
                    rows = best.get((g, i), []) + [(-s, d) for s, d in zip(found[i][hits].tolist(), doc[hits].tolist())]
                    best[g, i] = sorted(rows)[:top]
        rows = [(made[g].items[i], d, -s) for (g, i), found in best.items() for s, d in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["item_id", "doc_id", "score"])

    return counted.filter("doc_id is not null").mapInArrow(batches, "item_id long, doc_id long, score long")


def search(docs: DataFrame, benchmark: DataFrame, top: int = TOP) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id`` and ``score`` of the best documents of each item."""
    spark, out = docs.sparkSession, None
    planned = plans(benchmark)
    last = planned.agg(F.max("slice")).first()[0]
    for at in range(-1 if last is None else last + 1):
        # Bounded by the size of a slice.
        plan = [r.asDict() for r in planned.filter(F.col("slice") == at).collect()]
        vocabulary = sorted({bytes(t) for r in plan for t in r["terms"]})
        plan = [r | {"terms": [bytes(t) for t in r["terms"]]} for r in plan]
        if not plan:
            continue
        counted = materialise(term_counts(docs, vocabulary), "search_counts")
        documents, terms = counted.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        if not documents:
            break
        often = counted.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("df")).collect()
        weights = {r["id"]: math.floor(1000 * math.log((2 * documents + 2) / (2 * r["df"] + 1))) for r in often}
        found = best_rows(counted, plan, vocabulary, weights, documents, terms, top)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = [F.col("score").desc(), F.col("doc_id")]
    rank = lambda *keys: F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    out = out.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    out = out.withColumn("_rank", rank("item_id", "_salt")).filter(F.col("_rank") <= top).drop("_salt", "_rank")
    return out.withColumn("rank", rank("item_id")).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def op13_lexical(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op13_lexical": op13_lexical}
ORACLES: dict[str, str] = {
    "op13_lexical": r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), l AS (
  SELECT row_id, doc_id, len(terms)::BIGINT AS n, terms FROM d WHERE len(terms) > 0
), c AS (
  SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM l
), i AS (
  SELECT item_id, term, count(*)::BIGINT AS k FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT DISTINCT item_id, text FROM benchmark)
  ) GROUP BY item_id, term
), t AS (
  SELECT row_id, term, count(*)::BIGINT AS tf FROM (SELECT row_id, unnest(terms) AS term FROM l)
  WHERE term IN (SELECT term FROM i) GROUP BY row_id, term
), w AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM t CROSS JOIN c GROUP BY term, docs
), p AS (
  SELECT t.row_id, t.term, w.w * ((1000000000 * t.tf) // (1000 * t.tf + 8 * (100 - 75 + (75 * l.n * c.docs) // c.total))) AS part
  FROM t JOIN w USING (term) JOIN l USING (row_id) CROSS JOIN c
), s AS (
  SELECT i.item_id, p.row_id, sum(i.k * p.part)::BIGINT AS score FROM i JOIN p USING (term) GROUP BY i.item_id, p.row_id
), r AS (
  SELECT s.item_id, l.doc_id, s.score,
         row_number() OVER (PARTITION BY s.item_id ORDER BY s.score DESC, l.doc_id)::INT AS rank
  FROM s JOIN l USING (row_id) WHERE s.score > 0 AND l.doc_id IS NOT NULL
)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
}

by_value(__name__)
