import random

import numpy as np
from pyspark.sql import functions as F

from tallyloom.llm import components, jaccard_join
from tests.llm.helpers import jaccard_components, prose


def near_copies(seed: int):
    """Families of copies with more and more words changed, very short texts, exact copies, a shared passage."""
    draw, rows, passage = random.Random(seed), [], prose(999, 30)
    for family in range(4):
        base = prose(family, 60).split()
        for _ in range(12):
            words = list(base)
            for _ in range(draw.choice([0, 1, 1, 2, 3, 5])):
                words[draw.randrange(len(words))] = prose(draw.random(), 1)
            rows.append(" ".join(words))
    rows += [prose(50 + k, 20) + " " + passage for k in range(10)]
    rows += ["", " \n", None, "one", "One", "one two", "ONE TWO", "one two three four five six"] * 2
    return list(enumerate(rows))


def found(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit(1)).withColumn("node", F.lit("x"))
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(df.repartition(5), **how).collect()}


def test_join_equals_all_pairs(spark):
    rows = near_copies(1)
    for n, num in ((5, 80), (3, 90)):
        assert found(spark, rows, n=n, num=num, den=100) == jaccard_components(rows, n, num, 100)


def test_split_blocks_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 300)
    rows = near_copies(2)
    assert found(spark, rows, n=3, num=70, den=100) == jaccard_components(rows, 3, 70, 100)


def test_null_ids_repeated_rows_and_empty_table(spark):
    text = prose(1, 40)
    rows = [(None, text), (5, text), (5, text), (7, text), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in jaccard_join.join(df).collect())
    assert got == [(0, 0), (0, 0), (5, 5), (5, 5), (7, 5)]
    assert jaccard_join.join(df.filter("false")).count() == 0


def test_occurrences_equal_counting():
    draw = np.random.default_rng(4)
    sets = [np.unique(draw.integers(0, 60, draw.integers(1, 40))) for _ in range(40)]
    lists = {}
    for i, s in enumerate(sets):
        for t in s.tolist():
            lists.setdefault(t, []).append(i)
    for q in sets:
        for least in (1, 2, 5, max(1, len(q) - 1), len(q)):
            want = {i for i, s in enumerate(sets) if len(np.intersect1d(q, s)) >= least}
            ordered = sorted(q.tolist(), key=lambda t: len(lists[t]))
            assert set(jaccard_join.occurrences(ordered, lists, least)) == want


def test_linking_sets_share_a_part():
    draw = np.random.default_rng(8)
    bands = jaccard_join.Bands(80, 100)
    for _ in range(300):
        a = np.unique(draw.integers(0, 2**63, draw.integers(1, 80)).astype(np.uint64))
        b = np.unique(np.concatenate([a[draw.random(len(a)) > 0.1], draw.integers(0, 2**63, draw.integers(0, 8)).astype(np.uint64)]))
        common = np.sort(draw.choice(a, len(a) // 2, replace=False))
        if len(b) and jaccard_join.linked(a, b, 80, 100):
            shared = np.intersect1d(jaccard_join.signatures(a, bands, common), jaccard_join.signatures(b, bands, common))
            assert len(shared)


def test_components_of_paths_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200), (None, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(1, 41)} | {k: 100 for k in range(100, 160)} | {200: 200, 201: 200}


def test_few_edges_take_no_rounds(spark, monkeypatch):
    written, materialise = [], components.materialise
    monkeypatch.setattr(components, "materialise", lambda df, name: written.append(name) or materialise(df, name))
    draw = random.Random(3)
    edges = [(draw.randrange(-400, 400) << 40, draw.randrange(-400, 400) << 40) for _ in range(350)] + [(k, k + 1) for k in range(99, 0, -1)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    few = sorted(map(tuple, components.components(df).collect()))
    assert written == ["edges", "components"]
    assert components.components(df.filter("false")).collect() == []
    monkeypatch.setattr(components, "TASK_EDGES", 10)
    written.clear()
    assert sorted(map(tuple, components.components(df).collect())) == few and len(written) > 3
    # Other kinds of nodes go in rounds.
    names = components.components(spark.createDataFrame([("x", "b"), ("b", "c"), ("y", "z")], "a string, b string"))
    assert sorted(map(tuple, names.collect())) == [("b", "b"), ("c", "b"), ("x", "b"), ("y", "y"), ("z", "y")]


def test_join_in_rounds_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(components, "TASK_EDGES", 0)
    rows = near_copies(4)
    assert found(spark, rows, n=3, num=80, den=100) == jaccard_components(rows, 3, 80, 100)


def test_blobs_keep_all_meetings():
    draw = np.random.default_rng(5)
    part = draw.integers(0, 300, 4000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    doc = draw.integers(0, 900, 4000).astype("<i8")
    slices, pairs = {}, []
    for at in (0, 1000, 2000, 3000):
        for name, ids, counts, prints in jaccard_join.packed(part[at : at + 1000], doc[at : at + 1000], 7):
            if name < 0:
                pairs.append(np.stack([np.frombuffer(ids, "<i8"), np.frombuffer(prints, "<i8")]))
            else:
                assert 0 <= name < 7
                slices.setdefault(name, []).append({"ids": ids, "counts": counts, "prints": prints})
    parent = {}
    alone = sum(jaccard_join.meetings(rows).shape[1] for rows in slices.values())
    pairs += [jaccard_join.meetings(rows, parent) for rows in slices.values()]
    assert sum(p.shape[1] for p in pairs[-len(slices) :]) < alone  # a connection is told once

    def groups(a, b):
        names = {}
        jaccard_join.forest(a, b, names)

        def root(x):
            return x if names[x] == x else root(names[x])

        return {x: root(x) for x in names if root(x) != x}

    heads = np.array([doc[part == p].min() for p in part])
    assert groups(*np.concatenate(pairs, 1)) == groups(doc, heads)


def test_linking_sets_share_a_rare_shingle():
    draw = np.random.default_rng(6)
    sketch = draw.integers(0, 4, 1 << jaccard_join.SKETCH_BITS).astype(np.uint8)
    for num in (70, 80, 90):
        for _ in range(200):
            a = np.unique(draw.integers(0, 2**63, draw.integers(1, 80)).astype(np.uint64) * np.uint64(2))
            b = np.unique(np.concatenate([a[draw.random(len(a)) > 0.1], draw.integers(0, 2**63, draw.integers(0, 8)).astype(np.uint64)]))
            if len(b) and jaccard_join.linked(a, b, num, 100):
                # A shingle of both sets occurs more than once.
                sketch[(np.intersect1d(a, b) >> np.uint64(64 - jaccard_join.SKETCH_BITS)).astype(np.int64)] |= 1
                prefixes = [jaccard_join.rare_prefix(x, sketch, num, 100) for x in (a, b)]
                assert len(np.intersect1d(*prefixes))


def test_counts_of_shingles(spark):
    draw = np.random.default_rng(7)
    names = draw.integers(0, 2**63, 3000).astype(np.uint64) * np.uint64(2)
    sets = [np.unique(draw.choice(names, 60)) for _ in range(700)]
    df = spark.createDataFrame([(bytearray(s.tobytes()),) for s in sets], "found binary").repartition(3)
    got, every = jaccard_join.often(df, 42_000), np.concatenate(sets)
    found, counts = np.unique(every, return_counts=True)
    place = (found >> np.uint64(64 - jaccard_join.SKETCH_BITS)).astype(np.int64)
    want = np.zeros(1 << jaccard_join.SKETCH_BITS, np.uint8)
    np.maximum.at(want, place[counts > 1], np.ceil(np.log2(counts[counts > 1])).astype(np.uint8))
    assert (got == want).all()


def by_phrases(seed: int):
    """Documents of words of their own that hang together by chance phrases, near copies and exact copies of some."""
    draw, rows = random.Random(seed), []
    for k in range(60):
        words = prose(1000 + k, 60).split()
        for chance in (k // 2, 100 + k // 3, 200 + k // 20):  # phrases of two, three and twenty documents
            at = draw.randrange(0, 50)
            words[at : at + 7] = prose(chance, 7).split()
        rows.append(" ".join(words))
    for k in range(0, 60, 6):
        words = rows[k].split()
        words[draw.randrange(60)] = "changed"
        rows += [" ".join(words), rows[k]] + ([" ".join(words[:-1])] * 2 if k % 4 else [])
    for _ in range(30):  # more near copies than are counted for each pair
        words = rows[1].split()
        words[draw.randrange(60)] = prose(draw.random(), 1)
        rows.append(" ".join(words))
    return list(enumerate(rows))


def test_chance_phrases_make_no_candidates(spark, monkeypatch):
    texts, sizes = [], []
    for k in range(60):
        words = prose(1000 + k, 60).split()
        words[5:20], words[35:50] = prose(k // 5, 15).split(), prose(100 + k % 12, 15).split()
        texts.append(" ".join(words))
    rows = list(enumerate(texts + [texts[7] + " end", texts[30] + " end"]))
    sets_of = jaccard_join.sets_of

    def counted(docs, nodes, n):
        sizes.append(nodes.count())
        return sets_of(docs, nodes, n)

    monkeypatch.setattr(jaccard_join, "sets_of", counted)
    got = found(spark, rows, n=5, num=80, den=100)
    assert got == jaccard_components(rows, 5, 80, 100) and got[60][1] == 7 and got[61][1] == 30
    assert 4 <= sizes[0] <= 10


def test_small_blocks_and_many_slices_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_PARTS", 200)
    monkeypatch.setattr(jaccard_join, "FEW", 3)
    for rows, n, num in ((near_copies(5), 3, 60), (by_phrases(6), 5, 80)):
        assert found(spark, rows, n=n, num=num, den=100) == jaccard_components(rows, n, num, 100)


def test_linking_sets_share_the_parts_they_need():
    draw = np.random.default_rng(9)
    for num in (60, 80, 90):
        bands = jaccard_join.Bands(num, 100)
        for _ in range(300):
            a = np.unique(draw.integers(0, 2**63, draw.integers(1, 120)).astype(np.uint64))
            b = np.unique(np.concatenate([a[draw.random(len(a)) > 0.1], draw.integers(0, 2**63, draw.integers(0, 12)).astype(np.uint64)]))
            common = np.sort(draw.choice(a, int(len(a) * draw.random()), replace=False))
            if len(b) and jaccard_join.linked(a, b, num, 100):
                (x, least_a), (y, least_b) = (jaccard_join.signed(s, bands, common) for s in (a, b))
                assert len(np.intersect1d(x, y)) >= max(least_a, least_b)


def test_shared_parts_are_summed_in_few_rows(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_PARTS", 200)
    rows, bands, none = by_phrases(7), jaccard_join.Bands(80, 100), np.empty(0, np.uint64)
    rows += rows[:3]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.needed for r in jaccard_join.linkable(df, 5, 80, 100, none, 16).collect()}
    signed = [jaccard_join.signed(next(jaccard_join.shingles([t.encode()], 5)), bands, none) for _, t in rows]
    owners = {}
    for (i, _), (parts, _) in zip(rows, signed):
        for part in parts.tolist():
            owners.setdefault(part, set()).add(i)
    for (i, _), (parts, needed) in zip(rows, signed):
        shared = sum(len(owners[part]) > 1 for part in parts.tolist())
        # What a block holds several times may count twice, and a row that comes again in another block, too.
        assert i in got if shared >= needed else i not in got or 4 * shared >= needed
        assert got.get(i, needed) == needed
