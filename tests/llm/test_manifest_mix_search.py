import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from tallyloom.llm import curriculum, lexical, merkle
from tests.llm.helpers import prose

KINDS = "doc_id long, source string, lang string, n_chars long, text string, h string, n int, _g int, before int, total int, _part int, k int"


def rows(count: int):
    """A hot source, nulls in every column, equal ids, equal rows, empty and very long texts."""
    out = []
    for i in range(count):
        source = "hot" if i % 3 else f"s{i % 7}" if i % 5 else "é\U0001f600"
        out.append((i * 7919 % 1000, source, "en", i, prose(i, i % 30) + (" Über A" if i % 4 else "")))
    out += [(None, None, None, None, None), (None, "hot", None, 3, ""), (5, None, "de", None, "a b"), (5, None, "de", None, "a b")]
    out += [(3, "", "en", 1, None), (2000, "alone", "en", 1, "Word"), (2001, "long", "en", 9, prose(1, 2000) * 60), (7, "hot", None, 0, " \n\t")]
    return out


def frame(spark, data):
    return spark.createDataFrame([r + ("x", 1, 2, 3, 4, 5, 6) for r in data], KINDS).repartition(3)


# Merkle manifest


def digest(*parts) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row) -> str:
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climb(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """Root of a list of digests and the proof of each."""
    proofs, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(place):
            run = nodes[p // 16 * 16 : p // 16 * 16 + 16]
            proofs[i].append(("".join(run[: p % 16]), "".join(run[p % 16 + 1 :])))
        nodes = [digest(*nodes[k : k + 16]) for k in range(0, len(nodes), 16)]
        place = [p // 16 for p in place]
    return nodes[0], proofs


def manifest_of(data):
    by_source = collections.defaultdict(list)
    for r in data:
        by_source[r[1]].append(r)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        ordered = sorted(by_source[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[name] = ordered, *climb([leaf(r) for r in ordered])
    root, tops = climb([trees[n][1] for n in names])
    out = []
    for name, top in zip(names, tops):
        ordered, subroot, proofs = trees[name]
        for r, proof in zip(ordered, proofs):
            proof = proof + top
            shown = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                shown = (*r[:4], re.sub("[A-Z]", lambda m: m[0].lower(), r[4]))
            now = leaf(shown)
            for before, after in proof:
                now = digest(before, now, after)
            out.append((r[0] or -1, leaf(r), subroot, root, digest(*[a + b for a, b in proof]), now, now == root))
    return sorted(out)


def merkle_rows(spark, data, tmp_path):
    frame(spark, data).write.parquet(f"{tmp_path}/documents.parquet")
    return sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in merkle.op11_merkle(spark, str(tmp_path)).collect())


def test_manifest_equals_plain_trees(spark, tmp_path):
    data = rows(300)
    got = merkle_rows(spark, data, tmp_path)
    assert [(i if i else -1, *r) for i, *r in got] == [tuple(r) for r in manifest_of(data)]
    assert {r[-1] for r in got} == {True, False}


def test_manifest_over_several_rounds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 16)
    data = rows(420) + [(5000 + i, f"many{i}", None, None, "x") for i in range(30)]
    assert [(i if i else -1, *r) for i, *r in merkle_rows(spark, data, tmp_path)] == [tuple(r) for r in manifest_of(data)]


def test_manifest_of_nothing_and_of_one(spark):
    df = frame(spark, [(1, None, None, None, "A")])
    (only,) = merkle.manifest(df, merkle.FIELDS, "source", "doc_id").collect()
    assert only.leaf == only.subroot == only.root == leaf((1, None, None, None, "A")) and only.proof == []
    assert merkle.manifest(df.filter("false"), merkle.FIELDS, "source", "doc_id").count() == 0


# Mixing


def test_targets_are_met_to_the_word(spark):
    data = rows(300)
    got = curriculum.mix(frame(spark, data)).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r.doc_id or -1, r.source or "", r.size) for r in got) == sorted((r[0] or -1, r[1] or "", words(r[4])) for r in data)
    sizes = collections.Counter()
    for r in data:
        sizes[r[1]] += words(r[4])
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, limit = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, {s: 2 * sizes[s] for s in names}
    target, full = {}, set()
    while True:
        left = 1.5 * sum(sizes.values()) - sum(limit[s] for s in full)
        target = {s: limit[s] if s in full else left * weight[s] / sum(weight[t] for t in names if t not in full) for s in names}
        more = {s for s in names if target[s] > limit[s]}
        if not more:
            break
        full |= more
    taken = collections.Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r.size and r.taken == sum(u.words for u in r.uses)
    assert all(taken[s] == math.floor(target[s] + 0.5) for s in names)
    assert sorted(got, key=repr) == sorted(curriculum.mix(frame(spark, data)).collect(), key=repr)


def test_sequence_follows_the_schedules(spark):
    data = [(i, "abc"[i % 3], None, None, prose(i, 20)) for i in range(3000)]
    order = curriculum.sequence(curriculum.mix(frame(spark, data), epochs=9)).collect()
    assert [r.position for r in order] == sorted(r.position for r in order) and 0 <= order[0].position and order[-1].position <= 1
    for k, schedule in enumerate(curriculum.SCHEDULES):
        own = [r for r in order if r.source == "abc"[k]]
        whole = sum(r.words for r in own)
        for until in (0.25, 0.5, 0.75):
            (_, w0), (_, w1) = schedule
            asked = (w0 * until + (w1 - w0) * until**2 / 2) / curriculum.integral(schedule)
            assert sum(r.words for r in own if r.position < until) / whole == pytest.approx(asked, abs=0.03)


def test_inverse_of_schedules_with_several_knots(spark):
    schedule = ((0.0, 0.0), (0.25, 2.0), (0.5, 0.0), (1.0, 1.0))
    shares = [k / 50 for k in range(51)]
    df = spark.createDataFrame([(s,) for s in shares], "share double")
    got = [r[0] for r in df.select(curriculum.time_of(schedule, df.share)).collect()]
    times = np.linspace(0, 1, 200_001)
    passed = np.cumsum(np.interp(times, *zip(*schedule))) / 200_000 / curriculum.integral(schedule)
    for share, t in zip(shares, got):
        assert passed[min(200_000, int(t * 200_000))] == pytest.approx(share, abs=1e-4)


def test_mix_of_nothing(spark):
    assert curriculum.mix(frame(spark, []).limit(0)).count() == 0
    silent = frame(spark, [(1, "a", None, None, None), (2, "b", None, None, " ")])
    assert [(r.size, r.target, r.taken, r.position) for r in curriculum.mix(silent).collect()] == [(0, 0.0, 0, None)] * 2


# Search


def ranked(documents, items, top=10):
    lower = str.maketrans(lexical.UPPER, lexical.LOWER)
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(lower))
    docs = [(i, collections.Counter(terms(t))) for i, t in documents]
    docs = [(i, c, c.total()) for i, c in docs if c]
    count, total = len(docs), sum(n for *_, n in docs)
    df = collections.Counter(t for _, c, _ in docs for t in c)
    asked = collections.defaultdict(collections.Counter)
    for i, t in set(items):
        asked[i].update(terms(t))
    out = []
    for item, wanted in asked.items():
        found = []
        for i, c, n in docs:
            m = 25 + 75 * n * count // total
            score = 0
            for t, k in wanted.items():
                if c[t]:
                    w = math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1)))
                    score += k * w * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0 and i is not None:
                found.append((-score, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:top])]
    return sorted(out, key=lambda r: (r[0] is not None, r))


def library():
    common = "The of-and a b c d e f g"
    docs = [(i, f"{prose(i % 60, 25)} {common if i % 2 else ''} Straße ÄB été{i % 5}") for i in range(150)]
    docs += [(None, prose(1, 20)), (900, None), (901, ""), (902, "... !"), (7, docs[7][1]), (903, prose(2, 3000) * 40)]
    items = [(k, f"{common} {prose(k, 12)} the THE straße {prose(k % 4, 6)}") for k in range(25)]
    items += [(3, items[3][1]), (4, "été1 Äb äb"), (50, None), (51, "?!"), (52, "nowhere"), (None, prose(9, 5)), (53, prose(2, 400))]
    return docs, items


def found(spark, docs, items, **how):
    d = spark.createDataFrame([(*r, 1, "y", 2) for r in docs], "doc_id long, text string, n int, ids string, score int").repartition(3)
    b = spark.createDataFrame([(*r, 1, "z") for r in items], "item_id long, text string, rank int, terms string")
    return sorted((tuple(r) for r in lexical.search(d, b, **how).collect()), key=lambda r: (r[0] is not None, r))


def test_search_equals_scoring_all_pairs(spark):
    docs, items = library()
    assert found(spark, docs, items) == ranked(docs, items)


def test_search_in_slices_and_groups_and_with_ties(spark, monkeypatch):
    docs, items = library()
    docs += [(1000 + k, "a b c") for k in range(60)]
    monkeypatch.setattr(lexical, "SLICE_TERMS", 200)
    monkeypatch.setattr(lexical, "GROUP_TERMS", 60)
    monkeypatch.setattr(lexical, "PIECE", 64)
    assert found(spark, docs, [*items, (60, "a"), (61, "a b")], top=3) == ranked(docs, [*items, (60, "a"), (61, "a b")], top=3)


def test_search_of_nothing(spark):
    docs, items = library()
    assert found(spark, [], items[:3]) == [] and found(spark, docs[:5], []) == [] and found(spark, [(1, "!")], items[:3]) == []


def test_shared_pairs_make_up_the_lists():
    draw = np.random.default_rng(3)
    lists = [sorted(set(draw.integers(0, 40, draw.integers(0, 30)).tolist())) for _ in range(60)]
    sums, pairs = lexical.shared_pairs(lists, 40)
    parts = [{s} for s in range(40)]
    for a, b in pairs:
        assert not parts[a] & parts[b]
        parts.append(parts[a] | parts[b])
    for own, left in zip(lists, sums):
        assert sorted(t for s in left for t in parts[s]) == own
    # Sharing saves additions.
    assert len(pairs) + sum(map(len, sums)) < sum(map(len, lists))
