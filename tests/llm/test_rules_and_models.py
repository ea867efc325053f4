import math
import random

import numpy as np
import pytest

from tallyloom.llm import byte_lm, host_rules, language_id, quality_fm, tiling, toxicity, url_model
from tests.llm.helpers import fold, prose, repeated_words


def frame(spark, rows, kinds):
    return spark.createDataFrame(rows, kinds)


# Host rules


def test_measures():
    draw = random.Random(2)
    for _ in range(60):
        words = draw.choices("abcd", k=draw.randint(0, 60))
        assert host_rules.repeated_words([w.encode() for w in words]) == repeated_words(words, 8)
    assert host_rules.measure("é# b\nb\n\x0bb\n\n b\nb".encode()) == (6, 7, 1, 1, 0)


def test_host_verdicts(spark):
    good = [(i, prose(i, 40), "good") for i in range(60)]
    bad = [(100 + i, "short" if i % 10 else prose(i, 40), "bad") for i in range(60)]
    few = [(200, "short", "few"), (201, prose(3, 30), None), (202, None, None), (203, prose(4, 30), "few")]
    rows = {r.doc_id: r for r in host_rules.judge(frame(spark, good + bad + few, "doc_id long, text string, source string")).collect()}
    assert all(rows[i].kept for i in range(60)) and not any(rows[100 + i].kept for i in range(60))
    assert rows[201].kept and not rows[202].kept and not rows[200].kept and rows[202].n_words == 0
    # One failure of two documents is shrunk towards the other hosts' rates.
    assert rows[203].host_docs == 2 and rows[203].host_failed == 1
    empty = frame(spark, [], "doc_id long, text string, source string")
    assert host_rules.judge(empty).count() == 0


# URLs


def test_url_parts_and_rules(spark):
    urls = ["http://A.Example.com/en/x?q", "https://www.example.com/en/1#t", "x.net/es/", "http://b.net/es", None, "", "http://a.com", "ftp://q.NET/es/2"]
    rows = url_model.filter_urls(frame(spark, [(i, u, "h", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, rule int"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows.collect()}
    assert got[0] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert got[1] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[2][:3] == got[4][:3] == got[5][:3] == ("", "", None)
    assert got[3][:3] == ("b.net", "/es", None) and got[6][:3] == ("a.com", "", None)
    assert got[7] == ("q.net", "/es/2", "net/es/", "block")
    assert url_model.filter_urls(frame(spark, [], "page_id long, url string")).count() == 0


def test_url_model_separates_and_is_a_distribution(spark):
    draw = random.Random(1)
    rows = [(i, f"http://{prose(i, 1)}.{'com' if i % 2 else 'net'}/{'de' if i % 2 else 'es'}/{prose(i + 9, 1)}") for i in range(400)]
    rows += [(1000 + i, f"http://{prose(i + 5000, 1)}.org/{'de' if i % 2 else 'es'}/{draw.randint(1, 99)}") for i in range(60)]
    got = {r.page_id: r for r in url_model.filter_urls(frame(spark, rows, "page_id long, url string")).collect()}
    right = sum((got[1000 + i].verdict == "allow") == (i % 2 == 1) for i in range(60))
    assert right >= 54
    tables = np.zeros((2, 2, url_model.ORDERS * url_model.BUCKETS), np.int32)
    assert np.allclose(url_model.scores([b"http://x", b""], tables), 0)


# Classifiers


def labelled(n=240):
    rows, labels = [], []
    for i in range(n):
        text, bad = prose(i, 60), i % 2
        if bad:
            text = " ".join(w + "$$$" for w in text.split())
        rows.append((i, text, len(text)))
        labels.append((i, 1 - bad))
    return rows, labels


def test_quality(spark):
    rows, labels = labelled()
    docs = frame(spark, rows + [(900, None, None), (901, "", 0), (902, "x " * 40000, None)], "doc_id long, text string, n_chars long")
    wanted = frame(spark, labels + [(None, 1), (3, 0)], "doc_id long, quality int")
    machine = quality_fm.fit(docs, quality_fm.learnable(wanted), "quality", ("n_chars",))
    got = {r.doc_id: r for r in quality_fm.score(docs, machine, ("n_chars",)).collect()}
    held = [i for i, *_ in rows if fold(i, 3) == 1]
    assert len(held) > 40 and np.mean([got[i].predicted == dict(labels)[i] for i in held]) > 0.95
    assert all(0 <= got[i].score <= 1 for i in (900, 901, 902))
    none = quality_fm.fit(docs, wanted.filter("false"), "quality")
    assert {r.predicted for r in quality_fm.score(docs, none).collect()} == {1}
    assert quality_fm.score(docs.filter("false"), machine, ("n_chars",)).count() == 0


def test_machine_pairs_equal_the_double_sum():
    machine, draw = quality_fm.Machine(2), np.random.default_rng(1)
    machine.factors = draw.normal(size=machine.factors.shape)
    index, x = np.array([3, 9, 20, quality_fm.WORD_BUCKETS]), draw.normal(size=4)
    raw = machine.raw(index, x, np.zeros(4, np.int64), 1)[0][0]
    v = machine.factors[index]
    assert math.isclose(raw, sum(v[i] @ v[j] * x[i] * x[j] for i in range(4) for j in range(i)), rel_tol=1e-9)


def test_toxicity_finds_unseen_misspellings(spark):
    rows, labels = [], []
    for i in range(300):
        words = prose(i, 60).split()
        if i % 3 == 0:
            words[i % 60] = ["zorgblat", "quixfump", "zorgblut", "quixfomp"][i % 4]
            words[(i + 30) % 60] = "zorgblat"
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 3 == 0)))
    rows += [(900, prose(7, 30) + " zorgblatt " + prose(8, 30)), (901, None), (902, ""), (903, " \n "), (904, prose(77, 60))]
    docs, wanted = frame(spark, rows, "doc_id long, text string"), frame(spark, labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, wanted.filter("doc_id % 5 != 1"), "toxic")
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert np.mean([got[i].predicted == t for i, t in labels if i % 5 == 1]) > 0.9
    assert got[900].predicted == 1 and not any(got[i].predicted for i in (901, 902, 903, 904))
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.score(docs.filter("false"), model).count() == 0


def test_toxicity_passages_start_at_every_word():
    weights, text = np.random.default_rng(2).normal(size=toxicity.BUCKETS), prose(6, 90) + " same same other same"
    words = text.lower().encode().split()

    def mean(part):
        found = [toxicity.hashed([w])[0] for w in dict.fromkeys(part)]
        return sum(weights[b].mean() for b in found) / toxicity.PASSAGE

    want = max(mean(words[k : k + toxicity.PASSAGE]) for k in range(len(words)))
    assert math.isclose(toxicity.log_odds(text, weights, 0.0), want)
    index, share = toxicity.strongest_passage(text, weights)
    assert math.isclose((weights[index] * share).sum(), want)
    for n in range(1, 20):
        assert toxicity.log_odds("clean " * n + text, weights, 0.0) >= want - 1e-9


def test_toxicity_blocks_do_not_matter(monkeypatch):
    weights, text = np.random.default_rng(1).normal(size=toxicity.BUCKETS), prose(5, 500)
    whole = toxicity.log_odds(text, weights, 0.1)
    monkeypatch.setattr(toxicity, "BLOCK", 100)
    assert math.isclose(toxicity.log_odds(text, weights, 0.1), whole)


def test_language(spark):
    alphabets = {"aa": ["ra", "to", "mi"], "bb": ["zu", "wek", "prö"], "cc": ["ñe", "lló", "qui"]}
    rows = [(i, prose(i, 25, alphabets[k]), k) for i in range(180) for k in [list(alphabets)[i % 3]]]
    rows += [(900, None, "aa"), (901, "123 ²!", "aa"), (902, "wek zu", None)]
    docs = frame(spark, rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs, language_id.fold("doc_id", 4) != 2)
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    assert all(got[i].lang_pred == k and 0 < got[i].score <= 1 for i, _, k in rows[:180])
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[900].score == 0 and got[902].lang_pred == "bb"
    assert (model.weights == 0).mean() > 0.5
    assert {r.lang_pred for r in language_id.predict(docs, None).collect()} == {"und"}
    assert language_id.fit(docs.filter("false"), language_id.fold("doc_id", 4) != 2) is None


def test_language_counts(monkeypatch):
    text = "Ab c déf " * 50
    whole = language_id.counts(text)
    assert whole[1].sum() == 3 * len(text) - 3
    monkeypatch.setattr(language_id, "BLOCK", 7)
    assert all((a == b).all() for a, b in zip(language_id.counts(text), whole))


# Language-model scoring


def brute_losses(texts, targets):
    """Interpolated probabilities straight from the definition."""
    pad = bytes(byte_lm.ORDER - 1)

    def table(chosen):
        seen = {}
        for t in chosen:
            raw = pad + t
            for i in range(len(pad), len(raw)):
                for k in range(byte_lm.ORDER):
                    seen.setdefault(raw[i - k : i], {}).setdefault(raw[i], 0)
                    seen[raw[i - k : i]][raw[i]] += 1
        return seen

    def loss(seen, t):
        raw, total = pad + t, 0.0
        for i in range(len(pad), len(raw)):
            p = 1 / 256
            for k in range(byte_lm.ORDER):
                nexts = seen.get(raw[i - k : i], {})
                if nexts:
                    p = (nexts.get(raw[i], 0) + len(nexts) * p) / (sum(nexts.values()) + len(nexts))
            total -= math.log(p)
        return total / len(t)

    corpus, target = table(texts), table([t for t, x in zip(texts, targets) if x])
    return [(loss(corpus, t), loss(target, t)) if t else (None, None) for t in texts]


@pytest.mark.parametrize("limit", [byte_lm.BROADCAST_GRAMS, 0])
def test_losses_equal_the_definition(spark, limit):
    texts = [prose(i, 12) for i in range(8)] + ["", None, "é", "aaaa aaaa", prose(1, 12)]
    docs = frame(spark, [(i, t, 0.5) for i, t in enumerate(texts)], "doc_id long, text string, loss double")
    target = frame(spark, [(i,) for i in (1, 2, 3, 3, None)], "doc_id long")
    got = {r.doc_id: r for r in byte_lm.score(docs, target, limit).collect()}
    want = brute_losses([(t or "").encode() for t in texts], [i in (1, 2, 3) for i in range(len(texts))])
    for i, (loss, loss_target) in enumerate(want):
        if loss is None:
            assert got[i].score is None and got[i].n_tokens == 0
        else:
            assert math.isclose(got[i].loss, loss, rel_tol=1e-5) and math.isclose(got[i].score, loss_target - loss, abs_tol=1e-5)
    assert byte_lm.score(docs.filter("false"), target, limit).count() == 0


# Tiling


def brute_tiles(item, doc, least):
    """Greedy tiling by its definition: always the longest unmarked common run, first in item then document order."""
    a, b, covered = [True] * len(item), [True] * len(doc), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and a[i + n] and b[d + n] and item[i + n] == doc[d + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, d)
        n, i, d = best
        if n < least:
            return covered
        a[i : i + n], b[d : d + n], covered = [False] * n, [False] * n, covered + n


def test_tiles_equal_the_definition():
    draw = np.random.default_rng(3)
    for _ in range(150):
        item = draw.integers(0, 6, draw.integers(3, 25)).astype(np.uint64)
        doc = draw.integers(0, 6, draw.integers(1, 60)).astype(np.uint64)
        found = tiling.tiles(item, doc, 3)
        for n, i, d in found:
            assert n >= 3 and (item[i : i + n] == doc[d : d + n]).all()
        assert len({k for n, i, _ in found for k in range(i, i + n)}) == sum(n for n, *_ in found)
        assert len({k for n, _, d in found for k in range(d, d + n)}) == sum(n for n, *_ in found)


def test_distinct_words_are_covered_as_by_the_definition():
    draw = random.Random(5)
    for _ in range(60):
        item = list(range(30))
        parts = [item[:8], item[8:17], item[17:30]]
        draw.shuffle(parts)
        doc = [x for p in parts for x in [draw.randint(100, 200) for _ in range(draw.randint(0, 9))] + p[: draw.randint(2, len(p))]]
        got = sum(n for n, *_ in tiling.tiles(np.array(item, np.uint64), np.array(doc, np.uint64), 5))
        assert got == brute_tiles(item, doc, 5)


def test_contamination(spark, monkeypatch):
    items = [prose(1000 + k, 40) for k in range(4)] + ["tiny item", "", None, prose(1000, 40)]
    w = items[0].split()
    docs = [
        prose(1, 200) + " " + items[0].upper() + ", " + prose(2, 100),
        prose(3, 50) + " " + " ".join(w[20:] + ["zz"] + w[:20]),
        prose(4, 50) + " " + " ".join(w[:12]) + " " + prose(5, 50),
        prose(6, 400), None, "", "a Tiny item.", items[2],
    ]
    d = frame(spark, [(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, item_id string")
    b = frame(spark, [(i, t) for i, t in enumerate(items)], "item_id long, text string")
    for words in (tiling.SLICE_WORDS, 50):
        monkeypatch.setattr(tiling, "SLICE_WORDS", words)
        got = {(r.doc_id, r.item_id): r.coverage for r in tiling.overlaps(d, b, slice_words=words).collect()}
        assert {k for k, c in got.items() if c >= 0.5} == {(0, 0), (0, 7), (1, 0), (1, 7), (6, 4), (7, 2)}
        assert math.isclose(got[2, 0], 12 / 40) and got[1, 0] == 1.0
        assert sorted(r.doc_id for r in tiling.clean(d, b).collect()) == [2, 3, 4, 5]
    assert tiling.clean(d, b.filter("false")).count() == len(docs)
    assert tiling.contaminated(d, b.filter("false")).count() == 0 and tiling.contaminated(d.filter("false"), b).count() == 0
