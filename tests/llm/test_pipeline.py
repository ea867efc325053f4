"""Every stage of the corpus pipeline, and the whole, against plain versions."""

import random
import re
import string

import numpy as np
import pytest

import corpus_pipeline
from tallyloom.llm import packing, quality_fm
from tests.llm.helpers import fold, jaccard_components, prose

KINDS = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, node string, component_id int, size int, _bucket int"
STAGE = dict(corpus_pipeline.STAGES)
GOOD, BAD = ["ra", "to", "mi", "len", "sor"], ["zzq", "xxk", "wvv"]


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", f"s{k % 3}" if k % 4 else None, None if t is None else len(t), 0.5, 7, "n", 1, 2, 3) for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, KINDS).repartition(3)


def written(spark, folder, labels=(), items=()):
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def kept(df, like):
    assert df.schema.names == like.schema.names and [f.dataType for f in df.schema] == [f.dataType for f in like.schema]
    return df.collect()


def library():
    """Good and bad texts with labels."""
    texts = [prose(i, 30 + i % 50, GOOD) if i % 2 else prose(i, 10 + i % 9, BAD) + " #### |||" for i in range(120)]
    return texts, [(i, i % 2, 0) for i in range(120)]


def test_names_and_order_of_the_stages():
    assert list(STAGE) == ["quality", "near_duplicates", "decontamination", "pii", "packing"] and corpus_pipeline.ORACLE_SQL is None


def test_quality_keeps_what_the_plain_machine_accepts(spark, tmp_path):
    texts, labels = library()
    texts += [None, "", " \n", prose(7, 4000, GOOD) * 30, texts[1], texts[1]]
    df, folder = frame(spark, texts), written(spark, tmp_path, labels)
    got = kept(STAGE["quality"](spark, df, folder), df)
    machine = quality_fm.fit(df, quality_fm.learnable(spark.read.parquet(f"{folder}/labels.parquet")), "quality", ("n_chars",))
    import pyarrow as pa

    accepted = set()
    for i, text in enumerate(texts):
        batch = pa.RecordBatch.from_pydict({"text": [text], "n_chars": [None if text is None else float(len(text))]}, pa.schema([("text", pa.string()), ("n_chars", pa.float64())]))
        ((index, value),) = quality_fm.inputs(batch, ("n_chars",))
        x, v = machine.scaled(index, value), machine.factors[index].astype(float)
        # Every pair of inputs one by one.
        pairs = sum(float(v[a] @ v[b]) * x[a] * x[b] for a in range(len(index)) for b in range(a + 1, len(index))) if len(index) < 400 else None
        if pairs is None:
            total = (v * x[:, None]).sum(0)
            pairs = float((total**2 - ((v * x[:, None]) ** 2).sum(0)).sum() / 2)
        if machine.bias + float(machine.linear[index] @ x) + pairs >= 0:
            accepted.add(i)
    assert {r.doc_id for r in got} == accepted
    held = [i for i in range(120) if fold(i, 3) == 1]
    assert all((i in accepted) == (i % 2 == 1) for i in held) and sum(r.text == texts[1] for r in got) == 3


def test_near_duplicates_keep_the_first_of_each_group(spark, tmp_path):
    draw, texts = random.Random(4), []
    for family in range(6):
        base = prose(family, 80).split()
        for _ in range(8):
            words = list(base)
            for _ in range(draw.choice([0, 1, 1, 3, 9])):
                words[draw.randrange(80)] = prose(draw.random(), 1)
            texts.append(" ".join(words))
    texts += [None, None, "", "", "one", "One", prose(1, 3000) * 20, prose(1, 3000) * 20 + " x"]
    ids = list(range(len(texts)))
    groups = jaccard_components(list(zip(ids, texts)), 5, 80, 100)
    # Rows with one id are one document.
    df = frame(spark, texts + [texts[0], texts[9], None], ids + [0, 9, None])
    got = kept(STAGE["near_duplicates"](spark, df, str(tmp_path)), df)
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted(i for i, (_, smallest) in groups.items() if smallest == i)
    assert sum(r.doc_id is None for r in got) == 1


def coverage(item: str, text: str) -> float:
    """Greedy tiling with runs of five words, by looking at all pairs of places."""
    words = lambda t: [w for w in (x.strip(".,;:!?\"'()[]{}*_") for x in t.lower().split()) if w]
    a, b = words(item), words(text)
    free_a, free_b, least, marked = [True] * len(a), [True] * len(b), min(5, len(a)), 0
    while least:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and free_a[i + n] and free_b[j + n] and a[i + n] == b[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < least:
            break
        free_a[i : i + n], free_b[j : j + n] = [False] * n, [False] * n
        marked += n
    return marked / len(a) if a else 0.0


def test_decontamination_equals_tiling_by_all_pairs(spark, tmp_path):
    draw = random.Random(8)
    items = [(k, prose(1000 + k, 24)) for k in range(6)] + [(6, None), (7, ""), (8, "tiny item"), (9, prose(1000, 24)), (None, prose(1009, 20))]
    texts = []
    for k in range(40):
        w = items[k % 6][1].split()
        runs = [w[a : a + 6] for a in range(0, 24, 6)]
        draw.shuffle(runs)
        texts.append(prose(k, 15) + " " + " ".join(x for r in runs[: draw.randint(0, 4)] for x in [*r, prose(draw.random(), 2)]))
    texts += [None, "", "a Tiny, item!", texts[0], prose(3, 5000) * 4 + " " + items[0][1], prose(5, 20) + " " + items[-1][1]]
    df = frame(spark, texts)
    got = {r.doc_id for r in kept(STAGE["decontamination"](spark, df, written(spark, tmp_path, items=items)), df)}
    short = [t if t is None or len(t) < 5000 else t[-400:] for t in texts]
    assert got == {i for i, t in enumerate(short) if all(coverage(x or "", t or "") < 0.5 for _, x in items)}


def test_pseudonyms_replace_values_alike_in_all_documents(spark, tmp_path):
    card, mail = "4111 1111 1111 1111", "ann.b@example.com"
    texts = [f"pay {card} now", f"again {card}, {mail}", f"{mail}", "clean text 12", None, "", f"{card} " * 2000, f"pay {card} now"]
    df = frame(spark, texts)
    got = {r.doc_id: r.text for r in kept(STAGE["pii"](spark, df, str(tmp_path)), df)}
    new = re.fullmatch(r"pay (\d{4} \d{4} \d{4} \d{4}) now", got[0])[1]
    other = got[2]
    assert new != card and other != mail and other.endswith("@example.com")
    want = [t if t is None else t.replace(card, new).replace(mail, other) for t in texts]
    assert [got[i] for i in range(len(texts))] == want


def test_packing_holds_every_token_once(spark, tmp_path):
    texts = [prose(k, draw) for k, draw in enumerate([3, 40, 200, 2500, 1, 90])] + [None, "", prose(3, 60), prose(3, 60)]
    df = frame(spark, texts)
    got = STAGE["packing"](spark, df, str(tmp_path)).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    from tokenizers import Tokenizer
    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    for i, t in enumerate(texts):
        n, at = len(tok.encode(t or "", add_special_tokens=False).ids) + 1, 0
        for start, length, total in sorted(by_doc[i]):
            assert start == at and total == n
            at += length
        assert at == n
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.SIZE


@pytest.mark.parametrize("name", list(STAGE))
def test_stages_of_nothing(spark, tmp_path, name):
    df = frame(spark, ["x"]).limit(0)
    assert STAGE[name](spark, df, written(spark, tmp_path)).count() == 0


def test_the_whole_is_its_stages_one_after_the_other(spark, tmp_path):
    texts, labels = library()
    item = " ".join(random.Random(k).choice(string.ascii_lowercase) * 3 + str(k) for k in range(30))
    texts += [texts[1], texts[3] + " " + prose(1, 1, GOOD), prose(7, 60, GOOD) + " " + item, prose(9, 60, GOOD) + " mail ann@example.com"]
    folder = written(spark, tmp_path, labels, [(0, item)])
    docs = frame(spark, texts).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{folder}/documents.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = spark.createDataFrame(stage(spark, now, folder).collect(), stage(spark, now, folder).schema)
    key = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in df.collect())
    got = key(corpus_pipeline.run(spark, folder))
    assert got == key(now) and got
    ids = {r[0] for r in got}
    assert 1 in ids and not ids & {120, 121, 122} and 123 in ids and not any(i % 2 == 0 for i in ids if i < 120 and fold(i, 3) == 1)
    assert np.all([r[2] > 0 for r in got])
