import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tallyloom.llm import packing
from tests.llm.helpers import best_fit_decreasing, prose

ODD = ["a  b", "\n x", "  lead", "trail  ", "", "it's don't  'll", "\t\t x   y", "<|endoftext|> a", "x\x1c y \x85 z", "中文 字", "é́ ²½ 🙂🏽", "x" * 5000]


def reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_ids_equal_those_of_the_tokenizer_file():
    texts = ODD + [prose(k, 200) for k in range(5)]
    want = [e.ids for e in reference().encode_batch(texts, add_special_tokens=False)]
    assert [packing.encoder().encode_to_numpy(t).tolist() for t in texts] == want


def test_long_runs_of_white_space(spark):
    n = 1_100_000
    texts = [" " * n, "a" + "\n" * n + "b", "a" + " " * n + "b " + "\u3000\t\x85 " * (n // 4) + "12", "\x1c" * 70_000 + " " * 70_000 + "\n", prose(1, 20_000)]
    want = [e.ids for e in reference().encode_batch(texts, add_special_tokens=False)]
    assert [packing.encoded(packing.encoder(), t).tolist() for t in texts] == want
    rows = packing.pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.doc_tokens for r in rows} == {i: len(ids) + 1 for i, ids in enumerate(want)}


def test_plan_equals_packing_piece_by_piece():
    draw = random.Random(3)
    for _ in range(200):
        size = draw.choice([8, 16, 37])
        lengths = [draw.randint(1, size) for _ in range(draw.randint(0, 60))]
        held: dict[int, list] = {}
        for length, rank, n, first, offset in packing.best_fit_decreasing(dict(Counter(lengths)), size):
            for k in range(n):
                held.setdefault(first + k, []).append((offset, length))
        for pieces in held.values():
            pieces.sort()
            assert [o for o, _ in pieces] == np.cumsum([0] + [n for _, n in pieces])[:-1].tolist()
        assert sorted(size - sum(n for _, n in p) for p in held.values()) == best_fit_decreasing(lengths, size)


def test_round_trip(spark):
    texts = ODD + [None, prose(1, 3000), prose(1, 3000), prose(2, 900)] + [prose(k, k) for k in range(40)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, length int, _rank int")
    rows = packing.pack(df.repartition(4)).collect()
    want = [e.ids + [0] for e in reference().encode_batch([t or "" for t in texts], add_special_tokens=False)]
    by_doc, by_sequence = {}, {}
    for r in rows:
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert len(ids) == r.length and r.doc_tokens == len(want[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by_doc) == set(range(len(texts))) and set(by_sequence) == set(range(len(by_sequence)))
    for spans, total in [(s, len(want[i])) for i, s in by_doc.items()] + [(s, None) for s in by_sequence.values()]:
        ends = np.cumsum([0] + [n for _, n in sorted(spans)])
        assert [a for a, _ in sorted(spans)] == ends[:-1].tolist() and ends[-1] == (total or ends[-1]) and (total or ends[-1] <= 1024)


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "same words here")] * 5 + [(None, None)], "doc_id long, text string")
    rows = packing.pack(df).collect()
    assert len(rows) == 6 and len({(r.sequence_id, r.offset) for r in rows}) == 6
    assert packing.pack(df.filter("false")).count() == 0
