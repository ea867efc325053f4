"""Each query on tables with nulls, empty and very long texts, repeated rows, ties and columns with clashing names."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import registry
from tests.llm.helpers import prose

CLASHING = ["score", "predicted", "label", "index", "value", "_bucket", "size", "h", "n", "_g", "_part", "node", "target", "position", "kept", "held_out", "rank", "gram", "verdict"]
WORDS = {"en": ["the", "and", "river", "stone"], "de": ["und", "der", "fluss", "stein"]}


def documents():
    draw, rows = random.Random(3), []
    for i in range(150):
        lang = "en" if i % 2 else "de"
        text = " ".join(draw.choices(WORDS[lang], k=12)) + " " + prose(i, 20)
        rows.append((i, text + (" vile scum" if i % 5 == 0 else ""), lang, f"s{i % 4}", len(text)))
    long = prose(999, 3000) + "\n" + "z" * 200_000 + " " + prose(998, 60_000)
    rows += [(200, None, None, None, None), (201, "", "en", "", 0), (202, " \n\t", None, "s1", 3), (203, long, "en", "s2", len(long))]
    rows += [(204, rows[7][1], "de", "s3", 5), (5, *rows[5][1:]), (5, *rows[5][1:]), (None, "no id at all", "en", "s1", 12), (205, "été \U0001f600 %s #", "en", "s1", None)]
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("edges"))
    clash = lambda df: df.withColumns({c: F.lit(1) for c in CLASHING if c not in df.columns})
    save = lambda rows, kinds, name: clash(spark.createDataFrame(rows, kinds)).repartition(3).write.parquet(f"{path}/{name}.parquet")
    save(documents(), "doc_id long, text string, lang string, source string, n_chars long", "documents")
    save([(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(150)] + [(None, 1, 1), (3, 1, 0), (900, 0, 0)], "doc_id long, quality int, toxic int", "labels")
    urls = [f"http://{prose(i, 1)}.{'com' if i % 2 else 'net'}/{'de' if i % 2 else 'es'}/{i}" for i in range(80)]
    urls += [None, "", "x", "http://a.org/" + "y" * 100_000, urls[3], urls[3], "http://", "://", "http://example.com/en"]
    save([(i, u, None) for i, u in enumerate(urls)] + [(None, "http://b.org/de/1", None)], "page_id long, url string, html string", "pages")
    save([(0, prose(7, 20)), (0, prose(7, 20)), (1, None), (2, ""), (None, prose(9, 20)), (3, "the and river")], "item_id long, text string", "benchmark")
    return path


PER_DOCUMENT = ["op2_host_rules", "op3_toxicity", "op4_jaccard_join", "op6_language_id", "op7_quality_fm", "op9_byte_lm", "op10_pseudonyms", "op11_merkle", "op12_curriculum"]


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_documents_each_have_their_row(spark, folder, name):
    rows = registry.all_queries()[name](spark, folder).collect()
    want = documents()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in want)
    result = lambda r: {k: v for k, v in r.asDict().items() if k not in ("proof_sha256", "position", "taken")}
    one, *others = [result(r) for r in rows if r.doc_id == 5]
    assert len(others) == 2 and all(o == one for o in others)
    if name == "op4_jaccard_join":
        found = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
        assert found[204] == (found[7][0], 7) and found[200] == (0, 200) and found[202] == (0, 202) and found[None][1] is None


def test_pages_each_have_their_row(spark, folder):
    rows = registry.all_queries()["op1_url_model"](spark, folder).collect()
    assert len(rows) == 90 and {r.verdict for r in rows} == {"allow", "block"}
    by_id = {r.page_id: r for r in rows}
    assert by_id[84][1:] == by_id[85][1:] == by_id[3][1:] and by_id[None].host == "b.org"
    assert (by_id[80].host, by_id[80].path, by_id[86].host, by_id[88].rule) == ("", "", "", "com/")


def test_packing_and_search_and_tiling(spark, folder):
    queries, want = registry.all_queries(), documents()
    pieces = queries["op8_packing"](spark, folder).collect()
    assert sorted({str(r.doc_id) for r in pieces}) == sorted({str(r[0]) for r in want})
    assert sum(r.length for r in pieces if r.doc_id == 5) == 3 * next(r.doc_tokens for r in pieces if r.doc_id == 5)
    found = queries["op13_lexical"](spark, folder).collect()
    assert {r.item_id for r in found} == {0, 3, None} and all(r.score > 0 and r.doc_id is not None for r in found)
    for item in (0, 3, None):
        own = sorted((r.rank, -r.score, r.doc_id) for r in found if r.item_id == item)
        assert [r for r, *_ in own] == list(range(1, len(own) + 1)) and [x[1:] for x in own] == sorted(x[1:] for x in own)
    assert {(r.doc_id, r.item_id) for r in queries["op5_tiling"](spark, folder).collect()} >= {(7, 0), (204, 0)}


@pytest.mark.parametrize("name", [n for n in [*PER_DOCUMENT, "op1_url_model", "op5_tiling", "op8_packing", "op13_lexical"]])
def test_empty_tables(spark, folder, tmp_path, name):
    for t in ("documents", "labels", "pages", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert registry.all_queries()[name](spark, str(tmp_path)).count() == 0
