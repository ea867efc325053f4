from tallyloom.adapters import FULL_DOC, VAGUE_DOC
from tallyloom.operators import docs as O


def docs(spark, *texts):
    return spark.createDataFrame([(f"d{i}", "p", t) for i, t in enumerate(texts)], "doc_id string, project string, text string")


def test_checks_and_score(spark):
    df = docs(spark, FULL_DOC, "新增", "")
    by_doc = {}
    for r in O.check_documents(df).collect():
        by_doc.setdefault(r.doc_id, {})[r.check] = r
    assert all(r.passed for r in by_doc["d0"].values())
    assert by_doc["d0"]["effort"].value == "2.5 人天" and by_doc["d0"]["priority"].value == "P1"
    assert by_doc["d1"]["task_type"].value == "新增" and not by_doc["d1"]["dependencies"].passed
    assert by_doc["d1"]["api_definition"].value == "缺少：url, params, response, error_codes"
    score = {r.doc_id: (r.score, r.level, r.ready) for r in O.score_documents(df).collect()}
    assert score == {"d0": (100, "优秀", True), "d1": (14, "不合格", False), "d2": (0, "不合格", False)}


def test_vague_phrases_and_issues(spark):
    df = docs(spark, VAGUE_DOC, "nothing here")
    hits = {(r.line_no, r.phrase) for r in O.vague_phrases(df).collect()}
    assert {(2, "优化一下"), (3, "大概"), (3, "几个"), (7, "等等")} <= hits and all(n < 13 for n, _ in hits)
    kinds = {r.severity for r in O.issues(df).filter("doc_id = 'd1'").collect()}
    assert kinds == {"error"}


def test_blocks(spark):
    df = docs(spark, "intro\n### A  \nx\n#### no\n   ### B\ny", "none")
    assert [tuple(r) for r in O.document_blocks(df).orderBy("block_no").collect()] == [
        ("d0", 1, "A", "### A  \nx\n#### no"),
        ("d0", 2, "B", "   ### B\ny"),
    ]


def test_clean_up(spark):
    df = docs(spark, "⽤⼾列表列表\n  中\n文  x​\n\n/api/us\ner/list", "plain")
    got = {r.doc_id: r for r in O.normalise_corpus(df).collect()}
    assert got["d0"].fixed == "用户列表中\n文 x\n/api/user/list" and got["d0"].changed and not got["d1"].changed
    assert O.changed_share(df).first().changed_share == 0.5


def test_endpoints_and_metadata(spark):
    lines = spark.createDataFrame(
        [("d", "call (POST /api/a) and GET /b"), ("d", "GET /api/c→x"), ("d", "see /only/path"), ("d", "1 / 2")],
        "doc_id string, line string",
    )
    got = {(r.method, r.mentions) for r in O.endpoint_mentions(lines).collect()}
    assert got == {("POST", 1), ("GET", 1), ("", 1)}
    meta = O.document_metadata(docs(spark, FULL_DOC)).first()
    assert (meta.version, meta.created, meta.stack, meta.blocks) == ("v1.2", "2024-01-15", "java", 3)


def test_corpus(spark):
    r = O.corpus_report(docs(spark, FULL_DOC, "新增")).first()
    assert (r.docs, r.pass_rate, r.mean_score, r.level_90, r.level_0, r.worst_check) == (2, 0.5, 57.0, 1, 1, "dependencies")
