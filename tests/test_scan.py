import pytest

from tallyloom.adapters import JAVA_LINES, PYTHON_LINES
from tallyloom.operators import scan as S
from tallyloom.rules import code as C
from tallyloom.sources import files as X

LINES = "project string, doc_id string, path string, language string, line_no bigint, line string"


def lines(spark, texts, language):
    return spark.createDataFrame([("p", "d", "p/f", language, i + 1, t) for i, t in enumerate(texts)], LINES)


def rules_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.line_no, set()).add(r.rule_id)
    return out


def test_every_single_line_rule_fires_once_somewhere(spark):
    found = set()
    for language, texts in (("java", JAVA_LINES), ("python", PYTHON_LINES)):
        for hits in rules_of(S.scan(lines(spark, texts, language))).values():
            found |= hits
    # two rules need two lines and are tested line by line
    assert {r[0] for r in C.RULES} - found == {"PY-STYLE-005", "PY-PERF-001"}


def test_comments_case_and_lookahead(spark):
    got = rules_of(S.scan(lines(spark, ["# eval(x)", "EVAL(x)", "open(p) with", "open(p)", "PUBLIC CLASS a"], "python")))
    assert 1 not in got and "PY-SEC-006" in got[2]
    assert "PY-PERF-002" not in got.get(3, set()) and "PY-PERF-002" in got[4]
    assert 5 not in got
    java = rules_of(S.scan(lines(spark, ["PUBLIC CLASS a", "public class a", "* public class a"], "java")))
    assert "JAVA-STYLE-001" not in java[1] and "JAVA-STYLE-005" in java[1]
    assert "JAVA-STYLE-001" in java[2] and 3 not in java


def test_families_and_rule_table(spark):
    df = lines(spark, PYTHON_LINES, "python")
    only = {r for hits in rules_of(S.scan(df, families=("SEC",))).values() for r in hits}
    assert only and all("-SEC-" in r for r in only)
    table = spark.createDataFrame(
        [("python", r[0], r[1], r[2], r[3], S._pattern(r[2], r[5])) for r in S.rules_for("python")],
        "language string, rule_id string, severity string, type string, cwe string, pattern string",
    )
    key = lambda d: sorted((r.finding_id, r.severity, r.code) for r in d.collect())
    assert key(S.scan(df, table)) == key(S.scan(df))


@pytest.mark.parametrize("size", [1, 2, 1 << 16])
def test_suppression_between_switches(spark, size):
    text = ["eval(a)", "# scan-rules: disable=PY-SEC-006", "eval(b)", "x = {}", "# scan-rules: enable=PY-SEC-006", "eval(c)"]
    df = lines(spark, text, "python")
    left = S.suppress(S.scan(df), df, size=size)
    assert sorted(r.line_no for r in left.collect() if r.rule_id == "PY-SEC-006") == [1, 6]


def test_language_and_symbols(spark):
    files = spark.createDataFrame(
        [("a", "a/pom.xml"), ("a", "a/x.py"), ("b", "b/setup.py"), ("b", "b/x.java"), ("c", "c/x.py"), ("c", "c/y.java")],
        "project string, path string",
    )
    assert {r.project: r.language for r in S.detect_language(files).collect()} == {"a": "java", "b": "python", "c": "java"}
    code = spark.createDataFrame(
        [("1", "p/A.java", "java", "class A {\n public int go(int a) {}\n private void stop() {} }"), ("2", "p/m.py", "python", "def f(x):\n  pass")],
        "doc_id string, path string, language string, text string",
    )
    got = {(r.class_name, r.symbol, r.scenario) for r in S.extract_symbols(code).collect()}
    assert len(got) == 9 and ("A", "stop", "boundary") in got and (None, "f", "normal") in got


def test_read_sources_and_lines(spark, tmp_path):
    for name, text in (("src/a.py", "x\r\ny\n"), ("build/b.py", "z"), ("src/c.java", "q")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    df = X.read_sources(spark, str(tmp_path), "python")
    assert df.count() == 1
    assert [r.line for r in X.document_lines(df).orderBy("line_no").collect()] == ["x", "y", ""]
    assert X.document_lines(df, last_empty=False).count() == 2


def test_tables(spark):
    text = ["|接口名称|请求|", "|---|:--|", "| 登录 | POST |", "||GET|", "", "|模块|x|", "|a|b|", "text", "|only|", "end"]
    df = spark.createDataFrame([("d", i + 1, t) for i, t in enumerate(text)], "doc_id string, line_no bigint, line string")
    for size in (2, 1 << 16):
        tables = X.markdown_tables(df, size=size)
        rows = [(r.table_no, r.line_no, r.cells) for r in tables.orderBy("line_no").collect()]
        assert rows == [(1, 3, ["登录", "POST"]), (1, 4, ["GET"]), (2, 7, ["a", "b"])]
    got = [(r.kind, r.content) for r in X.interface_tasks(tables).orderBy("line_no").collect()]
    assert got == [("interface", "登录"), ("interface", "GET"), ("module", "a")]


def test_whole_lines_and_clean_projects(spark):
    df = lines(spark, ["x = eval(" + "a" * 300 + ")"], "python")
    assert all(len(r.code) > 300 for r in S.scan(df).collect() if r.rule_id == "PY-SEC-006")
    files = spark.createDataFrame([("p",), ("clean",), ("p",)], "project string")
    found = spark.createDataFrame([("p", "critical"), ("p", "info")], "project string, severity string")
    got = {r.project: (r.failed, r.blocking) for r in S.scan_gate(files, found).collect()}
    assert got == {"p": (True, 1), "clean": (False, 0)}


def test_rules_over_two_lines(spark):
    text = ["import a\nfrom b import c\nx\r\nimport d\nfrom e import f", "for i in y:\n  z += [i]\n\n# for i in y:\n  z += [i]\n FOR i in y:\n  z += [i]\n", "", None, "import a\n"]
    rows = [("p", f"d{i}", f"p/{i}", "python", t) for i, t in enumerate(text)] + [("p", "j", "p/j", "java", text[0])]
    files = spark.createDataFrame(rows, "project string, doc_id string, path string, language string, text string")
    got = sorted((r.doc_id, r.line_no, r.rule_id, r.code) for r in S.scan_texts(files).collect())
    assert got == [
        ("d0", 1, "PY-STYLE-005", "import a"), ("d0", 4, "PY-STYLE-005", "import d"),
        ("d1", 1, "PY-PERF-001", "for i in y:"), ("d1", 6, "PY-PERF-001", "FOR i in y:"),
    ]
    assert S.scan_texts(files.filter("false")).count() == 0
    told = S.with_messages(S.scan_texts(files)).select("rule_id", "message", "suggestion").distinct().collect()
    assert {(r.rule_id, r.message, r.suggestion) for r in told} == {(k, *C.MESSAGES[k]) for k in ("PY-STYLE-005", "PY-PERF-001")}
    assert set(C.MESSAGES) == {r[0] for r in C.RULES}
