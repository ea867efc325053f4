"""Rule tables through their index, against trying every rule on every row."""

import random

from pyspark.sql import functions as F

from tallyloom.functions import needles as N
from tallyloom.operators import docs as D
from tallyloom.operators import lookup as L
from tallyloom.operators import scan as S
from tallyloom.rules import code as C
from tests.test_scan import LINES


def test_required_text():
    assert N.required(r"(?i)foo\s+Bar") == (["foo"], True) or N.required(r"(?i)foo\s+Bar") == (["bar"], True)
    assert N.required(r"(?:open|exec)\s*\(") == (["open", "exec"], False)
    assert N.required(r"(?:eval|exec)\s*\(") == (["val", "xec"], False)  # a common start is taken out first
    assert N.required(r"a?b*c") is None and N.required(r"x|yyy") is None and N.required(r"\p{L}abc") is None
    assert N.required(r"(abc){0,2}d") is None and N.required(r"(abc){1,2}d") == (["abc"], False)
    assert N.required(r"(?=abc)def") == (["def"], False) and N.required(r"(?!abc)d") is None
    assert N.required(r"\Qa.b\Ec") is None and N.required(r"(?x)a b c") is None and N.required("(?<n>abc)") is None


def test_folding_is_that_of_java(spark):
    pairs = [("K", "kk"), ("İx", "ix"), ("ıx", "ix"), ("ſt", "st"), ("ß", "ss"), ("Σς", "σσ"), ("Å", "å"), ("ǅ", "ǆ"), ("éÉ", "éé")]
    df = spark.createDataFrame([(a, b, f"(?iU){b}") for a, b in pairs], "a string, b string, p string")
    for r in df.withColumn("hit", F.regexp_like("a", "p")).collect():
        if r.hit:
            assert N.fold(r.b) in N.fold(r.a), r


def test_ten_thousand_rules_equal_the_expression(spark):
    draw = random.Random(1)
    words = ["".join(draw.choices("abcdeK", k=draw.randint(2, 5))) for _ in range(400)]
    text = [" ".join(draw.choices([*words, "eval(x)", "İ", "a" * 130, ""], k=draw.randint(0, 12))) for _ in range(300)]
    lines = spark.createDataFrame([("p", "d", "p/f", ("python", "java", None)[i % 3], i, t) for i, t in enumerate(text)], LINES)
    made = [(f"U-{i}", "low", "style" if i % 2 else "bug", "", "", draw.choice([w, rf"\b{w}\w*\s+[a-c]+", f"(?:{w}|{draw.choice(words)})x", f"{w}?{w[0]}"])) for i, w in enumerate(draw.choices(words, k=60))]
    rules = [("python", r) for r in S.rules_for("python")] + [("java", r) for r in S.rules_for("java")] + [(lang, r) for r in made for lang in ("python", "java")]
    table = [(lang, r[0], r[1], r[2], r[3], S._pattern(r[2], r[5])) for lang, r in rules]
    kinds = "language string, rule_id string, severity string, type string, cwe string, pattern string"
    many = table + [("python", f"M-{k}", "low", "style", "", f"(?dU)zq{k}x") for k in range(10_000)]
    found = S.scan(lines, spark.createDataFrame(many, kinds))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    key = lambda rows: sorted((r.line_no, r.rule_id, r.language, r.severity, r.code) for r in rows)
    every = lines.crossJoin(spark.createDataFrame(table, kinds).withColumnRenamed("language", "l"))
    comment = F.coalesce(F.when(F.col("language") == "java", S.is_comment(F.col("line"), "java")).otherwise(S.is_comment(F.col("line"), "python")), F.lit(False))
    every = every.filter((F.col("l") == F.col("language")) & ~comment & F.regexp_like("line", "pattern")).withColumn("code", F.trim("line"))
    assert [x[:4] for x in key(found.collect())] == [x[:4] for x in key(every.collect())]
    assert S.scan(lines, spark.createDataFrame([], kinds)).count() == 0


def test_slices_of_rules_and_names(spark, monkeypatch):
    monkeypatch.setattr(N, "SLICE_RULES", 2)
    df = spark.createDataFrame([("GPT-4o",), ("my-gpt-4o-x",), ("nope",), (None,), ("nope",)], "model string")
    rules = spark.createDataFrame([("gpt-4o", 1, 5.0, 6.0), ("gpt", 0, 1.0, 2.0), ("x", 3, 7.0, 8.0), (None, 4, 9.0, 9.0), ("gpt-4o", 9, 0.5, 0.5)], "key string, ord int, price_in double, price_out double")
    got = sorted((r.model or "", r.price_in) for r in L.with_pricing(df, rules).collect())
    assert got == [("", 0.0), ("GPT-4o", 5.0), ("my-gpt-4o-x", 1.0), ("nope", 0.0), ("nope", 0.0)]


def test_vague_phrases_by_table(spark):
    docs = spark.createDataFrame([(1, "需要优化一下\n可能\nok"), (2, None), (3, "")], "doc_id long, text string")
    table = spark.createDataFrame([*D.D.VAGUE, *D.D.VAGUE_JAVA], "phrase string, hint string")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(D.vague_phrases(docs, table)) == key(D.vague_phrases(docs)) != []
