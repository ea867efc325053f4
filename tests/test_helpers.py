"""Chunked windows, containment and overlap against plain implementations."""

import random
from pathlib import Path

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions import ordered
from tallyloom.functions.containment import contained_pairs, one_edit_pairs
from tallyloom.functions.overlap import shared_length


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = []
    for g in ("hot", "b", None):
        for i in sorted(rng.sample(range(60), 25)):
            data.append((g, i, rng.choice([None, 1, 2, 3]), f"t{i}"))
    return spark.createDataFrame(data, "g string, n bigint, v bigint, t string").cache()


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.mark.parametrize("inclusive", [True, False])
def test_running_sum_equals_plain_window(rows, inclusive):
    got = ordered.running_sum(rows, ["g"], "n", {"s": F.col("v")}, inclusive=inclusive, size=7)
    w = W.partitionBy("g").orderBy("n").rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    same(got.select("g", "n", "s"), rows.select("g", "n", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("s")))


@pytest.mark.parametrize("inclusive", [True, False])
def test_carry_forward_equals_plain_window(rows, inclusive):
    got = ordered.carry_forward(rows, ["g"], "n", {"s": F.col("v")}, inclusive=inclusive, size=5)
    w = W.partitionBy("g").orderBy("n").rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    same(got.select("g", "n", "s"), rows.select("g", "n", F.last("v", ignorenulls=True).over(w).alias("s")))


def test_neighbours_and_row_numbers_equal_plain_window(rows):
    w = W.partitionBy("g").orderBy("n")
    got = ordered.neighbours(rows, ["g"], "n", ["t"], size=4)
    same(
        got.select("g", "n", F.col("prev.t").alias("p"), F.col("next.t").alias("q")),
        rows.select("g", "n", F.lag("t").over(w).alias("p"), F.lead("t").over(w).alias("q")),
    )
    same(
        ordered.row_numbers(rows, ["g"], "n", size=4).select("g", "n", "rn"),
        rows.select("g", "n", F.row_number().over(w).cast("long").alias("rn")),
    )


@pytest.mark.parametrize("longest", [None, 2.0])
def test_contained_pairs_equals_all_pairs(spark, longest):
    rng = random.Random(5)
    texts = sorted({"".join(rng.choice("ab表格") for _ in range(rng.randint(1, 9))) for _ in range(120)})
    rows = [(k, i, t) for i, t in enumerate(texts) for k in ("x", "y")]
    a = spark.createDataFrame(rows, "k string, s_id bigint, s_text string")
    b = spark.createDataFrame(rows, "k string, l_id bigint, l_text string")
    got = {(r.k, r.s_id, r.l_id) for r in contained_pairs(a, b, ["k"], longest=longest).collect()}
    want = {
        (k, i, j)
        for k, i, s in rows
        for k2, j, t in rows
        if k == k2 and s in t and (longest is None or len(t) <= longest * len(s))
    }
    assert got == want


def _edits(a, b):
    d = list(range(len(a) + 1))
    for i, y in enumerate(b, 1):
        e = [i]
        for j, x in enumerate(a, 1):
            e.append(min(d[j] + 1, e[-1] + 1, d[j - 1] + (x != y)))
        d = e
    return d[-1]


def test_one_edit_pairs_equals_all_pairs(spark):
    rng = random.Random(7)
    texts = sorted({"".join(rng.choice("ab表") for _ in range(rng.randint(1, 6))) for _ in range(80)})
    df = spark.createDataFrame([("x", i, t) for i, t in enumerate(texts)], "k string, id bigint, text string")
    got = {(r.a_id, r.b_id) for r in one_edit_pairs(df, ["k"], 5).collect()}
    want = {
        (i, j)
        for i, s in enumerate(texts)
        for j, t in enumerate(texts)
        if i < j and len(s) <= 5 and len(t) <= 5 and _edits(s, t) <= 1
    }
    assert got == want


def test_shared_length_equals_brute_force():
    rng = random.Random(1)
    for _ in range(400):
        a = "".join(rng.choice("ab表é") for _ in range(rng.randint(0, 40)))
        b = "".join(rng.choice("ab表é") for _ in range(rng.randint(0, 40)))
        best = max((n for i in range(len(a)) for n in range(1, len(a) - i + 1) if a[i : i + n] in b), default=0)
        assert shared_length(a, b) == (best if best >= 5 else 0)


def test_shared_length_takes_whole_long_texts():
    rng = random.Random(2)
    part = "".join(rng.choice("abcdefgh") for _ in range(3000))
    a = "".join(rng.choice("abcdefgh") for _ in range(40_000)) + part
    b = part + "".join(rng.choice("ijklmnop") for _ in range(60_000))
    assert shared_length(a, b) == 3000


def test_hot_and_lengthened_pieces_equal_all_pairs(spark, monkeypatch):
    from tallyloom.functions import containment

    monkeypatch.setattr(containment, "HOT", 5)
    rng = random.Random(7)
    hot = ["接口登录查询", "接口登录"]
    texts = sorted({rng.choice(hot) * rng.randint(0, 3) + "".join(rng.choices("abc", k=rng.randint(0, 12))) + rng.choice(hot) for _ in range(90)} | set(hot))
    texts += ["接口", "登", "接口登录查询接口登录查询接口登录"]
    a = spark.createDataFrame(list(enumerate(texts)), "s_id bigint, s_text string")
    b = spark.createDataFrame(list(enumerate(texts)), "l_id bigint, l_text string")
    got = [(r.s_id, r.l_id) for r in containment.contained_pairs(a, b).collect()]
    assert sorted(got) == sorted((i, j) for i, s in enumerate(texts) for j, t in enumerate(texts) if s in t)


@pytest.mark.parametrize("longest", [None, 1.5])
def test_contained_in_list_equals_all_pairs(spark, longest, monkeypatch):
    from tallyloom.functions import containment

    monkeypatch.setattr(containment, "LISTED", 9)
    rng = random.Random(9)
    listed = [("".join(rng.choices("ab表", k=rng.randint(0, 14))), k) for k in range(60)] + [("表", None)]
    texts = sorted({"".join(rng.choices("ab表", k=rng.randint(0, 6))) for _ in range(80)})
    got = containment.contained_in_list(
        spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame(listed, "l_text string, v int"), "v", longest
    )
    want = {}
    for t in texts:
        found = [v for x, v in listed if v is not None and t and t in x and (longest is None or len(x) <= longest * len(t))]
        if found:
            want[t] = min(found)
    assert {r.text: r.v for r in got.collect()} == want


def test_survivors_of_long_chains_in_few_jobs(spark, monkeypatch):
    from tallyloom.functions import survivors

    df = spark.createDataFrame([(None, k, k + 1) for k in range(10_000)] + [("q", 1, 5), ("q", 5, 7), ("q", 2, 7)], "project string, early long, late long")
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup())
    before = jobs()
    gone = {(r.project, r.seq) for r in survivors.ruled_out(df, ["project"]).collect()}
    assert gone == {(None, k) for k in range(1, 10_001, 2)} | {("q", 5), ("q", 7)}
    assert jobs() - before <= 10
    # Cut into components, of which one is still too large for a task.
    monkeypatch.setattr(survivors, "TASK_PAIRS", 30)
    rng = random.Random(2)
    pairs = sorted({("p", *sorted(rng.sample(range(40), 2))) for _ in range(60)}) + [("p", 100 + k, 101 + k) for k in range(20)] + [("q", 1, 2)]
    gone = set()
    for late in range(130):
        if any(b == late and p == "p" and a not in gone for p, a, b in pairs):
            gone.add(late)
    got = {(r.project, r.seq) for r in survivors.ruled_out(spark.createDataFrame(pairs, df.schema), ["project"]).collect()}
    assert got == {("p", k) for k in gone} | {("q", 2)}


def test_no_side_of_a_containment_goes_through_the_driver(spark, monkeypatch):
    """Texts and lists grow with the tasks, so none is collected, put into a plan or broadcast, however small it looks."""
    from tallyloom.functions import needles
    from tallyloom.operators import modules, tasks

    def refuse(*_):
        raise AssertionError("a list went through the driver")

    monkeypatch.setattr(needles, "slices", refuse)
    kind = "project string, seq bigint, module string, content string, task_type string, section_path string, raw_text string"
    rows = [(f"p{i % 3}", i, "m", f"查询列表{i}编号{i % 7}", "t", "", "a. x") for i in range(30)] + [("p0", 60, "m", "查询列表1", "t", "", "")]
    df = spark.createDataFrame(rows, kind)
    wl = spark.createDataFrame([(0, "w", "列表12编号5"), (1, "v", "查询列表2编号2和其他")], "ord bigint, module string, content string")
    listed = tasks.match_whitelist(df, wl)
    plans = [listed, tasks.dedup_keep_longer(df), modules.assign_modules(df, wl)]
    for plan in plans:
        assert "Broadcast" not in plan._jdf.queryExecution().executedPlan().toString()
    assert {r.seq: r.std_module for r in listed.filter("std_module is not null").collect()} == {12: "w", 2: "v"}
    assert 60 not in {r.seq for r in plans[1].collect()}


def test_pieces_on_one_counter_only_make_more_texts_meet(spark, monkeypatch):
    from tallyloom.functions import containment

    monkeypatch.setattr(containment, "COUNTERS", 2)
    texts = ["ab", "abc", "xabcx", "abcdeabcde", "cdeab", "q", "zzzz"]
    a = spark.createDataFrame([("k", i, t) for i, t in enumerate(texts)], "k string, s_id int, s_text string")
    got = {(r.s_id, r.l_id) for r in contained_pairs(a, a.toDF("k", "l_id", "l_text"), ["k"], equal=False).collect()}
    assert got == {(i, j) for i, s in enumerate(texts) for j, t in enumerate(texts) if s in t and s != t}


def _on_disk(spark):
    """Bytes of shuffles and written tables so far."""
    places = [str(d) for d in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()]
    places.append(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    return sum(f.stat().st_size for p in places for f in Path(p).rglob("*") if f.is_file())


def test_texts_that_share_all_pieces_take_little_disk(spark):
    rng = random.Random(11)
    texts = sorted({"".join(rng.choices("ab", k=rng.randint(14, 24))) for _ in range(2500)})
    a = spark.createDataFrame([("p", i, t) for i, t in enumerate(texts)], "k string, s_id long, s_text string")
    before = _on_disk(spark)
    got = {(r.s_id, r.l_id) for r in contained_pairs(a, a.toDF("k", "l_id", "l_text"), ["k"], equal=False).collect()}
    assert _on_disk(spark) - before < 2_000_000
    assert got == {(i, j) for i, s in enumerate(texts) for j, t in enumerate(texts) if s in t and s != t}


def test_tasks_and_a_list_that_share_all_pieces_take_little_disk(spark):
    from tallyloom.operators import tasks

    rng = random.Random(19)
    texts = sorted({"".join(rng.choices("ab", k=rng.randint(9, 24))) for _ in range(2500)})
    rng.shuffle(texts)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "seq long, content string")
    wl = spark.createDataFrame([(i, "w", t) for i, t in enumerate(texts[:2000])], "ord long, module string, content string")
    before = _on_disk(spark)
    got = {r.seq: r.std_content for r in tasks.match_whitelist(df, wl).collect()}
    assert _on_disk(spark) - before < 2_000_000
    assert got == {i: next((w for w in texts[:2000] if w in t or t in w), None) for i, t in enumerate(texts)}


def test_merging_does_not_move_source_texts(spark):
    from tallyloom.operators import tasks

    rng = random.Random(17)
    rows = [("p", i, "m", f"任务{i % 40}号", "t", "s", "".join(rng.choices("abcdefghijklmnop", k=20_000))) for i in range(120)]
    df = spark.createDataFrame(rows, "project string, seq long, module string, content string, task_type string, section_path string, raw_text string")
    wl = spark.createDataFrame([(0, "w", "任务3号和其他")], "ord long, module string, content string")
    before = _on_disk(spark)
    got = {(r.seq, r.module, r.content, r.listed) for r in tasks.merge_tasks(df, wl).collect()}
    assert _on_disk(spark) - before < 500_000
    assert got == {(i, "m", f"任务{i}号", False) for i in range(40) if i != 3} | {(3, "w", "任务3号和其他", True)}


def test_contained_pairs_of_odd_texts_and_small_parts(spark, monkeypatch):
    """Characters of any width, repeats inside a text, nulls, and limits so low that every part is cut."""
    from tallyloom.functions import containment

    for name, low in (("CHUNK", 40), ("FOUND", 60), ("HELD", 7), ("BLOCK", 2), ("HOT", 3)):
        monkeypatch.setattr(containment, name, low)
    texts = ["", "é", "😀", "😀b😀b😀", "b😀", "a" * 90, "a" * 37, "aa", "表a表a表", "a表", "ab" * 33, "ba" * 16, "\x00", "x\x00", "é\n", None]
    rows = [(k, i, t) for i, t in enumerate(texts) for k in (1, 2, None)]
    a = spark.createDataFrame(rows, "k int, s_id int, s_text string").repartition(3)
    got = [(r.k, r.s_id, r.l_id) for r in contained_pairs(a, a.toDF("k", "l_id", "l_text"), ["k"]).collect()]
    want = {(k, i, j) for k in (1, 2) for i, s in enumerate(texts) for j, t in enumerate(texts) if s and t and s in t}
    assert set(got) == want and len(got) == len(want)
    bare = contained_pairs(a.drop("k").distinct(), a.toDF("k", "l_id", "l_text").drop("k").distinct(), longest=3.0, equal=False)
    assert {(r.s_id, r.l_id) for r in bare.collect()} == {(i, j) for _, i, j in want if i != j and len(texts[j]) <= 3 * len(texts[i])}


@pytest.mark.parametrize("longest", [None, 1.5])
def test_list_matches_equals_all_pairs(spark, longest, monkeypatch):
    from tallyloom.functions import containment

    monkeypatch.setattr(containment, "HOT", 7)
    rng = random.Random(13)
    listed = [("".join(rng.choices("ab表", k=rng.randint(0, 9))), (k % 9, f"v{k}")) for k in range(70)] + [("表", None), (None, (0, "n"))]
    texts = sorted({"".join(rng.choices("ab表", k=rng.randint(0, 7))) for _ in range(90)})
    got = containment.list_matches(
        spark.createDataFrame(list(enumerate(texts)), "id long, text string"), spark.createDataFrame(listed, "l_text string, v struct<o int, n string>"), "v", longest
    )
    want = {}
    for i, t in enumerate(texts):
        near = lambda x: longest is None or max(len(x), len(t)) <= longest * min(len(x), len(t))
        found = [v for x, v in listed if t and x and v is not None and (t in x or x in t) and near(x)]
        if found:
            want[i] = min(found)
    assert {r.id: (r.v.o, r.v.n) for r in got.collect()} == want


def test_guarded_patterns_match_what_the_plain_ones_do(spark):
    from tallyloom.functions.needles import matches_needed
    from tallyloom.functions.text import alternation, contains_any
    from tallyloom.rules import documents as D

    words = ["加个方法", "^a]", "x-y", "\\d", "😀b"]
    assert alternation(words).startswith("(?=[") and "(?=" not in alternation([*words, ""])
    texts = ["a x-y", "加个方法", "加个", "q^a]", "\\d", "5", "😀b", "", None, "src/main/java/A.java", "jobs/a.py", "a.py", "**依赖**: 无"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", contains_any("t", words).alias("hit")).collect():
        assert r.hit == (None if r.t is None else any(w in r.t for w in words))
    for p in [*D.PATHS, *D.DEPENDENCY, *D.EFFORT]:
        both = df.select(matches_needed(F.col("t"), p).alias("a"), F.regexp_like("t", F.lit(p)).alias("b")).collect()
        assert all(r.a == r.b for r in both), p


def test_tree_has_a_file_for_every_row(spark, tmp_path):
    from tallyloom.sources import files

    rows = [("a", "x\ny"), ("a", "x\ny"), ("b/c", ""), (None, "表"), ("", None)]
    files.write_tree(spark.createDataFrame(rows, "project string, text string").repartition(2), f"file://{tmp_path}/tree")
    got = sorted((p.parent.name, p.read_text()) for p in tmp_path.glob("tree/*/*.txt"))
    assert got == [("project=__HIVE_DEFAULT_PARTITION__", "\n"), ("project=__HIVE_DEFAULT_PARTITION__", "表\n"), ("project=a", "x\ny\n"), ("project=a", "x\ny\n"), ("project=b%2Fc", "\n")]
    read = files.read_sources(spark, f"file://{tmp_path}/tree", "python", exclude=[], extension=".txt")
    assert sorted(r.text for r in read.collect()) == sorted(t for _, t in got)
