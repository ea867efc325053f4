import random
import statistics

from pyspark.sql import functions as F

from tallyloom.operators import estimate as E
from tallyloom.operators import levelling as V
from tallyloom.operators import runs as N

RECORDS = "task_content string, task_type string, module string, predicted_days double, actual_days double, recorded_at timestamp"


def days(spark, *rows):
    df = spark.createDataFrame([(c, t) for c, t in rows], "content string, task_type string")
    return [(r.content, r.days) for r in E.estimate_days(df).collect()]


def test_estimates(spark):
    got = dict(
        days(
            spark,
            ("新增用户接口", "接口任务"), ("查询列表接口", "接口任务"), ("创建记录表", "数据库任务"), ("展示列表", "前端任务"),
            ("做一些系统优化", "前端任务"), ("删除", "配置任务"), ("对接第三方支付", "x"), ("改", "x"),
        )
    )
    assert got == {
        "新增用户接口": 2.0, "查询列表接口": 1.0, "创建记录表": 0.5, "展示列表": 2.0, "做一些系统优化": 1.0, "删除": 0.3, "对接第三方支付": 1.5, "改": 1.5,
    }


def test_median_of_large_types_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(E, "RANKED", 5)
    rng = random.Random(4)
    ratios = {
        "wide": [10.0 ** rng.randint(-300, 300) * (1 + rng.random()) for _ in range(250)],
        "gap": [1 + k * 1e-12 for k in range(40)] + [1000 + k * 1e-9 for k in range(40)],
        "same": [2.0] * 50,
        "below": [-rng.random() for _ in range(31)] + [0.0, 3.0],
        "one": [7.0],
    }
    rows = [("c", t, "", 1.0, r, None) for t, found in ratios.items() for r in found]
    for precision in (1, 4):
        got = {r.task_type: r for r in E.calibration_factors(spark.createDataFrame(rows, RECORDS), precision).collect()}
        assert {t: r.records for t, r in got.items()} == {t: len(found) for t, found in ratios.items()}
    counted = spark.createDataFrame([(t, r, found.count(r)) for t, found in ratios.items() for r in set(found)], "task_type string, ratio double, n long")
    medians = {r.task_type: r.median_ratio for r in E._medians(counted, 10).collect()}
    assert medians == {t: (sorted(f)[(len(f) - 1) // 2] + sorted(f)[len(f) // 2]) / 2 for t, f in ratios.items()}


def test_median_is_exact_over_buckets(spark):
    rng = random.Random(9)
    rows = [("c", t, "", 1.0 + rng.random(), 5 * rng.random(), None) for t in "ab" for _ in range(301 if t == "a" else 200)]
    rows += [("c", "few", "", 1.0, 2.0, None)] * 2 + [("c", "a", "", 0.0, 1.0, None)]
    got = {r.task_type: r for r in E.calibration_factors(spark.createDataFrame(rows, RECORDS), precision=1).collect()}
    for t in "ab":
        ratios = [r[4] / r[3] for r in rows if r[1] == t and r[3] > 0]
        assert abs(got[t].factor - statistics.median(ratios)) <= 0.005 and got[t].records == len(ratios)
        assert (got[t].min_ratio, got[t].max_ratio) == (min(ratios), max(ratios))
    assert got["few"].factor == 1.0


def test_calibrated_range_and_ingest(spark):
    rec = [("a", "接口任务", "", 1.0, x, None) for x in (1.0, 1.0, 1.0, 2.0, 1.25)]
    records = spark.createDataFrame(rec, RECORDS)
    assert E.calibration_stats(records).first().precision == 0.30
    tasks = spark.createDataFrame([("新增接口", "接口任务")], "content string, task_type string")
    r = E.estimate_ranges(E.estimate_days(tasks, records)).first()
    assert (r.days, r.lower_days, r.upper_days, r.split_advised) == (2.0, 1.4, 2.6, False)
    new = spark.createDataFrame(
        [(" a ", None, None, None, 1.0, None), ("a", "t", "m", 1.0, 3.04, None), ("a", "t", "m", 1.0, 3.0, None), ("", "t", "m", 1.0, 1.0, None), ("b", "t", "m", 1.0, 0.0, None)],
        RECORDS,
    )
    assert [(x.task_content, x.actual_days) for x in E.ingest_records(records, new).collect()] == [("a", 3.0)]


PLAN = "project string, seq bigint, description string, dependencies array<bigint>"


def plan(spark, seed=1, n=60):
    rng = random.Random(seed)
    words = ["设计", "接口", "测试", "文档", "其他"]
    rows = []
    for p in ("p", "q"):
        for i in range(n):
            deps = rng.sample(range(n), rng.randint(1, 2)) if rng.random() < 0.4 else []
            rows.append((p, i, rng.choice(words), [d for d in deps if d != i] + ([999] if rng.random() < 0.1 else [])))
    return rows, spark.createDataFrame(rows, PLAN)


def test_weeks_conserve_effort_and_capacity(spark):
    _, df = plan(spark)
    weeks = V.level_weeks(df, 7.5, 5)
    total = V.with_effort(df).agg(F.sum("effort")).first()[0]
    assert weeks.agg(F.sum("week_effort")).first()[0] == total
    assert weeks.groupBy("project", "role", "week").agg(F.sum("week_effort").alias("w")).agg(F.max("w")).first()[0] <= 7.5
    load = V.weekly_load(weeks, "2024-03-04", 7.5, 5)
    assert load.filter("load_rate > 100").count() == 0 and load.filter("week > total_weeks").count() == 0


def test_no_capacity_gives_null_weeks(spark):
    df = spark.createDataFrame([("p", 1, "测试", []), ("p", 2, "接口", [1])], PLAN)
    assert {r.seq: r.week for r in V.level_weeks(df, 10, 0).collect()} == {1: None, 2: 1}


def test_scenarios(spark):
    df = spark.createDataFrame([("p", i, "设计", []) for i in range(12)], PLAN)
    assert {r.scenario: r.weeks for r in V.staffing_scenarios(df).collect()} == {"精简版": 6, "标准版": 4, "加速版": 3}


def test_runs_and_expectations(spark):
    df = spark.createDataFrame(
        [("p", "u", "pass", "old", 1.0), ("p", "u", "fail", "new", 2.0), ("q", "u", "fail", "old", 0.5), ("q", "v", "skip", "new", 0.5)],
        "project string, type string, status string, cohort string, duration double",
    )
    r = N.run_summary(df).first()
    assert (r.total, r.passed, r.failed, r.skipped, r.duration, r.pass_rate) == (4, 1, 2, 1, 4.0, 25.0)
    assert N.run_summary(df.limit(0)).first().pass_rate == 0.0
    assert {r.project: r.regression_passed for r in N.regression(df).collect()} == {"p": True, "q": False}
    got = N.expectations({"t": df}, [("t", "required", None), ("x", "required", None), ("t", "min_rows", 5), ("t", "columns", 5), ("x", "min_rows", 0)])
    assert {(r.table_name, r.check): r.passed for r in got.collect()} == {
        ("t", "required"): True, ("x", "required"): False, ("t", "min_rows"): False, ("t", "columns"): True, ("x", "min_rows"): False,
    }
