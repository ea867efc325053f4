import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import checks as C
from tallyloom.operators import lookup as L
from tallyloom.operators import modules as M
from tallyloom.operators import tasks as T

TASKS = "project string, seq bigint, module string, content string, task_type string, section_path string, line_num bigint, raw_text string"


def lines(spark, *text):
    return spark.createDataFrame([("d", i + 1, t) for i, t in enumerate(text)], "doc_id string, line_no bigint, line string")


def tasks(spark, *rows):
    """rows: content or (content, raw, module, section)."""
    full = []
    for i, r in enumerate(rows):
        content, raw, module, section = (r, r, "m", "1.1 x") if isinstance(r, str) else r
        full.append(("p", i, module, content, "功能任务", section, i + 1, raw))
    return spark.createDataFrame(full, TASKS)


def test_candidates_accept_and_reject(spark):
    good = ["新增用户列表查询接口", "【新增】备份开关配置", "POST /api/a 创建接口", "第1步：创建接口", "技能中心提供查询功能"]
    bad = ["短", "已有接口无需改动", "业务目标：新增接口", "1.2 接口设计", "[a_b=1]POST 新增接口", "提供查询功能。说明", "为了支持", "返回列表数据", "--- 12 ---"]
    got = {r.raw_text for r in T.task_candidates(lines(spark, *good, *bad)).collect()}
    assert got == set(good)


@pytest.mark.parametrize("size", [2, 1 << 16])
def test_candidates_fences_and_zones(spark, size):
    text = ["新增接口甲模块", "```", "新增接口乙模块", "```", "新增接口丙模块"] + ["x"] * 9 + ["第1步：接收请求数据", "A-->>B", "第2步：新增接口数据"]
    got = [r.raw_text for r in T.task_candidates(lines(spark, *text), size=size).orderBy("line_no").collect()]
    assert got == ["新增接口甲模块", "新增接口丙模块", "第2步：新增接口数据"]


def test_extraction(spark):
    df = spark.createDataFrame(
        [("d", 1, "a. 需要新增一个登录接口 (POST /api/login)。多余"), ("d", 2, "第1步：新增查询接口；第2步：查询记录表"), ("d", 3, "应用部署到容器→结束")],
        "doc_id string, line_no bigint, raw_text string",
    )
    got = [(r.content, r.task_type, r.api_path, r.step_derived) for r in T.extract_tasks(df).orderBy("line_no", "part_no").collect()]
    assert got == [
        ("登录接口 (POST /api/login) (POST /api/login)", "接口任务", "/api/login", False),
        ("新增查询接口", "接口任务", "", True),
        ("查询记录表", "数据库任务", "", True),
        ("应用部署到容器", "功能任务", "", False),
    ]


def test_sections_and_paths(spark):
    df = lines(spark, "# A", "## B", "x", "### C", "## D", "1.2.3 n", "一、t")
    s = T.sections(df, "markdown")
    assert [r.section_path for r in L.section_paths(s).orderBy("line_no").collect()] == ["# A", "# A > ## B", "## B > ### C", "# A > ## D"]
    deep = spark.createDataFrame([(1, n, "#" * n, n) for n in range(1, 10)], "doc_id long, line_no int, title string, level int")
    paths = [r.section_path for r in L.section_paths(deep).orderBy("line_no").collect()]
    assert paths == ["#"] + ["#" * n + " > " + "#" * (n + 1) for n in range(1, 9)]
    at = {r.line_no: r.section_title for r in L.with_section(df, s).collect()}
    assert at[3] == "## B" and at[7] == "## D"
    assert [(r.title, r.level) for r in T.sections(df).collect()] == [("1.2.3 n", 3)]
    assert [(r.title, r.level) for r in T.sections(df, "chinese").orderBy("line_no").collect()] == [("1.2.3 n", 3), ("一、t", 1)]
    ctx = {r.line_no: (r.before, r.after) for r in T.line_context(df, size=2).collect()}
    assert ctx[3] == ("## B", "### C") and ctx[5][1] == ""


def kept(df):
    return [r.content for r in df.orderBy("seq").collect()]


def test_dedup(spark):
    df = tasks(spark, "查询列表", "新增查询列表接口", "查询列表", "查询列裱", "查询列表项", ("查询列表项目", "第1步、查询列表项目", "m", "s"))
    # equal, one edit away, and contained at half the length or more are dropped; a step title is not tested for
    # containment, and one edit away from a dropped text does not count
    assert kept(T.dedup_tasks(df)) == ["查询列表", "查询列表项目"]
    longer = tasks(spark, "查询用户列表接口和分页", "用户列表接口和分页", ("用户列表接口和分页甲乙丙", "第1步、用户", "m", "s"))
    assert kept(T.dedup_tasks(longer)) == ["查询用户列表接口和分页", "用户列表接口和分页甲乙丙"]
    assert kept(T.dedup_keep_longer(longer)) == ["查询用户列表接口和分页", "用户列表接口和分页甲乙丙"]
    assert kept(T.dedup_exact(df)) == ["查询列表", "新增查询列表接口", "查询列裱", "查询列表项", "查询列表项目"]


def test_only_kept_tasks_rule_others_out(spark):
    df = tasks(spark, "用户列表查询接口新增", "列表查询接口", "列表查询接口导出数据")
    assert kept(T.dedup_tasks(df)) == ["用户列表查询接口新增", "列表查询接口导出数据"]
    wl = spark.createDataFrame([(0, "其他", "没有")], "ord int, module string, content string")
    assert kept(T.merge_tasks(df, wl)) == ["用户列表查询接口新增", "列表查询接口导出数据"]
    long = tasks(spark, "对账单明细列表的查询接口与导出任务甲乙丙丁戊", "对账单明细列表的查询接口与导出任务甲乙丙丁己")
    assert len(kept(T.merge_tasks(long, wl))) == 2 and len(kept(T.merge_tasks(long, wl, head=20))) == 1


def test_survivors_equal_a_loop(spark):
    import random

    from tallyloom.functions.survivors import ruled_out

    draw = random.Random(3)
    pairs = sorted({("p", *sorted(draw.sample(range(40), 2))) for _ in range(70)})
    gone = set()
    for late in range(40):
        if any(b == late and a not in gone for _, a, b in pairs):
            gone.add(late)
    df = spark.createDataFrame(pairs, "project string, early long, late long")
    assert {r.seq for r in ruled_out(df, ["project"]).collect()} == gone


def test_merge_with_whitelist(spark):
    wl = spark.createDataFrame([(0, "用户中心", "用户列表接口"), (1, "其他", "列表接口")], "ord int, module string, content string")
    df = tasks(spark, "新增用户列表接口", "更新用户列表接口", "支付回调", "实现支付回调", "导出")
    got = [(r.module, r.content, r.listed) for r in T.merge_tasks(df, wl).orderBy("seq").collect()]
    assert got == [("用户中心", "用户列表接口", True), ("m", "支付回调", False), ("m", "导出", False)]


def test_noise_and_types(spark):
    rows = ["列表", ("开始 对账", "开始 对账", "m", "s"), ("解析失败文件不存在", "x", "m", "s"), ("查询列表。多余", "y", "m", "s"), ("记录内容", "当开关开启时，记录内容", "m", "s")]
    assert kept(T.drop_noise(tasks(spark, *rows))) == ["查询列表"]
    df = tasks(spark, "新增表字段和索引接口", "无")
    assert [r.t for r in df.select(T.scored_type("content").alias("t")).collect()] == ["数据库任务", "功能任务"]


def test_legacy_and_key_lines(spark):
    df = lines(spark, "1.2.1 技能中心", "GET /api/skill/list 查询", "用户登录接口", "新增渠道列表接口", "背景说明新增接口")
    got = [(r.module, r.task_type, r.content) for r in T.legacy_tasks(df, size=2).orderBy("line_no").collect()][:2]
    assert got == [("技能中心", "REST_API", "实现 REST API：GET /api/skill/list"), ("技能中心", "INTERFACE", "实现用户登录接口接口开发")]
    keys = [(r.content, r.task_type, r.module) for r in T.key_lines(df).collect()]
    assert keys == [("新增渠道列表接口", "新增接口", "未分类")]


def test_modules(spark):
    wl = spark.createDataFrame([(0, "对账中心", "对账单的明细")], "ord int, module string, content string")
    df = tasks(
        spark,
        ("新增用户列表接口", "", "", "3.1 用户列表接口设计"),
        ("对账单的明细", "", "", ""),
        ("杂项", "", "", ""),
        ("清理缓存", "", "", "4.2 备份开关状态"),
    )
    got = [(r.module, r.match_source) for r in M.assign_modules(df, wl).orderBy("seq").collect()]
    assert got == [("用户中心", "content"), ("对账中心", "whitelist"), ("未分类", "fallback"), ("备份开关状态", "section")]
    many = tasks(spark, *[f"查询{i}" for i in range(11)], ("查询", "", "n", ""))
    assert {r.module for r in M.split_modules(many).collect()} == {"m - 查询功能", "n"}


def test_sequence_and_acceptance(spark):
    df = tasks(spark, ("c", "", "b", ""), ("d", "", "a", ""), ("e", "", "b", ""))
    got = [(r.content, r.task_id, r.dependency) for r in M.sequence_tasks(df, size=2).orderBy("seq").collect()]
    assert got == [("c", "T002", "无"), ("d", "T001", "无"), ("e", "T003", "T002")]
    first = df.limit(1).select(M.acceptance(F.lit("扣费接口")).alias("x")).first().x
    assert first.startswith("扣费金额计算正确") and first.count("；") == 4


def test_checks(spark):
    df = tasks(
        spark,
        ("新增接口", "新增接口", "用户", "1.1 用户管理"),
        ("完全不同", "原文没有", "用户", "1.1 用户管理"),
        ("短", "短", "用户", "2.1 支付"),
    )
    got = {r.seq: (r.confidence, r.status, r.issues) for r in C.check_tasks(df).collect()}
    assert got == {0: (1.0, "PASS", ""), 1: (0.2, "FAIL", "not_in_source"), 2: (0.6, "WARN", "section,short")}
    near = tasks(spark, "查询用户列表接口", "查询用户列表接囗", "别的")
    assert [(r.seq, r.distance) for r in C.adjacent_duplicates(near, size=1).collect()] == [(0, 0.125)]
    assert {(r.module, r.issue) for r in C.module_balance(near).collect()} == set()
    assert {(r.issue, r.n) for r in C.module_balance(near.limit(2)).select("issue", F.col("tasks").alias("n")).collect()} == {("too_few", 2)}


def test_intent(spark):
    df = tasks(spark, ("新增支付接口", "", "支付", ""), ("测试支付接口", "", "支付", ""), ("新增页面", "", "支付", ""), ("新增接口", "", "x", ""))
    assert kept(T.filter_tasks(df, exclude=["测试"], focus=["支付"], types=["api"])) == ["新增支付接口"]


@pytest.mark.parametrize("size", [1, 7, 100_000])
def test_section_paths_of_forty_levels(spark, size):
    draw, rows = random.Random(size), []
    for doc in ("a", "b"):
        at = 0
        for _ in range(250):
            at += draw.randint(1, 5)
            rows.append((doc, at, f"t{at}", draw.choice([draw.randint(1, 40), 40, 2])))
    rows += [("c", 1, "x", None), ("c", 2, None, 3), ("c", 3, "y", 9), ("c", 4, "z", -1)]
    want = {}
    for doc, at, title, level in rows:
        above = [(n, t) for d, n, t, o in rows if d == doc and n < at and o is not None and level is not None and o < level]
        parent = max(above)[1] if above else None
        want[doc, at] = None if title is None else title if parent is None else f"{parent} > {title}"
    df = spark.createDataFrame(rows, "doc_id string, line_no int, title string, level int").repartition(3)
    got = L.section_paths(df, size)
    assert {(r.doc_id, r.line_no): r.section_path for r in got.collect()} == want
    assert got.schema["line_no"].dataType == df.schema["line_no"].dataType


def rule_table(spark, columns, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord int, " + ", ".join(f"{c} string" for c in columns))


def test_user_tables_of_types(spark):
    types = rule_table(spark, ["name", "word"], [("red", "Rose"), ("blue", "sky"), ("red", "fire"), ("none", None)])
    df = spark.createDataFrame([("a rose and fire in the SKY",), ("sky",), ("x",), ("",)], "c string")
    assert [r.t for r in df.select(T.scored_type("c", types).alias("t")).collect()] == ["red", "blue", "功能任务", "功能任务"]
    few = rule_table(spark, ["name", "word"], [("blue", "sky"), ("red", "rose")])
    assert [r.t for r in df.select(T.first_type(F.col("c"), F.lit(None), few).alias("t")).collect()] == ["blue", "blue", "功能任务", "功能任务"]
    # The packaged list and the same rules as a table agree.
    same = rule_table(spark, ["name", "word"], [(n, w) for n, words in T.R.SCORED_TYPES for w in words])
    text = spark.createDataFrame([("新增接口 POST 表 字段",), ("缓存 Redis",), ("配置 页面",)], "c string")
    assert text.select(T.scored_type("c", same)).collect() == text.select(T.scored_type("c")).collect()


def test_user_tables_of_modules(spark):
    words = rule_table(spark, ["keyword", "module"], [("alpha", "A"), ("beta", "B")])
    df = tasks(spark, ("beta alpha task", "", "", ""), ("plain", "", "", "1.1 beta 功能"), ("用户列表", "", "", ""))
    got = [r.module for r in M.assign_modules(df, keywords=words).orderBy("seq").collect()]
    assert got == ["A", "B", "未分类"]
    many = tasks(spark, *[(f"zeta {i}", "", "n", "") for i in range(11)])
    assert {r.module for r in M.split_modules(many, words=rule_table(spark, ["word", "module"], [("zeta", "Z")])).collect()} == {"n - Z"}


def test_user_tables_of_acceptance_and_line_rules(spark):
    groups = M.acceptance_groups(
        rule_table(spark, ["name", "word"], [("pay", "Fee"), ("api", "http")]),
        rule_table(spark, ["name", "line"], [("api", "answers"), ("pay", "adds up"), ("rest", "works"), ("pay", "is logged")]),
    )
    df = spark.createDataFrame([("http fee",), ("HTTP",), ("x",)], "c string")
    assert [r.a for r in df.select(M.acceptance("c", groups).alias("a")).collect()] == ["adds up；is logged", "answers", "works"]
    rules = rule_table(spark, ["pattern", "task_type", "text"], [(r"do (\w+)", "DO", "done {1}"), ("see", "SEE", "seen")])
    found = T.legacy_tasks(lines(spark, "Part one", "do this", "see", "other"), rules=rules, modules=rule_table(spark, ["pattern", "module"], [("Part one", "P1")]))
    assert sorted((r.line_no, r.module, r.task_type, r.content) for r in found.collect()) == [(2, "P1", "DO", "done this"), (3, "P1", "SEE", "seen")]


def test_a_table_above_the_bound_is_refused(spark):
    from tallyloom.functions.ruletable import as_rules

    with pytest.raises(ValueError, match="more than 3"):
        as_rules(rule_table(spark, ["word"], [(str(k),) for k in range(4)]), ["word"], 3)
