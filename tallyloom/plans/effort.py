"""Registered estimate, levelling and test-run queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..operators import estimate as E
from ..operators import levelling as V
from ..operators import runs as N
from ..rules import effort as R
from .base import any_contains, cte, half_up, lit, sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
START = "2024-03-04"


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


_HAS = {}
for _name, _, _need, _without in R.ENTITIES:
    if _need == "table":
        c = f"regexp_matches(content, {lit(R.TABLE_WORD)})"
    else:
        c = " AND ".join(any_contains("lower(content)", w) for w in _need)
    if isinstance(_without, str):
        c = f"({c}) AND NOT ({_HAS[_without]})"
    elif _without:
        c = f"({c}) AND NOT {any_contains('lower(content)', _without)}"
    _HAS[_name] = f"({c})"
_ALL = [(n, s, _HAS[n]) for n, s, _, _ in R.ENTITIES] + [(n, s, any_contains("lower(content)", w)) for n, s, w in R.SPECIALS]
_SCORE = " + ".join(f"CASE WHEN {c} THEN {lit(s)} ELSE CAST(0 AS DOUBLE) END" for _, s, c in _ALL)
_NAMES = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {lit(n)} END" for n, _, c in _ALL) + "], lambda x: x IS NOT NULL)"
_ITER = "CASE " + " ".join(f"WHEN {any_contains('lower(content)', w)} THEN {lit(f)}" for f, w in R.ITERATION) + " ELSE CAST(1 AS DOUBLE) END"
_FALL = "CASE task_type " + " ".join(f"WHEN {lit(t)} THEN {lit(d)}" for t, d in R.FALLBACK.items()) + f" ELSE {lit(R.FALLBACK_DEFAULT)} END"
_PREC = "CASE " + " ".join(f"WHEN records >= {n} THEN {lit(p)}" for n, p in R.PRECISION) + " END"

cte(
    "factors",
    ("records",),
    f"""SELECT task_type, records, CASE WHEN records >= 3 THEN {half_up('med', 2)} ELSE CAST(1 AS DOUBLE) END AS factor, lo, hi FROM (
  SELECT task_type, count(*) AS records, median(actual_days / predicted_days) AS med, min(actual_days / predicted_days) AS lo,
    max(actual_days / predicted_days) AS hi FROM records WHERE predicted_days > 0 GROUP BY task_type)""",
)
cte(
    "estimated",
    ("tasks", "factors"),
    f"""SELECT project, seq, module, content, task_type, names, iteration, coalesce(factor, CAST(1 AS DOUBLE)) AS factor,
  coalesce(records, 0) AS records, {half_up('greatest(CAST(0.3 AS DOUBLE), CASE WHEN score > 0 THEN score ELSE fall END * iteration * coalesce(factor, CAST(1 AS DOUBLE)))', 1)} AS days
FROM (SELECT *, {_SCORE} AS score, {_NAMES} AS names, {_ITER} AS iteration, {_FALL} AS fall FROM tasks) LEFT JOIN factors USING (task_type)""",
)


def estimated(spark, sf):
    return E.estimate_days(A.tasks(spark, sf), A.calibration(spark, sf))


@query("est_days", sql("estimated", "SELECT project, seq, content, task_type, array_to_string(names, ',') AS features, iteration, factor, records, days FROM estimated"))
def est_days(spark, sf):
    df = estimated(spark, sf).withColumn("features", F.array_join("features", ","))
    return df.select("project", "seq", "content", "task_type", "features", "iteration", "factor", "records", "days")


@query("est_calib", sql("factors", f"SELECT task_type, records, factor, {half_up('lo', 6)} AS min_ratio, {half_up('hi', 6)} AS max_ratio FROM factors"))
def est_calib(spark, sf):
    df = E.calibration_factors(A.calibration(spark, sf))
    return df.withColumns({c: E.half_up(c, 6) for c in ("min_ratio", "max_ratio")})


@query("est_range", sql("estimated", f"""SELECT project, seq, days, {half_up(f'days * (CAST(1 AS DOUBLE) - {_PREC})', 1)} AS lower_days,
  {half_up(f'days * (CAST(1 AS DOUBLE) + {_PREC})', 1)} AS upper_days, days > 20 AS split_advised FROM estimated"""))
def est_range(spark, sf):
    return E.estimate_ranges(estimated(spark, sf)).select("project", "seq", "days", "lower_days", "upper_days", "split_advised")


@query("est_stats", sql("factors", f"""SELECT task_type, records, factor, {_PREC} AS precision, {half_up('lo', 2)} AS min_ratio, {half_up('hi', 2)} AS max_ratio,
  CASE WHEN records >= 3 THEN CASE WHEN factor < 1 THEN 'too high by ' ELSE 'too low by ' END || CAST(abs({half_up('(1 - factor) * 100', 0)}) AS INTEGER) || '%' ELSE 'too few records' END AS note FROM factors"""))
def est_stats(spark, sf):
    return E.calibration_stats(A.calibration(spark, sf))


@query("est_ingest", sql("records", f"""SELECT task_content, task_type, module, predicted_days, actual_days, recorded_at FROM (
  SELECT *, row_number() OVER (PARTITION BY task_content, actual_days ORDER BY recorded_at, predicted_days, task_type, module) AS rn
  FROM (SELECT * REPLACE ({half_up('actual_days', 1)} AS actual_days) FROM records)) n
  WHERE rn = 1 AND actual_days > 0 AND NOT EXISTS (SELECT 1 FROM (SELECT task_content, {half_up('actual_days', 1)} AS actual_days FROM records WHERE module IN ('m0', 'm1', 'm2')) e
    WHERE e.task_content = n.task_content AND e.actual_days = n.actual_days)"""))
def est_ingest(spark, sf):
    records = A.calibration(spark, sf)
    known = records.filter(F.col("module").isin("m0", "m1", "m2")).withColumn("actual_days", E.half_up("actual_days", 1))
    return E.ingest_records(known, records)


@query("est_rollup", sql("estimated", f"""SELECT project, module, count(*) AS tasks, {half_up('sum(days)', 1)} AS days,
  CAST(grouping(project, module) AS INTEGER) AS level FROM estimated GROUP BY ROLLUP (project, module)"""))
def est_rollup(spark, sf):
    return E.rollup_days(estimated(spark, sf))


# -- levelling ------------------------------------------------------------------

_EFFORT = "CASE " + " ".join(f"WHEN {any_contains('lower(description)', w)} THEN {lit(d)}" for d, w in R.PLAN_EFFORT) + f" ELSE {lit(R.PLAN_DEFAULT)} END"
cte(
    "efforts",
    ("plan_tasks",),
    f"""SELECT project, seq, CASE WHEN {any_contains('lower(description)', R.TEST_WORDS)} THEN 'test' ELSE 'backend' END AS role,
  {_EFFORT} + links * CAST(0.5 AS DOUBLE) AS effort FROM plan_tasks""",
)
cte(
    "levelled",
    ("efforts",),
    """SELECT project, seq, role, effort, CAST(w + 1 AS BIGINT) AS week,
  least((w + 1) * cap, upto) - greatest(w * cap, since) AS week_effort
FROM (SELECT *, unnest(generate_series(CAST(floor(since / cap) AS BIGINT), greatest(CAST(floor(since / cap) AS BIGINT), CAST(ceil(upto / cap) AS BIGINT) - 1))) AS w
FROM (SELECT *, CASE role WHEN 'test' THEN CAST(5 AS DOUBLE) ELSE CAST(15 AS DOUBLE) END AS cap,
  sum(effort) OVER (PARTITION BY project, role ORDER BY seq) AS upto,
  sum(effort) OVER (PARTITION BY project, role ORDER BY seq) - effort AS since FROM efforts))""",
)


@query("lvl_weeks", sql("levelled", "SELECT * FROM levelled"))
def lvl_weeks(spark, sf):
    return V.level_weeks(A.plan_tasks(spark, sf))


@query("lvl_load", sql("levelled", f"""SELECT project, week, {half_up('b', 1)} AS backend_load, {half_up('t', 1)} AS test_load, tasks,
  {half_up('least(b / 15, t / 5) * 100', 1)} AS load_rate, total_weeks, CAST(DATE '{START}' + CAST(total_weeks * 7 AS INTEGER) AS DATE) AS end_date FROM (
  SELECT project, week, coalesce(sum(week_effort) FILTER (WHERE role = 'backend'), 0) AS b, coalesce(sum(week_effort) FILTER (WHERE role = 'test'), 0) AS t,
    count(DISTINCT seq) AS tasks FROM levelled GROUP BY 1, 2) JOIN (SELECT project, max(week) AS total_weeks FROM levelled GROUP BY 1) USING (project)"""))
def lvl_load(spark, sf):
    return V.weekly_load(V.level_weeks(A.plan_tasks(spark, sf)), START)


_CASES = ", ".join(f"({lit(n)}, CAST({b * 5} AS DOUBLE), CAST({t * 5} AS DOUBLE))" for n, b, t in R.STAFFING)


@query("lvl_scenario", sql("efforts", f"""SELECT project, scenario, CAST(max(ceil(days / CASE role WHEN 'test' THEN test ELSE backend END)) AS BIGINT) AS weeks,
  CAST(sum(n) AS BIGINT) AS tasks, sum(days) AS effort FROM (SELECT project, role, sum(effort) AS days, count(*) AS n FROM efforts GROUP BY 1, 2),
  (VALUES {_CASES}) c(scenario, backend, test) GROUP BY project, scenario"""))
def lvl_scenario(spark, sf):
    return V.staffing_scenarios(A.plan_tasks(spark, sf))


# -- runs -----------------------------------------------------------------------

_COUNTS = f"""count(*) AS total, count(*) FILTER (WHERE status = 'pass') AS passed, count(*) FILTER (WHERE status IN ('fail', 'error')) AS failed,
  count(*) FILTER (WHERE status = 'skip') AS skipped, {half_up('coalesce(sum(duration), 0)', 2)} AS duration,
  {half_up("CAST(count(*) FILTER (WHERE status = 'pass') AS DOUBLE) / count(*) * 100", 1)} AS pass_rate"""


@query("run_summary", sql("runs", f"SELECT project, {_COUNTS} FROM runs GROUP BY project"))
def run_summary(spark, sf):
    return N.run_summary(A.runs(spark, sf), "project")


@query("run_type", sql("runs", f"SELECT type, {_COUNTS} FROM runs GROUP BY type"))
def run_type(spark, sf):
    return N.runs_by_type(A.runs(spark, sf))


@query("run_regression", sql("runs", """SELECT project, coalesce(bool_and(status = 'pass') FILTER (WHERE cohort = 'old'), TRUE) AS regression_passed,
  count(*) FILTER (WHERE cohort = 'old') AS old_results, count(*) FILTER (WHERE cohort <> 'old') AS new_results FROM runs GROUP BY project"""))
def run_regression(spark, sf):
    return N.regression(A.runs(spark, sf))


EXPECTED = [
    ("events", "required", None),
    ("invoices", "required", None),
    ("events", "min_rows", 1000),
    ("labels", "min_rows", 100_000_000),
    ("events", "columns", 6),
    ("labels", "columns", 4),
]


@query("chk_expect", """SELECT 'events' AS table_name, 'required' AS "check", CAST(NULL AS BIGINT) AS bound, CAST(1 AS BIGINT) AS actual, TRUE AS passed
  UNION ALL SELECT 'invoices', 'required', NULL, 0, FALSE
  UNION ALL SELECT 'events', 'min_rows', 1000, count(*), count(*) >= 1000 FROM events
  UNION ALL SELECT 'labels', 'min_rows', 100000000, count(*), count(*) >= 100000000 FROM labels
  UNION ALL SELECT 'events', 'columns', 6, 6, TRUE UNION ALL SELECT 'labels', 'columns', 4, 3, FALSE""")
def chk_expect(spark, sf):
    return N.expectations({n: A.table(spark, sf, n) for n in ("events", "labels")}, EXPECTED)
