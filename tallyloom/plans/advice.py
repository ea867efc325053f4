"""Registered advice queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import advice as V
from .base import cte, half_up, price, sql, strip
from .usage import sessions

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
AS_OF = "2024-02-01 00:00:00"
# Lower limits than the defaults, so that the small driver sessions meet every rule.
LIMITS = {
    "avg_msg_token": 150,
    "zombie_token": 300,
    "output_capped_ratio": 0.05,
    "thinking_ratio": 1.5,
    "imbalance_ratio": 1.0,
    "first3_input_ratio": 0.05,
    "first3_waste_ratio": 1.2,
    "system_prompt_ratio": 0.02,
    "fragment_min_tokens": 100,
    "fragmentation_threshold": 10,
}

# Longest shared substring by binary search on the length.
cte(
    "pairs",
    ("sessions",),
    f"""SELECT id, kind, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS a,
  CASE WHEN length(a) <= length(b) THEN b ELSE a END AS b FROM (
  SELECT id, 'near' AS kind, {strip('first_msg')} AS a, {strip('second_msg')} AS b FROM sessions
  UNION ALL SELECT id, 'far', {strip('first_msg')}, {strip('last_msg')} FROM sessions)
WHERE least(length(a), length(b)) >= CASE kind WHEN 'near' THEN 25 ELSE 20 END""",
)
cte(
    "search",
    ("pairs",),
    """search(id, kind, a, b, lo, hi) AS (/*rec*/
  SELECT id, kind, a, b, CAST(0 AS BIGINT), CAST(length(a) AS BIGINT) FROM pairs
  UNION ALL
  SELECT id, kind, a, b, CASE WHEN hit THEN mid ELSE lo END, CASE WHEN hit THEN hi ELSE mid - 1 END FROM (
    SELECT id, kind, a, b, lo, hi, mid,
      len(list_filter(range(1, length(a) - mid + 2), lambda p: contains(b, substr(a, p, mid)))) > 0 AS hit
    FROM (SELECT *, (lo + hi + 1) // 2 AS mid FROM search WHERE lo < hi)))""",
)
cte(
    "shared",
    ("search",),
    "SELECT id, kind, CASE WHEN lo >= 5 THEN lo ELSE 0 END AS n, length(a) AS m FROM search WHERE lo = hi",
)
cte(
    "overlapping",
    ("sessions", "shared"),
    """SELECT s.*, n.n AS near_shared, n.m AS near_length, f.n AS far_shared, f.m AS far_length,
  CAST(n.n AS DOUBLE) / n.m AS near_ratio, CAST(f.n AS DOUBLE) / f.m AS far_ratio
FROM sessions s LEFT JOIN shared n ON n.id = s.id AND n.kind = 'near' LEFT JOIN shared f ON f.id = s.id AND f.kind = 'far'""",
)

_COSTLY = "(" + " OR ".join(f"contains(lower(model), '{c}')" for c in V.COSTLY) + ")"


def _rule(category, condition, severity, value, tokens="0", usd="CAST(0 AS DOUBLE)", source="sessions") -> str:
    dimension = V.DIMENSIONS[category[0]]
    return (
        f"SELECT id AS session_id, {severity} AS severity, '{dimension}' AS dimension, '{category}' AS category, "
        f"{half_up(value, 4)} AS value, CAST({tokens} AS BIGINT) AS saved_tokens, {usd} AS saved_usd "
        f"FROM {source} WHERE {condition}"
    )


_IDLE = f"(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(time_start)) // 86400000000"
_D = "CAST({} AS DOUBLE)"
RULES = {
    "A1": (
        ("overlapping",),
        _rule("A1", "near_shared >= 5 AND near_ratio >= 0.25", "CASE WHEN near_ratio < 0.65 THEN 'info' ELSE 'warning' END",
              "near_ratio", source="overlapping"),
    ),
    "A2": (
        ("sessions",),
        _rule(
            "A2",
            "user_turns > 0 AND (CAST(total_chars AS DOUBLE) / user_turns > 600 OR CAST(total_input_tokens AS DOUBLE) / user_turns > 150)",
            "CASE WHEN CAST(total_chars AS DOUBLE) / user_turns <= 900 AND CAST(total_input_tokens AS DOUBLE) / user_turns <= 225 THEN 'info' ELSE 'warning' END",
            "CAST(total_input_tokens AS DOUBLE) / user_turns",
        ),
    ),
    "A3": (
        ("sessions",),
        _rule(
            "A3",
            "n_sizes >= 3 AND total_input_tokens > 0 AND CAST(first6_user AS DOUBLE) / total_input_tokens >= 0.05 "
            "AND CAST(first6_assistant AS DOUBLE) / greatest(total_output_tokens, 1) < 1.2",
            "'warning'",
            "CAST(first6_user AS DOUBLE) / total_input_tokens",
        ),
    ),
    "B1": (
        ("sessions",),
        _rule(
            "B1",
            "total_input_tokens > 0 AND system_tokens > 0 AND CAST(system_tokens AS DOUBLE) / total_input_tokens > 0.02",
            "CASE WHEN CAST(system_tokens AS DOUBLE) / total_input_tokens > 0.5 THEN 'critical' "
            "WHEN CAST(system_tokens AS DOUBLE) / total_input_tokens > 0.35 THEN 'warning' ELSE 'info' END",
            "CAST(system_tokens AS DOUBLE) / total_input_tokens",
        ),
    ),
    "B2": (
        ("sessions", "prices"),
        _rule(
            "B2",
            "thinking_tokens > 0 AND thinking_output_tokens > 0 AND CAST(thinking_tokens AS DOUBLE) / thinking_output_tokens > 1.5",
            "CASE WHEN CAST(thinking_tokens AS DOUBLE) / thinking_output_tokens > 4.0 THEN 'warning' ELSE 'info' END",
            "CAST(thinking_tokens AS DOUBLE) / thinking_output_tokens",
            usd=half_up(f"thinking_tokens / 1e6 * {price('model', 'price_out')} * 30", 4),
        ),
    ),
    "B3": (
        ("sessions",),
        _rule(
            "B3",
            "(user_turns > 20 AND assistant_turns = 0) OR (user_turns > 0 AND assistant_turns > 0 AND CAST(user_turns AS DOUBLE) / assistant_turns > 1.0)",
            "CASE WHEN user_turns > 20 AND assistant_turns = 0 THEN 'warning' ELSE 'info' END",
            "CAST(user_turns AS DOUBLE) / greatest(assistant_turns, 1)",
        ),
    ),
    "C1": (
        ("sessions", "specs"),
        _rule(
            "C1",
            "total_output_tokens > 0 AND CAST(total_output_tokens AS DOUBLE) / most >= 0.05",
            "CASE WHEN total_output_tokens % most < most * 0.05 OR CAST(total_output_tokens AS DOUBLE) / most > 0.95 THEN 'warning' ELSE 'info' END",
            "CAST(total_output_tokens AS DOUBLE) / most",
            tokens="least(most * 2, win) - most",
            source="""(SELECT s.*,
  coalesce((SELECT max_tokens FROM specs p WHERE contains(lower(model), p.key) ORDER BY (lower(model) = p.key) DESC, ord LIMIT 1), 8192) AS most,
  coalesce((SELECT context_window FROM specs p WHERE contains(lower(model), p.key) ORDER BY (lower(model) = p.key) DESC, ord LIMIT 1), 128000) AS win
  FROM sessions s)""",
        ),
    ),
    "C2": (
        ("sessions", "prices"),
        _rule(
            "C2",
            f"{_COSTLY} AND total_input_tokens <= 500 AND contains(lower(model), 'flash') AND contains(lower(model), 'deepseek')",
            "'info'",
            f"({price('model', 'price_in')} - 0.14) / 1e6 * total_input_tokens * 1e6",
            usd=half_up(f"({price('model', 'price_in')} - 0.14) / 1e6 * total_input_tokens * 100", 4),
        ),
    ),
    "C3": (
        ("overlapping",),
        _rule("C3", "far_length >= 50 AND far_shared >= 30 AND far_shared // 4 >= 15", "'info'", "far_shared",
              tokens="far_shared // 4", source="overlapping"),
    ),
    "D1": (
        ("sessions",),
        _rule(
            "D1",
            f"{_IDLE} >= 7 AND total_input_tokens >= 300",
            "CASE WHEN total_input_tokens > 100000 THEN 'warning' ELSE 'info' END",
            _IDLE,
            tokens="total_input_tokens",
        ),
    ),
    "D2": (
        ("overlapping",),
        _rule("D2", "far_shared IS NOT NULL AND NOT (far_shared >= 6 AND far_ratio >= 0.25)", "'info'", "far_ratio",
              source="overlapping"),
    ),
    "D3": (
        ("sessions",),
        _rule(
            "D3",
            "user_turns + assistant_turns < 5 AND input_output_ratio < 3.0 AND total_input_tokens >= 100",
            "'info'",
            "user_turns + assistant_turns",
        ),
    ),
}


def _one(category: str):
    def run(spark, sf):
        return V.advise(sessions(spark, sf), AS_OF, thresholds=LIMITS, rules=[category])

    return run


for _c, (_needs, _body) in RULES.items():
    QUERIES[f"adv_{_c.lower()}"] = _one(_c)
    ORACLES[f"adv_{_c.lower()}"] = sql(_needs, _body)

cte(
    "advice",
    ("overlapping", "specs", "prices"),
    "\nUNION ALL ".join(body for _, body in RULES.values()),
)
_RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 WHEN 'info' THEN 2 ELSE 99 END"
cte(
    "top_advice",
    ("advice",),
    f"""SELECT * EXCLUDE (n, nth) FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY
    CASE WHEN n > 3 AND nth > 1 THEN 1 ELSE 0 END, {_RANK}, category) AS position
  FROM (SELECT *, count(*) OVER (PARTITION BY session_id) AS n,
    row_number() OVER (PARTITION BY session_id, dimension ORDER BY {_RANK}, category) AS nth FROM advice))
WHERE position <= 3""",
)


def _advice(spark, sf):
    return V.advise(sessions(spark, sf), AS_OF, thresholds=LIMITS)


def msg_overlap(spark, sf):
    return V.message_overlap(sessions(spark, sf)).select(
        F.col("id").alias("session_id"),
        "near_shared",
        F.round("near_ratio", 6).alias("near_ratio"),
        "far_shared",
        F.round("far_ratio", 6).alias("far_ratio"),
    )


def adv_d3g(spark, sf):
    return V.fragmentation(sessions(spark, sf), AS_OF, thresholds=LIMITS)


def adv_top(spark, sf):
    return V.top_advice(_advice(spark, sf)).withColumn("position", F.col("position").cast("long"))


def adv_group(spark, sf):
    df = V.advice_by_dimension(_advice(spark, sf))
    items = F.transform("items", lambda i: F.concat_ws(":", i["category"], i["severity"]))
    return df.select("session_id", "dimension", "advices", F.array_join(items, ",").alias("items"))


def adv_summary(spark, sf):
    return V.advice_summary(V.top_advice(_advice(spark, sf)))


QUERIES.update(
    msg_overlap=msg_overlap, adv_d3g=adv_d3g, adv_top=adv_top, adv_group=adv_group, adv_summary=adv_summary
)
ORACLES.update(
    msg_overlap=sql("overlapping", """SELECT id AS session_id, near_shared, round(near_ratio, 6) AS near_ratio, far_shared,
  round(far_ratio, 6) AS far_ratio FROM overlapping"""),
    adv_d3g=sql("sessions", f"""SELECT source, 'info' AS severity, 'session_lifecycle' AS dimension, 'D3' AS category,
  count(*) AS sessions, {half_up('avg(user_turns + assistant_turns)', 4)} AS avg_turns FROM sessions
  WHERE start_time > TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AND start_time <= TIMESTAMP '{AS_OF}'
  GROUP BY source HAVING count(*) > 10 AND avg(user_turns + assistant_turns) < 5"""),
    adv_top=sql("top_advice", "SELECT * FROM top_advice"),
    adv_group=sql("advice", f"""SELECT session_id, dimension, count(*) AS advices,
  string_agg(category || ':' || severity, ',' ORDER BY {_RANK}, category) AS items FROM advice GROUP BY session_id, dimension"""),
    adv_summary=sql("top_advice", f"""SELECT dimension, severity, count(*) AS advices, {half_up('sum(saved_usd)', 4)} AS saved_usd
  FROM top_advice GROUP BY CUBE (dimension, severity)"""),
)
