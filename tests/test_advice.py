import itertools
import random
from datetime import datetime

import pytest

from tallyloom.operators import advice as V

SCHEMA = (
    "id string, model string, source string, total_input_tokens bigint, total_output_tokens bigint, input_output_ratio double, "
    "start_time timestamp, context struct<first_msg:string,second_msg:string,last_msg:string,user_turns:bigint,"
    "assistant_turns:bigint,total_chars:bigint,time_start:timestamp,system_tokens:bigint,thinking_tokens:bigint,"
    "thinking_output_tokens:bigint,message_sizes:array<struct<role:string,estimated_tokens:bigint>>>"
)
AS_OF = "2024-02-01 00:00:00"
LONG = "please look at the login failure in the service log again "


def session(**kw):
    ctx = dict(
        first_msg="", second_msg="", last_msg="", user_turns=6, assistant_turns=6, total_chars=100,
        time_start=datetime(2024, 1, 31), system_tokens=0, thinking_tokens=0, thinking_output_tokens=0, message_sizes=[],
    )
    row = dict(id="s", model="gpt-4o", source="a", total_input_tokens=1000, total_output_tokens=500, input_output_ratio=2.0,
               start_time=datetime(2024, 1, 31))
    for k, v in kw.items():
        (ctx if k in ctx else row)[k] = v
    return (*row.values(), tuple(ctx.values()))


CASES = [
    ("A1", dict(first_msg=LONG, second_msg=LONG), "warning"),
    ("A1", dict(first_msg="x" * 8 + LONG[:20] + "q" * 40, second_msg=LONG[:20] + "z" * 60), "info"),
    ("A1", dict(first_msg="short", second_msg="short"), None),
    ("A2", dict(total_input_tokens=6 * 900), "info"),
    ("A2", dict(total_input_tokens=6 * 1300), "warning"),
    ("A2", dict(user_turns=0, total_input_tokens=9000), None),
    ("A3", dict(message_sizes=[("user", 700), ("assistant", 10), ("user", 10)]), "warning"),
    ("A3", dict(message_sizes=[("user", 700), ("assistant", 10)]), None),
    ("B1", dict(system_tokens=300), "info"),
    ("B1", dict(system_tokens=400), "warning"),
    ("B1", dict(system_tokens=600), "critical"),
    ("B1", dict(system_tokens=250), None),
    ("B2", dict(thinking_tokens=300, thinking_output_tokens=100), "info"),
    ("B2", dict(thinking_tokens=500, thinking_output_tokens=100), "warning"),
    ("B2", dict(thinking_tokens=200, thinking_output_tokens=100), None),
    ("B3", dict(user_turns=21, assistant_turns=0), "warning"),
    ("B3", dict(user_turns=7, assistant_turns=2), "info"),
    ("B3", dict(user_turns=20, assistant_turns=0), None),
    ("C1", dict(total_output_tokens=14_500), "info"),
    ("C1", dict(total_output_tokens=16_000), "warning"),
    ("C1", dict(total_output_tokens=16_500), "warning"),
    ("C1", dict(total_output_tokens=10_000), None),
    ("C2", dict(model="deepseek-v4-flash", total_input_tokens=400), "info"),
    ("C2", dict(model="gpt-4o", total_input_tokens=400), None),
    ("C3", dict(first_msg=LONG * 2, last_msg="a" + LONG * 2), "info"),
    ("C3", dict(first_msg=LONG, last_msg="b" * 60), None),
    ("D1", dict(time_start=datetime(2024, 1, 20), total_input_tokens=60_000), "info"),
    ("D1", dict(time_start=datetime(2024, 1, 20), total_input_tokens=160_000), "warning"),
    ("D1", dict(time_start=datetime(2024, 1, 26), total_input_tokens=160_000), None),
    ("D2", dict(first_msg="a" * 30, last_msg="b" * 30), "info"),
    ("D2", dict(first_msg=LONG, last_msg=LONG), None),
    ("D3", dict(user_turns=2, assistant_turns=2), "info"),
    ("D3", dict(user_turns=3, assistant_turns=2), None),
]


def test_rules_fire_as_stated(spark):
    rows = [session(id=f"{i}", **kw) for i, (_, kw, _) in enumerate(CASES)]
    got = {(r.session_id, r.category): r.severity for r in V.advise(spark.createDataFrame(rows, SCHEMA), AS_OF).collect()}
    wrong = [(i, c, kw, s, got.get((str(i), c))) for i, (c, kw, s) in enumerate(CASES) if got.get((str(i), c)) != s]
    assert not wrong


def test_thresholds_can_be_overridden(spark):
    df = spark.createDataFrame([session()], SCHEMA)
    assert V.advise(df, AS_OF, rules=["B1"]).count() == 0
    assert V.advise(df, AS_OF, rules=["A2"], thresholds={"avg_msg_token": 10}).count() == 1


def test_top_advice_matches_selection_by_hand(spark):
    rng, order = random.Random(4), {"critical": 0, "warning": 1, "info": 2}
    cats = [f"{d}{n}" for d, n in itertools.product("ABCD", "123")]
    rows, want = [], set()
    for s in range(150):
        mine = [(rng.choice(list(order)), V.DIMENSIONS[c[0]], c) for c in rng.sample(cats, rng.randint(1, 8))]
        rows += [(f"s{s}", *m, 1.0, 0, 0.0) for m in mine]
        best = sorted(mine, key=lambda m: (order[m[0]], m[2]))
        if len(best) > 3:
            firsts = [m for i, m in enumerate(best) if m[1] not in {x[1] for x in best[:i]}]
            best = (firsts + [m for m in best if m not in firsts])[:3]
        want |= {(f"s{s}", m[2], i + 1) for i, m in enumerate(best)}
    df = spark.createDataFrame(
        rows, "session_id string, severity string, dimension string, category string, value double, saved_tokens bigint, saved_usd double"
    )
    assert {(r.session_id, r.category, r.position) for r in V.top_advice(df).collect()} == want


def test_fragmentation(spark):
    few = [session(id=f"a{i}", user_turns=1, assistant_turns=1) for i in range(21)]
    many = [session(id=f"b{i}", source="b") for i in range(30)]
    got = V.fragmentation(spark.createDataFrame(few + many, SCHEMA), AS_OF).collect()
    assert [(r.source, r.sessions) for r in got] == [("a", 21)]


def test_idle_days_by_last_message(spark):
    from pyspark.sql import functions as F

    old = session(time_start=datetime(2024, 1, 2), total_input_tokens=60_000)
    df = spark.createDataFrame([old], SCHEMA)
    late = df.withColumn("context", F.col("context").withField("time_end", F.lit(datetime(2024, 1, 31))))
    by = lambda since: V.advise(late, AS_OF, rules=["D1"], thresholds={"idle_since": since}).count()
    assert by("time_start") == 1 and by("time_end") == 0
