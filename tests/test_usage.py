from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyloom.functions.messages import code_chars, is_machine_made, split_thinking, strip_wrapper
from tallyloom.functions.text import estimate_tokens, rough_tokens
from tallyloom.operators import lookup as L
from tallyloom.operators import usage as U
from tallyloom.schemas import MESSAGES
from tallyloom.sources import records as R
from tallyloom.sources import sinks as K


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "c string").select(expression(F.col("c")).alias("x")).first().x


@pytest.mark.parametrize(
    "text,want",
    [
        ("System: [t] DM from ou_1: hello", "hello"),
        ("System: [t] DM from a: System: [u] Group in b: System: [v] PM from c: deep", "deep"),
        ("System: only a colon", "only a colon"),
        ("plain\n\nConversation info (x)\nmore", "plain"),
        ("plain\n[message_id: 3]", "plain"),
        ("plain\nou_" + "a" * 32 + ": x", "plain"),
    ],
)
def test_strip_wrapper(spark, text, want):
    assert one(spark, text, strip_wrapper) == want


@pytest.mark.parametrize(
    "text,want",
    [("", True), ("/new x", True), ("[2024-01-01] x", True), ("...!?", True), ("Exec completed ok", True), ("你好", False), ("hi", False)],
)
def test_machine_made(spark, text, want):
    assert one(spark, text, is_machine_made) is want


def test_split_thinking(spark):
    got = one(spark, "<thinking>a</thinking> b", split_thinking)
    assert (got.thinking, got.answer) == ("<thinking>a</thinking>", "b")
    got = one(spark, "think\n---\nsay", split_thinking)
    assert (got.thinking, got.answer) == ("think", "say")
    got = one(spark, "---\nsay", split_thinking)
    assert (got.thinking, got.answer) == ("", "---\nsay")


def test_counts(spark):
    assert one(spark, "", estimate_tokens) == 0
    assert one(spark, "ab", estimate_tokens) == 1
    assert one(spark, "abcdefg", estimate_tokens) == 2
    assert one(spark, "你好世界hello", rough_tokens) == 4
    assert one(spark, "x\n```py\nab\n```\ny", code_chars) == len("```py\nab\n```")


def test_prices_by_list_and_by_table(spark):
    df = spark.createDataFrame([("GPT-4o",), ("gpt-4o-mini-x",), ("nope",), (None,), ("deepseek-chat",)], "model string")
    by_list = L.with_pricing(df)
    table = spark.createDataFrame(
        [(k, i, a, b) for i, (k, a, b) in enumerate(L.M.PRICES)], "key string, ord int, price_in double, price_out double"
    )
    want = {"GPT-4o": 2.5, "gpt-4o-mini-x": 2.5, "nope": 0.0, None: 0.0, "deepseek-chat": 0.14}
    for got in (by_list, L.with_pricing(df, table)):
        assert {r.model: r.price_in for r in got.collect()} == want


def test_channel_order(spark):
    df = spark.createDataFrame(
        [(" mine ", 8090, "curl/8"), ("", 8090, "curl/8"), ("", 1, "curl/8"), (None, 1, "Mozilla vscode"), ("", 1, None)],
        "channel_header string, port int, user_agent string",
    )
    assert [r.channel for r in L.with_channel(df).collect()] == ["mine", "default", "curl", "VSCode", "unknown"]


def test_usage_from_bodies(spark):
    df = spark.createDataFrame(
        [
            ('{"usage": {"prompt_tokens": 0, "input_tokens": 7, "completion_tokens": 2, "total_tokens": 9}}',),
            ('{"x": 1}',),
            ("{bad",),
        ],
        "body string",
    )
    got = [r.usage for r in R.parse_usage(df, "body").collect()]
    assert tuple(got[0]) == (7, 2, 9) and got[1] is None and got[2] is None


def test_usage_from_event_stream(spark):
    text = (
        'data: {"usage": {"prompt_tokens": 1, "completion_tokens": 1, "total_tokens": 2}}\n\n'
        'data: {"usage": {"prompt_tokens": 10, "completion_tokens": 20, "total_tokens": 30}}\n\ndata: {bad "usage"\n\ndata: [DONE]\n'
    )
    df = spark.createDataFrame([(text,), ("data: [DONE]",)], "body string")
    got = [r.usage for r in R.parse_sse_usage(df, "body").collect()]
    assert tuple(got[0]) == (10, 20, 30) and got[1] is None


def test_transcripts(spark, tmp_path):
    lines = [
        '{"type": "session", "timestamp": "2024-01-01T00:00:00Z", "key": "agent:a:main:1"}',
        '{"type": "custom", "customType": "model-snapshot", "data": {"modelId": "snap"}}',
        '{"type": "message", "timestamp": "2024-01-01T00:01:00Z", "message": {"role": "user", "content": [{"type": "text", "text": " hi "}, {"type": "image"}]}}',
        '{"type": "message", "timestamp": "2024-01-01T00:02:00Z", "message": {"role": "assistant", "content": "a", "model": "own", "usage": {"input": 5, "output": 2, "totalTokens": 7}}}',
        '{"type": "model_change", "modelId": "new", "provider": "p"}',
        "not json",
        '{"type": "message", "timestamp": "2024-01-02T00:00:00Z", "message": {"role": "assistant", "content": "b", "usage": {"input": 1, "output": 1, "cacheRead": 3, "totalTokens": 5}}}',
        '{"type": "message", "message": {"role": "assistant", "content": "c", "usage": {"totalTokens": 0}}}',
    ]
    (tmp_path / "s1.jsonl").write_text("\n".join(lines))
    (tmp_path / "s1.reset.jsonl").write_text(lines[0])
    (tmp_path / "empty.jsonl").write_text("")
    records = R.read_transcripts(spark, str(tmp_path))
    assert records.count() == len(lines)
    assert records.filter("corrupt IS NOT NULL").count() == 1
    calls = R.usage_calls(records).orderBy("call_index").collect()
    assert [(c.model, c.input, c.cache_read, c.provider) for c in calls] == [("snap", 5, 0, ""), ("new", 1, 3, "p")]
    messages = R.transcript_messages(records)
    assert messages.orderBy("message_index").first().content == "hi"
    late = R.usage_calls(R.read_transcripts(spark, str(tmp_path), min_ts="2024-01-01T12:00:00Z"))
    assert late.count() == 1
    sessions = U.build_sessions(R.usage_calls(records), messages, origins=R.transcript_origins(records)).first()
    assert (sessions.model, sessions.message_count, sessions.channel) == ("new", 4, "主会话")
    assert sessions.total_input_tokens == 9 and sessions.input_output_ratio == 3.0


def test_all_message_sizes_are_rows(spark):
    roles = ["user", "assistant", "system", "tool"]
    rows = [("a", i, roles[i % 4], "x" * (i + 3), "text", "m", datetime(2024, 1, 1)) for i in range(300)]
    df = spark.createDataFrame([*rows, ("b", 0, "user", "", "text", "m", None)], MESSAGES)
    got = sorted(tuple(r) for r in U.message_sizes(df).collect())
    assert got == [("a", i, roles[i % 4], (i + 3) // 3) for i in range(300) if i % 4 < 3]
    listed = U.session_context(df).filter("conversation_id = 'a'").first().context.message_sizes
    assert [tuple(s) for s in listed] == [g[2:] for g in got[: len(listed)]] and len(listed) >= 6


def test_context_lists_the_sizes_of_all_messages(spark):
    rows = [("a", i, ("user", "assistant")[i % 2], "x" * (3 * i + 3), "text", "m", datetime(2024, 1, 1)) for i in range(250)]
    listed = U.session_context(spark.createDataFrame(rows, MESSAGES).repartition(5)).first().context.message_sizes
    assert [tuple(s) for s in listed] == [(("user", "assistant")[i % 2], i + 1) for i in range(250)]


SESSION = "id string, source string, source_id string, model string, total_input_tokens bigint, total_output_tokens bigint, " \
    "input_output_ratio double, message_count bigint, cost_estimate double, start_time timestamp, context struct<total_messages:bigint>"


def _session(i, source="a", tin=1500, tout=500, n=5, start=1, ctx=5, sid="x", cost=0.01):
    return (i, source, sid, "m", tin, tout, 0.0, n, cost, datetime(2024, 1, start), (ctx,))


def test_upsert_keeps_first_source_and_context(spark):
    old = spark.createDataFrame([_session("s1"), _session("s2")], SESSION)
    new = spark.createDataFrame([_session("s1", "b", 3000, 400, 9, 2, 0), _session("s3", "b", ctx=0, n=1)], SESSION)
    got = {r.id: r for r in K.upsert_sessions(old, new).collect()}
    assert (got["s1"].source, got["s1"].message_count, got["s1"].start_time.day) == ("a", 5, 1)
    assert (got["s1"].total_input_tokens, got["s1"].input_output_ratio) == (3000, 7.5)
    assert got["s3"].message_count == 1 and got["s2"].input_output_ratio == 3.0


def test_guard_and_rollups(spark):
    old = spark.createDataFrame([_session("s1"), _session("s2", sid="y")], SESSION)
    new = spark.createDataFrame([_session("s1"), _session("s2"), _session("s3")], SESSION)
    assert {r.id for r in K.accepted(old, new).collect()} == {"s1", "s3"}
    df = spark.createDataFrame(
        [_session("s1", tin=1000, tout=200), _session("s2", tin=2000, tout=400, n=10, cost=0.02)], SESSION
    ).withColumns({"total_cache_read_tokens": F.lit(0), "api_call_count": F.lit(1)})
    t = U.total_stats(df).first()
    assert (t.total_input, t.total_output, t.total_messages, t.total_cost) == (3000, 600, 15, 0.03)
    assert U.total_stats(df.limit(0)).first().total_input == 0


def test_replace_and_delete(spark):
    schema = "conversation_id string, message_index bigint, content string"
    old = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")], schema)
    new = spark.createDataFrame([("a", 7, "p"), ("a", 3, "q"), ("a", 11, "r")], schema)
    got = sorted(tuple(r) for r in K.replace_messages(old, new, size=2).collect())
    assert got == [("a", 0, "q"), ("a", 1, "p"), ("a", 2, "r"), ("b", 0, "z")]
    ids = spark.createDataFrame([("s_a", "a")], "id string, conversation_id string")
    s, m = K.delete_sessions(spark.createDataFrame([("s_a",), ("s_b",)], "id string"), old, ids)
    assert [r.id for r in s.collect()] == ["s_b"] and [r.conversation_id for r in m.collect()] == ["b"]


def test_report_formats(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "k string, n int")
    for fmt in K.FORMATS:
        path = K.write_report(df, str(tmp_path / fmt), fmt)
        assert spark.read.format(fmt).option("header", "true").load(path).count() == 1
    with pytest.raises(ValueError):
        K.write_report(df, str(tmp_path / "x"), "xls")
