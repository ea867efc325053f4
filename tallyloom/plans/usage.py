"""Registered queries over messages, sessions and requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..functions.text import rough_tokens
from ..operators import lookup as L
from ..operators import usage as U
from ..rules import models as M
from ..sources import records as R
from .base import any_contains, half_up, lit, price, ratio2, rough, sql, strip, t3

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
AS_OF = "2024-01-31 00:00:00"


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def sessions(spark, sf):
    return U.build_sessions(A.calls(spark, sf), A.messages(spark, sf), origins=A.origins(spark, sf))


def priced_requests(spark, sf):
    """Requests with channel, model, usage and cost."""
    df = L.with_channel(A.requests(spark, sf))
    df = R.parse_usage(df, "body").withColumn("model", R.request_model("request_body"))
    df = df.filter(F.col("usage").isNotNull())
    cost = U.usd("input_tokens", "price_in") + U.usd("output_tokens", "price_out")
    return (
        L.with_pricing(
            df.select(
                "request_id",
                "model",
                "channel",
                F.col("usage.prompt_tokens").alias("input_tokens"),
                F.col("usage.completion_tokens").alias("output_tokens"),
                F.col("usage.total_tokens").alias("total_tokens"),
                "response_time_ms",
                "ts",
            )
        )
        .withColumn("cost", U.half_up(cost, 8))
        .drop("price_in", "price_out")
    )


# -- 2.1 records ----------------------------------------------------------------


@query("src_usage_body", sql("used_requests", """
SELECT request_id, model, CASE WHEN has_usage THEN pt END AS prompt_tokens, CASE WHEN has_usage THEN ct END AS completion_tokens,
  CASE WHEN has_usage THEN tt END AS total_tokens FROM used_requests"""))
def src_usage_body(spark, sf):
    df = R.parse_usage(A.requests(spark, sf), "body")
    return df.select(
        "request_id", R.request_model("request_body").alias("model"),
        "usage.prompt_tokens", "usage.completion_tokens", "usage.total_tokens",
    )


_SSE = """
SELECT r.request_id, u.prompt_tokens, u.completion_tokens, u.total_tokens
FROM requests r LEFT JOIN (
  SELECT request_id, arg_max(pt, pos) AS prompt_tokens, arg_max(ct, pos) AS completion_tokens, arg_max(tt, pos) AS total_tokens
  FROM (SELECT request_id, pos, coalesce(nullif(CAST(json_extract(u, '$.prompt_tokens') AS BIGINT), 0),
          CAST(json_extract(u, '$.input_tokens') AS BIGINT), 0) AS pt,
        coalesce(nullif(CAST(json_extract(u, '$.completion_tokens') AS BIGINT), 0),
          CAST(json_extract(u, '$.output_tokens') AS BIGINT), 0) AS ct,
        coalesce(CAST(json_extract(u, '$.total_tokens') AS BIGINT), 0) AS tt
    FROM (SELECT request_id, pos, json_extract(CAST(payload AS JSON), '$.usage') AS u
      FROM (SELECT request_id, pos, CASE WHEN json_valid(substr(line, 7)) THEN substr(line, 7) END AS payload
        FROM (SELECT request_id, unnest(string_split(stream_body, chr(10))) AS line,
                generate_subscripts(string_split(stream_body, chr(10)), 1) AS pos FROM requests)
        WHERE starts_with(line, 'data: ')) WHERE payload IS NOT NULL)
    WHERE u IS NOT NULL) GROUP BY request_id) u USING (request_id)"""


@query("src_sse_usage", sql("requests", _SSE))
def src_sse_usage(spark, sf):
    df = R.parse_sse_usage(A.requests(spark, sf), "stream_body")
    return df.select("request_id", "usage.prompt_tokens", "usage.completion_tokens", "usage.total_tokens")


# -- 2.2 messages ---------------------------------------------------------------


@query("msg_prep", sql("prep", """
SELECT conversation_id, message_index, role, text, body, machine_made, thinking, answer,
  CAST(code_chars AS BIGINT) AS code_chars, CAST(length(text) - code_chars AS BIGINT) AS text_chars FROM prep"""))
def msg_prep(spark, sf):
    return U.prepare_messages(A.messages(spark, sf)).drop("content", "content_type", "model", "ts", "conv_id")


@query("msg_tokens", sql("messages", f"""
SELECT role, model, count(*) AS messages, CAST(sum(CASE WHEN content_type IN ('thinking', 'tool_call') OR content = ''
  THEN 0 ELSE {rough('content')} END) AS BIGINT) AS tokens FROM messages GROUP BY role, model"""))
def msg_tokens(spark, sf):
    return U.message_tokens(A.messages(spark, sf))


@query("msg_keywords", sql("messages", r"""
SELECT conversation_id, keyword, messages FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id
    ORDER BY messages DESC, keyword) AS rn
  FROM (SELECT conversation_id, keyword, count(*) AS messages
    FROM (SELECT conversation_id, message_index, unnest(list_distinct(list_concat(
        regexp_extract_all(content, '[\x{4e00}-\x{9fff}]{4,}'),
        list_transform(list_filter(regexp_extract_all(content, '[\p{L}\p{N}_]+'),
          lambda w: regexp_full_match(w, '[a-zA-Z]{4,}')), lambda w: lower(w))))) AS keyword FROM messages)
    GROUP BY conversation_id, keyword)) WHERE rn <= 5"""))
def msg_keywords(spark, sf):
    return U.session_keywords(A.messages(spark, sf), 5)


@query("flt_page", sql("sessions", """
SELECT id, source, title, model, total_input_tokens, start_time FROM sessions WHERE source = 'proxy'
ORDER BY start_time DESC, id LIMIT 10 OFFSET 5"""))
def flt_page(spark, sf):
    df = U.list_sessions(sessions(spark, sf), source="proxy", limit=10, offset=5)
    return df.select("id", "source", "title", "model", "total_input_tokens", "start_time")


@query("flt_logs", sql("channelled", """
SELECT request_id, channel, response_time_ms, ts FROM channelled WHERE channel = 'curl' ORDER BY ts DESC, request_id LIMIT 200"""))
def flt_logs(spark, sf):
    df = U.list_requests(L.with_channel(A.requests(spark, sf)), channel="curl", limit=200)
    return df.select("request_id", "channel", "response_time_ms", "ts")


@query("flt_messages", sql("messages", """
SELECT conversation_id, message_index, role, content, ts FROM messages WHERE conversation_id = 'c3' ORDER BY message_index"""))
def flt_messages(spark, sf):
    return U.conversation_messages(A.messages(spark, sf), "c3").select(
        "conversation_id", "message_index", "role", "content", "ts"
    )


# -- 2.3 look-ups ---------------------------------------------------------------


@query("jn_price", sql(("messages", "prices"), f"""
SELECT conversation_id, message_index, model, {price('model', 'price_in')} AS price_in, {price('model', 'price_out')} AS price_out FROM messages"""))
def jn_price(spark, sf):
    df = A.messages(spark, sf).select("conversation_id", "message_index", "model")
    return L.with_pricing(df)


@query("jn_spec", sql(("messages", "specs"), """
SELECT conversation_id, message_index, model,
  coalesce((SELECT s.context_window FROM specs s WHERE contains(lower(model), s.key) ORDER BY (lower(model) = s.key) DESC, ord LIMIT 1), 128000) AS context_window,
  coalesce((SELECT s.max_tokens FROM specs s WHERE contains(lower(model), s.key) ORDER BY (lower(model) = s.key) DESC, ord LIMIT 1), 8192) AS max_tokens
FROM messages"""))
def jn_spec(spark, sf):
    # the rule-table form of the look-up
    rules = spark.createDataFrame(
        [(k, i, w, m) for i, (k, w, m) in enumerate(M.SPECS)], "key string, ord int, context_window int, max_tokens int"
    )
    df = A.messages(spark, sf).select("conversation_id", "message_index", "model")
    return L.with_model_spec(df, rules)


@query("jn_encoding", sql(("messages", "encodings"), """
SELECT conversation_id, message_index, model, coalesce((SELECT s.encoding FROM encodings s
  WHERE contains(lower(model), s.key) ORDER BY (lower(model) = s.key) DESC, ord LIMIT 1), 'cl100k_base') AS encoding FROM messages"""))
def jn_encoding(spark, sf):
    return L.with_encoding(A.messages(spark, sf).select("conversation_id", "message_index", "model"))


@query("jn_channel", sql("channelled", "SELECT request_id, channel FROM channelled"))
def jn_channel(spark, sf):
    return L.with_channel(A.requests(spark, sf)).select("request_id", "channel")


# -- 2.4 aggregations -----------------------------------------------------------

_PLAIN = f"sum((input + cache_read) / 1e6 * {price('model', 'price_in')} + output / 1e6 * {price('model', 'price_out')})"


@query("agg_spend", sql(("calls", "prices"), f"""
SELECT CASE g WHEN 1 THEN 'session' WHEN 2 THEN 'model' ELSE 'all' END AS level, conversation_id, model,
  CAST(calls AS BIGINT) AS calls, {half_up('plain', 6)} AS cost, {half_up('cached', 6)} AS cost_cached
FROM (SELECT conversation_id, model, grouping(conversation_id, model) AS g, sum(n) AS calls, sum(plain) AS plain, sum(cached) AS cached
  FROM (SELECT conversation_id, model, count(*) AS n, sum((input + cache_read) / 1e6 * pin + output / 1e6 * pout) AS plain,
      sum(input / 1e6 * pin + cache_read / 1e6 * pin * 0.5 + output / 1e6 * pout) AS cached
    FROM (SELECT *, {price('model', 'price_in')} AS pin, {price('model', 'price_out')} AS pout FROM calls)
    GROUP BY conversation_id, model)
  GROUP BY GROUPING SETS ((conversation_id), (model), ()))"""))
def agg_spend(spark, sf):
    return U.spend(A.calls(spark, sf))


_SESSION_COLUMNS = """id, source, source_id, title, model, total_input_tokens, total_output_tokens, total_cache_read_tokens,
  api_call_count, input_output_ratio, message_count, cost_estimate, accuracy, start_time, end_time, channel, duration, size"""


@query("ses_build", sql("sessions", f"""
SELECT {_SESSION_COLUMNS}, first_msg, second_msg, last_msg, user_turns, assistant_turns, system_tokens, sizes FROM sessions"""))
def ses_build(spark, sf):
    df = sessions(spark, sf)
    sizes = F.transform(
        "context.message_sizes", lambda s: F.concat_ws(":", s["role"], s["estimated_tokens"].cast("string"))
    )
    return df.select(
        *[c for c in df.columns if c != "context"],
        *[f"context.{c}" for c in ("first_msg", "second_msg", "last_msg", "user_turns", "assistant_turns", "system_tokens")],
        F.array_join(sizes, ",").alias("sizes"),
    )


@query("agg_convstats", sql(("messages", "prices"), f"""
SELECT conversation_id, model, tin AS total_input_tokens, tout AS total_output_tokens, {ratio2('tin', 'tout')} AS input_output_ratio,
  message_count, {half_up(f"tin / 1e6 * {price('model', 'price_in')} + tout / 1e6 * {price('model', 'price_out')}", 6)} AS cost_estimate
FROM (SELECT conversation_id, arg_min(model, message_index) AS model, count(*) AS message_count,
  CAST(coalesce(sum(tok) FILTER (WHERE role IN ('user', 'system')), 0) AS BIGINT) AS tin,
  CAST(coalesce(sum(tok) FILTER (WHERE role = 'assistant' AND content_type = 'text'), 0) AS BIGINT) AS tout
  FROM (SELECT *, CASE WHEN content_type IN ('thinking', 'tool_call') OR content = '' THEN 0 ELSE {rough('content')} END AS tok FROM messages)
  GROUP BY conversation_id)"""))
def agg_convstats(spark, sf):
    return U.conversation_stats(A.messages(spark, sf))


@query("agg_segments", sql("messages", f"""
SELECT conversation_id, segment, CAST(sum(tok) AS BIGINT) AS tokens FROM (SELECT conversation_id,
  CASE WHEN content_type = 'thinking' THEN 'thinking' WHEN role IN ('system', 'user', 'assistant') THEN role END AS segment,
  {rough('content')} AS tok FROM messages) WHERE segment IS NOT NULL GROUP BY 1, 2 HAVING sum(tok) > 0"""))
def agg_segments(spark, sf):
    return U.message_segments(A.messages(spark, sf))


@query("agg_session", sql("usage", """SELECT conversation_id, model, total_input, cache_read, output, total_tokens, api_calls,
  first_ts, last_ts, cost, accuracy FROM usage"""))
def agg_session(spark, sf):
    return U.session_usage(A.calls(spark, sf))


@query("agg_context", sql("context", """SELECT conversation_id, first_msg, second_msg, last_msg, user_turns, assistant_turns,
  total_messages, total_chars, time_start, time_end, system_tokens, thinking_tokens, thinking_output_tokens, sizes AS message_sizes FROM context"""))
def agg_context(spark, sf):
    df = U.session_context(A.messages(spark, sf)).select("conversation_id", "context.*")
    sizes = F.transform(
        "message_sizes", lambda s: F.concat_ws(":", s["role"], s["estimated_tokens"].cast("string"))
    )
    return df.withColumn("message_sizes", F.array_join(sizes, ","))


@query("agg_sizes", sql("said", """SELECT conversation_id, message_index, role, length(used) // 3 AS estimated_tokens
  FROM said WHERE used IS NOT NULL"""))
def agg_sizes(spark, sf):
    return U.message_sizes(A.messages(spark, sf))


@query("agg_totals", sql("sessions", f"""SELECT count(*) AS total_conversations,
  CAST(coalesce(sum(total_input_tokens), 0) AS BIGINT) AS total_input, CAST(coalesce(sum(total_output_tokens), 0) AS BIGINT) AS total_output,
  CAST(coalesce(sum(total_cache_read_tokens), 0) AS BIGINT) AS total_cache_read, CAST(coalesce(sum(api_call_count), 0) AS BIGINT) AS total_api_calls,
  {half_up('coalesce(sum(cost_estimate), 0)', 6)} AS total_cost, CAST(coalesce(sum(message_count), 0) AS BIGINT) AS total_messages FROM sessions"""))
def agg_totals(spark, sf):
    return U.total_stats(sessions(spark, sf))


@query("agg_waste", sql("sessions", """SELECT id, title, model, input_output_ratio, start_time FROM sessions
  WHERE input_output_ratio > 1.0 ORDER BY start_time DESC, id LIMIT 20"""))
def agg_waste(spark, sf):
    return U.high_waste(sessions(spark, sf), threshold=1.0).select("id", "title", "model", "input_output_ratio", "start_time")


_SUMS = f"""CAST(coalesce(sum(total_input_tokens), 0) AS BIGINT) AS input_tokens,
  CAST(coalesce(sum(total_output_tokens), 0) AS BIGINT) AS output_tokens, {half_up('coalesce(sum(cost_estimate), 0)', 6)} AS cost"""


@query("agg_daily", sql("sessions", f"""SELECT CAST(start_time AS DATE) AS day, {_SUMS} FROM sessions
  WHERE start_time >= DATE '2024-01-03' GROUP BY 1"""))
def agg_daily(spark, sf):
    return U.daily_trend(sessions(spark, sf), "2024-02-02", 30)


@query("agg_source", sql("sessions", f"SELECT source, count(*) AS count, {_SUMS} FROM sessions GROUP BY source"))
def agg_source(spark, sf):
    return U.by_source(sessions(spark, sf))


@query("agg_channel", sql("priced_requests", f"""SELECT channel, count(*) AS count, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
  CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, {half_up('sum(cost)', 6)} AS cost
  FROM priced_requests GROUP BY channel"""))
def agg_channel(spark, sf):
    return U.by_channel(priced_requests(spark, sf))


@query("agg_reqlog", sql(("priced_requests", "prices"), f"""SELECT 'proxy_' || request_id AS id, 'proxy' AS source, request_id AS source_id,
  '代理请求 (' || channel || ')' AS title, model, input_tokens AS total_input_tokens, output_tokens AS total_output_tokens, total_tokens,
  {ratio2('input_tokens', 'output_tokens')} AS input_output_ratio, CAST(1 AS BIGINT) AS message_count, cost AS request_cost,
  {half_up(f"input_tokens / 1e6 * {price('model', 'price_in')} + output_tokens / 1e6 * {price('model', 'price_out')}", 6)} AS cost_estimate,
  'real' AS accuracy, channel, response_time_ms, ts AS start_time, ts AS end_time FROM priced_requests"""))
def agg_reqlog(spark, sf):
    return U.request_usage(priced_requests(spark, sf))


@query("agg_summary", sql("sessions", f"""SELECT s.*, t.* FROM
  (SELECT id, title, total_input_tokens, total_output_tokens, input_output_ratio, input_output_ratio > 3.0 AS wasteful
   FROM sessions ORDER BY start_time DESC, id LIMIT 10) s,
  (SELECT count(*) AS total_conversations, CAST(sum(message_count) AS BIGINT) AS total_messages, CAST(sum(total_input_tokens) AS BIGINT) AS total_input,
   CAST(sum(total_output_tokens) AS BIGINT) AS total_output, {ratio2('sum(total_input_tokens)', 'sum(total_output_tokens)')} AS overall_ratio,
   {half_up('sum(cost_estimate)', 6)} AS total_cost FROM sessions) t"""))
def agg_summary(spark, sf):
    return U.usage_summary(sessions(spark, sf))


@query("flagship", sql(("messages", "prices"), f"""
SELECT CAST(ts AS DATE) AS day, model, count(DISTINCT conversation_id) AS conversations, CAST(sum(tin) AS BIGINT) AS input_tokens,
  CAST(sum(tout) AS BIGINT) AS output_tokens, {ratio2('sum(tin)', 'sum(tout)')} AS ratio,
  {half_up(f"sum(tin) / 1e6 * {price('model', 'price_in')} + sum(tout) / 1e6 * {price('model', 'price_out')}", 6)} AS cost
FROM (SELECT *, CASE WHEN role IN ('user', 'system') THEN {rough('content')} ELSE 0 END AS tin,
   CASE WHEN role = 'assistant' AND content_type = 'text' THEN {rough('content')} ELSE 0 END AS tout FROM messages)
GROUP BY 1, 2"""))
def flagship(spark, sf):
    """Cost and ratio per day and model."""
    n = rough_tokens("content")
    df = (
        A.messages(spark, sf)
        .groupBy(F.to_date("ts").alias("day"), "model")
        .agg(
            F.countDistinct("conversation_id").alias("conversations"),
            F.sum(F.when(F.col("role").isin("user", "system"), n).otherwise(0)).alias("input_tokens"),
            F.sum(
                F.when((F.col("role") == "assistant") & (F.col("content_type") == "text"), n).otherwise(0)
            ).alias("output_tokens"),
        )
    )
    cost = U.usd("input_tokens", "price_in") + U.usd("output_tokens", "price_out")
    return L.with_pricing(df).select(
        "day", "model", "conversations", "input_tokens", "output_tokens",
        ratio2_spark("input_tokens", "output_tokens").alias("ratio"), U.half_up(cost, 6).alias("cost"),
    )


def ratio2_spark(a, b):
    return U.ratio2(a, b)
