"""Token, cost and session roll-ups."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ordered
from ..functions.messages import clean_message, code_chars, is_machine_made, split_thinking, strip_wrapper
from ..functions.staging import staged
from ..functions.text import (
    SPACE,
    col,
    estimate_tokens,
    half_up,
    keywords,
    ratio2,
    readable,
    rough_tokens,
    strip,
    sub,
)
from ..rules import models as M
from ..session import materialise
from .lookup import source_channel, with_pricing


def zero(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(0))


def usd(tokens: Column | str, price: Column | str) -> Column:
    return col(tokens) / F.lit(1e6) * col(price)


# -- messages -----------------------------------------------------------------


def prepare_messages(messages: DataFrame) -> DataFrame:
    """Clean text, unwrap relays, flag machine-made messages, split thinking, count code: one projection."""
    df = messages.withColumn("text", clean_message("content"))
    body = F.when(F.col("role") == "user", strip_wrapper("text")).otherwise(F.col("text"))
    # staged columns, so that no expression repeats the one before it
    df = df.withColumn("body", body).withColumn("_trimmed", strip("body"))
    thought = F.when(F.col("role") == "assistant", split_thinking("text"))
    df = df.withColumn("_split", thought)
    df = df.withColumn("code_chars", code_chars("text"))
    return df.select(
        *messages.columns,
        "text",
        "body",
        ((F.col("role") == "user") & is_machine_made("_trimmed")).alias("machine_made"),
        F.coalesce(F.col("_split.thinking"), F.lit("")).alias("thinking"),
        F.coalesce(F.col("_split.answer"), F.lit("")).alias("answer"),
        "code_chars",
        (F.length("text") - F.col("code_chars")).cast("long").alias("text_chars"),
    )


def with_token_count(messages: DataFrame, method: str = "rough") -> DataFrame:
    """Add ``token_count``; thinking and tool-call messages count 0."""
    count = rough_tokens("content") if method == "rough" else estimate_tokens("content")
    count = F.when(F.coalesce(F.col("content"), F.lit("")) == "", F.lit(0).cast("long")).otherwise(count)
    silent = F.col("content_type").isin("thinking", "tool_call")
    return messages.withColumn("token_count", F.when(silent, F.lit(0).cast("long")).otherwise(count))


def message_tokens(messages: DataFrame, method: str = "rough") -> DataFrame:
    """Messages and tokens per role and model."""
    return (
        with_token_count(messages, method)
        .groupBy("role", "model")
        .agg(F.count(F.lit(1)).alias("messages"), F.sum("token_count").alias("tokens"))
    )


def session_keywords(messages: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` most frequent keywords per conversation (each message counts a keyword once)."""
    counts = (
        messages.select("conversation_id", F.explode(keywords("content")).alias("keyword"))
        .groupBy("conversation_id", "keyword")
        .agg(F.count(F.lit(1)).alias("messages"))
    )
    return ordered.first_rows(counts, ["conversation_id"], [F.desc("messages"), F.asc("keyword")], k)


def conversation_stats(messages: DataFrame, prices=M.PRICES) -> DataFrame:
    """Input, output, ratio, count and cost per conversation from its messages."""
    df = with_token_count(messages)
    incoming = F.col("role").isin("user", "system")
    outgoing = (F.col("role") == "assistant") & (F.coalesce("content_type", F.lit("text")) == "text")
    tokens = F.col("token_count")
    stats = df.groupBy("conversation_id").agg(
        F.min_by("model", "message_index").alias("model"),
        zero(F.sum(F.when(incoming, tokens))).alias("total_input_tokens"),
        zero(F.sum(F.when(outgoing, tokens))).alias("total_output_tokens"),
        F.count(F.lit(1)).alias("message_count"),
    )
    cost = usd("total_input_tokens", "price_in") + usd("total_output_tokens", "price_out")
    return with_pricing(stats, prices).select(
        "conversation_id",
        "model",
        "total_input_tokens",
        "total_output_tokens",
        ratio2("total_input_tokens", "total_output_tokens").alias("input_output_ratio"),
        "message_count",
        half_up(cost, 6).alias("cost_estimate"),
    )


def message_segments(messages: DataFrame) -> DataFrame:
    """Tokens per conversation and segment: thinking first, else by role; empty segments are left out."""
    label = F.when(F.col("content_type") == "thinking", F.lit("thinking")).when(
        F.col("role").isin("system", "user", "assistant"), F.col("role")
    )
    df = messages.select(
        "conversation_id", label.alias("segment"), rough_tokens("content").alias("tokens")
    ).filter(F.col("segment").isNotNull())
    return df.groupBy("conversation_id", "segment").agg(F.sum("tokens").alias("tokens")).filter("tokens > 0")


# -- calls and sessions -------------------------------------------------------


def session_usage(calls: DataFrame, prices=M.PRICES, cache_discount: float = 0.5) -> DataFrame:
    """Usage per session from its API calls; cached input is charged at ``cache_discount``."""
    df = calls.groupBy("conversation_id").agg(
        zero(F.sum("input")).alias("input_uncached"),
        zero(F.sum("cache_read")).alias("cache_read"),
        zero(F.sum("output")).alias("output"),
        F.count(F.lit(1)).alias("api_calls"),
        F.max_by("model", "call_index").alias("model"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )
    df = df.withColumn("model", F.coalesce(F.nullif("model", F.lit("")), F.lit("unknown")))
    cost = (
        usd("input_uncached", "price_in")
        + usd("cache_read", "price_in") * F.lit(cache_discount)
        + usd("output", "price_out")
    )
    return with_pricing(df, prices).select(
        "conversation_id",
        "model",
        (F.col("input_uncached") + F.col("cache_read")).alias("total_input"),
        "cache_read",
        "output",
        (F.col("input_uncached") + F.col("cache_read") + F.col("output")).alias("total_tokens"),
        "api_calls",
        "first_ts",
        "last_ts",
        half_up(cost, 6).alias("cost"),
        F.lit("real").alias("accuracy"),
    )


def _measured(messages: DataFrame) -> DataFrame:
    """What counts of every message: said text, estimated tokens, characters, thinking."""
    df = prepare_messages(messages)
    real = (F.col("role") == "user") & ~F.col("machine_made") & (F.col("text") != "")
    system = (F.col("role") == "system") & (F.col("text") != "")
    answer = (F.col("role") == "assistant") & (F.col("text") != "")
    used = F.when(real, F.col("body")).when(system | answer, F.col("text"))
    third = F.floor(F.length(used) / 3).cast("long")
    thought = F.floor(F.length("thinking") / 3).cast("long")
    return df.select(
        "conversation_id",
        "message_index",
        "role",
        "ts",
        real.alias("real"),
        F.when(real, F.col("body")).alias("said"),
        used.isNotNull().alias("sized"),
        third.alias("est"),
        F.when(real | answer, F.length(used)).cast("long").alias("chars"),
        F.when(answer, thought).alias("thought"),
        F.when(answer & (F.col("thinking") != ""), F.floor(F.length("answer") / 3)).cast("long").alias("answered"),
    )


def message_sizes(messages: DataFrame) -> DataFrame:
    """Estimated tokens of every message that counts, one row each: a session of any length is whole."""
    df = staged(_measured(messages), {"estimated_tokens": F.col("est")})
    return df.filter(F.col("estimated_tokens").isNotNull()).select(
        "conversation_id", "message_index", "role", "estimated_tokens"
    )


def session_context(messages: DataFrame) -> DataFrame:
    """First, second and last real user message, turns, characters, sizes and time span per session.

    ``message_sizes`` lists the sizes of all messages that count, in order; the operator of that name has
    them as rows. Messages are measured once and written.
    """
    df = materialise(_measured(messages), "measured_messages")
    index = F.col("message_index")
    totals = df.groupBy("conversation_id").agg(
        F.min_by("said", F.when(F.col("real"), index)).alias("first_msg"),
        F.max_by("said", F.when(F.col("real"), index)).alias("last_msg"),
        F.count_if("real").alias("user_turns"),
        F.count_if(F.col("role") == "assistant").alias("assistant_turns"),
        F.count(F.lit(1)).alias("total_messages"),
        zero(F.sum("chars")).alias("total_chars"),
        F.min("ts").alias("time_start"),
        F.max("ts").alias("time_end"),
        zero(F.sum(F.when(F.col("role") == "system", F.col("est")))).alias("system_tokens"),
        zero(F.sum("thought")).alias("thinking_tokens"),
        zero(F.sum("answered")).alias("thinking_output_tokens"),
    )
    real = df.filter("real").select("conversation_id", "message_index", "said")
    second = (
        ordered.first_rows(real, ["conversation_id"], ["message_index"], 2)
        .groupBy("conversation_id")
        .agg(F.max_by("said", "message_index").alias("_second"), F.count(F.lit(1)).alias("_said"))
        .select("conversation_id", F.when(F.col("_said") > 1, F.col("_second")).alias("second_msg"))
    )
    sized = df.filter("sized").select("conversation_id", "message_index", "role", "est")
    sizes = (
        sized.groupBy("conversation_id")
        .agg(F.sort_array(F.collect_list(F.struct("message_index", "role", "est"))).alias("_sizes"))
        .select(
            "conversation_id",
            F.transform(
                "_sizes", lambda s: F.struct(s["role"].alias("role"), s["est"].alias("estimated_tokens"))
            ).alias("message_sizes"),
        )
    )
    df = totals.join(second, "conversation_id", "left").join(sizes, "conversation_id", "left")
    empty = F.array().cast("array<struct<role:string,estimated_tokens:bigint>>")
    blank = F.lit("")
    return df.select(
        "conversation_id",
        F.struct(
            F.coalesce("first_msg", blank).alias("first_msg"),
            F.coalesce("second_msg", blank).alias("second_msg"),
            F.coalesce("last_msg", blank).alias("last_msg"),
            "user_turns",
            "assistant_turns",
            "total_messages",
            "total_chars",
            "time_start",
            "time_end",
            "system_tokens",
            F.coalesce("message_sizes", empty).alias("message_sizes"),
            "thinking_tokens",
            "thinking_output_tokens",
        ).alias("context"),
    )


def session_title(
    first_msg: Column, channel: Column, kind: Column, total_tokens: Column, longest: int | None = None
) -> Column:
    """First message on one line, else channel and kind, large totals appended; cut to ``longest`` only if asked for."""
    flat = strip(sub(first_msg, f"{SPACE}+", " "))
    kind = F.when(F.coalesce(kind, F.lit("direct")).isin("", "direct"), F.lit(None)).otherwise(kind)
    title = F.when(first_msg != "", flat).otherwise(F.concat_ws(" · ", channel, kind))
    if longest:
        title = F.when(F.length(title) > longest, F.concat(F.substring(title, 1, longest - 3), F.lit("..."))).otherwise(title)
    return F.when(
        total_tokens > 10_000, F.concat(title, F.lit(" (输入"), readable(total_tokens), F.lit(")"))
    ).otherwise(title)


def duration_label(start: Column, end: Column) -> Column:
    """Whole hours from 60 minutes on, else minutes, empty below one minute."""
    minutes = F.floor((F.unix_micros(end) - F.unix_micros(start)) / 60_000_000).cast("long")
    return (
        F.when(minutes >= 60, F.concat(F.floor(minutes / 60).cast("string"), F.lit("h")))
        .when(minutes > 0, F.concat(minutes.cast("string"), F.lit("m")))
        .otherwise(F.lit(""))
    )


def size_label(chars: Column) -> Column:
    """Characters as 900, 1.5K or 12K."""
    return (
        F.when(chars >= 10_000, F.concat(F.floor(chars / 1000).cast("string"), F.lit("K")))
        .when(chars >= 1_000, F.concat(half_up(chars / 1000, 1).cast("decimal(20,1)").cast("string"), F.lit("K")))
        .when(chars > 0, chars.cast("string"))
        .otherwise(F.lit(""))
    )


def build_sessions(
    calls: DataFrame,
    messages: DataFrame,
    prices=M.PRICES,
    *,
    origins: DataFrame | None = None,
    source: str = "transcript",
) -> DataFrame:
    """The sessions table: usage joined with context, title, channel, duration and size.

    ``origins`` (conversation_id, source, source_id, kind) is optional. Sessions
    without calls do not appear.
    """
    df = session_usage(calls, prices).join(session_context(messages), "conversation_id")
    if origins is not None:
        df = df.join(origins, "conversation_id", "left")
    else:
        df = df.withColumns({n: F.lit(None).cast("string") for n in ("source", "source_id", "kind")})
    df = df.withColumns(
        {
            "source": F.coalesce("source", F.lit(source)),
            "source_id": F.coalesce("source_id", "conversation_id"),
        }
    )
    channel = source_channel(F.col("source_id"))
    ctx = F.col("context")
    return df.select(
        F.concat_ws("_", "source", "conversation_id").alias("id"),
        "source",
        "source_id",
        session_title(ctx["first_msg"], channel, F.col("kind"), F.col("total_tokens")).alias("title"),
        "model",
        F.col("total_input").alias("total_input_tokens"),
        F.col("output").alias("total_output_tokens"),
        F.col("cache_read").alias("total_cache_read_tokens"),
        F.col("api_calls").alias("api_call_count"),
        ratio2("total_input", "output").alias("input_output_ratio"),
        ctx["total_messages"].alias("message_count"),
        F.col("cost").alias("cost_estimate"),
        "accuracy",
        F.col("first_ts").alias("start_time"),
        F.col("last_ts").alias("end_time"),
        channel.alias("channel"),
        duration_label(ctx["time_start"], ctx["time_end"]).alias("duration"),
        size_label(ctx["total_chars"]).alias("size"),
        "context",
    )


# -- roll-ups over sessions ---------------------------------------------------


def spend(calls: DataFrame, prices=M.PRICES, cache_discount: float = 0.5) -> DataFrame:
    """Cost per session, per model and in total, with and without the cache discount."""
    df = with_pricing(calls, prices)
    df = df.withColumns(
        {
            "_plain": usd(F.col("input") + F.col("cache_read"), "price_in") + usd("output", "price_out"),
            "_cached": usd("input", "price_in")
            + usd("cache_read", "price_in") * F.lit(cache_discount)
            + usd("output", "price_out"),
        }
    )
    # one pass to (session, model), then the three levels from that small table
    base = df.groupBy("conversation_id", "model").agg(
        F.sum("_plain").alias("_plain"), F.sum("_cached").alias("_cached"), F.count(F.lit(1)).alias("_calls")
    )
    level = (
        F.when(F.grouping_id() == 1, F.lit("session")).when(F.grouping_id() == 2, F.lit("model")).otherwise(F.lit("all"))
    )
    return (
        base.groupingSets([["conversation_id"], ["model"], []], "conversation_id", "model")
        .agg(
            level.alias("level"),
            F.sum("_calls").alias("calls"),
            half_up(F.sum("_plain"), 6).alias("cost"),
            half_up(F.sum("_cached"), 6).alias("cost_cached"),
        )
        .select("level", "conversation_id", "model", "calls", "cost", "cost_cached")
    )


def _usage_sums(cost: str = "cost_estimate") -> list[Column]:
    return [
        zero(F.sum("total_input_tokens")).alias("input_tokens"),
        zero(F.sum("total_output_tokens")).alias("output_tokens"),
        half_up(zero(F.sum(cost)), 6).alias("cost"),
    ]


def total_stats(sessions: DataFrame) -> DataFrame:
    """Global totals, 0 for an empty table."""
    return sessions.agg(
        F.count(F.lit(1)).alias("total_conversations"),
        zero(F.sum("total_input_tokens")).alias("total_input"),
        zero(F.sum("total_output_tokens")).alias("total_output"),
        zero(F.sum("total_cache_read_tokens")).alias("total_cache_read"),
        zero(F.sum("api_call_count")).alias("total_api_calls"),
        half_up(zero(F.sum("cost_estimate")), 6).alias("total_cost"),
        zero(F.sum("message_count")).alias("total_messages"),
    )


def high_waste(sessions: DataFrame, threshold: float = 3.0, limit: int = 20) -> DataFrame:
    """Newest sessions whose input/output ratio is above the threshold."""
    return (
        sessions.filter(F.col("input_output_ratio") > threshold)
        .orderBy(F.desc("start_time"), F.asc("id"))
        .limit(limit)
    )


def daily_trend(sessions: DataFrame, as_of: datetime | str, days: int = 30) -> DataFrame:
    """Tokens and cost per day over the last ``days`` days before ``as_of``."""
    floor = F.date_sub(F.to_date(F.lit(as_of)), days)
    return (
        sessions.filter(F.col("start_time") >= floor.cast("timestamp"))
        .groupBy(F.to_date("start_time").alias("day"))
        .agg(*_usage_sums())
    )


def by_source(sessions: DataFrame) -> DataFrame:
    """Sessions, tokens and cost per source."""
    return sessions.groupBy("source").agg(F.count(F.lit(1)).alias("count"), *_usage_sums())


def by_channel(requests: DataFrame) -> DataFrame:
    """Requests, tokens and cost per channel; a blank channel is ``unknown``."""
    channel = F.coalesce(F.nullif("channel", F.lit("")), F.lit("unknown"))
    return (
        requests.groupBy(channel.alias("channel"))
        .agg(
            F.count(F.lit(1)).alias("count"),
            zero(F.sum("input_tokens")).alias("input_tokens"),
            zero(F.sum("output_tokens")).alias("output_tokens"),
            zero(F.sum("total_tokens")).alias("total_tokens"),
            half_up(zero(F.sum("cost")), 6).alias("cost"),
        )
    )


def list_sessions(sessions: DataFrame, source: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """One page of sessions, newest first."""
    df = sessions.filter(F.col("source") == source) if source else sessions
    return df.orderBy(F.desc("start_time"), F.asc("id")).offset(offset).limit(limit)


def list_requests(requests: DataFrame, channel: str | None = None, limit: int = 200) -> DataFrame:
    """Newest requests, optionally of one channel."""
    df = requests.filter(F.col("channel") == channel) if channel else requests
    return df.orderBy(F.desc("ts"), F.asc("request_id")).limit(limit)


def conversation_messages(messages: DataFrame, conversation_id: str) -> DataFrame:
    """All messages of one conversation in order."""
    return messages.filter(F.col("conversation_id") == conversation_id).orderBy("message_index")


def usage_summary(sessions: DataFrame, threshold: float = 3.0, recent: int = 10) -> DataFrame:
    """The newest sessions with a waste mark, next to the overall totals; the sessions are built once."""
    sessions = materialise(sessions, "summed_sessions")
    totals = total_stats(sessions).select(
        "total_conversations",
        "total_messages",
        "total_input",
        "total_output",
        ratio2("total_input", "total_output").alias("overall_ratio"),
        "total_cost",
    )
    newest = list_sessions(sessions, limit=recent).select(
        "id", "title", "total_input_tokens", "total_output_tokens", "input_output_ratio",
        (F.col("input_output_ratio") > threshold).alias("wasteful"),
    )
    overall = totals.select(F.struct(*totals.columns)).scalar()
    return newest.withColumn("_all", overall).select(*newest.columns, "_all.*")


def request_usage(requests: DataFrame, prices=M.PRICES) -> DataFrame:
    """Priced request rows in the shape of one-call sessions.

    Needs request_id, model, channel, input_tokens, output_tokens, total_tokens, response_time_ms, ts.
    """
    cost = usd("input_tokens", "price_in") + usd("output_tokens", "price_out")
    return with_pricing(requests, prices).select(
        F.concat(F.lit("proxy_"), "request_id").alias("id"),
        F.lit("proxy").alias("source"),
        F.col("request_id").alias("source_id"),
        F.concat(F.lit("代理请求 ("), "channel", F.lit(")")).alias("title"),
        "model",
        F.col("input_tokens").alias("total_input_tokens"),
        F.col("output_tokens").alias("total_output_tokens"),
        "total_tokens",
        ratio2("input_tokens", "output_tokens").alias("input_output_ratio"),
        F.lit(1).cast("long").alias("message_count"),
        half_up(cost, 8).alias("request_cost"),
        half_up(cost, 6).alias("cost_estimate"),
        F.lit("real").alias("accuracy"),
        "channel",
        "response_time_ms",
        F.col("ts").alias("start_time"),
        F.col("ts").alias("end_time"),
    )
