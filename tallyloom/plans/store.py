"""Registered queries over transcripts, the session store and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..operators import lookup as L
from ..operators import scan as S
from ..operators import usage as U
from ..session import new_path
from ..sources import files as X
from ..sources import records as R
from ..sources import sinks as K
from ..sources.growing import Transcripts
from ..sources.store import Store
from ..streaming import jobs as J
from .base import CTES, cte, half_up, ratio2, sql
from .scan import ORACLES as SCAN_ORACLES
from .scan import findings
from .usage import sessions

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


# -- transcripts ------------------------------------------------------------------

cte(
    "transcript",
    ("messages", "calls"),
    """SELECT conversation_id AS session, message_index * 2 + 10 AS record_no, 'message' AS type, role, content, ts, model, total_tokens,
    input, cache_read, output, CAST(NULL AS VARCHAR) AS changed, CAST(NULL AS VARCHAR) AS provider, CAST(NULL AS VARCHAR) AS snap, conv_id FROM messages m LEFT JOIN
    (SELECT conversation_id, call_index AS message_index, input, cache_read, output, total_tokens FROM calls) c USING (conversation_id, message_index)
  UNION ALL SELECT conversation_id, 1, 'session', NULL, NULL, min(ts), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, conv_id FROM messages GROUP BY conversation_id, conv_id
  UNION ALL SELECT conversation_id, 2, CASE conv_id % 3 WHEN 0 THEN 'model_change' ELSE 'custom' END, NULL, NULL, CASE conv_id % 3 WHEN 0 THEN min(ts) END,
    NULL, NULL, NULL, NULL, NULL, CASE conv_id % 3 WHEN 0 THEN 'deepseek-chat' END, CASE conv_id % 3 WHEN 0 THEN 'p1' END, CASE conv_id % 3 WHEN 1 THEN 'glm-4' END, conv_id
    FROM messages WHERE conv_id % 3 <> 2 GROUP BY conversation_id, conv_id
  UNION ALL SELECT conversation_id, message_index * 2 + 9, 'model_change', NULL, NULL, ts, NULL, NULL, NULL, NULL, NULL, 'gpt-4o', 'p2', NULL, conv_id FROM messages
    WHERE conv_id % 4 = 0 AND message_index = 3
  UNION ALL SELECT conversation_id, message_index * 2 + 9, 'model_change', NULL, NULL, ts, NULL, NULL, NULL, NULL, NULL, '', '', NULL, conv_id FROM messages
    WHERE conv_id % 5 = 0 AND message_index = 4
  UNION ALL SELECT conversation_id, message_index * 2 + 9, 'custom', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'glm-4', conv_id FROM messages
    WHERE conv_id % 10 = 0 AND message_index = 5""",
)
# The latest model change counts; after an empty one, or before any, the first model that a snapshot or a call names.
cte(
    "transcript_calls",
    ("transcript",),
    """SELECT * EXCLUDE (model), coalesce(nullif(last_changed, ''), first_value(named IGNORE NULLS) OVER (PARTITION BY session, changes ORDER BY record_no
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS model FROM (
  SELECT *, CASE WHEN total_tokens > 0 THEN nullif(model, '') ELSE nullif(snap, '') END AS named, count(changed) OVER w AS changes,
    last_value(changed IGNORE NULLS) OVER w AS last_changed, last_value(provider IGNORE NULLS) OVER w AS last_provider FROM transcript
  WINDOW w AS (PARTITION BY session ORDER BY record_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
)
cte(
    "ingested_usage0",
    ("transcript_calls",),
    """SELECT session AS conversation_id, CAST(sum(input) AS BIGINT) AS input_uncached, CAST(sum(cache_read) AS BIGINT) AS cache_read,
  CAST(sum(output) AS BIGINT) AS output, count(*) AS api_calls, coalesce(nullif(max_by(model, record_no), ''), 'unknown') AS model,
  min(ts) AS first_ts, max(ts) AS last_ts FROM transcript_calls WHERE total_tokens > 0 GROUP BY session""",
)
cte("ingested_usage", ("ingested_usage0", "prices"), CTES["usage"][1].removeprefix("usage AS (")[:-1].replace("FROM usage0", "FROM ingested_usage0"))
cte("ingested_origins", (), """SELECT DISTINCT 'c' || conv_id AS conversation_id, 'transcript' AS source, 'agent:a:feishu:' || conv_id AS source_id,
  'direct' AS kind FROM conversations""")
cte(
    "ingested",
    ("ingested_usage", "context", "ingested_origins"),
    CTES["sessions"][1].removeprefix("sessions AS (")[:-1].replace("FROM usage u", "FROM ingested_usage u").replace("JOIN origins o", "JOIN ingested_origins o"),
)


def _written(spark, sf, path: str, wave: int, files: int = 4) -> None:
    """Transcript files of the conversations: the first records of all sessions, or the rest."""
    first = F.col("record_no") <= 14
    df = A.transcript_lines(spark, sf).filter(first if wave == 0 else ~first)
    df = df.repartition(files, "session").sortWithinPartitions("session", "record_no")
    df.select("value").write.text(f"{path}/wave={wave}")


@query("src_transcript", sql("transcript", """SELECT session, row_number() OVER (PARTITION BY session ORDER BY record_no) - 1 AS record_no, type, ts, role,
  CASE WHEN conv_id % 2 = 0 THEN content ELSE trim(content, ' ' || chr(10)) END AS content, changed AS changed_model, snap AS snapshot_model,
  total_tokens FROM transcript"""))
def src_transcript(spark, sf):
    path = new_path(spark, "transcripts")
    for wave in (0, 1):
        _written(spark, sf, path, wave)
    df = R.read_transcripts(spark, path, glob="*.txt")
    return df.select(
        "session", "record_no", "type", "ts", "role", "content", "changed_model", "snapshot_model",
        F.col("usage.totalTokens").alias("total_tokens"),
    )


@query("src_calls", sql("transcript_calls", """SELECT session AS conversation_id, record_no AS call_index, input, cache_read, output, total_tokens,
  model, coalesce(last_provider, '') AS provider FROM transcript_calls WHERE total_tokens > 0"""))
def src_calls(spark, sf):
    df = R.usage_calls(R.parse_transcripts(A.transcript_lines(spark, sf)))
    return df.select("conversation_id", "call_index", "input", "cache_read", "output", "total_tokens", "model", "provider")


@query("src_tree", r"""SELECT source AS project, md5(text || chr(10)) AS digest, length(text) + 1 AS chars FROM documents
  WHERE NOT contains(source, 'src1')""")
def src_tree(spark, sf):
    root = new_path(spark, "tree")
    X.write_tree(A.document_texts(spark, sf), root)
    df = X.read_sources(spark, root, "python", exclude=["project=src1"], extension=".txt")
    return df.select(
        F.regexp_extract("path", "project=([^/]*)/", 1).alias("project"),
        F.md5("text").alias("digest"),
        F.length("text").cast("long").alias("chars"),
    )


# -- store ------------------------------------------------------------------------

_COLUMNS = [
    "id", "source", "source_id", "title", "model", "total_input_tokens", "total_output_tokens", "total_cache_read_tokens",
    "api_call_count", "input_output_ratio", "message_count", "cost_estimate", "accuracy", "start_time", "end_time", "context",
]


def _existing(spark, sf):
    """An older state of the transcript and proxy sessions."""
    df = sessions(spark, sf).select(*_COLUMNS).filter(F.col("source").isin("transcript", "proxy"))
    return df.withColumns(
        {
            "source": F.concat(F.lit("old-"), "source"),
            "source_id": F.when(F.col("model") == "GPT-4o", "moved").otherwise(F.col("source_id")),
            "start_time": F.col("start_time") - F.make_dt_interval(F.lit(1)),
            "message_count": F.lit(1).cast("long"),
            "total_output_tokens": F.lit(1).cast("long"),
        }
    )


def _incoming(spark, sf):
    """The present proxy and extension sessions; some arrive without context."""
    df = sessions(spark, sf).select(*_COLUMNS).filter(F.col("source").isin("proxy", "extension"))
    return df.withColumn("context", F.when(F.col("model") != "other-model", F.col("context")))


cte("old_sessions", ("sessions",), """SELECT id, 'old-' || source AS source, CASE WHEN model = 'GPT-4o' THEN 'moved' ELSE source_id END AS source_id, title, model,
  total_input_tokens, CAST(1 AS BIGINT) AS total_output_tokens, CAST(1 AS BIGINT) AS message_count, start_time - INTERVAL 1 DAY AS start_time, end_time, total_chars
  FROM sessions WHERE source IN ('transcript', 'proxy')""")
cte("new_sessions", ("sessions",), """SELECT id, source, source_id, title, model, total_input_tokens, total_output_tokens, message_count, start_time, end_time,
  CASE WHEN model <> 'other-model' THEN total_chars END AS total_chars FROM sessions WHERE source IN ('proxy', 'extension')""")


@query("snk_upsert", sql(("old_sessions", "new_sessions"), f"""SELECT id, coalesce(o.source, n.source) AS source, CASE WHEN n.id IS NULL THEN o.source_id ELSE n.source_id END AS source_id,
  coalesce(n.model, o.model) AS model, coalesce(n.total_input_tokens, o.total_input_tokens) AS total_input_tokens,
  coalesce(n.total_output_tokens, o.total_output_tokens) AS total_output_tokens,
  {ratio2('coalesce(n.total_input_tokens, o.total_input_tokens)', 'coalesce(n.total_output_tokens, o.total_output_tokens)')} AS input_output_ratio,
  CASE WHEN n.id IS NULL OR (n.total_chars IS NULL AND o.id IS NOT NULL) THEN o.message_count ELSE n.message_count END AS message_count,
  coalesce(o.start_time, n.start_time) AS start_time, coalesce(n.end_time, o.end_time) AS end_time,
  CASE WHEN n.total_chars IS NULL THEN o.total_chars ELSE n.total_chars END AS context_chars
  FROM old_sessions o FULL JOIN new_sessions n USING (id)"""))
def snk_upsert(spark, sf):
    df = K.upsert_sessions(_existing(spark, sf), _incoming(spark, sf))
    return df.select(
        "id", "source", "source_id", "model", "total_input_tokens", "total_output_tokens", "input_output_ratio",
        "message_count", "start_time", "end_time", F.col("context.total_chars").alias("context_chars"),
    )


@query("snk_store", ORACLES["snk_upsert"])
def snk_store(spark, sf):
    # the same through a stored table of which only the touched buckets are written anew
    old = _existing(spark, sf)
    store = Store(spark, new_path(spark, "store"), "id", old.schema, buckets=8)
    store.write(old, lambda known, new: new)
    store.write(_incoming(spark, sf), lambda known, new: K.upsert_sessions(known, new))
    return store.read().select(
        "id", "source", "source_id", "model", "total_input_tokens", "total_output_tokens", "input_output_ratio",
        "message_count", "start_time", "end_time", F.col("context.total_chars").alias("context_chars"),
    )


@query("snk_guard", sql(("old_sessions", "new_sessions"), """SELECT n.id, n.source_id, n.model FROM new_sessions n LEFT JOIN old_sessions o USING (id)
  WHERE o.id IS NULL OR o.source_id = n.source_id"""))
def snk_guard(spark, sf):
    return K.accepted(_existing(spark, sf), _incoming(spark, sf)).select("id", "source_id", "model")


@query("snk_replace", sql("messages", """SELECT conversation_id, message_index, role, content FROM messages
    WHERE conversation_id NOT IN (SELECT conversation_id FROM messages WHERE role = 'system')
  UNION ALL SELECT conversation_id, row_number() OVER (PARTITION BY conversation_id ORDER BY message_index) - 1, role, content FROM messages
    WHERE role <> 'system' AND conversation_id IN (SELECT conversation_id FROM messages WHERE role = 'system')"""))
def snk_replace(spark, sf):
    old = A.messages(spark, sf).select("conversation_id", "message_index", "role", "content")
    systems = old.filter(F.col("role") == "system").select("conversation_id").distinct()
    new = old.join(systems, "conversation_id", "left_semi").filter(F.col("role") != "system")
    return K.replace_messages(old, new)


@query("snk_delete", sql(("sessions", "messages"), """SELECT 'session' AS kind, id, CAST(NULL AS BIGINT) AS message_index FROM sessions WHERE model <> 'other-model'
  UNION ALL SELECT 'message', m.conversation_id, m.message_index FROM messages m
    WHERE m.conversation_id NOT IN (SELECT conversation_id FROM sessions WHERE model = 'other-model')"""))
def snk_delete(spark, sf):
    s, m = sessions(spark, sf), A.messages(spark, sf)
    ids = s.filter(F.col("model") == "other-model").select("id", F.concat(F.lit("c"), F.element_at(F.split("source_id", ":"), -1)).alias("conversation_id"))
    left, rest = K.delete_sessions(s, m, ids)
    none = F.lit(None).cast("long")
    return left.select(F.lit("session").alias("kind"), "id", none.alias("message_index")).unionByName(
        rest.select(F.lit("message").alias("kind"), F.col("conversation_id").alias("id"), "message_index")
    )


@query("snk_report", SCAN_ORACLES["scan_stats"])
def snk_report(spark, sf):
    df = S.finding_stats(findings(spark, sf))
    path = K.write_report(df, new_path(spark, "report"), "json")
    return spark.read.schema(df.schema).json(path)


# -- streams ----------------------------------------------------------------------


def _priced_stream(spark, sf):
    df = L.with_channel(A.requests(spark, sf, A.stream(spark, sf, "events")))
    df = R.parse_usage(df, "body").withColumn("model", R.request_model("request_body")).filter(F.col("usage").isNotNull())
    cost = U.usd("usage.prompt_tokens", "price_in") + U.usd("usage.completion_tokens", "price_out")
    return L.with_pricing(df).select(
        "request_id",
        "channel",
        "ts",
        F.col("usage.prompt_tokens").alias("input_tokens"),
        F.col("usage.completion_tokens").alias("output_tokens"),
        U.half_up(cost, 8).alias("cost"),
    )


@query("str_ingest", sql("ingested", """SELECT id, source, source_id, title, model, total_input_tokens, total_output_tokens, api_call_count,
  message_count, cost_estimate, start_time, end_time FROM ingested"""))
def str_ingest(spark, sf):
    spark.dataSource.register(Transcripts)
    path, base = new_path(spark, "transcripts"), new_path(spark, "ingest")
    for wave in (0, 1):  # the second run meets the rest of the sessions
        _written(spark, sf, path, wave)
        lines = spark.readStream.format("transcripts").option("glob", "*.txt").load(path)
        J.ingest_sessions(lines, f"{base}/out", f"{base}/checkpoint")
    df = J.stored_sessions(spark, f"{base}/out")
    return df.select(
        "id", "source", "source_id", "title", "model", "total_input_tokens", "total_output_tokens", "api_call_count",
        "message_count", "cost_estimate", "start_time", "end_time",
    )


@query("str_usage", sql("priced_requests", f"""SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS start, CAST(CAST(ts AS DATE) + 1 AS TIMESTAMP) AS "end", channel,
  count(*) AS requests, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, {half_up('sum(cost)', 6)} AS cost
  FROM priced_requests GROUP BY 1, 2, 3"""))
def str_usage(spark, sf):
    return J.usage_by_window(_priced_stream(spark, sf), "1 day")


@query("str_slide", sql("priced_requests", f"""SELECT CAST(d AS TIMESTAMP) AS start, CAST(d + INTERVAL 30 DAY AS TIMESTAMP) AS "end", channel, count(*) AS requests,
  CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, {half_up('sum(cost)', 6)} AS cost
  FROM (SELECT *, unnest(generate_series(CAST(ts AS DATE) - INTERVAL 29 DAY, CAST(CAST(ts AS DATE) AS TIMESTAMP), INTERVAL 1 DAY)) AS d FROM priced_requests) GROUP BY 1, 2, 3"""))
def str_slide(spark, sf):
    return J.usage_by_window(_priced_stream(spark, sf), "30 days", "1 day")


@query("str_dedup", sql("priced_requests", "SELECT request_id, channel, ts, input_tokens, output_tokens, cost FROM priced_requests"))
def str_dedup(spark, sf):
    return J.distinct_requests(_priced_stream(spark, sf).unionByName(_priced_stream(spark, sf)))


@query("str_idle", """SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS "end", count(*) AS events FROM (
  SELECT *, sum(CASE WHEN prev IS NULL OR ts - prev >= INTERVAL 12 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (
    SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events))
  GROUP BY user_id, run HAVING max(ts) + INTERVAL 12 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def str_idle(spark, sf):
    return J.activity_sessions(A.stream(spark, sf, "events").select("user_id", "ts"), "user_id", "12 hours", "1 hour")


@query("str_scan", sql("findings", "SELECT * FROM findings"))
def str_scan(spark, sf):
    return J.scan_stream(A.code_files(spark, sf, A.stream(spark, sf, "documents")))
