"""Transcript records, API calls and usage objects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ordered
from ..functions.messages import clean_parts
from ..functions.text import col
from ..schemas import CONTENT_PARTS, TRANSCRIPT_RECORD

_COUNTS = "prompt_tokens bigint, input_tokens bigint, completion_tokens bigint, output_tokens bigint, total_tokens bigint"
_BODY = f"usage struct<{_COUNTS.replace(' bigint', ':bigint')}>"


# The place of a line: its file, a part of the file, its row in that part.
PLACE = ["file", "block", "row"]
# Lines of a growing file are counted in parts of so many bytes.
BLOCK_BYTES = 64 << 20


def located(scan: DataFrame) -> DataFrame:
    """Lines of a text scan, a text stream or the ``transcripts`` source with their place and the file's time.

    A text scan reads large files in splits and numbers the rows of a task, so a row's place
    is its split and that number; the source gives the line's first byte.
    """
    if "at" in scan.columns:
        return scan.select("value", "file", "modified", F.floor(F.col("at") / BLOCK_BYTES).alias("block"), F.col("at").alias("row"))
    return scan.select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_modification_time").alias("modified"),
        F.col("_metadata.file_block_start").alias("block"),
    )


def transcript_text(df: DataFrame) -> DataFrame:
    """``(session, value, modified, file, block, row)`` of located lines, of a batch scan or one micro-batch.

    The session is the ``session`` field of the record, else the file name. Cleared files
    (``.reset.`` or ``.deleted.`` in the name) and blank lines are left out.
    """
    name = F.regexp_extract("file", r"([^/]*)$", 1)
    df = df.filter(~name.contains(".reset.") & ~name.contains(".deleted.") & (F.trim("value") != ""))
    if "row" not in df.columns:
        df = df.withColumn("row", F.monotonically_increasing_id())
    session = F.coalesce(F.get_json_object("value", "$.session"), F.regexp_replace(name, r"\.[^.]*$", ""))
    return df.select(session.alias("session"), "value", "modified", *PLACE)


def numbered(records: DataFrame, arrival: Sequence[str]) -> DataFrame:
    """Add ``record_no``: 0, 1, 2, ... in each session over all its files.

    Files come in the order of their first ``arrival`` (columns), then by name; inside a file
    rows come by block and row. Only one count for each session, file and block is put in
    order over a session, so a session of any size is numbered in parts.
    """
    place = ["session", *PLACE[:-1]]
    inside = F.row_number().over(W.partitionBy(*place).orderBy(PLACE[-1])) - 1
    counts = records.groupBy(*place).agg(F.count("*").alias("_n"), F.min(F.struct(*arrival)).alias("_came"))
    counts = counts.withColumn("_came", F.min("_came").over(W.partitionBy("session", "file")))
    before = F.sum("_n").over(W.partitionBy("session").orderBy("_came", *PLACE[:-1]).rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select(*place, F.coalesce(before, F.lit(0)).alias("_start"))
    df = records.withColumn("_inside", inside).join(starts, place)
    return df.withColumn("record_no", F.col("_start") + F.col("_inside")).drop("_start", "_inside")


def read_transcripts(spark: SparkSession, path: str, min_ts: str | None = None, glob: str = "*.jsonl") -> DataFrame:
    """JSON-lines session files as typed records, numbered over the files of a session by time, then name.

    Empty files have no lines. Bad lines keep their text in ``corrupt``. A time floor
    drops usage, not the record, so message counts stay whole.
    """
    raw = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path)
    return parse_transcripts(numbered(transcript_text(located(raw)), ["modified"]), min_ts)


def parse_transcripts(raw: DataFrame, min_ts: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Typed records from ``(session, record_no, value)`` lines, with the columns to ``keep``."""
    raw = raw.filter(F.trim("value") != "")
    number = ["record_no"] if "record_no" in raw.columns else []
    rec = F.from_json("value", TRANSCRIPT_RECORD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    df = raw.select(
        "session", *number, rec.alias("r"), F.get_json_object("value", "$.message.content").alias("_content"), *keep
    )
    parts = F.from_json("_content", CONTENT_PARTS)
    text = F.when(F.col("_content").startswith("["), clean_parts(parts)).otherwise(F.col("_content"))
    ts = F.try_to_timestamp(F.col("r.timestamp"))
    usage = F.col("r.message.usage")
    if min_ts is not None:
        usage = F.when(ts.isNull() | (ts >= F.lit(min_ts).cast("timestamp")), usage)
    return df.select(
        "session",
        *number,
        F.col("r.type").alias("type"),
        ts.alias("ts"),
        F.col("r.key").alias("key"),
        F.col("r.kind").alias("kind"),
        F.col("r.channel").alias("channel"),
        F.when(F.col("r.type") == "model_change", F.coalesce("r.modelId", F.lit(""))).alias("changed_model"),
        F.when(F.col("r.type") == "model_change", F.coalesce("r.provider", F.lit(""))).alias("changed_provider"),
        F.when(
            (F.col("r.type") == "custom") & (F.col("r.customType") == "model-snapshot"), F.col("r.data.modelId")
        ).alias("snapshot_model"),
        F.col("r.message.role").alias("role"),
        text.alias("content"),
        F.col("r.message.model").alias("message_model"),
        usage.alias("usage"),
        F.col("r._corrupt").alias("corrupt"),
        *keep,
    )


def joined_parts(records: DataFrame, arrival: Sequence[str]) -> DataFrame:
    """Records of sessions that came in several files and batches, each once, numbered over all of them.

    ``arrival``: the columns that say when a row came. ``digest`` is the text of the
    record. A place of a file is read once, so rows are told apart by it. A record with
    a time that comes again in another file is a repeated delivery; a record without a time
    is one wherever it lies. Equal records inside a file are told apart by their order.
    """
    same = ["session", "digest"]
    copy = F.row_number().over(W.partitionBy(*same, "file").orderBy(*PLACE[1:]))
    timed = records.filter("ts IS NOT NULL").withColumn("_copy", copy)
    timed = ordered.first_by(timed, [*same, "_copy"], [*arrival, *PLACE])
    df = timed.drop("_copy").unionByName(records.filter("ts IS NULL"))
    return numbered(df, arrival).drop("digest", *arrival, *PLACE)


def usage_calls(records: DataFrame) -> DataFrame:
    """API calls: records with a role and ``usage.totalTokens > 0``.

    The model is that of the latest ``model_change``. When that is empty, or there was none,
    it is the first one named since, by a snapshot or by a call itself. Both are carried
    forward in chunks, so one very long session does not land in one task.
    """
    is_call = F.coalesce((F.col("role") != "") & (F.col("usage.totalTokens") > 0), F.lit(False))
    named = F.nullif(F.when(is_call, F.col("message_model")).otherwise(F.col("snapshot_model")), F.lit(""))
    changed = F.col("changed_model").isNotNull()
    df = ordered.carry_forward(
        records,
        ["session"],
        "record_no",
        {"_changed": F.when(changed, F.struct("changed_model", "changed_provider"))},
    )
    df = ordered.first_since(df, ["session"], "record_no", changed, named, "_named")
    zero = lambda f: F.coalesce(F.col(f"usage.{f}"), F.lit(0)).cast("long")
    return df.filter(is_call).select(
        F.col("session").alias("conversation_id"),
        F.col("record_no").alias("call_index"),
        zero("input").alias("input"),
        zero("cacheRead").alias("cache_read"),
        zero("cacheWrite").alias("cache_write"),
        zero("output").alias("output"),
        zero("totalTokens").alias("total_tokens"),
        F.coalesce(F.nullif("_changed.changed_model", F.lit("")), "_named", F.lit("")).alias("model"),
        F.coalesce("_changed.changed_provider", F.lit("")).alias("provider"),
        "role",
        "ts",
    )


def transcript_messages(records: DataFrame) -> DataFrame:
    """The message records as the messages table."""
    return records.filter(F.col("type") == "message").filter(F.col("role") != "").select(
        F.col("session").alias("conversation_id"),
        F.col("record_no").alias("message_index"),
        "role",
        F.coalesce("content", F.lit("")).alias("content"),
        F.lit("text").alias("content_type"),
        F.col("message_model").alias("model"),
        "ts",
    )


def transcript_origins(records: DataFrame, source: str = "transcript") -> DataFrame:
    """Source id and kind per session from its ``session`` record."""
    first = F.when(F.col("type") == "session", F.col("record_no"))
    return records.groupBy(F.col("session").alias("conversation_id")).agg(
        F.lit(source).alias("source"),
        F.coalesce(
            F.nullif(F.max_by("key", first), F.lit("")),
            F.nullif(F.max_by("channel", first), F.lit("")),
            F.min("session"),
        ).alias("source_id"),
        F.coalesce(F.nullif(F.max_by("kind", first), F.lit("")), F.lit("direct")).alias("kind"),
    )


# -- usage objects in responses -------------------------------------------------


def request_model(body: Column | str) -> Column:
    """``model`` field of a request body, empty when absent or not JSON."""
    return F.coalesce(F.get_json_object(col(body), "$.model"), F.lit(""))


def _usage(u: Column) -> Column:
    def first(a: str, b: str) -> Column:
        return F.coalesce(F.nullif(u[a], F.lit(0).cast("long")), u[b], F.lit(0).cast("long"))

    counts = F.struct(
        first("prompt_tokens", "input_tokens").alias("prompt_tokens"),
        first("completion_tokens", "output_tokens").alias("completion_tokens"),
        F.coalesce(u["total_tokens"], F.lit(0).cast("long")).alias("total_tokens"),
    )
    return F.when(u.isNotNull(), counts)


def parse_usage(df: DataFrame, body: str) -> DataFrame:
    """Add ``usage`` (prompt, completion, total) from a JSON body; NULL without a usage object."""
    # parsed in a column of its own: the counts refer to it several times
    parsed = df.withColumn("_usage", F.from_json(F.col(body), _BODY)["usage"])
    return parsed.withColumn("usage", _usage(F.col("_usage"))).drop("_usage")


def parse_sse_usage(df: DataFrame, body: str) -> DataFrame:
    """Add ``usage`` from an event-stream body: the last ``data:`` line that carries one.

    Works inside the row with array functions; the substring test comes first so
    that only lines naming a usage are parsed.
    """
    lines = F.transform(F.split(F.col(body), "\n"), lambda x: F.trim(x))
    tagged = F.filter(lines, lambda x: x.startswith("data: ") & x.contains('"usage"'))
    parsed = F.transform(tagged, lambda x: F.from_json(F.substring(x, F.lit(7), F.length(x)), _BODY)["usage"])
    found = F.filter(parsed, lambda u: u.isNotNull())
    last = df.withColumn("_usage", F.try_element_at(found, F.lit(-1)))
    return last.withColumn("usage", _usage(F.col("_usage"))).drop("_usage")
