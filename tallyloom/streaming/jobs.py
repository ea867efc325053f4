"""The usage and scan jobs on streams.

Every job takes a streaming DataFrame, runs what is available and leaves its
result in files below the shared folder. Results of a micro-batch go to a folder
named by the batch, so a batch that runs again after a failure replaces its own
output. No job keeps state: every batch leaves its own records, sums, pieces or rows,
and reading adds them up, so a row counts however late it comes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions import ordered
from ..functions.text import half_up
from ..operators import scan as S
from ..operators import usage as U
from ..rules import models as M
from ..session import materialise, new_path
from ..sources import records as R
from ..sources.files import document_lines
from ..sources.store import read_batches


def _run(writer: DataStreamWriter, checkpoint: str) -> None:
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def _batches(df: DataFrame, path: str, checkpoint: str, mode: str) -> None:
    """Write every micro-batch to ``path/batch=<n>``, replacing an earlier try."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    _run(df.writeStream.outputMode(mode).foreachBatch(write), checkpoint)


def _paths(spark, name: str) -> tuple[str, str]:
    base = new_path(spark, name)
    return f"{base}/out", f"{base}/checkpoint"


# -- sessions ---------------------------------------------------------------------


def ingest_sessions(lines: DataFrame, path: str, checkpoint: str) -> None:
    """Records of new transcript lines, one folder per micro-batch.

    ``lines``: a stream of the ``transcripts`` source, which also sees what is appended
    to a known file, or of text files. The store is append-only; ``stored_sessions``
    builds the sessions from all of it, so a session may come in any number of
    files and batches.
    """

    def write(batch: DataFrame, number: int) -> None:
        text = R.transcript_text(batch).withColumn("digest", F.sha2("value", 256))
        records = R.parse_transcripts(text, keep=["modified", *R.PLACE, "digest"])
        records.write.mode("overwrite").parquet(f"{path}/batch={number}")

    _run(R.located(lines).writeStream.foreachBatch(write), checkpoint)


def stored_records(spark, path: str) -> DataFrame:
    """The transcript records of an ingest folder, numbered over all files of a session."""
    return R.joined_parts(spark.read.parquet(path), ["batch", "modified"])


def stored_sessions(spark, path: str, *, prices=M.PRICES) -> DataFrame:
    """The session table of an ingest folder."""
    records = materialise(stored_records(spark, path), "records")
    return U.build_sessions(
        R.usage_calls(records), R.transcript_messages(records), prices, origins=R.transcript_origins(records)
    )


# -- usage ------------------------------------------------------------------------

_SUMS = ("requests", "input_tokens", "output_tokens", "cost")


def _step_sums(requests: DataFrame, step: str) -> DataFrame:
    """Requests, tokens and cost per step of time and channel. ``requests`` is priced."""
    return requests.groupBy(F.window("ts", step)["start"].alias("step"), "channel").agg(
        F.count(F.lit(1)).alias("requests"), *[F.sum(c).alias(c) for c in _SUMS[1:]]
    )


def usage_by_window(requests: DataFrame, length: str = "1 day", slide: str | None = None) -> DataFrame:
    """Run the windowed usage job and read its current result.

    Each micro-batch writes its sums per step (``slide``, or the window itself).
    Reading adds the batches up per step first and only then spreads a step over
    the windows that hold it, so a request is never multiplied by the windows.
    """
    spark, step = requests.sparkSession, slide or length
    path, checkpoint = _paths(spark, "usage")

    def write(batch: DataFrame, number: int) -> None:
        _step_sums(batch, step).write.mode("overwrite").parquet(f"{path}/batch={number}")

    _run(requests.writeStream.foreachBatch(write), checkpoint)
    steps = read_batches(spark, path).groupBy("step", "channel").agg(*[F.sum(c).alias(c) for c in _SUMS])
    span = F.window("step", length, slide) if slide else F.window("step", length)
    out = steps.groupBy(span.alias("span"), "channel").agg(*[F.sum(c).alias(c) for c in _SUMS])
    return out.select(
        F.col("span.start").alias("start"), F.col("span.end").alias("end"), "channel", *_SUMS[:3], half_up("cost", 6).alias("cost")
    )


def distinct_requests(requests: DataFrame) -> DataFrame:
    """One row per request id, the earliest, although files are delivered twice and at any time."""
    spark = requests.sparkSession
    path, checkpoint = _paths(spark, "distinct")
    _batches(requests, path, checkpoint, "append")
    rest = [c for c in requests.columns if c not in ("request_id", "ts")]
    first = spark.read.parquet(path).groupBy("request_id").agg(F.min(F.struct("ts", *rest)).alias("_r"))
    return first.select("request_id", "_r.*").select(*requests.columns)


def activity_sessions(events: DataFrame, key: str, gap: str, delay: str) -> DataFrame:
    """Runs of activity per key that an idle gap has closed. ``events``: key, ts.

    Two events less than a gap apart belong to one run. Time is cut into steps of one gap, so
    what a key does in a step is one piece of a run: first and last time and a count, which add
    up over batches in any order. Reading joins neighbouring pieces, so an event
    that comes late still closes, extends or joins runs. A run is closed when its gap ended
    ``delay`` before the latest event.
    """
    spark = events.sparkSession
    path, checkpoint = _paths(spark, "activity")
    micros = F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"INTERVAL {gap}"))
    step = F.floor(F.unix_micros("ts") / micros).cast("long").alias("step")

    def write(batch: DataFrame, number: int) -> None:
        pieces = batch.filter("ts IS NOT NULL").groupBy(key, step).agg(
            F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("events")
        )
        pieces.write.mode("overwrite").parquet(f"{path}/batch={number}")

    _run(events.writeStream.foreachBatch(write), checkpoint)
    return _runs(read_batches(spark, path), key, gap, delay)


def _runs(pieces: DataFrame, key: str, gap: str, delay: str, size: int = ordered.CHUNK) -> DataFrame:
    """Closed runs from the pieces of all batches; a key of any number of steps is gone through in chunks."""
    pieces = pieces.groupBy(key, "step").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("events").alias("events"))
    pieces = materialise(pieces, "activity_pieces")
    pause, latest = F.expr(f"INTERVAL {gap}"), pieces.agg(F.max("last")).first()[0]
    joined = ordered.neighbours(pieces, [key], "step", ["last"], following=None, size=size)
    opens = F.when(F.col("prev").isNull() | (F.col("first") >= F.col("prev.last") + pause), 1).otherwise(0).cast("long")
    joined = ordered.running_sum(joined.withColumn("_opens", opens).drop("prev"), [key], "step", {"_run": F.col("_opens")}, size=size)
    runs = joined.groupBy(key, "_run").agg(
        F.min("first").alias("start"), (F.max("last") + pause).alias("end"), F.sum("events").alias("events")
    )
    closed = F.col("end") <= F.lit(latest).cast("timestamp") - F.expr(f"INTERVAL {delay}")
    return runs.filter(closed).select(key, "start", "end", "events")


# -- scan -------------------------------------------------------------------------


def scan_stream(files: DataFrame, rules=None) -> DataFrame:
    """Rule scan of arriving source files: a stateless stream."""
    spark = files.sparkSession
    path, checkpoint = _paths(spark, "scan")
    lines = document_lines(files)
    found = S.scan(lines) if rules is None else S.scan(lines, rules)
    _run(found.writeStream.outputMode("append").format("parquet").option("path", path), checkpoint)
    return spark.read.schema(found.schema).parquet(path)
