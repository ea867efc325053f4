"""Streams against their batch results."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyloom import adapters as A
from tallyloom.operators import usage as U
from tallyloom.session import new_path
from tallyloom.sources import records as R
from tallyloom.streaming import jobs as J

SF = "/root/testdata/sf0.001"


def test_ingest_equals_batch_and_is_idempotent(spark):
    path, base = new_path(spark, "t"), new_path(spark, "i")
    lines = A.transcript_lines(spark, SF)
    lines.repartition(3, "session").sortWithinPartitions("session", "record_no").select("value").write.text(path)
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.option("maxFilesPerTrigger", 1).text(path)
        J.ingest_sessions(stream, f"{base}/out", f"{base}/checkpoint")
    records = R.parse_transcripts(lines)
    batch = U.build_sessions(R.usage_calls(records), R.transcript_messages(records), origins=R.transcript_origins(records))
    columns = ["id", "model", "title", "total_input_tokens", "total_output_tokens", "message_count", "cost_estimate", "start_time"]
    key = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert key(J.stored_sessions(spark, f"{base}/out")) == key(batch)


def _said(session, minute, role, content, tokens=0):
    usage = f', "usage": {{"input": {tokens}, "output": 1, "totalTokens": {tokens + 1}}}' if tokens else ""
    head = f'"session": "{session}", "type": "message", "timestamp": "2024-01-01T00:{minute:02}:00Z"'
    return f'{{{head}, "message": {{"role": "{role}", "content": "{content}"{usage}}}}}'


@pytest.mark.parametrize("per_batch", [1, 10])
def test_session_in_several_files_is_whole(spark, tmp_path, per_batch):
    parts = [
        ['{"session": "s", "type": "session", "timestamp": "2024-01-01T00:00:00Z", "key": "agent:a:main:1"}',
         '{"session": "s", "type": "model_change", "modelId": "gpt-4o"}', _said("s", 1, "user", "first"), _said("s", 2, "assistant", "a", 100)],
        [_said("s", 3, "user", "second"), _said("s", 4, "assistant", "b", 30), _said("s", 4, "assistant", "b", 30), _said("t", 1, "assistant", "c", 7)],
        [_said("s", 1, "user", "first"), _said("s", 2, "assistant", "a", 100), _said("s", 5, "user", "third")],  # two lines again
    ]
    for i, lines in enumerate(parts):
        (tmp_path / f"{i}.jsonl").write_text("\n".join(lines) + "\n")
        os.utime(tmp_path / f"{i}.jsonl", (1_700_000_000 + i,) * 2)
    base = new_path(spark, "parts")
    stream = spark.readStream.option("maxFilesPerTrigger", per_batch).text(str(tmp_path))
    J.ingest_sessions(stream, f"{base}/out", f"{base}/checkpoint")
    got = {r.id: r for r in J.stored_sessions(spark, f"{base}/out").collect()}
    assert set(got) == {"transcript_s", "transcript_t"} and got["transcript_t"].total_input_tokens == 7
    s = got["transcript_s"]
    assert (s.total_input_tokens, s.api_call_count, s.message_count, s.model) == (160, 3, 6, "gpt-4o")
    assert (s.context.first_msg, s.context.second_msg, s.context.last_msg) == ("first", "second", "third")
    numbers = [r.record_no for r in J.stored_records(spark, f"{base}/out").filter("session = 's'").collect()]
    assert len(numbers) == len(set(numbers)) == 8
    assert U.message_sizes(R.transcript_messages(J.stored_records(spark, f"{base}/out"))).count() == 7


def _requests(spark, folder, rows):
    schema = "request_id string, channel string, ts timestamp, input_tokens bigint, output_tokens bigint, cost double"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_usage_is_summed_over_micro_batches(spark):
    folder, day = new_path(spark, "r"), datetime(2024, 1, 1, 1)
    _requests(spark, folder, [("a", "x", day, 1, 2, 0.1), ("b", "y", day, 1, 2, 0.1)])
    stream = _requests(spark, folder, [("c", "x", day + timedelta(hours=2), 10, 20, 0.5)])
    got = {(r.channel, r.requests, r.input_tokens, r.cost) for r in J.usage_by_window(stream).collect()}
    assert got == {("x", 2, 11, 0.6), ("y", 1, 1, 0.1)}


def test_late_requests_count(spark):
    folder, day = new_path(spark, "l"), datetime(2024, 6, 1, 1)
    _requests(spark, folder, [("a", "x", day, 1, 2, 0.1)])
    stream = _requests(spark, folder, [("b", "x", day - timedelta(days=90), 10, 20, 0.5), ("a", "x", day, 1, 2, 0.1)])
    got = {(r.start.month, r.requests, r.input_tokens) for r in J.usage_by_window(stream).collect()}
    assert got == {(6, 2, 2), (3, 1, 10)}
    sliding = J.usage_by_window(stream, "3 days", "1 day").collect()
    assert len(sliding) == 6 and {r.end - r.start for r in sliding} == {timedelta(days=3)}
    assert sorted(r.request_id for r in J.distinct_requests(stream).collect()) == ["a", "b"]


def test_repeated_requests_count_once(spark):
    folder, day = new_path(spark, "d"), datetime(2024, 1, 1)
    rows = [("a", "x", day, 1, 2, 0.1), ("b", "x", day, 1, 2, 0.1)]
    _requests(spark, folder, rows)
    stream = _requests(spark, folder, rows)
    assert J.distinct_requests(stream).count() == 2


def test_activity_closes_after_the_gap(spark):
    folder, t = new_path(spark, "e"), datetime(2024, 1, 1)
    hours = [0, 1, 9, 40]
    spark.createDataFrame([("u", t + timedelta(hours=h)) for h in hours], "k string, ts timestamp").write.parquet(folder)
    stream = spark.readStream.schema("k string, ts timestamp").parquet(folder)
    got = sorted((r.events, (r.end - r.start) / timedelta(hours=1)) for r in J.activity_sessions(stream, "k", "4 hours", "1 hour").collect())
    assert got == [(1, 4.0), (2, 5.0)]
    assert spark.range(1).select(F.lit(1)).count() == 1


@pytest.mark.parametrize("size", [1, 3, 1 << 16])
def test_late_events_close_and_join_runs(spark, size):
    import random

    folder, t, draw = new_path(spark, "late"), datetime(2024, 1, 1), random.Random(5)
    rows = [(draw.choice(["u", "v", None]), t + timedelta(minutes=draw.randint(0, 6000))) for _ in range(150)] + [("u", None)]
    for part in (rows[:60], rows[60:61], rows[61:]):  # in no order of time
        spark.createDataFrame(part, "k string, ts timestamp").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("k string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(folder)
    gap, want, last = timedelta(hours=2), [], max(x for _, x in rows if x)
    for key in ("u", "v", None):
        run = []
        for at in [*sorted(x for k, x in rows if k == key and x), None]:
            if run and (at is None or at - run[-1] >= gap):
                if run[-1] + gap <= last - timedelta(hours=1):
                    want.append((str(key), run[0], run[-1] + gap, len(run)))
                run = []
            run.append(at)
    pieces = J.activity_sessions(stream, "k", "2 hours", "1 hour")
    assert sorted((str(r.k), r.start, r.end, r.events) for r in pieces.collect()) == sorted(want)
    step = F.floor(F.unix_micros("ts") / 7_200_000_000).alias("step")
    direct = spark.read.parquet(folder).filter("ts is not null").groupBy("k", step).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("events"))
    got = J._runs(direct, "k", "2 hours", "1 hour", size)
    assert sorted((str(r.k), r.start, r.end, r.events) for r in got.collect()) == sorted(want)
