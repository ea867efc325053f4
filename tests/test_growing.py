"""Transcript files that grow, against one read of all of them."""

import io
import os
import random

import pytest

from tallyloom.sources import growing
from tallyloom.sources import records as R
from tallyloom.session import new_path
from tallyloom.streaming import jobs as J


def said(session, minute, content, **more):
    usage = "".join(f', "{k}": {v}' for k, v in more.items())
    return (
        f'{{"session": "{session}", "type": "message", "timestamp": "2024-01-01T00:{minute:02}:00Z", '
        f'"message": {{"role": "assistant", "content": "{content}"{usage}}}}}\n'
    )


def add(path, text, when):
    with open(path, "a") as f:
        f.write(text)
    os.utime(path, (1_700_000_000 + when,) * 2)


def ingest(spark, folder, base):
    stream = spark.readStream.format("transcripts").load(str(folder))
    J.ingest_sessions(stream, f"{base}/out", f"{base}/checkpoint")


def numbers(records):
    return sorted((r.session, r.record_no, r.content) for r in records.collect())


def test_appended_lines_are_read_once(spark, tmp_path):
    spark.dataSource.register(growing.Transcripts)
    base = new_path(spark, "grow")
    add(tmp_path / "a.jsonl", said("s", 1, "one") + said("t", 1, "x") + said("s", 2, "two"), 1)
    add(tmp_path / "b.jsonl", said("s", 3, "three") + said("s", 4, "four")[:30], 2)
    add(tmp_path / "c.reset.jsonl", said("s", 9, "gone"), 1)
    add(tmp_path / "empty.jsonl", "", 1)
    ingest(spark, tmp_path, base)
    assert numbers(J.stored_records(spark, f"{base}/out")) == [("s", 0, "one"), ("s", 1, "two"), ("s", 2, "three"), ("t", 0, "x")]
    add(tmp_path / "a.jsonl", "\n", 1)
    add(tmp_path / "b.jsonl", said("s", 4, "four")[30:] + said("s", 4, "four"), 3)
    add(tmp_path / "d.jsonl", said("u", 5, "new"), 4)
    ingest(spark, tmp_path, base)
    ingest(spark, tmp_path, base)  # nothing new
    got = numbers(J.stored_records(spark, f"{base}/out"))
    assert got == numbers(R.read_transcripts(spark, str(tmp_path)))
    by_source = spark.read.format("transcripts").load(str(tmp_path))
    assert got == numbers(R.parse_transcripts(R.numbered(R.transcript_text(R.located(by_source)), ["modified"])))
    assert [n for s, n, _ in got if s == "s"] == list(range(5))


def test_numbers_go_on_over_files_and_equal_times_go_by_name(spark, tmp_path):
    (tmp_path / "s.jsonl").mkdir()
    for name, when, lines in (("b", 5, ["2", "3"]), ("a", 5, ["0", "1"]), ("c", 1, ["-1"])):
        add(tmp_path / f"{name}.jsonl", "".join(said("s", 1, x) for x in lines), when)
    got = {r.content: r.record_no for r in R.read_transcripts(spark, str(tmp_path)).collect()}
    assert got == {"-1": 0, "0": 1, "1": 2, "2": 3, "3": 4}


def test_a_file_that_became_shorter_is_read_anew(spark, tmp_path):
    spark.dataSource.register(growing.Transcripts)
    base = new_path(spark, "short")
    add(tmp_path / "a.jsonl", said("s", 1, "one") + said("s", 2, "two"), 1)
    ingest(spark, tmp_path, base)
    (tmp_path / "a.jsonl").write_text(said("s", 3, "three"))
    ingest(spark, tmp_path, base)
    assert [c for *_, c in numbers(J.stored_records(spark, f"{base}/out"))] in (["one", "two", "three"], ["three", "one", "two"], ["one", "three", "two"])


def test_files_that_did_not_change_are_not_opened(spark, tmp_path):
    spark.dataSource.register(growing.Transcripts)
    add(tmp_path / "old.jsonl", said("s", 1, "one"), 1)
    add(tmp_path / "new.jsonl", said("s", 2, "two"), 100)
    folder = growing.Folder({"path": str(tmp_path), "modifiedAfter": "1700000050"})
    assert [p.rpartition("/")[2] for p, *_ in folder.files()] == ["new.jsonl"]
    df = spark.read.format("transcripts").option("modifiedAfter", 1_700_000_050).load(str(tmp_path))
    assert df.count() == 1
    assert spark.read.format("transcripts").load(str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("size", [1, 3, 7, 50])
def test_ranges_give_every_line_once(size, monkeypatch):
    monkeypatch.setattr(growing, "READ_BYTES", 5)
    draw = random.Random(size)
    for _ in range(40):
        text = b"\n".join(bytes(draw.choices(b"ab", k=draw.randint(0, 9))) for _ in range(draw.randint(0, 8)))
        cuts = [*range(0, len(text), size), len(text)]
        got = [x for a, b in zip(cuts, cuts[1:]) for x in growing.lines(io.BytesIO(text), a, b)]
        want, at = [], 0
        for line in text.split(b"\n"):
            if at < len(text):
                want.append((at, line))
            at += len(line) + 1
        assert got == want
        assert growing.whole_lines(io.BytesIO(text), len(text)) == text.rfind(b"\n") + 1
