"""``spark.read.format("transcripts")``: lines of files that grow.

A batch read gives all lines of the files below a folder, a stream what is new in each
trigger: new files, and what was appended to known ones. The stream's offset names for each
file how many bytes of whole lines were read, so a line is read once and a line still being
written is left for later. A file that became shorter was written anew and is read from
its start. Large files are read in ranges, one task each.

``spark.dataSource.register(growing.Transcripts)`` makes the format known to a session.
Options: ``path``; ``glob`` (file names, ``*.jsonl``); ``modifiedAfter`` (seconds since 1970,
a time floor: files not changed since are not opened); ``rangeBytes``. Folders are opened with
``pyarrow.fs``: local, ``hdfs://``, ``s3://``, ``gs://``. The offset holds one entry for each
file, so a folder should hold up to some hundred thousand of them.

Columns: ``file``, ``modified``, ``at`` (the line's first byte), ``value``. Bytes that are
no UTF-8 are replaced; a missing folder and empty files have no lines.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions.shipping import by_value

RANGE_BYTES = 64 << 20
READ_BYTES = 1 << 20
ROWS = 4096
SCHEMA = "file string, modified timestamp, at bigint, value string"


class Range(InputPartition):
    """Lines of ``path`` that start in bytes ``first`` to ``end`` (not included)."""

    def __init__(self, path: str, modified: int, first: int, end: int):
        self.path, self.modified, self.first, self.end = path, modified, first, end


class Folder:
    """The files below a folder that the options ask for."""

    def __init__(self, options: dict):
        path = options["path"]
        if path.startswith("file:") and not path.startswith("file://"):
            path = path.removeprefix("file:")
        self.path = path
        self.glob = options.get("glob", "*.jsonl")
        self.after = float(options.get("modifiedAfter", "-inf"))
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))

    def open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def files(self) -> Iterator[tuple[str, int, int]]:
        """Path, time of the last change in microseconds and size, in the order of paths."""
        store, root = self.open()
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True))
        for info in sorted(found, key=lambda x: x.path):
            hidden = any(x[:1] in "._" for x in info.path[len(root) :].strip("/").split("/"))
            if info.type == fs.FileType.File and not hidden and fnmatch.fnmatch(info.base_name, self.glob):
                modified = (info.mtime_ns or 0) // 1000
                if modified >= self.after * 1_000_000:
                    yield info.path, modified, info.size

    def ranges(self, path: str, modified: int, first: int, end: int) -> list[Range]:
        cuts = [*range(first, end, self.range_bytes), end]
        return [Range(path, modified, a, b) for a, b in zip(cuts, cuts[1:])]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        at, values, size = [], [], 0

        def batch() -> pa.RecordBatch:
            n = len(at)
            when = pa.array([part.modified] * n, pa.timestamp("us", "UTC"))
            return pa.RecordBatch.from_arrays(
                [pa.array([part.path] * n, pa.string()), when, pa.array(at, pa.int64()), pa.array(values, pa.string())],
                ["file", "modified", "at", "value"],
            )

        store, _ = self.open()
        with store.open_input_file(part.path) as file:
            for place, line in lines(file, part.first, part.end):
                at.append(place)
                values.append(line.rstrip(b"\r").decode("utf-8", "replace"))
                size += len(line)
                if len(at) >= ROWS or size >= READ_BYTES:
                    yield batch()
                    at, values, size = [], [], 0
        if at:
            yield batch()


def lines(file, first: int, end: int) -> Iterator[tuple[int, bytes]]:
    """First byte and content of the lines that start in bytes ``first`` to ``end``."""
    # Unless a line starts right there, what comes first belongs to the line of an earlier range.
    place = max(0, first - 1)
    file.seek(place)
    held, skip = bytearray(), first > 0
    searched = 0
    while place < end:
        cut = held.find(b"\n", searched)
        if cut < 0:
            searched = len(held)
            more = file.read(READ_BYTES)
            if more:
                held += more
                continue
            if held and not skip:
                yield place, bytes(held)
            return
        if not skip:
            yield place, bytes(held[:cut])
        skip, searched = False, 0
        place += cut + 1
        del held[: cut + 1]


def whole_lines(file, size: int) -> int:
    """Bytes up to the end of the last whole line of a file of ``size`` bytes."""
    end = size
    while end > 0:
        start = max(0, end - READ_BYTES)
        file.seek(start)
        cut = file.read(end - start).rfind(b"\n")
        if cut >= 0:
            return start + cut + 1
        end = start
    return 0


class Lines(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = Folder(options)

    def partitions(self) -> list[Range]:
        out = [r for path, modified, size in self.folder.files() for r in self.folder.ranges(path, modified, 0, size)]
        return out or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.folder.read(partition) if partition.end else iter(())


class GrowingLines(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder = Folder(options)
        self.known: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, _ = self.folder.open()
        out = {}
        for path, modified, size in self.folder.files():
            before = self.known.get(path)
            if not before or before[0] != size:
                with store.open_input_file(path) as file:
                    self.known[path] = size, whole_lines(file, size)
            if end := self.known[path][1]:
                out[path] = [end, modified]
        return out

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for path, (last, modified) in end.items():
            first = start.get(path, [0])[0]
            if last != first:
                out += self.folder.ranges(path, modified, first if first < last else 0, last)
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.folder.read(partition)

    def commit(self, end: dict) -> None:
        pass


class Transcripts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "transcripts"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Lines:
        return Lines(self.options)

    def streamReader(self, schema) -> GrowingLines:
        return GrowingLines(self.options)


by_value(__name__)
