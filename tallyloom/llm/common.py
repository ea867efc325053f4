"""Helpers shared by the operators: folds, size checks, per-process caches, batches."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.shipping import by_value

BROADCAST_BYTES = 64 << 20
SLICE_ROWS = 256


def fold(doc_id: str, mod: int) -> Column:
    """``crc32(doc_id as text) mod n``; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod, F.lit(0))


def fits(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` with rows of ``row_bytes`` stays below the broadcast bound, by counting it."""
    return df.count() * row_bytes <= limit


def small_side(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` marked for broadcast when its counted size allows it; else as it is, for a shuffle join."""
    return F.broadcast(df) if fits(df, row_bytes) else df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front as long as ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def held(name: str, make: Callable):
    """A value made once per Python process (tokenizer, power tables), across tasks."""
    store = sys.modules.setdefault("_tallyloom_held", types.ModuleType("_tallyloom_held")).__dict__
    if name not in store:
        store[name] = make()
    return store[name]


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a string column; empty where it is null."""
    return [v or b"" for v in batch.column(name).cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, which bounds what a worker makes of one batch at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Runs of rows with equal ``keys`` in a sorted partition, across batch borders."""
    last, rows = None, []
    for batch in slices(batches):
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if rows and key != last:
                yield last, rows
                rows = []
            last = key
            rows.append(row)
    if rows:
        yield last, rows


by_value(__name__)
