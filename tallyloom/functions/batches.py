"""Arrow batches of sorted partitions, group by group."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa

from .shipping import by_value

ROWS = 1024


def runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Runs of rows with equal ``keys`` in a sorted partition, across batch borders."""
    last, rows = None, []
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            for row in batch.slice(at, ROWS).to_pylist():
                key = tuple(row[k] for k in keys)
                if rows and key != last:
                    yield last, rows
                    rows = []
                last = key
                rows.append(row)
    if rows:
        yield last, rows


def table(rows: Sequence[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


by_value(__name__)
