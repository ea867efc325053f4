"""Bounded, balanced samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.shipping import by_value


def choose(labels: DataFrame, label: str, classes: Sequence, rows: int) -> DataFrame:
    """At most ``rows`` labelled ids (``doc_id``, ``label``), the same share for every class, smallest hashes first."""
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    share = max(1, rows // max(1, len(classes)))
    parts = [known.filter(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(share) for c in classes]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def features(docs: DataFrame, chosen: DataFrame, make: Callable[[pa.RecordBatch], list], columns: Sequence[Column | str] = ("text",)):
    """Labels and sparse features of the chosen documents, on the driver.

    ``chosen`` is bounded, so it is broadcast; ``make`` gives ``(indices, values)``
    for each row of a batch. Returns labels, row borders, indices and values.
    """

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            found = make(batch)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("label"),
                    pa.array([i.astype(np.int32) for i, _ in found], pa.list_(pa.int32())),
                    pa.array([v.astype(np.float32) for _, v in found], pa.list_(pa.float32())),
                ],
                ["doc_id", "label", "index", "value"],
            )

    kind = chosen.schema["label"].dataType.simpleString()
    rows = docs.select("doc_id", *columns).join(F.broadcast(chosen), "doc_id")
    # A repeated document counts once, which also keeps the bound.
    table = (
        rows.mapInArrow(batches, f"doc_id long, label {kind}, index array<int>, value array<float>")
        .dropDuplicates(["doc_id"])
        .toArrow()
        .sort_by("doc_id")
    )
    index, value = table.column("index").combine_chunks(), table.column("value").combine_chunks()
    if isinstance(index, pa.ChunkedArray):
        index, value = pa.array([], pa.list_(pa.int32())), pa.array([], pa.list_(pa.float32()))
    borders = np.concatenate([[0], np.cumsum(index.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return table.column("label").to_pylist(), borders, index.flatten().to_numpy(), value.flatten().to_numpy()


def take(rows: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the entries of ``rows`` and the position in ``rows`` that each belongs to."""
    sizes = borders[rows + 1] - borders[rows]
    owner = np.repeat(np.arange(len(rows)), sizes)
    starts = np.cumsum(sizes) - sizes
    return np.arange(len(owner)) - starts[owner] + borders[rows][owner], owner


def sums(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Column sums of ``values`` by ``owner``."""
    if values.ndim == 1:
        return np.bincount(owner, values, n)
    return np.stack([np.bincount(owner, values[:, k], n) for k in range(values.shape[1])], 1)


by_value(__name__)
