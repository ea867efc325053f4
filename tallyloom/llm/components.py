"""Connected components of an edge table, by alternating large and small stars.

In a large-star step every node hangs its larger neighbours onto its smallest one;
in a small-star step it hangs its smaller ones there. Each step keeps the
components and shortens the paths until every node points at the smallest of its
component. The smallest neighbour is an aggregate that Spark combines before the
shuffle and joins back, so a node with very many neighbours is not gathered in one
place. Each round is written to the shared folder, which cuts the lineage and
survives lost executors.

A round is seven shuffles, whatever the size of the table, and the driver keeps count of every
task. Up to ``TASK_EDGES`` edges are connected by one task without any; only more go in rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.shipping import by_value
from tallyloom.session import materialise

# Edges that one task connects, in about 150 MB.
TASK_EDGES = 1_000_000


def forest(a: np.ndarray, b: np.ndarray, parent: dict[int, int] | None = None) -> np.ndarray:
    """The pairs that connect what ``a`` and ``b`` connect, fewer than nodes.

    ``parent`` holds what is connected already, so that only what is new comes out.
    """
    parent = {} if parent is None else parent

    def root(x: int) -> int:
        while (above := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[above]
        return x

    found = []
    for x, y in np.unique(np.stack([a, b]), axis=1).T.tolist():
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            found.append((max(x, y), min(x, y)))
    return np.array(found, "<i8").reshape(-1, 2).T


def _settled(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every node of the edges and the smallest one of its component."""
    parent: dict[int, int] = {}
    for batch in source:
        forest(batch.column("a").to_numpy(), batch.column("b").to_numpy(), parent)
    nodes = np.sort(np.fromiter(parent, "<i8", len(parent)))
    place = np.searchsorted(nodes, np.fromiter((parent[x] for x in nodes.tolist()), "<i8", len(nodes)))
    while (place != place[place]).any():
        place = place[place]
    for at in range(0, len(nodes), 1 << 16):
        here = slice(at, at + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[here]), pa.array(nodes[place[here]])], ["node", "component"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges`` point from a larger node ``a`` to a smaller node ``b``."""
    if large:
        edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    smallest = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(smallest.withColumn("m", F.least("a", "m")), "a")
    moved = joined.filter(F.col("b") > F.col("a") if large else F.col("b") != F.col("m"))
    out = moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.unionByName(smallest.select("a", F.col("m").alias("b")))
    return out.filter("a != b").distinct()


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``node`` and ``component`` (its smallest node) of every node on an edge; null ends and loops are left out."""
    whole = edges.filter(F.col(left).isNotNull() & F.col(right).isNotNull())
    now = whole.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b"))
    now = now.filter("a != b")
    now, last = materialise(now.distinct(), "edges"), None
    if now.schema["a"].dataType.simpleString() == "bigint" and now.count() <= TASK_EDGES:
        return materialise(now.coalesce(1).mapInArrow(_settled, "node long, component long"), "components")
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
        now = materialise(_star(_star(now, True), False), "edges")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


by_value(__name__)
