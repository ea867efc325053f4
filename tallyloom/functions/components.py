"""Connected components of an edge table, by alternating large and small stars.

In a large-star step every node hangs its larger neighbours onto its smallest one;
in a small-star step it hangs its smaller ones there. Each step keeps the
components and shortens the paths until every node points at the smallest of its
component. The smallest neighbour is an aggregate that Spark combines before the
shuffle. Each round is written to the shared folder, which cuts the lineage and
survives lost executors. Nodes may be of any type that has an order, structs too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges`` point from a larger node ``a`` to a smaller node ``b``."""
    if large:
        edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    smallest = edges.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = edges.join(smallest, "a")
    moved = joined.filter(F.col("b") > F.col("a") if large else F.col("b") != F.col("m"))
    out = moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.unionByName(smallest.select("a", F.col("m").alias("b")))
    return out.filter("a != b").distinct()


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``node`` and ``component`` (its smallest node) of every node on an edge; null ends and loops are left out."""
    whole = edges.filter(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
    now = whole.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b"))
    now, last = materialise(now.distinct(), "edges"), None
    while (state := now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()) != last:
        last = state
        now = materialise(_star(_star(now, True), False), "edges")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
