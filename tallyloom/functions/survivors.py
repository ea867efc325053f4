"""Which rows stay when a row goes as soon as an earlier one that stays rules it out."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .components import components
from .shipping import by_value

# Pairs that one task settles one after the other.
TASK_PAIRS = 1_000_000


def _settled(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Late rows that go. Pairs come sorted by group and late row, so an early one is decided before it is asked."""
    group, gone = None, set()
    for batch in source:
        late_gone = []
        columns = [batch.column(c).to_pylist() for c in ("group", "early", "late")]
        for i, (now, early, late) in enumerate(zip(*columns)):
            if now != group:
                group, gone = now, set()
            if early not in gone and late not in gone:
                gone.add(late)
                late_gone.append(i)
        yield batch.take(pa.array(late_gone, pa.int64()))


def _in_tasks(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Groups of ``pairs`` (column ``group``) settled in a task each."""
    pairs = pairs.repartition("group").sortWithinPartitions("group", "late", "early")
    return pairs.mapInArrow(_settled, pairs.schema).select(*keys, F.col("late").alias("seq"))


def _in_rounds(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A round settles the pairs whose early row has no undecided earlier row of its own: that row stays, its later
    ones go, and what a gone row ruled out is open again. There are as many rounds as the longest chain has links."""
    open_pairs = materialise(pairs.select(*keys, "early", "late"), "open_pairs")
    gone = None
    while open_pairs.limit(1).count():
        waiting = open_pairs.select(*keys, F.col("late").alias("early")).distinct()
        now = open_pairs.join(waiting, [*keys, "early"], "left_anti").select(*keys, F.col("late").alias("seq")).distinct()
        now = materialise(now, "gone")
        gone = now if gone is None else gone.unionByName(now)
        for end in ("early", "late"):
            open_pairs = open_pairs.join(now.withColumnRenamed("seq", end), [*keys, end], "left_anti")
        # What is left of a row that stays only led to rows that are gone.
        open_pairs = materialise(open_pairs, "open_pairs")
    return pairs.select(*keys, F.col("late").alias("seq")).limit(0) if gone is None else gone


def _parted(pairs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The pairs of small groups and those of large ones, if there are any."""
    sizes = materialise(pairs.groupBy("group").agg(F.count("*").alias("_n")).filter(F.col("_n") > TASK_PAIRS), "large_groups")
    if not sizes.limit(1).count():
        return pairs, None
    large = F.broadcast(sizes.select("group"))  # at most one for TASK_PAIRS pairs
    return pairs.join(large, "group", "left_anti"), pairs.join(large, "group", "left_semi")


def ruled_out(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys`` and ``seq`` of the rows that go. ``pairs``: keys, early, late, with early < late.

    Only rows that stay rule others out, so decisions depend on each other along chains. Groups
    of ``keys`` with up to ``TASK_PAIRS`` pairs are settled in one task each, in order. A larger
    one is cut into its connected components, which do not touch each other; only a component that
    is too large itself is settled in rounds.
    """
    keys = list(keys)
    group = F.struct(*keys)
    whole = materialise(pairs.select(*keys, "early", "late").distinct(), "ruled_pairs")
    small, large = _parted(whole.withColumn("group", group))
    out = _in_tasks(small, keys)
    if large is not None:
        node = lambda end: F.struct(*keys, F.col(end).alias("seq"))
        nodes = large.drop("group").withColumns({"_a": node("early"), "_b": node("late")})
        names = components(nodes, "_a", "_b").select(F.col("node").alias("_a"), F.col("component").alias("group"))
        grouped = materialise(nodes.join(names, "_a").select(*keys, "early", "late", "group"), "ruled_components")
        small, large = _parted(grouped)
        out = out.unionByName(_in_tasks(small, keys))
        if large is not None:
            out = out.unionByName(_in_rounds(large, keys))
    return out


by_value(__name__)
