"""Writes to the session store, as functions of the old and the new rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ordered
from ..functions.text import ratio2

FIRST = ["source", "start_time"]  # kept from the first version of a session
FORMATS = ("json", "csv", "parquet")


def has_context(c: Column | str = "context") -> Column:
    """A context that counts at least one message."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c["total_messages"] > 0, F.lit(False))


def fold_sessions(versions: DataFrame, version: str = "version") -> DataFrame:
    """One row per session id from any number of versions.

    Source and start time stay those of the first version, everything else is
    of the last one, except that message count and context change only with a
    version that has a context.
    """
    pair = F.struct("message_count", "context")
    kept = [*FIRST, "message_count", "context"]
    rest = [c for c in versions.columns if c not in ("id", version, "input_output_ratio", *kept)]
    folded = versions.groupBy("id").agg(
        F.min_by(F.struct(*FIRST), version).alias("_first"),
        F.max_by(F.struct(*rest), version).alias("_last"),
        F.coalesce(F.max_by(pair, F.when(has_context(), F.col(version))), F.min_by(pair, version)).alias("_ctx"),
    )
    df = folded.select("id", "_first.*", "_last.*", "_ctx.*")
    ratio = ratio2(F.coalesce("total_input_tokens", F.lit(0)), F.coalesce("total_output_tokens", F.lit(0)))
    df = df.withColumn("input_output_ratio", ratio)
    return df.select(*[c for c in versions.columns if c != version])


def upsert_sessions(existing: DataFrame, incoming: DataFrame, version: str | None = None) -> DataFrame:
    """The store after writing ``incoming``; several versions of an id need a ``version`` column above 0."""
    new = incoming.withColumn("version", F.lit(1) if version is None else F.col(version))
    if version not in (None, "version"):
        new = new.drop(version)
    old = existing.withColumn("version", F.lit(0).cast(new.schema["version"].dataType))
    return fold_sessions(old.unionByName(new))


def accepted(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows that may be written: unseen ids, and known ids with the same source id."""
    known = existing.select("id", F.col("source_id").alias("_known"), F.lit(True).alias("_seen"))
    df = incoming.join(known, "id", "left")
    return df.filter(F.col("_seen").isNull() | F.col("_known").eqNullSafe(F.col("source_id"))).select(*incoming.columns)


def replace_messages(existing: DataFrame, incoming: DataFrame, size: int = ordered.CHUNK) -> DataFrame:
    """All messages of every incoming conversation replaced, numbered from 0 in their given order."""
    ids = incoming.select("conversation_id").distinct()
    new = ordered.row_numbers(incoming, ["conversation_id"], "message_index", "_rn", size=size)
    new = new.withColumn("message_index", F.col("_rn") - 1).select(*existing.columns)
    return existing.join(ids, "conversation_id", "left_anti").select(*existing.columns).unionByName(new)


def delete_sessions(sessions: DataFrame, messages: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions and messages without the given ids. ``ids``: id, conversation_id."""
    return (
        sessions.join(ids.select("id"), "id", "left_anti"),
        messages.join(ids.select("conversation_id"), "conversation_id", "left_anti"),
    )


def write_report(df: DataFrame, path: str, fmt: str = "json") -> str:
    """Write a report as JSON, CSV or parquet; returns the path."""
    if fmt not in FORMATS:
        raise ValueError(f"format {fmt!r} is not one of {FORMATS}")
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", "true")
    writer.format(fmt).save(path)
    return path
