"""Rule look-ups and joins: prices, model sizes, encodings, channels, sections, whitelists."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ordered
from ..functions.batches import runs, table
from ..functions.joins import salted_join
from ..functions.needles import containing
from ..functions.shipping import by_value
from ..functions.text import first_match, matches, strip
from ..rules import models as M
from ..session import materialise

RuleList = Sequence[tuple]


def name_lookup(name: Column, rules: RuleList, fields: Sequence[str]) -> Column:
    """Struct of ``fields`` for the rule matching ``name``: exact first, then first contained, else NULL.

    The rules are literals, so this is a projection: no join and no shuffle.
    """
    low = F.lower(name)

    def value(rule: tuple) -> Column:
        return F.struct(*[F.lit(v).alias(f) for f, v in zip(fields, rule[1:])])

    exact = [(low == r[0], value(r)) for r in rules]
    contained = [(low.contains(r[0]), value(r)) for r in rules]
    return first_match(exact + contained)


def _from_table(df: DataFrame, name: str, rules: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Same look-up for a rule table ``(key, ord, *fields)`` of any size.

    Only the distinct names meet the rules, through an index of the keys; then an ordinary
    equi-join brings the result back, with hot names split.
    """
    names = df.select(F.col(name).alias("_name")).distinct().withColumn("_low", F.lower("_name"))
    hit = containing(names, "_low", rules.select("key", "ord", *fields), "key")
    best = hit.groupBy("_name").agg(
        F.min_by(F.struct(*fields), F.struct((F.col("_low") != F.col("key")).alias("part"), F.col("ord"))).alias("_hit")
    )
    return salted_join(df.withColumn("_name", F.col(name)), best, ["_name"], F.monotonically_increasing_id()).drop("_name")


def _lookup(df, name, rules, fields, defaults) -> DataFrame:
    if isinstance(rules, DataFrame):
        df = _from_table(df, name, rules, fields)
    else:
        df = df.withColumn("_hit", name_lookup(F.col(name), rules, fields))
    for f, d in zip(fields, defaults):
        df = df.withColumn(f, F.coalesce(F.col(f"_hit.{f}"), F.lit(d)))
    return df.drop("_hit")


def with_pricing(df: DataFrame, prices: RuleList | DataFrame = M.PRICES, name: str = "model") -> DataFrame:
    """Add ``price_in`` and ``price_out`` per million tokens; unknown models cost 0."""
    return _lookup(df, name, prices, ["price_in", "price_out"], [0.0, 0.0])


def with_model_spec(df: DataFrame, specs: RuleList | DataFrame = M.SPECS, name: str = "model") -> DataFrame:
    """Add ``context_window`` and ``max_tokens``."""
    return _lookup(df, name, specs, ["context_window", "max_tokens"], list(M.DEFAULT_SPEC))


def with_encoding(df: DataFrame, rules: RuleList | DataFrame = M.ENCODINGS, name: str = "model") -> DataFrame:
    """Add ``encoding``, the tokenizer family of the model."""
    return _lookup(df, name, rules, ["encoding"], [M.DEFAULT_ENCODING])


def with_channel(
    df: DataFrame,
    ports: RuleList = M.PORT_CHANNELS,
    agents: RuleList = M.AGENT_CHANNELS,
    *,
    header: str = "channel_header",
    port: str = "port",
    agent: str = "user_agent",
) -> DataFrame:
    """Add ``channel``: explicit header, else listening port, else first user-agent pattern, else ``unknown``."""
    by_header = F.nullif(strip(F.coalesce(F.col(header), F.lit(""))), F.lit(""))
    by_port = first_match([(F.col(port) == p, F.lit(c)) for p, c in ports])
    ua = F.coalesce(F.col(agent), F.lit(""))
    by_agent = first_match([(matches(ua, f"(?i){p}"), F.lit(c)) for p, c in agents])
    return df.withColumn("channel", F.coalesce(by_header, by_port, by_agent, F.lit("unknown")))


def source_channel(source_id: Column) -> Column:
    """Display name of the third ``:``-part of a source id."""
    key = F.coalesce(F.get(F.split(source_id, ":"), F.lit(2)), F.lit(""))
    named = first_match([(key == k, F.lit(v)) for k, v in M.SOURCE_CHANNELS])
    return F.coalesce(named, F.nullif(key, F.lit("")), F.lit(M.OTHER_CHANNEL))


# -- sections -----------------------------------------------------------------


def with_section(lines: DataFrame, sections: DataFrame) -> DataFrame:
    """Nearest section heading at or before each line of the same document.

    ``lines``: doc_id, line_no, ...; ``sections``: doc_id, line_no, title, level.
    An equi-join on (doc, line) marks the heading lines and a chunked
    carry-forward spreads them, so nothing is joined on ranges.
    """
    marks = sections.select(
        "doc_id", "line_no", F.struct(F.col("line_no").alias("line"), "title", "level").alias("_mark")
    )
    marked = lines.join(marks, ["doc_id", "line_no"], "left")
    out = ordered.carry_forward(marked, ["doc_id"], "line_no", {"_section": F.col("_mark")})
    return out.select(
        *[c for c in out.columns if c not in ("_mark", "_section")],
        F.col("_section.title").alias("section_title"),
        F.col("_section.level").alias("section_level"),
        F.col("_section.line").alias("section_line"),
    )


class Open:
    """Headings that are open: levels grow from bottom to top, a heading closes those of its level and deeper."""

    def __init__(self):
        self.levels: list[int] = []
        self.titles: list = []

    def above(self, level: int) -> int:
        """How many open headings are above ``level``."""
        return bisect_left(self.levels, level)

    def add(self, level: int, title) -> None:
        keep = self.above(level)
        del self.levels[keep:], self.titles[keep:]
        self.levels.append(level)
        self.titles.append(title)


_HEADINGS = pa.schema(
    [("doc_id", pa.string()), ("chunk", pa.int64()), ("line_no", pa.int64()), ("title", pa.string()), ("level", pa.int64()),
     ("parent", pa.string()), ("settled", pa.bool_()), ("stays", pa.bool_())]
)
_PARENTS = pa.schema([("doc_id", pa.string()), ("chunk", pa.int64()), ("level", pa.int64()), ("above", pa.string())])


def _inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parents found inside a chunk, and which headings are open at its end."""
    for _, rows in runs(batches, ["doc_id", "chunk"]):
        now = Open()
        for r in rows:
            r |= {"parent": None, "settled": r["level"] is None, "stays": False}
            if r["level"] is not None:
                if above := now.above(r["level"]):
                    r |= {"parent": now.titles[above - 1]["title"], "settled": True}
                now.add(r["level"], r)
        for r in now.titles:
            r["stays"] = True
        yield table(rows, _HEADINGS)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The heading above a level before the start of a chunk, from the open headings of the chunks before it."""
    for (doc,), rows in runs(batches, ["doc_id"]):
        now, out = Open(), []
        for r in rows:
            if r["asked"]:
                if above := now.above(r["level"]):
                    out.append({"doc_id": doc, "chunk": r["chunk"], "level": r["level"], "above": now.titles[above - 1]})
            else:
                now.add(r["level"], r["title"])
        if out:
            yield table(out, _PARENTS)


def section_paths(sections: DataFrame, size: int = ordered.CHUNK) -> DataFrame:
    """``parent > title`` per section; the parent is the nearest earlier section of a smaller level.

    A chunk of a document's lines is gone through with a stack of open headings. What is open
    at its end sums it up; a second pass over these few rows answers which heading lies
    above a level where a chunk starts. Levels may be any numbers and as many as occur.
    """
    spec = sections.select(
        F.col("doc_id").cast("string").alias("doc_id"), F.floor(F.col("line_no") / size).cast("long").alias("chunk"),
        F.col("line_no").cast("long").alias("line_no"), "title", F.col("level").cast("long").alias("level"),
    )
    spec = spec.repartition("doc_id", "chunk").sortWithinPartitions("doc_id", "chunk", "line_no")
    kinds = "doc_id string, chunk long, line_no long, title string, level long, parent string, settled boolean, stays boolean"
    found = materialise(spec.mapInArrow(_inside, kinds), "headings")
    asked = found.filter("NOT settled").select("doc_id", "chunk", "level").distinct()
    asked = asked.select("doc_id", "chunk", F.lit(None).cast("long").alias("line_no"), F.lit(None).cast("string").alias("title"), "level", F.lit(True).alias("asked"))
    still = found.filter("stays").select("doc_id", "chunk", "line_no", "title", "level", F.lit(False).alias("asked"))
    # Questions have no line and come before the headings of their chunk.
    both = still.unionByName(asked).repartition("doc_id").sortWithinPartitions("doc_id", "chunk", F.col("line_no").asc_nulls_first())
    above = both.mapInArrow(_across, "doc_id string, chunk long, level long, above string")
    out = found.join(above, ["doc_id", "chunk", "level"], "left")
    parent = F.when(F.col("settled"), F.col("parent")).otherwise(F.col("above"))
    path = F.concat(F.coalesce(F.concat(parent, F.lit(" > ")), F.lit("")), F.col("title"))
    kept = {f.name: f.dataType for f in sections.schema}
    out = out.withColumn("section_path", path)
    return out.select(*[F.col(c).cast(kept[c]).alias(c) for c in ("doc_id", "line_no", "title", "level")], "section_path")


# -- whitelists ---------------------------------------------------------------


def merge_whitelists(official: DataFrame, user: DataFrame) -> DataFrame:
    """Union of both lists, one row per (module, content), the official row first."""
    both = official.withColumn("origin", F.lit("official")).unionByName(user.withColumn("origin", F.lit("user")))
    return both.groupBy("module", "content").agg(F.min("origin").alias("origin"))


def learn_tasks(whitelist: DataFrame, tasks: DataFrame) -> DataFrame:
    """Tasks whose (module, content) the list does not hold yet, once each."""
    fresh = tasks.select("module", "content").filter(strip("content") != "").distinct()
    return fresh.join(whitelist.select("module", "content"), ["module", "content"], "left_anti")


def whitelist_stats(whitelist: DataFrame) -> DataFrame:
    """Modules and tasks per origin."""
    return whitelist.groupBy("origin").agg(
        F.countDistinct("module").alias("modules"), F.count(F.lit(1)).alias("tasks")
    )


by_value(__name__)
