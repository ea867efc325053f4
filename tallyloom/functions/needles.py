"""Rule tables of any size: which rows can match which rules, by the text that a rule requires.

A pattern is searched for text that every match must hold (its needles). The needles of a
slice of rules form one automaton, which goes over a row's text once whatever the number of
rules. Only a row and a rule that meet there go on to the pattern itself, so rows are
never multiplied by rules. A slice holds at most ``SLICE_RULES`` rules and
``SLICE_CHARS`` characters, which bounds what is sent to the tasks; a larger
table takes one pass for each slice.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .shipping import by_value
from .text import alternation, matches

SLICE_RULES = 20_000
SLICE_CHARS = 4_000_000
LEAST = 2
FLAGS = re.compile(r"\(\?([a-zA-Z]+)\)")


def fold(text: str) -> str:
    """``text`` with every character in the form by which Java compares without case."""
    if text.isascii():
        return text.lower()
    return "".join(c.upper().lower()[0] if len(c.upper()) == 1 else c for c in text)


def _needed(tree) -> list[str] | None:
    """Strings of which every match of a parsed pattern holds one; the longest choice."""
    choices, run = [], ""
    for kind, value in [*tree, (None, None)]:
        if kind is re._constants.LITERAL:
            run += chr(value)
            continue
        if run:
            choices.append([run])
            run = ""
        found = None
        if kind is re._constants.SUBPATTERN:
            found = _needed(value[-1])
        elif kind in (re._constants.MAX_REPEAT, re._constants.MIN_REPEAT, re._constants.POSSESSIVE_REPEAT) and value[0] > 0:
            found = _needed(value[2])
        elif kind is re._constants.ATOMIC_GROUP:
            found = _needed(value)
        elif kind is re._constants.BRANCH:
            arms = [_needed(arm) for arm in value[1]]
            found = None if None in arms else [n for arm in arms for n in arm]
        if found:
            choices.append(found)
    best = max(choices, key=lambda c: min(map(len, c)), default=None)
    return best if best and min(map(len, best)) >= LEAST else None


def required(pattern: str) -> tuple[list[str], bool] | None:
    """Needles of a Java pattern and whether they are compared without case; None where none can be told.

    What this reads differently from Java, it does not read at all: the rule is then tried on every row.
    """
    flags = FLAGS.match(pattern)
    names, rest = (flags[1], pattern[flags.end() :]) if flags else ("", pattern)
    if "x" in names or r"\Q" in rest or "(?" in re.sub(r"\(\?[:=!>]|\(\?<[=!]", "", rest):
        return None
    try:
        found = _needed(re._parser.parse(rest))
    except (re.error, OverflowError):
        return None
    if not found:
        return None
    return ([fold(n) for n in found], True) if "i" in names else (found, False)


def matches_needed(c: Column, pattern: str, flags: str = "") -> Column:
    """Whether ``pattern`` matches, tried only on a text that holds what every match must hold."""
    found = required(pattern)
    hit = matches(c, flags + pattern)
    if not found or found[1]:
        return hit
    return (c.contains(found[0][0]) if len(found[0]) == 1 else matches(c, alternation(found[0]))) & hit


def slices(rules: DataFrame, text: str) -> Iterator[list[dict]]:
    """The rules in bounded slices, each rule with a ``_rule`` number; ``text`` is their long column."""
    part, size = [], 0
    rows = rules.limit(SLICE_RULES + 1).collect()  # one job for a table of one slice
    for row in rows if len(rows) <= SLICE_RULES else rules.toLocalIterator(prefetchPartitions=True):
        length = len(row[text] or "")
        if part and (len(part) >= SLICE_RULES or size + length > SLICE_CHARS):
            yield part
            part, size = [], 0
        part.append(row.asDict() | {"_rule": len(part)})
        size += length
    if part:
        yield part


def meetings(df: DataFrame, text: str, needles: Sequence[tuple[int, Sequence[str], bool]]) -> DataFrame:
    """``df`` with a row for every rule whose needle occurs in ``text``, its number in ``_rule``.

    ``needles``: rule, texts of which one must occur, whether case is left out. An empty text occurs everywhere.
    """
    shared = df.sparkSession.sparkContext.broadcast(list(needles))

    def automaton(chosen: Sequence[tuple[int, Sequence[str]]]):
        rules: dict[str, list[int]] = {}
        for rule, texts in chosen:
            for t in texts:
                rules.setdefault(t, []).append(rule)
        everywhere = set(rules.pop("", []))
        tree = ahocorasick.Automaton()
        for t, found in rules.items():
            tree.add_word(t, found)
        if rules:
            tree.make_automaton()
        return (tree if rules else None), everywhere

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, always = automaton([(r, t) for r, t, folded in shared.value if not folded])
        bare, more = automaton([(r, t) for r, t, folded in shared.value if folded])
        always |= more
        for batch in source:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows, rules = [], []
                for i, value in enumerate(part.column(text).to_pylist()):
                    if value is None:
                        continue
                    found = set(always)
                    if plain:
                        for _, hit in plain.iter(value):
                            found.update(hit)
                    if bare:
                        for _, hit in bare.iter(fold(value)):
                            found.update(hit)
                    rows += [i] * len(found)
                    rules += found
                if rows:
                    yield part.take(pa.array(rows, pa.int32())).append_column("_rule", pa.array(rules, pa.int32()))

    return df.mapInArrow(batches, StructType([*df.schema.fields, StructField("_rule", IntegerType(), False)]))


def rule_rows(df: DataFrame, part: Sequence[dict], rules: DataFrame) -> DataFrame:
    """``df`` from ``meetings`` with the columns of the rules; a slice is bounded, so it is broadcast."""
    kinds = StructType([*rules.schema.fields, StructField("_rule", IntegerType(), False)])
    return df.join(F.broadcast(df.sparkSession.createDataFrame([tuple(r[c] for c in kinds.names) for r in part], kinds)), "_rule").drop("_rule")


def containing(df: DataFrame, text: str, rules: DataFrame, needle: str) -> DataFrame:
    """``df`` with a row and the rule's columns for every rule whose ``needle`` lies in ``text``."""
    out = None
    for part in slices(rules.filter(F.col(needle).isNotNull()), needle):
        met = meetings(df, text, [(r["_rule"], [r[needle]], False) for r in part])
        met = rule_rows(met, part, rules)
        out = met if out is None else out.unionByName(met)
    if out is not None:
        return out
    return df.sparkSession.createDataFrame([], StructType([*df.schema.fields, *rules.schema.fields]))


by_value(__name__)
