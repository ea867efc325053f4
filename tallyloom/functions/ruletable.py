"""Rule tables as arguments of operators that test their rules in one expression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

# Rules of one expression. Tables of any size go through ``functions/needles.py`` where an operator says so.
MOST = 2_000


def as_rules(rules: Sequence[tuple] | DataFrame, columns: Sequence[str], most: int = MOST) -> list[tuple]:
    """The rules in order, as tuples of ``columns``. A table has ``ord``, the order in which rules are tried.

    The order settles which of several rules applies, so equal ``ord`` are ordered by the other columns. A table
    with more than ``most`` rules is refused: no rule is left out.
    """
    if not isinstance(rules, DataFrame):
        return list(rules)
    found = rules.select("ord", *columns).orderBy("ord", *columns).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"the rule table has more than {most} rules")
    return [tuple(r)[1:] for r in found]


def as_groups(rules: Sequence[tuple] | DataFrame, name: str, word: str, most: int = MOST) -> list[tuple[str, list[str]]]:
    """``(name, words)`` in the order of each name's first word; a table has a row for each word."""
    if not isinstance(rules, DataFrame):
        return list(rules)
    groups: dict[str, list[str]] = {}
    for n, w in as_rules(rules, [name, word], most):
        groups.setdefault(n, [])
        if w is not None:
            groups[n].append(w)
    return list(groups.items())

