"""Text expressions built from Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes that mean the same in Java and RE2 regular expressions.
SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
# The members of SPACE one by one, for trimming.
WHITESPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
CJK = r"[\x{4e00}-\x{9fff}]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sub(c: Column | str, pattern: str, replacement: str = "") -> Column:
    return F.regexp_replace(col(c), F.lit(pattern), F.lit(replacement))


def matches(c: Column | str, pattern: str) -> Column:
    return F.regexp_like(col(c), F.lit(pattern))


def group(c: Column | str, pattern: str, index: int = 1) -> Column:
    """Captured group of the first match, NULL when there is no match or it is empty."""
    return F.nullif(F.regexp_extract(col(c), pattern, index), F.lit(""))


def strip(c: Column | str) -> Column:
    """Trim every kind of white space at both ends."""
    return F.btrim(col(c), F.lit(WHITESPACE))


def alternation(words) -> str:
    """A pattern of ``words`` that tries them only where a character begins one of them."""
    words = list(words)
    pattern = "(?:" + "|".join(rf"\Q{w}\E" for w in words) + ")"
    if not all(words):
        return pattern
    return "(?=[" + "".join(rf"\x{{{ord(x):x}}}" for x in sorted({w[0] for w in words})) + "])" + pattern


def contains_any(c: Column | str, words) -> Column:
    """True when any of ``words`` occurs.

    Longer lists become one alternation, so that the text expression appears
    only once however the optimizer moves the condition.
    """
    words = list(words)
    if len(words) > 3:
        return matches(c, alternation(words))
    out = col(c).contains(words[0])
    for w in words[1:]:
        out = out | col(c).contains(w)
    return out


def any_of(conditions) -> Column:
    conditions = list(conditions)
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def count_contained(c: Column | str, words) -> Column:
    """How many of ``words`` occur in the text."""
    c = col(c)
    return F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(c, w)))


def first_contained(c: Column | str, words) -> Column:
    """First of ``words`` (list order) that occurs in the text, else NULL."""
    c = col(c)
    hits = F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(c, w))
    return F.get(hits, F.lit(0))


def first_match(pairs, default: Column | None = None) -> Column:
    """Ordered first-match-wins over ``(condition, value)`` pairs."""
    out = None
    for condition, value in pairs:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out if default is None else out.otherwise(default)


def estimate_tokens(c: Column | str) -> Column:
    """A third of the characters, at least 1; 0 for empty text."""
    n = F.coalesce(F.length(col(c)), F.lit(0))
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(n / 3))).cast("long")


def rough_tokens(c: Column | str) -> Column:
    """CJK characters count a half, others a quarter, plus one."""
    text = F.coalesce(col(c), F.lit(""))
    other = F.length(sub(text, CJK))
    cjk = F.length(text) - other
    return (F.floor(cjk / 2) + F.floor(other / 4) + 1).cast("long")


def words(c: Column | str) -> Column:
    return F.regexp_extract_all(col(c), F.lit(f"{WORD}+"), F.lit(0))


def keywords(c: Column | str) -> Column:
    """CJK runs of four or more, then lower-cased Latin words of four or more; distinct, first seen first."""
    runs = F.regexp_extract_all(col(c), F.lit(f"{CJK}{{4,}}"), F.lit(0))
    latin = F.filter(words(c), lambda w: F.regexp_like(w, F.lit(r"\A[a-zA-Z]{4,}\z")))
    return F.array_distinct(F.concat(runs, F.transform(latin, F.lower)))


def half_up(c: Column | str, places: int) -> Column:
    """Round half up on the decimal value.

    A nudge far below the last place kept makes ties such as 1.005 come out the
    same in every engine.
    """
    return F.round(col(c) + F.lit(10.0 ** -(places + 6)), places)


def ratio2(a: Column | str, b: Column | str) -> Column:
    """``a / b`` to two places, 0 when ``b`` is not positive."""
    a, b = col(a), col(b)
    return F.when(b > 0, half_up(a.cast("double") / b, 2)).otherwise(F.lit(0.0))


def readable(n: Column | str) -> Column:
    """1500 as 1K, 2500000 as 2.5M."""
    n = col(n).cast("long")
    return (
        F.when(n >= 1_000_000, F.concat(half_up(n / 1_000_000, 1).cast("decimal(20,1)").cast("string"), F.lit("M")))
        .when(n >= 1_000, F.concat(F.floor(n / 1_000).cast("string"), F.lit("K")))
        .otherwise(n.cast("string"))
    )
