"""Quality checks and clean-up of technical documents.

Everything up to the corpus roll-up works inside the document row: no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.needles import containing, matches_needed
from ..functions.text import (
    CJK,
    SPACE,
    WORD,
    any_of,
    col,
    contains_any,
    first_contained,
    first_match,
    group,
    half_up,
    matches,
    strip,
    sub,
)
from ..rules import documents as D
from ..sources.files import document_lines

_UNIX = "(?dU)"


def _captured(c: Column, patterns: Sequence[str]) -> Column:
    """Trimmed group of the first pattern that matches, else NULL."""
    return F.coalesce(*[F.when(matches_needed(c, p, _UNIX), strip(F.regexp_extract(c, _UNIX + p, 1))) for p in patterns])


def _check(name: str, required: bool, passed: Column, value: Column) -> Column:
    weight = D.REQUIRED_WEIGHT if required else D.BONUS_WEIGHT
    return F.struct(
        F.lit(name).alias("check"),
        F.lit(required).alias("required"),
        passed.alias("passed"),
        value.cast("string").alias("value"),
        F.when(passed, weight).otherwise(0).alias("score"),
    )


def _checks(text: Column) -> list[Column]:
    mark = first_contained(text, D.TASK_MARKS)
    depends = _captured(text, D.DEPENDENCY)
    missing = F.filter(
        F.array(*[F.when(~contains_any(text, words), F.lit(part)) for part, words in D.API_PARTS.items()]),
        lambda p: p.isNotNull(),
    )
    complete = F.size(missing) == 0
    has_path = any_of([matches_needed(text, p, _UNIX) for p in D.PATHS])
    has_method = contains_any(text, D.METHODS)
    accepted = contains_any(text, D.ACCEPTANCE) & any_of([matches(text, "(?m)" + _UNIX + p) for p in D.CHECKLIST])
    effort, priority = _captured(text, D.EFFORT), _captured(text, D.PRIORITY)
    background = contains_any(text, D.BACKGROUND)
    api_value = F.when(complete, "完整").otherwise(F.concat(F.lit("缺少："), F.array_join(missing, ", ")))
    return [
        _check("task_type", True, mark.isNotNull(), mark),
        _check("dependencies", True, depends.isNotNull(), depends),
        _check("api_definition", True, complete, api_value),
        _check("implementation", True, has_path, F.when(has_path & has_method, "具体").when(has_path, "较具体")),
        _check("acceptance_criteria", True, accepted, F.when(accepted, "可执行")),
        _check("effort", False, effort.isNotNull(), effort),
        _check("priority", False, priority.isNotNull(), priority),
        _check("background", False, background, F.when(background, "有业务背景说明")),
    ]


def assess(docs: DataFrame) -> DataFrame:
    """Add ``checks``, the array of the eight check results, to every document."""
    return docs.withColumn("checks", F.array(*_checks(F.col("text"))))


def check_documents(docs: DataFrame) -> DataFrame:
    """One row per document and check."""
    df = assess(docs).select("doc_id", F.explode_outer("checks").alias("c"))
    return df.select("doc_id", "c.*")


def level_of(score: Column) -> Column:
    return first_match([(score >= mark, F.lit(name)) for mark, name in D.LEVELS[:-1]], F.lit(D.LEVELS[-1][1]))


def score_documents(docs: DataFrame) -> DataFrame:
    """Score, grade, readiness and ordered fix list per document."""
    df = assess(docs)
    total = F.aggregate("checks", F.lit(0), lambda s, c: s + c["score"])
    passed = F.size(F.filter("checks", lambda c: c["required"] & c["passed"]))
    failed = F.transform(F.filter("checks", lambda c: ~c["passed"]), lambda c: c["check"])
    keep = [c for c in ("doc_id", "project") if c in docs.columns]
    df = df.select(
        *keep,
        F.least(total, F.lit(100)).alias("score"),
        passed.alias("passed_checks"),
        failed.alias("_failed"),
    )
    hint = F.create_map(*[F.lit(x) for pair in D.SUGGESTIONS.items() for x in pair])
    return df.select(
        *keep,
        "score",
        "passed_checks",
        level_of(F.col("score")).alias("level"),
        ((F.col("score") >= D.PASS_MARK) & (F.col("passed_checks") == len(D.REQUIRED))).alias("ready"),
        F.array_join(F.transform("_failed", lambda c: F.element_at(hint, c)), "; ").alias("suggestions"),
    )


def vague_phrases(
    docs: DataFrame, phrases: Sequence[tuple[str, str]] | DataFrame = tuple(D.VAGUE + D.VAGUE_JAVA)
) -> DataFrame:
    """One row per line and vague phrase. Documents without any phrase are dropped before lines are made.

    ``phrases`` may be a table (phrase, hint) of any size, which is then met through an index.
    """
    if isinstance(phrases, DataFrame):
        lines = document_lines(docs.select("doc_id", "text")).select("doc_id", "line_no", "line")
        df = containing(lines, "line", phrases.select("phrase", "hint"), "phrase")
        return df.select("doc_id", "line_no", "phrase", "hint", strip("line").alias("context"))
    words = [p for p, _ in phrases]
    # texts in other scripts are told apart by one character class before any phrase is tried
    cjk = all(any("\u4e00" <= ch <= "\u9fff" for ch in p) for p in words)

    def possible(c: str) -> Column:
        return matches(c, CJK) & contains_any(c, words) if cjk else contains_any(c, words)

    hit = docs.select("doc_id", "text").filter(possible("text"))
    lines = document_lines(hit).filter(possible("line"))
    table = F.array(*[F.struct(F.lit(p).alias("phrase"), F.lit(h).alias("hint")) for p, h in phrases])
    found = F.filter(table, lambda p: F.contains(F.col("line"), p["phrase"]))
    df = lines.select("doc_id", "line_no", "line", F.explode_outer(found).alias("p")).filter(F.col("p").isNotNull())
    return df.select("doc_id", "line_no", "p.phrase", "p.hint", strip("line").alias("context"))


def issues(docs: DataFrame) -> DataFrame:
    """One error row per failed required check and one warning row per vague phrase."""
    failed = check_documents(docs).filter(F.col("required") & ~F.col("passed"))
    hint = F.create_map(*[F.lit(x) for pair in D.SUGGESTIONS.items() for x in pair])
    errors = failed.select(
        "doc_id",
        F.lit(None).cast("long").alias("line_no"),
        F.concat(F.lit("missing_"), "check").alias("type"),
        F.lit("error").alias("severity"),
        F.col("check").alias("text"),
        F.element_at(hint, F.col("check")).alias("suggestion"),
    )
    warnings = vague_phrases(docs).select(
        "doc_id",
        "line_no",
        F.lit("vague_language").alias("type"),
        F.lit("warning").alias("severity"),
        F.col("phrase").alias("text"),
        F.col("hint").alias("suggestion"),
    )
    return errors.unionByName(warnings)


def document_blocks(docs: DataFrame) -> DataFrame:
    """Blocks headed by ``###`` lines: ordinal, title, content. Cut inside the row, without a shuffle."""
    df = docs.select("doc_id", F.split("text", "\n").alias("_lines"))
    title = rf"\A###{SPACE}+([^\n]*[^\n\t-\r\x1c-\x20\x{{85}}\p{{Z}}])"
    heads = F.filter(
        F.transform("_lines", lambda x, i: F.when(matches(strip(x), title), i)), lambda i: i.isNotNull()
    )
    df = df.withColumn("_heads", heads)
    block = F.transform(
        "_heads",
        lambda start, j: F.struct(
            (j + 1).alias("block_no"),
            strip(F.regexp_extract(strip(F.get("_lines", start)), title, 1)).alias("title"),
            F.array_join(
                F.slice("_lines", start + 1, F.coalesce(F.get("_heads", j + 1), F.size("_lines")) - start), "\n"
            ).alias("content"),
        ),
    )
    out = df.select("doc_id", F.explode_outer(block).alias("b")).filter(F.col("b").isNotNull())
    return out.select("doc_id", F.col("b.block_no").cast("long").alias("block_no"), "b.title", "b.content")


def tech_stack(text: Column) -> Column:
    low = F.lower(text)
    return first_match([(contains_any(low, words), F.lit(s)) for s, words in D.STACKS], F.lit("unknown"))


def document_metadata(docs: DataFrame) -> DataFrame:
    """Version, creation time, stack, characters and blocks per document."""
    text = F.col("text")
    head = rf"\A###{SPACE}+[^\n]*[^\n\t-\r\x1c-\x20\x{{85}}\p{{Z}}]"
    return docs.select(
        "doc_id",
        _captured(text, [D.VERSION]).alias("version"),
        _captured(text, [D.CREATED]).alias("created"),
        tech_stack(text).alias("stack"),
        F.length(text).cast("long").alias("chars"),
        F.size(F.filter(F.split(text, "\n"), lambda x: matches(strip(x), head))).cast("long").alias("blocks"),
    )


def stack_counts(docs: DataFrame) -> DataFrame:
    """Documents, characters and blocks per stack."""
    return document_metadata(docs).groupBy("stack").agg(
        F.count(F.lit(1)).alias("docs"),
        F.count("version").alias("versioned"),
        F.sum("chars").alias("chars"),
        F.sum("blocks").alias("blocks"),
    )


def corpus_report(docs: DataFrame) -> DataFrame:
    """Pass rate, mean score, grades and most frequent failed check per project."""
    df = assess(docs)
    total = F.least(F.aggregate("checks", F.lit(0), lambda s, c: s + c["score"]), F.lit(100))

    def failed(name: str) -> Column:
        return F.exists("checks", lambda c: (c["check"] == name) & ~c["passed"])

    names = D.REQUIRED + D.BONUS
    df = df.select("project", total.alias("score"), *[failed(n).alias(f"_f_{n}") for n in names])
    df = df.withColumn("level", level_of(F.col("score")))
    counts = df.groupBy("project").agg(
        F.count(F.lit(1)).alias("docs"),
        F.count_if(F.col("score") >= D.PASS_MARK).alias("passed"),
        half_up(F.avg("score"), 4).alias("mean_score"),
        *[F.count_if(F.col("level") == name).alias(f"level_{mark}") for mark, name in D.LEVELS],
        *[F.count_if(f"_f_{n}").alias(f"_f_{n}") for n in names],
    )
    worst = F.array_max(F.array(*[F.struct(F.col(f"_f_{n}").alias("n"), F.lit(-i).alias("o"), F.lit(n).alias("name")) for i, n in enumerate(names)]))
    return counts.select(
        "project",
        "docs",
        half_up(F.col("passed") / F.col("docs"), 4).alias("pass_rate"),
        "mean_score",
        *[f"level_{mark}" for mark, _ in D.LEVELS],
        F.when(worst["n"] > 0, worst["name"]).alias("worst_check"),
        worst["n"].alias("worst_failures"),
    )


# -- clean-up -------------------------------------------------------------------

_IN_LINE = r"[\t\x0b-\r\x1c-\x20\x{85}\p{Z}]"


def normalise_text(c: Column | str) -> Column:
    """Repair extracted text: radicals, control and zero-width characters, blanks, doubled words."""
    out = F.translate(col(c), D.RADICALS, D.CHARACTERS)
    out = sub(out, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}\x{ad}\x{200b}-\x{200f}\x{2028}-\x{202f}\x{feff}]")
    out = F.replace(out, F.lit("　"), F.lit(" "))
    out = sub(out, r"[ \t]+", " ")
    out = sub(out, rf"(?dm)^{_IN_LINE}+|{_IN_LINE}+$")
    return sub(out, rf"({'|'.join(D.DOUBLED)})\1", "$1")


def join_broken_lines(c: Column | str) -> Column:
    """Join CJK words and API paths broken over lines, drop blank lines."""
    out = sub(col(c), r"([\x{4e00}-\x{9fa5}])\n([\x{4e00}-\x{9fa5}])", "$1$2")
    out = sub(out, rf"(/api/(?:{WORD}|-)+)\n((?:{WORD}|[/-])+)", "$1$2")
    return sub(out, rf"\n{SPACE}*\n", "\n")


def norm_key(c: Column | str) -> Column:
    """Comparison key: no control characters, single spaces."""
    return strip(sub(sub(col(c), r"[\x00-\x1f\x7f]"), f"{SPACE}+", " "))


def normalise_corpus(docs: DataFrame) -> DataFrame:
    """Corrected text, comparison key and change flag per document."""
    df = docs.withColumn("fixed", join_broken_lines(normalise_text("text")))
    return df.select(
        *[c for c in ("doc_id", "project") if c in docs.columns],
        "fixed",
        norm_key("fixed").alias("key"),
        (F.col("fixed") != F.col("text")).alias("changed"),
    )


def changed_share(docs: DataFrame) -> DataFrame:
    """Share of documents that needed correction, per project."""
    return normalise_corpus(docs).groupBy("project").agg(
        F.count(F.lit(1)).alias("docs"), half_up(F.count_if("changed") / F.count(F.lit(1)), 4).alias("changed_share")
    )


# Endpoint in brackets, bare method and path, bare path.
_METHODS = "|".join(D.METHOD_NAMES)
ENDPOINTS = [
    rf"\(({_METHODS})\s+(/[^)\s]+)\)",
    rf"(?:^|[\s(])({_METHODS})\s+(/[^\s)→,，;；\"]+)",
    r"(/\w[\w/\-{}]+)",
]


def endpoint(c: Column | str) -> Column:
    """``struct<method, path>`` of the first endpoint form found, NULL without one."""
    c = col(c)
    full = [_UNIX + p for p in ENDPOINTS]

    def pair(p: str, method: Column, index: int) -> Column:
        return F.when(matches(c, p), F.struct(method.alias("method"), F.regexp_extract(c, p, index).alias("path")))

    return F.coalesce(
        pair(full[0], F.regexp_extract(c, full[0], 1), 2),
        pair(full[1], F.regexp_extract(c, full[1], 1), 2),
        pair(full[2], F.lit(""), 1),
    )


def endpoint_mentions(lines: DataFrame) -> DataFrame:
    """Endpoint mentions per document and method."""
    df = lines.filter(F.col("line").contains("/")).select("doc_id", endpoint("line").alias("e"))
    return (
        df.filter(F.col("e").isNotNull())
        .groupBy("doc_id", F.col("e.method").alias("method"))
        .agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("e.path").alias("paths"))
    )
