"""Consistency and quality checks of tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ordered
from ..functions.text import any_of, half_up, strip, sub
from ..rules import tasks as R
from .modules import U, _without_suffix


def found_in_source(content: Column, raw: Column) -> Column:
    """The text, the text without its verb, or any four characters of it occur in the source."""
    core = sub(content, rf"\A(?:{'|'.join(R.CORE_VERBS)})")
    last = F.length(content) - 3
    pieces = F.exists(
        F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.contains(raw, F.substring(content, i, F.lit(4)))
    )
    return F.contains(raw, content) | ((core != "") & F.contains(raw, core)) | ((last >= 1) & pieces)


def agrees_with_section(module: Column, section: Column) -> Column:
    """Module and section name one another, number and suffix aside."""
    names = F.transform(F.split(section, " > "), lambda p: _without_suffix(sub(p, U + R.SECTION_NUMBER), R.CHECK_SUFFIXES))
    part = F.exists(names, lambda n: (n != "") & (F.contains(module, n) | F.contains(n, module)))
    return (module == "") | (section == "") | F.contains(section, module) | part


def check_tasks(tasks: DataFrame) -> DataFrame:
    """Confidence in tenths of every task, its issues, and PASS, WARN or FAIL.

    ``tasks``: project, seq, module, content, section_path, line_num, raw_text.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    content, section, raw = text("content"), text("section_path"), text("raw_text")
    df = tasks.withColumns(
        {
            "_none": (section == "") & (F.coalesce("line_num", F.lit(0)) <= 0),
            "_lost": ~found_in_source(content, raw),
            "_apart": ~agrees_with_section(text("module"), section),
            "_short": F.length(content) < 4,
        }
    )
    points = F.lit(10)
    for flag, loss in (("_none", 5), ("_lost", 8), ("_apart", 2), ("_short", 2)):
        points = F.when(F.col(flag), F.greatest(points - loss, F.lit(1))).otherwise(points)
    names = {"_none": "no_source", "_lost": "not_in_source", "_apart": "section", "_short": "short"}
    issues = F.filter(F.array(*[F.when(F.col(f), F.lit(n)) for f, n in names.items()]), lambda i: i.isNotNull())
    empty = content == ""
    df = df.select(
        "project",
        "seq",
        F.when(empty, 0).otherwise(points).alias("_points"),
        F.when(empty, F.array(F.lit("empty"))).otherwise(issues).alias("_issues"),
    )
    valid = F.col("_points") >= 3
    return df.select(
        "project",
        "seq",
        (F.col("_points") / 10).alias("confidence"),
        valid.alias("valid"),
        F.array_join("_issues", ",").alias("issues"),
        F.when(~valid, "FAIL").when(F.size("_issues") > 0, "WARN").otherwise("PASS").alias("status"),
    )


def adjacent_duplicates(tasks: DataFrame, limit: float = 0.3, size: int = ordered.CHUNK) -> DataFrame:
    """Neighbouring tasks of a project whose normalised edit distance is below the limit."""
    df = ordered.neighbours(
        tasks.select("project", "seq", "content"), ["project"], "seq", ["seq", "content"], previous=None, following="_n", size=size
    )
    a, b = F.col("content"), F.col("_n.content")
    distance = F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))
    df = df.select("project", "seq", F.col("_n.seq").alias("next_seq"), F.when((a != "") & (b != ""), distance).alias("_d"))
    return df.filter(F.col("_d") < limit).select("project", "seq", "next_seq", half_up("_d", 4).alias("distance"))


def module_balance(tasks: DataFrame, least: int = 3, most: int = 15) -> DataFrame:
    """Modules with too few or too many tasks."""
    n = F.col("tasks")
    df = tasks.groupBy("project", "module").agg(F.count(F.lit(1)).alias("tasks"))
    return df.withColumn("issue", F.when(n < least, "too_few").when(n > most, "too_many")).filter(F.col("issue").isNotNull())


def provenance(tasks: DataFrame, longest: int = 200) -> DataFrame:
    """Several tasks on one line, line 0, and over-long source text."""
    lines = (
        tasks.filter("line_num > 0")
        .groupBy("project", "line_num")
        .agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("seq"))
        .filter("n > 1")
        .select("project", "seq", "line_num", F.lit("same_line").alias("issue"), "n")
    )
    size = F.length("raw_text")
    single = F.array(
        F.when(F.col("line_num") == 0, F.struct(F.lit("line_zero").alias("issue"), F.lit(1).cast("long").alias("n"))),
        F.when(size > longest, F.struct(F.lit("long_source").alias("issue"), size.cast("long").alias("n"))),
    )
    rest = tasks.select("project", "seq", "line_num", F.explode_outer(single).alias("i")).filter(F.col("i").isNotNull())
    return lines.unionByName(rest.select("project", "seq", "line_num", "i.issue", "i.n"))


def content_quality(tasks: DataFrame, shortest: int = 20, most: int = 10, section: int = 3) -> DataFrame:
    """Short texts, TODO in the source and large modules; tasks without a usable section are left out."""
    df = tasks.filter(F.length(F.coalesce("section_path", F.lit(""))) > section)
    raw = F.coalesce("raw_text", F.lit(""))
    size = F.length("content").cast("long")
    single = F.array(
        F.when(size < shortest, F.struct(F.lit("short").alias("issue"), size.alias("n"))),
        F.when(any_of([raw.contains("TODO"), raw.contains("todo")]), F.struct(F.lit("todo").alias("issue"), F.lit(1).cast("long").alias("n"))),
    )
    per_task = df.select("project", "module", "seq", F.explode_outer(single).alias("i")).filter(F.col("i").isNotNull())
    modules = df.groupBy("project", "module").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)
    return per_task.select("project", "module", "seq", "i.issue", "i.n").unionByName(
        modules.select("project", "module", F.lit(None).cast("long").alias("seq"), F.lit("large_module").alias("issue"), "n")
    )
