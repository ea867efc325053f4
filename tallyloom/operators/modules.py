"""Module assignment, splitting and order of tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ordered
from ..functions.containment import list_matches
from ..functions.joins import salted_join
from ..functions.ruletable import as_groups, as_rules
from ..functions.text import SPACE, col, contains_any, first_match, half_up, strip, sub
from ..rules import tasks as R
from ..session import materialise

U = "(?dU)"


def _without_suffix(c: Column, suffixes=R.SECTION_SUFFIXES) -> Column:
    """Cut the first listed suffix the text ends with."""
    return first_match([(c.endswith(s), strip(F.substring(c, F.lit(1), F.length(c) - F.lit(len(s))))) for s in suffixes], c)


def _first_keyword(condition, keywords) -> Column:
    """Module of the first keyword for which ``condition(keyword)`` holds."""
    table = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(m).alias("m")) for k, m in keywords])
    return F.get(F.filter(table, lambda e: condition(e["k"])), F.lit(0))


def _match(module: Column, confidence: Column, source: str, rank: int) -> Column:
    return F.struct(
        F.coalesce(module, F.lit("")).alias("module"),
        F.when(module.isNotNull(), confidence).otherwise(0.0).alias("confidence"),
        F.lit(source).alias("source"),
        F.lit(rank).alias("rank"),
    )


def by_content(content: Column, keywords=R.MODULE_KEYWORDS) -> Column:
    """First keyword in the text; longer keywords are more certain."""
    low = F.lower(content)
    hit = _first_keyword(lambda k: F.contains(low, F.lower(k)), keywords)
    return _match(hit["m"], F.least(F.lit(0.5) + F.length(hit["k"]) * F.lit(0.05), F.lit(0.95)), "content", 0)


def section_name(section: Column) -> tuple[Column, Column]:
    """Last part of the path without number, and the same without suffix."""
    last = strip(F.substring_index(section, " > ", -1))
    plain = sub(last, U + R.SECTION_NUMBER)
    return plain, _without_suffix(plain)


def by_section(plain: Column, name: Column, keywords=R.MODULE_KEYWORDS) -> Column:
    """Module from the section title: keyword 0.7, own name 0.5, bare title 0.3."""
    marks = F.lit("，,。；;：:")
    hit = _first_keyword(lambda k: F.contains(name, k) | F.contains(k, name), keywords)
    tidy, bare = F.btrim(name, marks), F.btrim(strip(plain), marks)
    module = F.when(
        name == "", F.when(F.length(bare) > 2, bare)
    ).otherwise(F.coalesce(hit["m"], F.nullif(tidy, F.lit(""))))
    confidence = F.when(name == "", 0.3).when(hit.isNotNull(), 0.7).otherwise(0.5)
    return _match(module, confidence, "section", 1)


def core_words(content: Column | str) -> Column:
    """Distinct words of two or more characters after the leading verb, cut at joining characters."""
    c = col(content)
    verb = "|".join(R.CORE_VERBS)
    body = sub(c, rf"\A(?:{verb})")
    return F.array_distinct(F.filter(F.transform(F.split(body, R.CORE_SPLIT), strip), lambda w: F.length(w) >= 2))


def whitelist_scores(contents: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Best whitelist module per distinct text: share of shared core words, or 0.5 for a word of near equal length.

    ``contents``: content (distinct); ``whitelist``: ord, module, content.
    """
    order = whitelist.groupBy("module").agg(F.min("ord").alias("ord"))
    words = materialise(whitelist.select("module", F.explode(core_words("content")).alias("word")).distinct().join(order, "module"), "core_words")
    mine = contents.select("content", core_words("content").alias("_w")).filter(F.size("_w") > 0)
    mine = materialise(mine.withColumn("id", F.monotonically_increasing_id()), "core_contents")
    shares = (
        mine.select("id", F.size("_w").alias("_n"), F.explode("_w").alias("word"))
        .join(words.hint("merge"), "word")
        .groupBy("id", "module", "ord")
        .agg((F.count(F.lit(1)) / F.max("_n")).alias("score"))
    )
    # A long word and a text of near equal length, one inside the other; the first module of a word stands for it.
    first = words.filter(F.length("word") >= 4).groupBy("word").agg(F.min(F.struct("ord", "module")).alias("_m"))
    first = materialise(first, "long_words")
    texts, listed = mine.select("id", F.col("content").alias("text")), first.withColumnRenamed("word", "l_text")
    inside = list_matches(texts, listed, "_m", longest=1.5)
    inside = inside.select("id", "_m.module", "_m.ord", F.lit(0.5).alias("score"))
    scored = shares.unionByName(inside)
    best = scored.groupBy("id").agg(F.min_by(F.struct("module", "score"), F.struct(-F.col("score"), "ord")).alias("b"))
    best = best.filter(F.col("b.score") > 0.3)
    return mine.select("id", "content").join(best.hint("merge"), "id").select(
        "content", F.col("b.module").alias("wl_module"), F.least(F.col("b.score"), F.lit(0.9)).alias("wl_score")
    )


def canonical_module(c: Column | str) -> Column:
    """Module name without path, number, suffix and blanks."""
    name = section_name(col(c))[1]
    return F.coalesce(F.nullif(sub(name, f"{SPACE}+"), F.lit("")), F.lit(R.UNSORTED))


def assign_modules(tasks: DataFrame, whitelist: DataFrame | None = None, keywords=R.MODULE_KEYWORDS) -> DataFrame:
    """Module, confidence, deciding source and conflict flag per task.

    ``tasks``: content, section_path, ...; the whitelist is scored once per
    distinct text. ``keywords``: pairs, or a table keyword, module, ord.
    """
    keep, keywords = tasks.columns, as_rules(keywords, ["keyword", "module"])
    df = tasks
    if whitelist is not None:
        df = df.join(whitelist_scores(tasks.select("content").distinct(), whitelist).hint("merge"), "content", "left")
    else:
        df = df.withColumns({"wl_module": F.lit(None).cast("string"), "wl_score": F.lit(None).cast("double")})
    plain, name = section_name(F.coalesce("section_path", F.lit("")))
    df = df.withColumns({"_plain": plain, "_name": name})
    df = df.withColumns(
        {
            "_c": by_content(F.col("content"), keywords),
            "_s": by_section(F.col("_plain"), F.col("_name"), keywords),
            "_w": _match(F.col("wl_module"), F.col("wl_score"), "whitelist", 2),
        }
    )
    three = F.array("_c", "_s", "_w")
    found = F.array_distinct(
        F.transform(F.filter(three, lambda r: (r["module"] != "") & (r["confidence"] > 0.3)), lambda r: r["module"])
    )
    best = F.array_min(
        F.transform(three, lambda r: F.struct((-r["confidence"]).alias("o"), r["rank"].alias("r"), r.alias("m")))
    )["m"]
    df = df.withColumns({"_best": best, "conflict": F.size(found) > 1})
    # a general name gives way to a telling section title, then to a phrase naming the interface
    module, confidence = F.col("_best.module"), F.col("_best.confidence")
    general = module.isin(R.STANDARD_MODULES) | ((F.length(module) <= 3) & (F.col("_best.source") == "section"))
    s_module = F.col("_s.module")
    titled = (
        general
        & (F.col("_s.confidence") >= 0.4)
        & ~s_module.isin(R.STANDARD_MODULES)
        & (F.length(s_module) >= 4)
    )
    df = df.withColumns(
        {
            "_general": general,
            "_m1": F.when(titled, s_module).otherwise(module),
            "_c1": F.when(titled, F.col("_s.confidence")).otherwise(confidence),
            "_src1": F.when(titled, "section").otherwise(F.col("_best.source")),
            "_phrase": F.regexp_extract("content", U + R.ENTITY_PHRASE, 0),
        }
    )
    phrase, m1 = F.col("_phrase"), F.col("_m1")
    phrased = (
        F.col("_general")
        & (phrase != "")
        & (phrase != F.col("content"))
        & ~F.contains(m1, phrase)
        & (F.length(phrase) > F.length(m1) + 2)
    )
    other = F.greatest(
        *[
            F.when((F.col(f"{r}.module") != "") & (F.col(f"{r}.module") != F.col("_w.module")), F.col(f"{r}.confidence")).otherwise(0.0)
            for r in ("_c", "_s")
        ]
    )
    listed = (F.col("_w.confidence") >= 0.7) & (F.col("_w.confidence") > other)
    df = df.withColumns(
        {
            "_m2": F.when(listed, F.col("_w.module")).when(phrased, phrase).otherwise(m1),
            "_c2": F.when(listed, F.col("_w.confidence"))
            .when(phrased, F.least(F.col("_c1") + F.lit(0.1), F.lit(0.95)))
            .otherwise(F.col("_c1")),
            "_src2": F.when(listed, "whitelist").otherwise(F.col("_src1")),
        }
    )
    none = F.col("_m2") == ""
    rest = [c for c in keep if c != "module"]
    return df.select(
        *rest,
        F.when(none, R.UNSORTED).otherwise(F.col("_m2")).alias("module"),
        half_up(F.when(none, 0.1).otherwise(F.col("_c2")), 4).alias("confidence"),
        F.when(none, "fallback").otherwise(F.col("_src2")).alias("match_source"),
        "conflict",
    )


def sub_module(module: Column, content: Column, words=R.SUB_MODULES) -> Column:
    """``module - sub`` by the first sub-module word in the text."""
    name = first_match([(content.contains(w), F.lit(s)) for w, s in words])
    return F.when(name.isNotNull(), F.concat_ws(" - ", module, name)).otherwise(module)


def split_modules(tasks: DataFrame, most: int = 10, words=R.SUB_MODULES) -> DataFrame:
    """Tasks of modules with more than ``most`` tasks get a sub-module. Counts are pre-aggregated, not windowed.

    ``words``: pairs of word and sub-module, or a table word, module, ord.
    """
    words = as_rules(words, ["word", "module"])
    sizes = tasks.groupBy("project", "module").agg(F.count(F.lit(1)).alias("_n"))
    large = sizes.filter(F.col("_n") > most).select("project", "module", F.lit(True).alias("_large"))
    df = salted_join(tasks, large, ["project", "module"], "content")
    return df.select(
        *[c for c in tasks.columns if c != "module"],
        F.when(F.col("_large"), sub_module(F.col("module"), F.col("content"), words)).otherwise(F.col("module")).alias("module"),
    )


def sequence_tasks(tasks: DataFrame, size: int = ordered.CHUNK) -> DataFrame:
    """Ids ``T001...`` in module order per project, and the previous id of the module as dependency.

    The position is the number of tasks in earlier modules (from counts) plus
    the position inside the module (chunked), so no window spans a project.
    """
    counts = tasks.groupBy("project", "module").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("project").orderBy("module").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("project", "module", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    df = ordered.row_numbers(tasks, ["project", "module"], "seq", "_rn", size=size)
    df = salted_join(df, offsets, ["project", "module"], "seq", "inner")

    def task_id(n: Column) -> Column:
        text = n.cast("string")
        return F.concat(F.lit("T"), F.lpad(text, F.greatest(F.length(text), F.lit(3)), F.lit("0")))

    position = F.col("_before") + F.col("_rn")
    return df.select(
        *tasks.columns,
        task_id(position).alias("task_id"),
        F.when(F.col("_rn") > 1, task_id(position - 1)).otherwise(R.NO_DEPENDENCY).alias("dependency"),
    )


def acceptance(content: Column | str, groups=R.ACCEPTANCE) -> Column:
    """Acceptance lines of the first word group that applies; the last group is the default.

    ``groups``: (words, lines); from a table see ``acceptance_groups``.
    """
    low = F.lower(col(content))
    cases = [(contains_any(low, words), F.lit("；".join(lines[:5]))) for words, lines in groups[:-1]]
    return first_match(cases, F.lit("；".join(groups[-1][1][:5])))


def acceptance_groups(words: DataFrame, lines: DataFrame) -> list[tuple[list[str], list[str]]]:
    """Groups for ``acceptance`` from tables ``words`` (name, word, ord) and ``lines`` (name, line, ord).

    A name without words is the default; without one, texts that no group fits have no lines.
    """
    groups, texts = as_groups(words, "name", "word"), dict(as_groups(lines, "name", "line"))
    named = {n for n, _ in groups}
    default = next((t for n, t in texts.items() if n not in named), [""])
    return [([w.lower() for w in found], texts[n]) for n, found in groups if n in texts] + [([], default)]
