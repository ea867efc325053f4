"""Mining of work items from document lines, and their clean-up."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ordered
from ..functions.containment import contained_pairs, list_matches, one_edit_pairs
from ..functions.ruletable import as_groups, as_rules
from ..functions.staging import staged
from ..functions.survivors import ruled_out
from ..functions.text import (
    SPACE,
    alternation,
    any_of,
    col,
    contains_any,
    count_contained,
    first_contained,
    first_match,
    matches,
    strip,
    sub,
)
from ..rules import documents as D
from ..rules import tasks as R
from ..session import materialise
from .docs import endpoint, norm_key

U = "(?dU)"


def _hit(c: Column | str, pattern: str, flags: str = U) -> Column:
    return matches(c, flags + pattern)


def _hit_any(c: Column | str, patterns: Sequence[str]) -> Column:
    """Any of the patterns, in one pass."""
    return _hit(c, "|".join(f"(?:{p})" for p in patterns))


def _starts_any(c: Column, words: Sequence[str]) -> Column:
    return matches(c, r"\A(?:" + "|".join(rf"\Q{w}\E" for w in words) + ")")


def _ends_any(c: Column, words: Sequence[str]) -> Column:
    return matches(c, alternation(words) + r"\z")


# -- sections -------------------------------------------------------------------


def sections(lines: DataFrame, template: str = "numeric", rules: Mapping = R.HEADINGS) -> DataFrame:
    """Headings of the documents by template: doc_id, line_no, title, level."""
    df = lines.select("doc_id", "line_no", strip("line").alias("title"))
    title = F.col("title")

    def level(kind: int) -> Column:
        if kind == 0:
            return (F.length(title) - F.length(F.replace(title, F.lit("."), F.lit(""))) + 1).cast("int")
        if kind == -1:
            return F.length(F.regexp_extract(title, r"\A(#+)", 1)).cast("int")
        return F.lit(kind)

    found = first_match([(_hit(title, p), level(n)) for p, n in rules[template]])
    return df.withColumn("level", found).filter(F.col("level").isNotNull())


def line_context(lines: DataFrame, size: int = ordered.CHUNK) -> DataFrame:
    """Previous and next non-empty line of every non-empty line; empty where a heading or the end comes first."""
    df = lines.select("doc_id", "line_no", strip("line").alias("text")).filter(F.col("text") != "")
    df = ordered.neighbours(df, ["doc_id"], "line_no", ["text"], previous="_p", following="_n", size=size)

    def shown(c: str) -> Column:
        t = F.coalesce(F.col(f"{c}.text"), F.lit(""))
        return F.when(_hit(t, R.CONTEXT_HEADING), "").otherwise(t)

    return df.select("doc_id", "line_no", "text", shown("_p").alias("before"), shown("_n").alias("after"))


# -- candidates -----------------------------------------------------------------


def _tech_any(c: Column) -> Column:
    """A technical word in any case."""
    return contains_any(F.lower(c), sorted({t.lower() for t in R.TECH}))


def _rejected(t: Column, bare: Column, is_enum: Column) -> Column:
    """Hard filters on a trimmed line."""
    words = F.split(t, f"{SPACE}+")
    technical = F.size(F.filter(words, lambda w: contains_any(w, R.NOUNS)))
    nouns = contains_any(t, R.NOUNS)
    negation = "|".join(rf"\Q{w}\E" for w in R.NEGATIONS)
    edge = r"[，,。、；;：:\s]"
    marked = contains_any(t, ["【新增】", "【更新】", "【删除】"])
    return any_of(
        [
            F.length(t) < 6,
            contains_any(t, R.MARKERS),
            _ends_any(t, R.SUFFIXES),
            _hit(t, rf"\A(?:{negation})|(?:{negation})\z|{edge}(?:{negation})(?:{edge}|$)"),
            _hit_any(t, [*R.RESIDUE, *R.DIAGRAMS, r"^[\d\s\.\-\|]+$"]),
            _hit(t, R.NUMBERED) & ~marked,
            nouns & (F.length(t) >= 15) & (count_contained(t, R.NOUNS) >= 3),
            nouns & (F.size(words) >= 4) & (technical >= 3) & (technical / F.size(words) >= 0.4),
            is_enum & ((F.length(bare) < 6) | ~(contains_any(bare, R.VERBS) | _tech_any(bare))),
        ]
    )


def _flag(c: Column, points: int = 1) -> Column:
    return F.when(c, points).otherwise(0)


def _score(t: Column, bare: Column, is_enum: Column, verbs: Column, tech: Column) -> Column:
    """Points of a line that passed the hard filters."""
    verb_any, tech_any = verbs > 0, _tech_any(t)
    build = contains_any(t, R.BUILD_VERBS)
    variable = ~build & _hit(t, R.RAW_VARIABLE)
    descriptive = _starts_any(t, R.DESCRIPTIVE)
    verb_list, tech_list = "|".join(R.VERBS), "|".join(R.TECH)
    pattern = any_of(
        [
            _hit(t, rf"^(?:{verb_list}).*(?:{tech_list})"),
            _hit(t, R.STEP + "[：:]"),
            _hit(t, r"^[\[\(]?(?:POST|GET|PUT|DELETE|PATCH)\s+"),
            contains_any(t, ["【新增】", "【更新】", "【删除】"]),
            _hit(t, rf"(?:{'|'.join(R.MODULE_WORDS)}).*(?:{verb_list})"),
        ]
    )
    equals, question = F.instr(t, F.lit("=")), F.instr(t, F.lit("?"))
    assigned = (equals > 0) & ~t.startswith("POST") & ~t.startswith("GET") & ~((question > 0) & (question < equals))
    flow = ~build & (_hit_any(t, R.FLOW) | (is_enum & _hit_any(bare, R.FLOW)))
    mixed = _starts_any(t, R.MIXED)
    return (
        _flag(verbs > 0)
        + _flag(verbs >= 3)
        + _flag(tech > 0)
        + _flag(tech >= 3)
        + _flag(_hit(t, r"\b(?:POST|GET|PUT|DELETE|PATCH|HEAD|OPTIONS)\b"), 2)
        + _flag(contains_any(t, ["【新增】", "【更新】", "【删除】", "【修改】"]), 2)
        + _flag(_hit(t, R.STEP))
        + _flag(_hit(t, r"Step\s*\d+", "(?idU)"))
        - _flag(variable, 2)
        + _flag(~descriptive & ~variable & pattern, 2)
        - _flag(descriptive, 2)
        + F.when(mixed, F.when(verb_any & tech_any, 1).otherwise(-2)).otherwise(0)
        - _flag(is_enum & ~(contains_any(bare, R.VERBS) & _tech_any(bare)))
        - _flag(assigned, 2)
        - _flag(flow, 3)
    )


def task_candidates(lines: DataFrame, size: int = ordered.CHUNK) -> DataFrame:
    """Lines that look like work items: doc_id, line_no, raw_text, score (at least 2).

    Scoring is a projection; only candidates and fence lines are shuffled to
    tell which candidates stand inside a fence, and only step lines near a
    diagram meet the diagram zones.
    """
    keep = [c for c in ("project",) if c in lines.columns]
    # every point of the score needs a CJK character or one of the Latin words, so prose in other scripts stops here
    latin = [w for w in R.TECH if w.isascii()] + ["POST", "GET", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS"]
    possible = rf"[\x{{4e00}}-\x{{9fff}}]|(?=[`~sSa\[{''.join(sorted({w[0] for w in latin}))}])(?:```|~~~|(?i:step)|{'|'.join(latin)}|alt|\[)"
    # the few lines left are read twice, by score and as marks
    lines = lines.select(*keep, "doc_id", "line_no", "line", matches("line", possible).alias("_possible"))
    lines = materialise(lines.filter(F.col("_possible") | F.col("line").contains("-->>")), "possible_lines")
    df = lines.filter("_possible")
    df = df.select(*keep, "doc_id", "line_no", strip("line").alias("raw_text"))
    t = F.col("raw_text")
    fence = any_of([t.startswith(f) for f in R.FENCES])
    df = staged(
        df, {"_fence": fence, "_enum": _hit(t, R.ENUM_PREFIX), "_bare": strip(sub(t, "(?dU)" + R.ENUM_PREFIX))}
    )
    bare, is_enum = F.col("_bare"), F.col("_enum")
    df = staged(df, {"_scorable": ~F.col("_fence") & ~_rejected(t, bare, is_enum)})
    df = df.filter(F.col("_fence") | F.col("_scorable"))
    df = staged(df, {"_verbs": count_contained(t, R.VERBS), "_tech": count_contained(t, R.TECH)})
    score = _score(t, bare, is_enum, F.col("_verbs"), F.col("_tech"))
    df = staged(df, {"score": F.when(F.col("_scorable"), score)})
    df = df.select(*keep, "doc_id", "line_no", "raw_text", "_fence", "score")
    picked = df.filter(F.col("_fence") | (F.col("score") >= 2))
    picked = ordered.running_sum(
        picked, ["doc_id"], "line_no", {"_open": _flag(F.col("_fence"))}, inclusive=False, size=size
    )
    found = picked.filter(~F.col("_fence") & (F.col("_open") % 2 == 0))
    found = found.withColumn("_step", _hit(t, R.STEP) & ~contains_any(t, R.BUILD_VERBS))
    marks = lines.filter(_hit_any(strip("line"), R.FLOW_MARKERS))
    around = F.sequence(F.col("line_no") - R.FLOW_REACH, F.col("line_no") + R.FLOW_REACH)
    zone = marks.select("doc_id", F.explode(around).alias("line_no")).distinct().withColumn("_step", F.lit(True))
    found = found.join(zone, ["doc_id", "line_no", "_step"], "left_anti")
    return found.select(*keep, "doc_id", "line_no", "raw_text", "score")


# -- extraction -----------------------------------------------------------------


def clean_content(raw: Column) -> Column:
    """Task text of one part: prefixes off, first sentence, edges trimmed."""
    # optional groups in a row take their parts off in the same order, in one pass
    steps = "".join(f"(?:{p[1:]})?" for p in R.PREFIXES)
    text = strip(sub(raw, rf"{U}\A{steps}"))
    cuts = []
    for end in R.SENTENCE_ENDS:
        at = F.instr(text, F.lit(end))
        cuts.append(F.when((at > 1) & (at < F.length(text)), F.substring(text, F.lit(1), at)))
    text = strip(F.coalesce(*cuts, text))
    text = F.btrim(strip(sub(text, f"{SPACE}+", " ")), F.lit(R.EDGE_MARKS))
    text = F.when(text.contains("→"), strip(F.substring_index(text, "→", 1))).otherwise(text)
    return F.btrim(text, F.lit(R.EDGE_MARKS))


def first_type(content: Column, raw: Column, types=R.TYPE_WORDS) -> Column:
    """First type with a word in content or raw text. ``types``: name and words, or a table name, word, ord."""
    both, types = F.lower(F.concat_ws(" ", content, raw)), as_groups(types, "name", "word")
    return first_match([(contains_any(both, [w.lower() for w in words]), F.lit(n)) for n, words in types], F.lit(R.DEFAULT_TYPE))


def extract_tasks(candidates: DataFrame) -> DataFrame:
    """One row per task: compound lines split, text cleaned, endpoint, type and step flag added.

    ``candidates``: doc_id, line_no, raw_text (more columns are kept).
    """
    keep = [c for c in candidates.columns if c not in ("raw_text", "score")]
    raw = F.col("raw_text")
    by_step, by_enum = _hit(raw, R.SPLIT_STEP), _hit(raw, R.SPLIT_ENUM)
    pieces = F.when(by_step, F.split(raw, U + R.SPLIT_STEP)).when(by_enum, F.split(raw, U + R.SPLIT_ENUM)).otherwise(F.array(raw))
    parts = F.filter(F.transform(pieces, strip), lambda p: p != "")
    df = candidates.select(*keep, "raw_text", F.posexplode_outer(parts).alias("part_no", "_part"))
    df = df.filter(F.length("_part") >= 4)
    df = staged(df, {"_clean": sub("_part", r"[\x01-\x08\x0b\x0c\x0e-\x1f\x7f]")}).drop("_part")
    df = df.withColumnRenamed("_clean", "_part")
    df = staged(df, {"_content": clean_content(F.col("_part"))}).filter(F.length("_content") >= 3)
    df = df.withColumns({"_api": endpoint("_part"), "task_type": first_type(F.col("_content"), F.col("_part"))})
    path = F.col("_api.path")
    shown = F.when(F.col("_api.method") != "", F.concat_ws(" ", "_api.method", path)).otherwise(path)
    chained = _hit("raw_text", R.SPLIT_STEP) & (F.col("part_no") > 0)
    starts = _hit("raw_text", "^" + R.STEP + "[：:]") & (F.col("part_no") == 0)
    return df.select(
        *keep,
        "part_no",
        F.when(F.col("_api").isNotNull(), F.concat(F.col("_content"), F.lit(" ("), shown, F.lit(")")))
        .otherwise(F.col("_content"))
        .alias("content"),
        "task_type",
        F.coalesce("_api.method", F.lit("")).alias("api_method"),
        F.coalesce("_api.path", F.lit("")).alias("api_path"),
        F.when(chained, contains_any("_content", R.STEP_VERBS)).otherwise(starts).alias("step_derived"),
        _hit("_part", "^第[0-9一二三四五六七八九十百]+[步、]").alias("step_title"),
        F.col("_part").alias("raw_text"),
    )


# -- filters and types ----------------------------------------------------------


def drop_noise(tasks: DataFrame) -> DataFrame:
    """Drop status fragments, conditional descriptions and section titles; keep the first sentence.

    ``tasks``: content, raw_text, ...
    """
    text, raw = strip("content"), F.coalesce(F.col("raw_text"), F.lit(""))
    short = (F.length(text) <= 5) & ~contains_any(text, R.DEV_VERBS)
    conditional = _hit_any(raw, R.CONDITIONS)
    whole = (
        (F.length(text) >= 4)
        & (strip(raw) != "")
        & F.contains(raw, text)
        & (F.abs(F.length(text) - F.length(strip(raw))) <= 20)
    )
    title = (
        whole
        & ~_hit(raw, R.STEP)
        & ~_hit(raw, r"(?:POST|GET|PUT|DELETE|PATCH)\s+/")
        & ~_starts_any(text, R.TITLE_VERBS)
        & ~_hit(raw, r"^[a-zA-Z][\.\)、]\s*")
    )
    drop = any_of(
        [text == "", short, count_contained(text, R.NOISE) >= 2, text.startswith("开始 "), conditional, title]
    )
    sentence = F.nullif(strip(F.substring_index(text, "。", 1)), F.lit(""))
    return tasks.filter(~drop).withColumn("content", F.coalesce(sentence, text))


def scored_type(c: Column | str, types=R.SCORED_TYPES) -> Column:
    """Type with the most words in the text; a tie goes to the first of the list, no word to the default.

    ``types``: name and words, or a table name, word, ord.
    """
    low, types = F.lower(col(c)), as_groups(types, "name", "word")
    scores = F.array(
        *[
            F.struct(
                count_contained(low, [w.lower() for w in words]).alias("hits"), F.lit(-i).alias("o"), F.lit(n).alias("name")
            )
            for i, (n, words) in enumerate(types)
        ]
    )
    best = F.array_max(scores)
    return F.when(best["hits"] > 0, best["name"]).otherwise(F.lit(R.DEFAULT_TYPE))


def type_stats(tasks: DataFrame) -> DataFrame:
    """Tasks per type."""
    return tasks.groupBy(F.coalesce("task_type", F.lit(R.DEFAULT_TYPE)).alias("task_type")).agg(F.count(F.lit(1)).alias("tasks"))


def filter_tasks(
    tasks: DataFrame, exclude: Sequence[str] = (), focus: Sequence[str] = (), types: Sequence[str] = ()
) -> DataFrame:
    """Drop excluded words, keep focus words (content or module) and words of the wanted kinds."""
    df = tasks
    if exclude:
        df = df.filter(~contains_any("content", exclude))
    if focus:
        df = df.filter(contains_any("content", focus) | contains_any("module", focus))
    words = [w for t in types for w in R.INTENT_TYPES.get(t, [])]
    if words:
        df = df.filter(contains_any("content", words))
    return df


# -- duplicates -----------------------------------------------------------------


def dedup_exact(tasks: DataFrame, keys: Sequence[str] = ("project", "module")) -> DataFrame:
    """First task per group and text; tasks without text all stay."""
    content = strip("content")
    named = tasks.filter(content != "").withColumn("_key", content)
    first = named.groupBy(*keys, "_key").agg(F.min("seq").alias("seq"))
    kept = named.join(first, [*keys, "_key", "seq"], "left_semi").drop("_key")
    return kept.unionByName(tasks.filter(content == ""))


def _distinct_contents(tasks: DataFrame) -> DataFrame:
    """First position of every text of a project; the combine happens before the shuffle."""
    step = F.col("step_title") if "step_title" in tasks.columns else _hit("raw_text", "^第[0-9一二三四五六七八九十百]+[步、]")
    return tasks.groupBy("project", "content").agg(F.min("seq").alias("seq"), F.min_by(step, "seq").alias("step"))


def _without(texts: DataFrame, dropped: DataFrame) -> DataFrame:
    """``project`` and ``seq`` that stay. Both tables grow with the tasks, so neither is sent to all of them."""
    return texts.select("project", "seq").join(dropped.hint("merge"), ["project", "seq"], "left_anti")


def _only(tasks: DataFrame, kept: DataFrame) -> DataFrame:
    return tasks.join(kept.hint("merge"), ["project", "seq"], "left_semi")


def dedup_tasks(tasks: DataFrame) -> DataFrame:
    """Drop a task when an earlier one that is kept has the same text, contains it or lies in it (at least half
    as long; not for step titles), or is one edit away when both have at most ten characters; per project.
    """
    texts = materialise(_distinct_contents(tasks), "distinct_contents")
    pairs = contained_pairs(
        texts.select("project", F.col("seq").alias("s_id"), F.col("content").alias("s_text")),
        texts.select("project", F.col("seq").alias("l_id"), F.col("content").alias("l_text")),
        ["project"],
        longest=2.0,
        equal=False,
    ).filter("s_id <> l_id")
    plain = texts.filter(~F.col("step")).select("project", F.col("seq").alias("late"))
    contained = pairs.select("project", F.least("s_id", "l_id").alias("early"), F.greatest("s_id", "l_id").alias("late"))
    contained = contained.join(plain.hint("merge"), ["project", "late"])
    near = one_edit_pairs(texts.select("project", F.col("seq").alias("id"), F.col("content").alias("text")), ["project"], 10)
    near = near.select("project", F.col("a_id").alias("early"), F.col("b_id").alias("late"))
    dropped = ruled_out(contained.unionByName(near), ["project"])
    return _only(tasks, _without(texts, dropped))


def dedup_keep_longer(tasks: DataFrame) -> DataFrame:
    """Per project: first of equal texts, and of two texts where one contains the other the longer."""
    texts = tasks.withColumn("content", strip("content")).filter(F.col("content") != "")
    first = materialise(texts.groupBy("project", "content").agg(F.min("seq").alias("seq")), "distinct_contents")
    pairs = contained_pairs(
        first.select("project", F.col("seq").alias("s_id"), F.col("content").alias("s_text")),
        first.select("project", F.col("seq").alias("l_id"), F.col("content").alias("l_text")),
        ["project"],
        equal=False,
    ).filter("s_id <> l_id")
    inner = pairs.select("project", F.col("s_id").alias("seq")).distinct()
    return _only(tasks, _without(first, inner))


def match_whitelist(tasks: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Add the first whitelist entry whose key contains the task's key or lies in it.

    ``whitelist``: ord, module, content. Distinct task keys and distinct keys of the list meet,
    either one inside the other; the result returns by an equi-join.
    """
    df = tasks.withColumn("key", norm_key("content"))
    keys = df.select(F.col("key").alias("text")).filter(F.col("text") != "").distinct()
    keys = materialise(keys.withColumn("id", F.monotonically_increasing_id()), "task_keys")
    listed = whitelist.select(
        F.struct("ord", F.col("module").alias("std_module"), F.col("content").alias("std_content")).alias("_w"), norm_key("content").alias("wl_key")
    )
    listed = listed.filter(F.col("wl_key") != "")
    first = materialise(listed.groupBy("wl_key").agg(F.min("_w").alias("_w")), "whitelist_keys")
    best = list_matches(keys, first.withColumnRenamed("wl_key", "l_text"), "_w")
    best = keys.join(best.hint("merge"), "id").select(F.col("text").alias("key"), "_w")
    return df.join(best.hint("merge"), "key", "left").select(
        *tasks.columns, "key", F.col("_w.std_module").alias("std_module"), F.col("_w.std_content").alias("std_content")
    )


def merge_tasks(tasks: DataFrame, whitelist: DataFrame, head: int | None = None) -> DataFrame:
    """Standard names for listed tasks, then repeats off: same key, and for unlisted tasks also containment in
    either direction, or the same first ``head`` characters if asked for, of an earlier kept task of the project.
    """
    tasks = tasks.select("project", "seq", "module", "content", "task_type")  # source texts are long and not asked for
    df = materialise(match_whitelist(tasks, whitelist), "whitelisted")
    df = df.withColumn("key", F.coalesce(norm_key("std_content"), F.col("key"))).filter(F.col("key") != "")
    listed = F.col("std_content").isNotNull()
    first = materialise(
        df.groupBy("project", "key").agg(F.min("seq").alias("seq"), F.min_by(listed, "seq").alias("listed")), "merge_keys"
    )
    pairs = contained_pairs(
        first.select("project", F.col("seq").alias("s_id"), F.col("key").alias("s_text")),
        first.select("project", F.col("seq").alias("l_id"), F.col("key").alias("l_text")),
        ["project"],
        equal=False,
    ).filter("s_id <> l_id")
    pairs = pairs.select("project", F.least("s_id", "l_id").alias("early"), F.greatest("s_id", "l_id").alias("late"))
    if head:
        long = first.filter(F.length("key") > head).withColumn("_head", F.substring("key", 1, head))
        heads = long.groupBy("project", "_head").agg(F.min("seq").alias("early"))
        same_head = long.join(heads, ["project", "_head"]).filter("seq > early").select("project", "early", F.col("seq").alias("late"))
        pairs = pairs.unionByName(same_head)
    unlisted = first.filter(~F.col("listed")).select("project", F.col("seq").alias("late"))
    dropped = ruled_out(pairs.join(unlisted.hint("merge"), ["project", "late"]), ["project"])
    df = _only(df, _without(first, dropped))
    return df.select(
        "project",
        "seq",
        F.coalesce("std_module", "module").alias("module"),
        F.coalesce("std_content", strip("content")).alias("content"),
        "task_type",
        listed.alias("listed"),
    )


# -- line rules and keyword fallback ----------------------------------------------


def _filled(t: Column, pattern: str, template: str) -> Column:
    full = U + pattern
    pieces, rest = [], template
    for n in (1, 2):
        if f"{{{n}}}" in rest:
            head, rest = rest.split(f"{{{n}}}", 1)
            pieces += [F.lit(head), F.regexp_extract(t, full, n)]
    return F.concat(*pieces, F.lit(rest))


def _rule_hit(t: Column, pattern: str) -> Column:
    """A rule test; rules of the form "anything, then a word" look for the word first."""
    if pattern.startswith("(.+"):
        return t.contains(pattern[3:-1]) & _hit(t, pattern)
    return _hit(t, pattern)


def clean_rule_text(c: Column, longest: int | None = None) -> Column:
    """Doubled words and prefixes off; over-long detail only if ``longest`` is given."""
    out = c
    for pattern, value in R.RULE_CLEANUP:
        out = sub(out, U + pattern, value)
        if pattern == r"\s+":
            out = strip(out)
    if longest is None:
        return out
    shortened = F.when(out.contains("。"), F.substring_index(out, ".", 1)).otherwise(F.substring(out, 1, longest))
    return F.when(F.length(out) > longest, shortened).otherwise(out)


def legacy_tasks(lines: DataFrame, size: int = ordered.CHUNK, rules=R.LINE_RULES, modules=R.LINE_MODULES) -> DataFrame:
    """First matching line rule per line, with the module of the latest module line.

    ``rules``: pattern, type, text, or a table pattern, task_type, text, ord; ``modules``: pattern, module, or a
    table pattern, module, ord.

    Lines that neither name a module nor match a rule are left out before the
    carry-forward.
    """
    t = F.col("raw_text")
    # all packaged rules name a CJK word or radical, an API path or a language model
    packaged = rules is R.LINE_RULES and modules is R.LINE_MODULES
    df = lines.filter(matches("line", r"[\x{2e80}-\x{9fff}]|/api/|LLM")) if packaged else lines
    rules, modules = as_rules(rules, ["pattern", "task_type", "text"]), as_rules(modules, ["pattern", "module"])
    df = df.select("doc_id", "line_no", strip("line").alias("raw_text"))
    module = first_match([(_hit(t, p), F.lit(m)) for p, m in modules])
    rule = first_match(
        [
            (_rule_hit(t, p), F.struct(F.lit(kind).alias("task_type"), _filled(t, p, text).alias("content")))
            for p, kind, text in rules
        ]
    )
    df = staged(df, {"_module": module, "_rule": rule})
    df = df.filter(F.col("_module").isNotNull() | F.col("_rule").isNotNull())
    df = ordered.carry_forward(df, ["doc_id"], "line_no", {"module": F.col("_module")}, size=size)
    df = df.filter(F.col("_rule").isNotNull())
    return df.select(
        "doc_id",
        "line_no",
        F.coalesce("module", F.lit(R.UNSORTED)).alias("module"),
        "_rule.task_type",
        F.col("_rule.content").alias("content"),
        "raw_text",
    ).withColumn("short_content", clean_rule_text(F.col("content")))


def key_lines(lines: DataFrame, with_sections: DataFrame | None = None) -> DataFrame:
    """Keyword fallback: task lines by six patterns, typed as new or updated interface or plain task.

    Lines that carry ``section_title`` (see ``with_section``) get it as module.
    """
    t = strip("line")
    found = (
        (F.length(t) >= 8) & ~contains_any(t, R.KEY_EXCLUDED) & any_of([_hit(t, p) for p in R.KEY_PATTERNS])
    )
    kind = first_match(
        [
            (any_of([_hit(t, p) for p in R.KEY_NEW]), F.lit("新增接口")),
            (any_of([_hit(t, p) for p in R.KEY_UPDATE]), F.lit("更新接口")),
        ],
        F.lit("普通任务"),
    )
    df = lines.filter(found)
    title = F.col("section_title") if "section_title" in lines.columns else F.lit(None).cast("string")
    tidy = strip(sub(sub(F.replace(F.replace(title, F.lit("TODO"), F.lit("")), F.lit("todo"), F.lit("")), ",+", ","), r",\s*\z"))
    return df.select(
        "doc_id", "line_no", F.coalesce(tidy, F.lit(R.UNSORTED)).alias("module"), t.alias("content"), kind.alias("task_type")
    )
