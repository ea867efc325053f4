"""Registered task-mining queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..operators import checks as C
from ..operators import docs as O
from ..operators import lookup as L
from ..operators import modules as M
from ..operators import tasks as T
from ..rules import tasks as R
from ..sources import files as X
from .base import SPACE, any_contains, cte, half_up, lit, re2, sql, strip

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def lines(spark, sf):
    return X.document_lines(A.technical_docs(spark, sf)).drop("n")


def rx(x: str, pattern: str, flag: str = "c") -> str:
    return f"regexp_matches({x}, {lit(re2(pattern))}, '{flag}')"


def any_rx(x: str, patterns) -> str:
    return "(" + " OR ".join(rx(x, p) for p in patterns) + ")"


def starts_any(x: str, words) -> str:
    return "(" + " OR ".join(f"starts_with({x}, {lit(w)})" for w in words) + ")"


def ends_any(x: str, words) -> str:
    return "(" + " OR ".join(f"ends_with({x}, {lit(w)})" for w in words) + ")"


def count_of(x: str, words) -> str:
    return "(" + " + ".join(f"CAST(contains({x}, {lit(w)}) AS INTEGER)" for w in words) + ")"


def norm(x: str) -> str:
    return strip(rf"regexp_replace(regexp_replace({x}, '[\x00-\x1f\x7f]', '', 'g'), '{SPACE}+', ' ', 'g')")


cte("bare_lines", ("tech_lines",), f"SELECT doc_id, project, line_no, line, {strip('line')} AS t FROM tech_lines")


# -- sections -------------------------------------------------------------------


def _sections(template: str) -> str:
    arms = []
    for p, n in R.HEADINGS[template]:
        level = {0: "length(t) - length(replace(t, '.', '')) + 1", -1: r"length(regexp_extract(t, '\A(#+)', 1))"}.get(n, str(n))
        arms.append(f"WHEN {rx('t', p)} THEN {level}")
    return f"SELECT doc_id, line_no, title, CAST(level AS INTEGER) AS level FROM (SELECT doc_id, line_no, t AS title, CASE {' '.join(arms)} END AS level FROM bare_lines) WHERE level IS NOT NULL"


for _t in R.HEADINGS:
    cte(f"sections_{_t}", ("bare_lines",), _sections(_t))


@query("tsk_sections", sql([f"sections_{t}" for t in R.HEADINGS], " UNION ALL ".join(
    f"SELECT '{t}' AS template, * FROM sections_{t}" for t in R.HEADINGS)))
def tsk_sections(spark, sf):
    out = None
    for t in R.HEADINGS:
        part = T.sections(lines(spark, sf), t).select(F.lit(t).alias("template"), "doc_id", "line_no", "title", "level")
        out = part if out is None else out.unionByName(part)
    return out


@query("jn_section", sql("sections_numeric", """SELECT l.doc_id, l.line_no, s.title AS section_title, s.level AS section_level, s.line_no AS section_line
  FROM bare_lines l ASOF LEFT JOIN sections_numeric s ON l.doc_id = s.doc_id AND l.line_no >= s.line_no"""))
def jn_section(spark, sf):
    df = L.with_section(lines(spark, sf), T.sections(lines(spark, sf)))
    return df.select("doc_id", "line_no", "section_title", "section_level", "section_line")


@query("jn_sectionpath", sql("sections_markdown", """SELECT doc_id, line_no, title, level, coalesce((SELECT arg_max(p.title, p.line_no) || ' > '
    FROM sections_markdown p WHERE p.doc_id = s.doc_id AND p.line_no < s.line_no AND p.level < s.level), '') || title AS section_path
  FROM sections_markdown s"""))
def jn_sectionpath(spark, sf):
    return L.section_paths(T.sections(lines(spark, sf), "markdown"))


_SHOWN = "CASE WHEN {0} IS NULL OR " + rx("{0}", R.CONTEXT_HEADING).replace("{", "{{").replace("}", "}}").replace("{{0}}", "{0}") + " THEN '' ELSE {0} END"


@query("tsk_context", sql("bare_lines", f"""SELECT doc_id, line_no, t AS text, {_SHOWN.format('p')} AS before, {_SHOWN.format('n')} AS after FROM (
  SELECT *, lag(t) OVER (PARTITION BY doc_id ORDER BY line_no) AS p, lead(t) OVER (PARTITION BY doc_id ORDER BY line_no) AS n
  FROM bare_lines WHERE t <> '')"""))
def tsk_context(spark, sf):
    return T.line_context(lines(spark, sf))


# -- candidates -----------------------------------------------------------------

_V, _TECH = any_contains("{0}", R.VERBS), any_contains("lower({0})", sorted({t.lower() for t in R.TECH}))
_EQ, _QU = "instr(t, '=')", "instr(t, '?')"
_MARK3 = any_contains("t", ["【新增】", "【更新】", "【删除】"])
_NEG = "|".join(R.NEGATIONS)
_VL, _TL = "|".join(R.VERBS), "|".join(R.TECH)
_NOUN_WORDS = f"len(list_filter(words, lambda w: {any_contains('w', R.NOUNS)}))"
_METHOD = r"(?:\A|[^\p{L}\p{N}_])(?:POST|GET|PUT|DELETE|PATCH|HEAD|OPTIONS)(?:[^\p{L}\p{N}_]|\z)"


def _pts(c: str, n: int = 1) -> str:
    return f"CASE WHEN {c} THEN {n} ELSE 0 END"


cte(
    "line_flags",
    ("bare_lines",),
    f"""SELECT *, {any_contains('t', R.BUILD_VERBS)} AS build, {starts_any('t', R.DESCRIPTIVE)} AS descriptive,
  {_V.format('bare')} AS bare_verb, {_TECH.format('bare')} AS bare_tech, {_V.format('t')} AS verb_any, {_TECH.format('t')} AS tech_any,
  {any_rx('t', R.FLOW)} OR (is_enum AND {any_rx('bare', R.FLOW)}) AS flow
FROM (SELECT *, {strip(f"regexp_replace(t, {lit(re2(R.ENUM_PREFIX))}, '')")} AS bare, {rx('t', R.ENUM_PREFIX)} AS is_enum,
  string_split_regex(t, '{SPACE}+') AS words, starts_with(t, '```') OR starts_with(t, '~~~') AS fence FROM bare_lines)""",
)
cte(
    "scored",
    ("line_flags",),
    f"""SELECT *, CASE WHEN fence OR length(t) < 6 OR {any_rx('t', R.RESIDUE)}
    OR (is_enum AND (length(bare) < 6 OR NOT (bare_verb OR bare_tech)))
    OR {starts_any('t', R.NEGATIONS)} OR {ends_any('t', R.NEGATIONS)}
    OR {rx('t', rf'[，,。、；;：:' + chr(92) + f's](?:{_NEG})(?:[，,。、；;：:' + chr(92) + 's]|$)')}
    OR {any_contains('t', R.MARKERS)} OR {any_rx('t', R.DIAGRAMS)} OR {rx('t', r'^[' + chr(92) + 'd' + chr(92) + r's\.\-\|]+$')}
    OR ({count_of('t', R.NOUNS)} >= 3 AND length(t) >= 15)
    OR (len(words) >= 4 AND {_NOUN_WORDS} >= 3 AND CAST({_NOUN_WORDS} AS DOUBLE) / len(words) >= 0.4)
    OR ({rx('t', R.NUMBERED)} AND NOT {_MARK3}) OR {ends_any('t', R.SUFFIXES)} THEN NULL ELSE
  {_pts(f"{count_of('t', R.VERBS)} > 0")} + {_pts(f"{count_of('t', R.VERBS)} >= 3")}
  + {_pts(f"{count_of('t', R.TECH)} > 0")} + {_pts(f"{count_of('t', R.TECH)} >= 3")}
  + {_pts(f"regexp_matches(t, '{_METHOD}')", 2)} + {_pts(any_contains('t', ['【新增】', '【更新】', '【删除】', '【修改】']), 2)}
  + {_pts(rx('t', R.STEP))} + {_pts(rx('t', 'Step' + chr(92) + 's*' + chr(92) + 'd+', 'i'))}
  - {_pts(f"NOT build AND {rx('t', R.RAW_VARIABLE)}", 2)}
  + {_pts(f'''NOT descriptive AND NOT (NOT build AND {rx('t', R.RAW_VARIABLE)}) AND ({rx('t', f'^(?:{_VL}).*(?:{_TL})')}
      OR {rx('t', R.STEP + '[：:]')} OR {rx('t', r'^[\[\(]?(?:POST|GET|PUT|DELETE|PATCH)' + chr(92) + 's+')} OR {_MARK3}
      OR {rx('t', f"(?:{'|'.join(R.MODULE_WORDS)}).*(?:{_VL})")})''', 2)}
  - {_pts('descriptive', 2)}
  + CASE WHEN {starts_any('t', R.MIXED)} THEN CASE WHEN verb_any AND tech_any THEN 1 ELSE -2 END ELSE 0 END
  - {_pts('is_enum AND NOT (bare_verb AND bare_tech)')}
  - {_pts(f"{_EQ} > 0 AND NOT starts_with(t, 'POST') AND NOT starts_with(t, 'GET') AND NOT ({_QU} > 0 AND {_QU} < {_EQ})", 2)}
  - {_pts('NOT build AND flow', 3)} END AS score FROM line_flags""",
)
cte(
    "candidates",
    ("scored",),
    f"""SELECT project, doc_id, line_no, t AS raw_text, score FROM (
  SELECT *, sum(CAST(fence AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY line_no) AS fences,
    max(CAST({any_rx('t', R.FLOW_MARKERS)} AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS zone
  FROM scored) WHERE score >= 2 AND NOT fence AND fences % 2 = 0 AND NOT (zone = 1 AND {rx('t', R.STEP)} AND NOT build)""",
)


def candidates(spark, sf):
    return T.task_candidates(lines(spark, sf))


@query("tsk_candidates", sql("candidates", "SELECT * FROM candidates"))
def tsk_candidates(spark, sf):
    return candidates(spark, sf)


def _cleaned(x: str) -> str:
    """Prefix steps as nested replacements."""
    for p in R.PREFIXES:
        if "(?!" in p:
            word = p[1]
            no = {"应": ["应用", "应该"], "需": ["需求"]}[word]
            x = f"(SELECT CASE WHEN starts_with(v, '{word}') AND NOT {starts_any('v', no)} THEN regexp_replace(v, '^{word}{SPACE}*', '') ELSE v END FROM (SELECT {x} AS v))"
        else:
            x = f"regexp_replace({x}, {lit(re2(p))}, '')"
    return strip(x)


_EDGE = lit(R.EDGE_MARKS)
_CUT = "CASE " + " ".join(
    f"WHEN instr(p1, {lit(e)}) > 1 AND instr(p1, {lit(e)}) < length(p1) THEN substr(p1, 1, instr(p1, {lit(e)}))" for e in R.SENTENCE_ENDS
) + " ELSE p1 END"
_TYPE1 = "CASE " + " ".join(
    f"WHEN {any_contains('lower(content0 || chr(32) || part)', [w.lower() for w in ws])} THEN {lit(n)}" for n, ws in R.TYPE_WORDS
) + f" ELSE {lit(R.DEFAULT_TYPE)} END"
_E = [re2(p) for p in O.ENDPOINTS]
cte(
    "parts",
    ("candidates",),
    f"""SELECT project, doc_id, line_no, raw_text, CAST(pos - 1 AS INTEGER) AS part_no,
    regexp_replace(part, '[\\x01-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g') AS part FROM (
  SELECT *, unnest(ps) AS part, generate_subscripts(ps, 1) AS pos FROM (SELECT *, list_filter(list_transform(
    CASE WHEN {rx('raw_text', R.SPLIT_STEP)} THEN string_split_regex(raw_text, {lit(re2(R.SPLIT_STEP))})
      WHEN {rx('raw_text', R.SPLIT_ENUM)} THEN string_split_regex(raw_text, {lit(re2(R.SPLIT_ENUM))}) ELSE [raw_text] END,
    lambda p: {strip('p')}), lambda p: p <> '') AS ps FROM candidates)) WHERE length(part) >= 4""",
)
cte(
    "extracted",
    ("parts",),
    f"""SELECT project, doc_id, line_no, part_no, CASE WHEN path IS NULL THEN content0 WHEN method <> '' THEN content0 || ' (' || method || ' ' || path || ')'
    ELSE content0 || ' (' || path || ')' END AS content, {_TYPE1} AS task_type, coalesce(method, '') AS api_method, coalesce(path, '') AS api_path,
  CASE WHEN {rx('raw_text', R.SPLIT_STEP)} AND part_no > 0 THEN {any_contains('content0', R.STEP_VERBS)}
    ELSE {rx('raw_text', '^' + R.STEP + '[：:]')} AND part_no = 0 END AS step_derived,
  {rx('part', '^第[0-9一二三四五六七八九十百]+[步、]')} AS step_title, part AS raw_text
FROM (SELECT *, trim(CASE WHEN contains(p3, '→') THEN {strip("split_part(p3, '→', 1)")} ELSE p3 END, {_EDGE}) AS content0,
  CASE WHEN regexp_matches(part, {lit(_E[0])}) THEN regexp_extract(part, {lit(_E[0])}, 1) WHEN regexp_matches(part, {lit(_E[1])}) THEN regexp_extract(part, {lit(_E[1])}, 1)
    WHEN regexp_matches(part, {lit(_E[2])}) THEN '' END AS method,
  CASE WHEN regexp_matches(part, {lit(_E[0])}) THEN regexp_extract(part, {lit(_E[0])}, 2) WHEN regexp_matches(part, {lit(_E[1])}) THEN regexp_extract(part, {lit(_E[1])}, 2)
    WHEN regexp_matches(part, {lit(_E[2])}) THEN regexp_extract(part, {lit(_E[2])}, 1) END AS path
FROM (SELECT *, trim({strip(f"regexp_replace(p2, '{SPACE}+', ' ', 'g')")}, {_EDGE}) AS p3
FROM (SELECT *, {strip(_CUT)} AS p2 FROM (SELECT *, {_cleaned('part')} AS p1 FROM parts)))) WHERE length(content0) >= 3""",
)


@query("tsk_extract", sql("extracted", "SELECT * FROM extracted"))
def tsk_extract(spark, sf):
    return T.extract_tasks(candidates(spark, sf))


# -- filters --------------------------------------------------------------------

_C, _RAW = strip("content"), "raw_text"
cte(
    "noise_flags",
    ("tasks",),
    f"""SELECT *, {_C} AS c, (length({_C}) >= 4 AND {strip(_RAW)} <> '' AND contains({_RAW}, {_C}) AND abs(length({_C}) - length({strip(_RAW)})) <= 20
  AND NOT {rx(_RAW, R.STEP)} AND NOT {rx(_RAW, '(?:POST|GET|PUT|DELETE|PATCH)' + chr(92) + 's+/')} AND NOT {starts_any(_C, R.TITLE_VERBS)}
  AND NOT {rx(_RAW, r'^[a-zA-Z][\.\)、]' + chr(92) + 's*')}) AS is_title FROM tasks""",
)


@query("tsk_filter", sql("noise_flags", f"""SELECT project, seq, module, coalesce(nullif({strip("split_part(c, '。', 1)")}, ''), c) AS content, task_type
  FROM noise_flags WHERE c <> '' AND NOT (length(c) <= 5 AND NOT {any_contains('c', R.DEV_VERBS)}) AND {count_of('c', R.NOISE)} < 2
  AND NOT starts_with(c, '开始 ') AND NOT {any_rx(_RAW, R.CONDITIONS)} AND NOT is_title"""))
def tsk_filter(spark, sf):
    return T.drop_noise(A.tasks(spark, sf)).select("project", "seq", "module", "content", "task_type")


_T2 = ", ".join(f"{{'h': {count_of('lower(content)', [w.lower() for w in ws])}, 'o': {-i}, 'n': {lit(n)}}}" for i, (n, ws) in enumerate(R.SCORED_TYPES))
cte("typed", ("tasks",), f"SELECT *, CASE WHEN b.h > 0 THEN b.n ELSE {lit(R.DEFAULT_TYPE)} END AS type2 FROM (SELECT *, list_max([{_T2}]) AS b FROM tasks)")


@query("tsk_type2", sql("typed", "SELECT project, seq, content, type2 FROM typed"))
def tsk_type2(spark, sf):
    return A.tasks(spark, sf).select("project", "seq", "content", T.scored_type("content").alias("type2"))


@query("tsk_typestats", sql("typed", "SELECT type2 AS task_type, count(*) AS tasks FROM typed GROUP BY 1"))
def tsk_typestats(spark, sf):
    return T.type_stats(A.tasks(spark, sf).withColumn("task_type", T.scored_type("content")))


@query("flt_intent", sql("tasks", f"""SELECT project, seq, module, content FROM tasks WHERE NOT contains(content, '测试')
  AND (contains(content, '列表') OR contains(module, '列表') OR contains(content, '支付') OR contains(module, '支付'))
  AND {any_contains('content', R.INTENT_TYPES['api'] + R.INTENT_TYPES['database'])}"""))
def flt_intent(spark, sf):
    df = T.filter_tasks(A.tasks(spark, sf), exclude=["测试"], focus=["列表", "支付"], types=["api", "database"])
    return df.select("project", "seq", "module", "content")


# -- duplicates -----------------------------------------------------------------

_STEP_TITLE = "^第[0-9一二三四五六七八九十百]+[步、]"
cte("firsts", ("tasks",), f"SELECT project, content, min(seq) AS seq, arg_min({rx('raw_text', _STEP_TITLE)}, seq) AS step FROM tasks GROUP BY 1, 2")


def _survivors(rows: str, hit: str) -> str:
    """``project`` and ``seq`` of the rows (project, seq, x) that no earlier survivor ``y`` of the project rules out."""
    return f"""(WITH RECURSIVE numbered AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY seq) AS i FROM ({rows})),
  walk AS (SELECT project, CAST(0 AS BIGINT) AS i, list_filter([x], lambda e: FALSE) AS kept, list_filter([seq], lambda e: FALSE) AS seqs
      FROM numbered WHERE i = 1
    UNION ALL SELECT n.project, n.i, CASE WHEN out THEN kept ELSE list_append(kept, n.x) END, CASE WHEN out THEN seqs ELSE list_append(seqs, n.seq) END
      FROM (SELECT n.*, w.kept, w.seqs, len(list_filter(w.kept, lambda y: {hit})) > 0 AS out
        FROM walk w JOIN numbered n ON n.project = w.project AND n.i = w.i + 1) n)
  SELECT project, unnest(seqs) AS seq FROM (SELECT project, arg_max(seqs, i) AS seqs FROM walk GROUP BY project))"""


_NEAR = """(NOT n.x.step AND (contains(n.x.content, y.content) OR contains(y.content, n.x.content))
      AND CAST(least(length(n.x.content), length(y.content)) AS DOUBLE) / greatest(length(n.x.content), length(y.content)) >= 0.5)
    OR (length(n.x.content) <= 10 AND length(y.content) <= 10 AND levenshtein(n.x.content, y.content) <= 1)"""


@query("tsk_dedup", sql("firsts", f"""SELECT t.project, t.seq, t.content FROM tasks t
  JOIN {_survivors("SELECT project, seq, {'content': content, 'step': step} AS x FROM firsts", _NEAR)} s USING (project, seq)"""))
def tsk_dedup(spark, sf):
    return T.dedup_tasks(A.tasks(spark, sf)).select("project", "seq", "content")


@query("tsk_dedupmod", sql("tasks", f"""SELECT project, seq, module, content FROM (SELECT *, row_number() OVER (PARTITION BY project, module, {_C} ORDER BY seq) AS rn
  FROM tasks) WHERE rn = 1 OR {_C} = ''"""))
def tsk_dedupmod(spark, sf):
    return T.dedup_exact(A.tasks(spark, sf)).select("project", "seq", "module", "content")


@query("tsk_deduplong", sql("firsts", """SELECT x.project, x.seq, x.content FROM firsts x WHERE NOT EXISTS (SELECT 1 FROM firsts y
  WHERE y.project = x.project AND y.content <> x.content AND contains(y.content, x.content))"""))
def tsk_deduplong(spark, sf):
    return T.dedup_keep_longer(A.tasks(spark, sf)).select("project", "seq", "content")


cte("whitelist", ("tasks",), "SELECT module, content, min(seq) AS ord FROM tasks WHERE module = '数据库模块' GROUP BY 1, 2")
cte(
    "wl_hits",
    ("whitelist",),
    f"""SELECT key, arg_min(w.module, w.ord) AS std_module, arg_min(w.content, w.ord) AS std_content
FROM (SELECT DISTINCT {norm('content')} AS key FROM tasks) k JOIN (SELECT *, {norm('content')} AS wl FROM whitelist) w
  ON contains(wl, key) OR contains(key, wl) WHERE key <> '' AND wl <> '' GROUP BY key""",
)
cte("wl_tasks", ("wl_hits",), f"SELECT t.*, h.std_module, h.std_content FROM (SELECT *, {norm('content')} AS key FROM tasks) t LEFT JOIN wl_hits h USING (key)")


@query("jn_whitelist", sql("wl_tasks", "SELECT project, seq, content, std_module, std_content FROM wl_tasks"))
def jn_whitelist(spark, sf):
    df = T.match_whitelist(A.tasks(spark, sf), A.whitelist(spark, sf))
    return df.select("project", "seq", "content", "std_module", "std_content")


cte(
    "merge_keys",
    ("wl_tasks",),
    f"""SELECT project, coalesce({norm('std_content')}, key) AS mk, min(seq) AS seq, arg_min(std_content IS NOT NULL, seq) AS listed
FROM wl_tasks GROUP BY 1, 2""",
)


@query("tsk_merge", sql(("merge_keys", "wl_tasks"), f"""SELECT t.project, t.seq, coalesce(std_module, module) AS module, coalesce(std_content, {_C}) AS content,
  task_type, std_content IS NOT NULL AS listed FROM wl_tasks t
  JOIN {_survivors("SELECT project, seq, {'mk': mk, 'listed': listed} AS x FROM merge_keys WHERE mk <> ''",
                   "NOT n.x.listed AND (contains(y.mk, n.x.mk) OR contains(n.x.mk, y.mk))")} s USING (project, seq)"""))
def tsk_merge(spark, sf):
    return T.merge_tasks(A.tasks(spark, sf), A.whitelist(spark, sf))


_OFFICIAL = ("用户中心", "数据库模块", "渠道模块")
_USER = ("渠道模块", "支付模块")


def _merged(spark, sf):
    official, user = (A.whitelist(spark, sf, m).select("module", "content") for m in (_OFFICIAL, _USER))
    return L.merge_whitelists(official, user)


cte("wl_merged", ("tasks",), f"""SELECT module, content, min(origin) AS origin FROM (
  SELECT module, content, 'official' AS origin FROM tasks WHERE module IN {_OFFICIAL}
  UNION ALL SELECT module, content, 'user' FROM tasks WHERE module IN {_USER}) GROUP BY 1, 2""")


@query("jn_wlmerge", sql("wl_merged", "SELECT * FROM wl_merged"))
def jn_wlmerge(spark, sf):
    return _merged(spark, sf)


@query("jn_learn", sql("wl_merged", f"""SELECT DISTINCT module, content FROM tasks t WHERE {_C} <> '' AND NOT EXISTS (
  SELECT 1 FROM wl_merged w WHERE w.module = t.module AND w.content = t.content)"""))
def jn_learn(spark, sf):
    return L.learn_tasks(_merged(spark, sf), A.tasks(spark, sf))


@query("jn_wlstats", sql("wl_merged", "SELECT origin, count(DISTINCT module) AS modules, count(*) AS tasks FROM wl_merged GROUP BY 1"))
def jn_wlstats(spark, sf):
    return L.whitelist_stats(_merged(spark, sf))


# -- line rules -----------------------------------------------------------------


def _fill(p: str, text: str) -> str:
    out = lit(text)
    for n in (1, 2):
        if f"{{{n}}}" in text:
            out = f"replace({out}, '{{{n}}}', regexp_extract(t, {lit(re2(p))}, {n}))"
    return out


def _tidied(x: str) -> str:
    for p, v in R.RULE_CLEANUP:
        if p.endswith(r"\1"):
            for w in p[1:-3].split("|"):
                x = f"replace({x}, {lit(w + w)}, {lit(w)})"
            continue
        x = f"regexp_replace({x}, {lit(re2(p))}, {lit(v.replace('$', chr(92)))}, 'g')"
        if p == r"\s+":
            x = strip(x)
    return x


@query("tsk_legacy", sql("bare_lines", f"""SELECT doc_id, line_no, module, task_type, content, t AS raw_text,
  tidy AS short_content FROM (
  SELECT *, coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '未分类') AS module,
    {_tidied('content')} AS tidy FROM (SELECT *,
    CASE {' '.join(f"WHEN {rx('t', p)} THEN {lit(m)}" for p, m in R.LINE_MODULES)} END AS m,
    CASE {' '.join(f"WHEN {rx('t', p)} THEN {lit(k)}" for p, k, _ in R.LINE_RULES)} END AS task_type,
    CASE {' '.join(f"WHEN {rx('t', p)} THEN {_fill(p, x)}" for p, _, x in R.LINE_RULES)} END AS content FROM bare_lines WHERE t <> '')) WHERE task_type IS NOT NULL"""))
def tsk_legacy(spark, sf):
    return T.legacy_tasks(lines(spark, sf))


_TIDY = strip(rf"regexp_replace(regexp_replace(replace(replace(s.title, 'TODO', ''), 'todo', ''), ',+', ',', 'g'), ',{SPACE}*\z', '')")


@query("tsk_keylines", sql("sections_numeric", f"""SELECT doc_id, line_no, coalesce(module, '未分类') AS module, t AS content,
  CASE WHEN {any_rx('t', R.KEY_NEW)} THEN '新增接口' WHEN {any_rx('t', R.KEY_UPDATE)} THEN '更新接口' ELSE '普通任务' END AS task_type FROM (
  SELECT l.doc_id, l.line_no, l.t, {_TIDY} AS module FROM bare_lines l ASOF LEFT JOIN sections_numeric s ON l.doc_id = s.doc_id AND l.line_no >= s.line_no)
  WHERE length(t) >= 8 AND NOT {any_contains('t', R.KEY_EXCLUDED)} AND {any_rx('t', R.KEY_PATTERNS)}"""))
def tsk_keylines(spark, sf):
    return T.key_lines(L.with_section(lines(spark, sf), T.sections(lines(spark, sf))))


# -- modules --------------------------------------------------------------------


def _suffix(x: str, suffixes) -> str:
    return "CASE " + " ".join(f"WHEN ends_with({x}, {lit(s)}) THEN {strip(f'left({x}, length({x}) - {len(s)})')}" for s in suffixes) + f" ELSE {x} END"


def _core(x: str) -> str:
    verbs = "|".join(R.CORE_VERBS)
    body = rf"regexp_replace({x}, '\A(?:{verbs})', '')"
    return f"list_distinct(list_filter(list_transform(string_split_regex({body}, '{R.CORE_SPLIT}'), lambda w: {strip('w')}), lambda w: length(w) >= 2))"


_LAST = strip("list_extract(string_split(section_path, ' > '), -1)")
_KW = "[" + ", ".join(f"{{'k': {lit(k)}, 'm': {lit(m)}}}" for k, m in R.MODULE_KEYWORDS) + "]"
_MARKS = lit("，,。；;：:")
_STD = "(" + ", ".join(lit(m) for m in R.STANDARD_MODULES) + ")"
cte("wl_words", ("whitelist",), f"SELECT DISTINCT module, unnest({_core('content')}) AS word FROM whitelist")
cte(
    "wl_best",
    ("wl_words",),
    f"""SELECT content, arg_min(module, (-score, ord)) AS wl_module, least(max(score), 0.9) AS wl_score FROM (
  SELECT content, module, max(score) AS score FROM (
    SELECT content, module, CAST(count(*) AS DOUBLE) / any_value(n) AS score
    FROM (SELECT content, len(w) AS n, unnest(w) AS word FROM (SELECT content, {_core('content')} AS w FROM (SELECT DISTINCT content FROM tasks))) JOIN wl_words USING (word)
    GROUP BY content, module
    UNION ALL SELECT content, module, CAST(0.5 AS DOUBLE) FROM (SELECT DISTINCT content FROM tasks WHERE len({_core('content')}) > 0) c JOIN wl_words w ON length(word) >= 4
      AND (contains(content, word) OR contains(word, content)) AND greatest(length(content), length(word)) <= least(length(content), length(word)) * 1.5)
  GROUP BY content, module) JOIN (SELECT module, min(ord) AS ord FROM whitelist GROUP BY 1) USING (module)
GROUP BY content HAVING max(score) > 0.3""",
)
cte(
    "three",
    ("wl_best",),
    f"""SELECT * EXCLUDE (wl_module, wl_score), coalesce(wl_module, '') AS wm, CASE WHEN wl_module IS NULL THEN CAST(0 AS DOUBLE) ELSE wl_score END AS wc,
  coalesce(ch.m, '') AS cm, CASE WHEN ch IS NULL THEN CAST(0 AS DOUBLE) ELSE least(CAST(0.5 AS DOUBLE) + length(ch.k) * CAST(0.05 AS DOUBLE), CAST(0.95 AS DOUBLE)) END AS cc,
  coalesce(sm0, '') AS sm, CASE WHEN sm0 IS NULL THEN CAST(0 AS DOUBLE) WHEN name = '' THEN 0.3 WHEN sh IS NOT NULL THEN 0.7 ELSE 0.5 END AS sc
FROM (SELECT *, CASE WHEN name = '' THEN CASE WHEN length(bare) > 2 THEN bare END ELSE coalesce(sh.m, nullif(trim(name, {_MARKS}), '')) END AS sm0
FROM (SELECT *, trim({strip('plain')}, {_MARKS}) AS bare, list_filter({_KW}, lambda e: contains(lower(content), lower(e.k)))[1] AS ch,
  list_filter({_KW}, lambda e: contains(name, e.k) OR contains(e.k, name))[1] AS sh
FROM (SELECT *, {_suffix('plain', R.SECTION_SUFFIXES)} AS name FROM (SELECT t.*, b.wl_module, b.wl_score,
  regexp_replace({_LAST}, {lit(re2(R.SECTION_NUMBER))}, '') AS plain FROM tasks t LEFT JOIN wl_best b USING (content)))))""",
)
cte(
    "decided",
    ("three",),
    f"""SELECT *, CASE WHEN general AND sc >= 0.4 AND sm NOT IN {_STD} AND length(sm) >= 4 THEN sm ELSE bm END AS m1,
  CASE WHEN general AND sc >= 0.4 AND sm NOT IN {_STD} AND length(sm) >= 4 THEN sc ELSE bc END AS c1,
  CASE WHEN general AND sc >= 0.4 AND sm NOT IN {_STD} AND length(sm) >= 4 THEN 'section' ELSE bs END AS s1
FROM (SELECT *, bm IN {_STD} OR (length(bm) <= 3 AND bs = 'section') AS general
FROM (SELECT *, CASE WHEN cc >= sc AND cc >= wc THEN cm WHEN sc >= wc THEN sm ELSE wm END AS bm, greatest(cc, sc, wc) AS bc,
  CASE WHEN cc >= sc AND cc >= wc THEN 'content' WHEN sc >= wc THEN 'section' ELSE 'whitelist' END AS bs,
  len(list_distinct(list_filter([CASE WHEN cc > 0.3 AND cm <> '' THEN cm END, CASE WHEN sc > 0.3 AND sm <> '' THEN sm END, CASE WHEN wc > 0.3 AND wm <> '' THEN wm END], lambda x: x IS NOT NULL))) > 1 AS conflict,
  regexp_extract(content, {lit(re2(R.ENTITY_PHRASE))}) AS phrase FROM three))""",
)
_PHRASED = "(general AND phrase <> '' AND phrase <> content AND NOT contains(m1, phrase) AND length(phrase) > length(m1) + 2)"
_OTHER = "greatest(CASE WHEN cm <> '' AND cm <> wm THEN cc ELSE CAST(0 AS DOUBLE) END, CASE WHEN sm <> '' AND sm <> wm THEN sc ELSE CAST(0 AS DOUBLE) END)"
_LISTED = f"(wc >= 0.7 AND wc > {_OTHER})"


@query("mod_assign", sql("decided", f"""SELECT project, seq, content, section_path, CASE WHEN m2 = '' THEN '未分类' ELSE m2 END AS module,
  {half_up("CASE WHEN m2 = '' THEN CAST(0.1 AS DOUBLE) ELSE c2 END", 4)} AS confidence, CASE WHEN m2 = '' THEN 'fallback' ELSE s2 END AS match_source, conflict FROM (
  SELECT *, CASE WHEN {_LISTED} THEN wm WHEN {_PHRASED} THEN phrase ELSE m1 END AS m2,
    CASE WHEN {_LISTED} THEN wc WHEN {_PHRASED} THEN least(c1 + 0.1, 0.95) ELSE c1 END AS c2, CASE WHEN {_LISTED} THEN 'whitelist' ELSE s1 END AS s2 FROM decided)"""))
def mod_assign(spark, sf):
    df = A.tasks(spark, sf).select("project", "seq", "content", "section_path")
    return M.assign_modules(df, A.whitelist(spark, sf))


_SUB = "CASE " + " ".join(f"WHEN contains(content, {lit(w)}) THEN module || ' - ' || {lit(s)}" for w, s in R.SUB_MODULES) + " ELSE module END"


@query("mod_split", sql("tasks", f"""SELECT project, seq, content, CASE WHEN n > 10 THEN {_SUB} ELSE module END AS module FROM (
  SELECT *, count(*) OVER (PARTITION BY project, module) AS n FROM tasks)"""))
def mod_split(spark, sf):
    return M.split_modules(A.tasks(spark, sf)).select("project", "seq", "content", "module")


@query("tsk_sequence", sql("tasks", """SELECT project, seq, module, 'T' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS task_id,
  CASE WHEN r = 1 THEN '无' ELSE 'T' || CASE WHEN n - 1 < 1000 THEN lpad(CAST(n - 1 AS VARCHAR), 3, '0') ELSE CAST(n - 1 AS VARCHAR) END END AS dependency FROM (
  SELECT *, row_number() OVER (PARTITION BY project ORDER BY module, seq) AS n, row_number() OVER (PARTITION BY project, module ORDER BY seq) AS r FROM tasks)"""))
def tsk_sequence(spark, sf):
    return M.sequence_tasks(A.tasks(spark, sf).select("project", "seq", "module"))


_ACC = "CASE " + " ".join(f"WHEN {any_contains('lower(content)', w)} THEN {lit('；'.join(ls[:5]))}" for w, ls in R.ACCEPTANCE[:-1]) + f" ELSE {lit('；'.join(R.ACCEPTANCE[-1][1][:5]))} END"


@query("tsk_accept", sql("tasks", f"SELECT project, seq, content, {_ACC} AS acceptance FROM tasks"))
def tsk_accept(spark, sf):
    return A.tasks(spark, sf).select("project", "seq", "content", M.acceptance("content").alias("acceptance"))


# -- checks ---------------------------------------------------------------------

_VERBLESS = f"regexp_replace(content, '\\A(?:{'|'.join(R.CORE_VERBS)})', '')"
_FOUND = f"""(contains(raw_text, content) OR ({_VERBLESS} <> '' AND contains(raw_text, {_VERBLESS}))
  OR len(list_filter(range(1, length(content) - 2), lambda i: contains(raw_text, substr(content, i, 4)))) > 0)"""
_PART = f"list_transform(string_split(section_path, ' > '), lambda p: regexp_replace(p, {lit(re2(R.SECTION_NUMBER))}, ''))"
_AGREES = f"""(module = '' OR section_path = '' OR contains(section_path, module) OR len(list_filter(list_transform({_PART},
  lambda q: {_suffix('q', R.CHECK_SUFFIXES)}), lambda n: n <> '' AND (contains(module, n) OR contains(n, module)))) > 0)"""
cte(
    "check_flags",
    ("tasks",),
    f"""SELECT project, seq, section_path = '' AND line_num <= 0 AS f1, NOT {_FOUND} AS f2, NOT {_AGREES} AS f3, length(content) < 4 AS f4 FROM tasks""",
)


@query("chk_task", sql("check_flags", """SELECT project, seq, CAST(p4 AS DOUBLE) / 10 AS confidence, p4 >= 3 AS valid,
  array_to_string(list_filter([CASE WHEN f1 THEN 'no_source' END, CASE WHEN f2 THEN 'not_in_source' END, CASE WHEN f3 THEN 'section' END, CASE WHEN f4 THEN 'short' END],
    lambda x: x IS NOT NULL), ',') AS issues, CASE WHEN p4 < 3 THEN 'FAIL' WHEN f1 OR f2 OR f3 OR f4 THEN 'WARN' ELSE 'PASS' END AS status
  FROM (SELECT *, CASE WHEN f4 THEN greatest(p3 - 2, 1) ELSE p3 END AS p4 FROM (SELECT *, CASE WHEN f3 THEN greatest(p2 - 2, 1) ELSE p2 END AS p3
  FROM (SELECT *, CASE WHEN f2 THEN greatest(p1 - 8, 1) ELSE p1 END AS p2 FROM (SELECT *, CASE WHEN f1 THEN 5 ELSE 10 END AS p1 FROM check_flags))))"""))
def chk_task(spark, sf):
    return C.check_tasks(A.tasks(spark, sf))


# Edit distance over characters (the engine's own function counts bytes): one row of the distance table per character
# of the second text; the inner minimum replaces the left-neighbour dependency of the usual recurrence.
_DISTANCE = """list_reduce(range(1, length(nx) + 1), lambda prev, i: list_transform([list_transform(range(0, length(content) + 1),
    lambda j: CASE WHEN j = 0 THEN i ELSE least(prev[j + 1] + 1, prev[j] + CASE WHEN substr(content, j, 1) = substr(nx, i, 1) THEN 0 ELSE 1 END) END)],
    lambda t: list_transform(range(0, length(content) + 1), lambda j: list_min(list_transform(range(0, j + 1), lambda k: t[k + 1] + j - k))))[1],
    range(0, length(content) + 1))[length(content) + 1]"""


@query("chk_adjacent", sql("tasks", f"""SELECT project, seq, next_seq, {half_up('d', 4)} AS distance FROM (
  SELECT project, seq, next_seq, CAST({_DISTANCE} AS DOUBLE) / greatest(length(content), length(nx)) AS d FROM (
    SELECT *, lead(content) OVER (PARTITION BY project ORDER BY seq) AS nx, lead(seq) OVER (PARTITION BY project ORDER BY seq) AS next_seq FROM tasks)
  WHERE content <> '' AND nx <> '') WHERE d < 0.3"""))
def chk_adjacent(spark, sf):
    return C.adjacent_duplicates(A.tasks(spark, sf))


@query("chk_balance", sql("tasks", """SELECT project, module, count(*) AS tasks, CASE WHEN count(*) < 3 THEN 'too_few' ELSE 'too_many' END AS issue
  FROM tasks GROUP BY 1, 2 HAVING count(*) < 3 OR count(*) > 15"""))
def chk_balance(spark, sf):
    return C.module_balance(A.tasks(spark, sf))


@query("chk_provenance", sql("tasks", """SELECT project, min(seq) AS seq, line_num, 'same_line' AS issue, count(*) AS n FROM tasks WHERE line_num > 0
  GROUP BY project, line_num HAVING count(*) > 1
  UNION ALL SELECT project, seq, line_num, 'line_zero', 1 FROM tasks WHERE line_num = 0
  UNION ALL SELECT project, seq, line_num, 'long_source', length(raw_text) FROM tasks WHERE length(raw_text) > 200"""))
def chk_provenance(spark, sf):
    return C.provenance(A.tasks(spark, sf))


@query("chk_quality", sql("tasks", """SELECT project, module, seq, 'short' AS issue, length(content) AS n FROM tasks WHERE length(section_path) > 3 AND length(content) < 20
  UNION ALL SELECT project, module, seq, 'todo', 1 FROM tasks WHERE length(section_path) > 3 AND (contains(raw_text, 'TODO') OR contains(raw_text, 'todo'))
  UNION ALL SELECT project, module, NULL, 'large_module', count(*) FROM tasks WHERE length(section_path) > 3 GROUP BY project, module HAVING count(*) > 10"""))
def chk_quality(spark, sf):
    return C.content_quality(A.tasks(spark, sf))
