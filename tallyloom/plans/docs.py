"""Registered document queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..operators import docs as O
from ..rules import documents as D
from ..sources import files as X
from .base import SPACE, WORD, captured, half_up, lit, re2, sql, strip

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def docs(spark, sf):
    return A.technical_docs(spark, sf)


def lines(spark, sf):
    return X.document_lines(docs(spark, sf))


@query("doc_checks", sql("doc_checks", 'SELECT doc_id, "check", required, passed, value, score FROM doc_checks'))
def doc_checks(spark, sf):
    return O.check_documents(docs(spark, sf))


_HINT = "CASE \"check\" " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in D.SUGGESTIONS.items()) + " END"
_POS = "CASE \"check\" " + " ".join(f"WHEN {lit(k)} THEN {i}" for i, k in enumerate(D.REQUIRED + D.BONUS)) + " END"


@query("doc_score", sql("doc_scores", f"""SELECT s.doc_id, s.project, score, passed_checks, level,
  score >= 70 AND passed_checks = 5 AS ready, coalesce(suggestions, '') AS suggestions FROM doc_scores s
  LEFT JOIN (SELECT doc_id, string_agg({_HINT}, '; ' ORDER BY {_POS}) AS suggestions FROM doc_checks WHERE NOT passed GROUP BY 1)
  USING (doc_id)"""))
def doc_score(spark, sf):
    return O.score_documents(docs(spark, sf))


@query("doc_vague", sql("vague_hits", "SELECT * FROM vague_hits"))
def doc_vague(spark, sf):
    return O.vague_phrases(docs(spark, sf))


@query("doc_issues", sql(("doc_checks", "vague_hits"), f"""SELECT doc_id, CAST(NULL AS BIGINT) AS line_no, 'missing_' || "check" AS type,
  'error' AS severity, "check" AS text, {_HINT} AS suggestion FROM doc_checks WHERE required AND NOT passed
  UNION ALL SELECT doc_id, line_no, 'vague_language', 'warning', phrase, hint FROM vague_hits"""))
def doc_issues(spark, sf):
    return O.issues(docs(spark, sf))


_HEAD = rf"\A###{SPACE}+"


@query("doc_blocks", sql("tech_lines", f"""SELECT doc_id, CAST(block AS BIGINT) AS block_no,
  {strip(f"regexp_replace(arg_min(bare, line_no), '{_HEAD}', '')")} AS title, string_agg(line, chr(10) ORDER BY line_no) AS content
  FROM (SELECT *, sum(CASE WHEN regexp_matches(bare, '{_HEAD}.') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS block
    FROM (SELECT *, {strip('line')} AS bare FROM tech_lines)) WHERE block > 0 GROUP BY doc_id, block"""))
def doc_blocks(spark, sf):
    return O.document_blocks(docs(spark, sf))


_STACK = "CASE WHEN contains(lower(text), 'java') OR contains(lower(text), 'spring') THEN 'java' WHEN contains(lower(text), 'python') OR contains(lower(text), 'fastapi') THEN 'python' ELSE 'unknown' END"


@query("doc_meta", sql(("tech_docs", "tech_lines"), f"""SELECT d.doc_id, {captured('text', [D.VERSION])} AS version,
  {captured('text', [D.CREATED])} AS created, {_STACK} AS stack, length(text) AS chars, coalesce(blocks, 0) AS blocks FROM tech_docs d
  LEFT JOIN (SELECT doc_id, count(*) AS blocks FROM tech_lines WHERE regexp_matches({strip('line')}, '{_HEAD}.') GROUP BY 1) USING (doc_id)"""))
def doc_meta(spark, sf):
    return O.document_metadata(docs(spark, sf))


_WORST = ", ".join(
    f"{{'n': count(*) FILTER (WHERE \"check\" = {lit(n)} AND NOT passed), 'o': {-i}, 'name': {lit(n)}}}"
    for i, n in enumerate(D.REQUIRED + D.BONUS)
)
_LEVELS = ", ".join(f"count(*) FILTER (WHERE level = {lit(n)}) AS level_{m}" for m, n in D.LEVELS)


@query("doc_corpus", sql(("doc_scores", "doc_checks"), f"""SELECT project, docs, pass_rate, mean_score, level_90, level_80, level_70,
  level_60, level_0, CASE WHEN worst.n > 0 THEN worst.name END AS worst_check, worst.n AS worst_failures FROM
  (SELECT project, count(*) AS docs, {half_up('CAST(count(*) FILTER (WHERE score >= 70) AS DOUBLE) / count(*)', 4)} AS pass_rate,
    {half_up('avg(score)', 4)} AS mean_score, {_LEVELS} FROM doc_scores GROUP BY project)
  JOIN (SELECT project, list_max([{_WORST}]) AS worst FROM doc_checks GROUP BY project) USING (project)"""))
def doc_corpus(spark, sf):
    return O.corpus_report(docs(spark, sf))


def _normalised() -> str:
    x = f"translate(text, {lit(D.RADICALS)}, {lit(D.CHARACTERS)})"
    x = rf"regexp_replace({x}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{{9f}}\x{{ad}}\x{{200b}}-\x{{200f}}\x{{2028}}-\x{{202f}}\x{{feff}}]', '', 'g')"
    x = f"replace({x}, chr(12288), ' ')"
    x = rf"regexp_replace({x}, '[ \t]+', ' ', 'g')"
    x = rf"regexp_replace({x}, '(?m)^[\t\x0b-\r\x1c-\x20\x{{85}}\p{{Z}}]+|[\t\x0b-\r\x1c-\x20\x{{85}}\p{{Z}}]+$', '', 'g')"
    for w in D.DOUBLED:
        x = f"replace({x}, {lit(w + w)}, {lit(w)})"
    x = rf"regexp_replace({x}, '([\x{{4e00}}-\x{{9fa5}}])\n([\x{{4e00}}-\x{{9fa5}}])', '\1\2', 'g')"
    x = rf"regexp_replace({x}, '(/api/(?:{WORD}|-)+)\n((?:{WORD}|[/-])+)', '\1\2', 'g')"
    return rf"regexp_replace({x}, '\n{SPACE}*\n', chr(10), 'g')"


_KEY = strip(rf"regexp_replace(regexp_replace(fixed, '[\x00-\x1f\x7f]', '', 'g'), '{SPACE}+', ' ', 'g')")


@query("doc_normalise", sql("tech_docs", f"""SELECT doc_id, project, fixed, {_KEY} AS key, fixed <> text AS changed
  FROM (SELECT *, {_normalised()} AS fixed FROM tech_docs)"""))
def doc_normalise(spark, sf):
    return O.normalise_corpus(docs(spark, sf))


_E = [re2(p).replace("(?:^|", r"(?:\A|") for p in O.ENDPOINTS]


@query("doc_endpoints", sql("tech_lines", f"""SELECT doc_id, method, count(*) AS mentions, count(DISTINCT path) AS paths FROM (
  SELECT doc_id, CASE WHEN regexp_matches(line, {lit(_E[0])}) THEN regexp_extract(line, {lit(_E[0])}, 1)
      WHEN regexp_matches(line, {lit(_E[1])}) THEN regexp_extract(line, {lit(_E[1])}, 1)
      WHEN regexp_matches(line, {lit(_E[2])}) THEN '' END AS method,
    CASE WHEN regexp_matches(line, {lit(_E[0])}) THEN regexp_extract(line, {lit(_E[0])}, 2)
      WHEN regexp_matches(line, {lit(_E[1])}) THEN regexp_extract(line, {lit(_E[1])}, 2)
      ELSE regexp_extract(line, {lit(_E[2])}, 1) END AS path FROM tech_lines)
  WHERE method IS NOT NULL GROUP BY doc_id, method"""))
def doc_endpoints(spark, sf):
    return O.endpoint_mentions(lines(spark, sf))


_TABLES = rf"""SELECT doc_id, gap, line_no, list_transform(string_split_regex(regexp_replace(bare, '\A\|+|\|+\z', '', 'g'), '\|'),
    lambda c: {strip('c')}) AS cells
  FROM (SELECT *, sum(CASE WHEN inside THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS gap
    FROM (SELECT *, bare LIKE '|%' AND bare LIKE '%|' AS inside FROM (SELECT *, {strip('line')} AS bare FROM tech_lines)))
  WHERE inside"""
_ROWS = f"""SELECT *, min(line_no) OVER (PARTITION BY doc_id, gap) AS first_no, count(*) OVER (PARTITION BY doc_id, gap) AS n,
    first_value(cells) OVER (PARTITION BY doc_id, gap ORDER BY line_no) AS header
  FROM ({_TABLES}) WHERE len(list_filter(cells, lambda c: regexp_replace(c, '[-: ]', '', 'g') <> '')) > 0"""
_NUMBERED = f"""SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY gap) AS table_no, line_no, header, cells, first_no
  FROM ({_ROWS}) WHERE n >= 2"""


@query("src_mdtable", sql("tech_lines", f"""SELECT doc_id, table_no, line_no, array_to_string(header, '|') AS header,
  array_to_string(cells, '|') AS cells FROM ({_NUMBERED}) WHERE line_no > first_no"""))
def src_mdtable(spark, sf):
    df = X.markdown_tables(lines(spark, sf))
    return df.withColumns({c: F.array_join(c, "|") for c in ("header", "cells")})


def _has(words):
    return "(" + " OR ".join(f"contains(head, {lit(w)})" for w in words) + ")"


def _named(name):
    return (
        f"CASE WHEN list_contains(low, {lit(name)}) THEN nullif(list_extract(cells, list_position(low, {lit(name)})), '') END"
    )


@query("src_iftasks", sql("tech_lines", f"""SELECT doc_id, table_no, line_no, kind, content, '普通任务' AS task_type FROM (
  SELECT *, CASE WHEN {_has(X.INTERFACE_WORDS)} THEN 'interface' WHEN {_has(X.MODULE_WORDS)} THEN 'module' END AS kind,
    coalesce({', '.join(_named(n) for n in X.NAME_COLUMNS)}, nullif(cells[1], '')) AS content
  FROM (SELECT *, lower(array_to_string(header, ' ')) AS head, list_transform(header, lambda h: lower(h)) AS low
    FROM ({_NUMBERED}) WHERE line_no > first_no)) WHERE kind IS NOT NULL AND content IS NOT NULL"""))
def src_iftasks(spark, sf):
    return X.interface_tasks(X.markdown_tables(lines(spark, sf)))
