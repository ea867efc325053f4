"""Registered scan and line queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..operators import scan as S
from ..rules import code as C
from ..sources import files as X
from .base import lit, sql

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
    return X.document_lines(A.code_files(spark, sf))


def findings(spark, sf):
    return S.scan(lines(spark, sf))


@query("src_lines", sql("code_lines", "SELECT doc_id, project, path, language, line_no, line FROM code_lines"))
def src_lines(spark, sf):
    return lines(spark, sf).drop("n")


@query("src_lang", sql("code_files", """SELECT project, count(*) FILTER (WHERE path LIKE '%.java') AS java_files,
  count(*) FILTER (WHERE path LIKE '%.py') AS python_files, CASE WHEN count(*) FILTER (WHERE path LIKE '%.java') >=
  count(*) FILTER (WHERE path LIKE '%.py') THEN 'java' ELSE 'python' END AS language FROM code_files GROUP BY project"""))
def src_lang(spark, sf):
    return S.detect_language(A.code_files(spark, sf).select("project", "path"))


@query("scan_rules", sql("findings", "SELECT * FROM findings"))
def scan_rules(spark, sf):
    return findings(spark, sf)


@query("scan_table", sql("findings", "SELECT * FROM findings"))
def scan_table(spark, sf):
    # the packaged rules as a rule table
    rules = [(lang, r[0], r[1], r[2], r[3], S._pattern(r[2], r[5])) for lang in C.EXTENSIONS for r in S.rules_for(lang)]
    kinds = "language string, rule_id string, severity string, type string, cwe string, pattern string"
    return S.scan(lines(spark, sf), spark.createDataFrame(rules, kinds))


@query("scan_texts", sql("text_findings", "SELECT * FROM text_findings"))
def scan_texts(spark, sf):
    return S.scan_texts(A.code_files(spark, sf))


def _message(place: int) -> str:
    arms = " ".join(f"WHEN {lit(rule)} THEN {lit(texts[place])}" for rule, texts in C.MESSAGES.items())
    return f"CASE rule_id {arms} ELSE '' END"


@query("scan_messages", sql(("findings", "text_findings"), f"""SELECT finding_id, doc_id, rule_id, {_message(0)} AS message, {_message(1)} AS suggestion
  FROM (SELECT * FROM findings UNION ALL SELECT * FROM text_findings)"""))
def scan_messages(spark, sf):
    both = findings(spark, sf).unionByName(S.scan_texts(A.code_files(spark, sf)))
    return S.with_messages(both).select("finding_id", "doc_id", "rule_id", "message", "suggestion")


@query("scan_stats", sql("findings", """SELECT CASE WHEN grouping(severity) = 0 THEN 'severity' WHEN grouping(type) = 0 THEN 'type'
    WHEN grouping(rule_id) = 0 THEN 'rule' ELSE 'total' END AS level, coalesce(severity, type, rule_id, 'all') AS name,
  count(*) AS findings FROM findings GROUP BY GROUPING SETS ((severity), (type), (rule_id), ())"""))
def scan_stats(spark, sf):
    return S.finding_stats(findings(spark, sf))


@query("scan_totals", sql(("findings", "code_lines"), """SELECT project, files, lines, coalesce(findings, 0) AS findings,
  coalesce(files_hit, 0) AS files_hit FROM (SELECT project, count(*) AS files FROM code_files GROUP BY 1)
  LEFT JOIN (SELECT project, count(*) AS lines FROM code_lines GROUP BY 1) USING (project)
  LEFT JOIN (SELECT project, count(*) AS findings, count(DISTINCT path) AS files_hit FROM findings GROUP BY 1) USING (project)"""))
def scan_totals(spark, sf):
    return S.scan_totals(A.code_files(spark, sf), lines(spark, sf), findings(spark, sf))


_SEV = ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in C.SEVERITIES)
_ORDER = "CASE severity " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(C.SEVERITIES)) + " END"


@query("scan_file", sql("findings", f"""SELECT path, count(*) AS findings, {_SEV}, arg_min(severity, {_ORDER}) AS worst,
  min(line_no) AS first_line FROM findings GROUP BY path"""))
def scan_file(spark, sf):
    return S.findings_by_file(findings(spark, sf))


@query("scan_gate", sql(("findings", "code_files"), """SELECT project, count(severity) > 0 AS failed, count(severity) AS blocking
  FROM (SELECT DISTINCT project FROM code_files) LEFT JOIN (SELECT project, severity FROM findings
    WHERE severity IN ('critical', 'high')) USING (project) GROUP BY project"""))
def scan_gate(spark, sf):
    return S.scan_gate(A.code_files(spark, sf), findings(spark, sf))


_SLA = "VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in C.DEADLINES)


@query("scan_sla", sql("findings", f"""SELECT finding_id, path, severity, priority, deadline FROM findings
  JOIN ({_SLA}) d(severity, priority, deadline) USING (severity)"""))
def scan_sla(spark, sf):
    return S.with_deadline(findings(spark, sf).select("finding_id", "path", "severity"))


@query("scan_suppress", sql(("findings", "code_lines"), """SELECT f.* FROM findings f WHERE NOT coalesce((
  SELECT arg_max(regexp_extract(line, 'scan-rules: (disable|enable)=', 1) = 'disable', l.line_no) FROM code_lines l
  WHERE l.path = f.path AND l.line_no <= f.line_no AND contains(l.line, 'scan-rules: ')
    AND regexp_extract(line, 'scan-rules: (?:disable|enable)=([-A-Za-z0-9_]+)', 1) = f.rule_id), FALSE)"""))
def scan_suppress(spark, sf):
    return S.suppress(findings(spark, sf), lines(spark, sf))


@query("scan_methods", sql("code_files", r"""SELECT doc_id, path, language, class_name, position, symbol,
  unnest(['normal', 'boundary', 'exception']) AS scenario FROM (
  SELECT doc_id, path, language, class_name, unnest(symbols) AS symbol,
    CAST(generate_subscripts(symbols, 1) - 1 AS INTEGER) AS position FROM (SELECT *,
    CASE WHEN language = 'java' THEN coalesce(nullif(regexp_extract(text, 'class[\t-\r\x1c-\x20\x{85}\p{Z}]+([\p{L}\p{N}_]+)', 1), ''),
      regexp_extract(path, '([^/.]*)\.[^./]*$', 1)) END AS class_name,
    CASE WHEN language = 'java' THEN regexp_extract_all(text, '(?:public|private|protected)[\t-\r\x1c-\x20\x{85}\p{Z}]+[\p{L}\p{N}_]+[\t-\r\x1c-\x20\x{85}\p{Z}]+([\p{L}\p{N}_]+)[\t-\r\x1c-\x20\x{85}\p{Z}]*\([^)]*\)', 1)
    ELSE regexp_extract_all(text, 'def[\t-\r\x1c-\x20\x{85}\p{Z}]+([\p{L}\p{N}_]+)[\t-\r\x1c-\x20\x{85}\p{Z}]*\([^)]*\)', 1) END AS symbols FROM code_files))"""))
def scan_methods(spark, sf):
    return S.extract_symbols(A.code_files(spark, sf))
