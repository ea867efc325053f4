"""Rule scan of source lines and its reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ordered
from ..functions.needles import meetings, required, rule_rows, slices
from ..functions.text import WORD, any_of, first_match, matches, strip, sub
from ..rules import code as C


# Rules without required text that one expression holds.
OPEN_RULES = 64


def rules_for(language: str, families: Sequence[str] = ("SEC", "STYLE", "PERF"), rules=C.RULES) -> list[tuple]:
    """The rules of one language, limited to families (security, style, performance)."""
    prefix = {"java": "JAVA", "python": "PY"}[language]
    return [r for r in rules if r[0].split("-")[0] == prefix and r[0].split("-")[1] in families]


def _pattern(kind: str, pattern: str) -> str:
    # U: \w and \s cover all scripts; d: only \n ends a line
    return ("(?dU)" if kind == "style" else "(?idU)") + pattern


def _hits(line: Column, rules: Sequence[tuple]) -> Column:
    """Array of the matching rules of one line, in rule order: every rule is tested in one pass."""
    tests = []
    for rule_id, severity, kind, cwe, literal, pattern in rules:
        found = matches(line, _pattern(kind, pattern))
        if literal:
            found = line.contains(literal) & found
        fields = [("rule_id", rule_id), ("severity", severity), ("type", kind), ("cwe", cwe)]
        tests.append(F.when(found, F.struct(*[F.lit(v).alias(k) for k, v in fields])))
    return F.filter(F.array(*tests), lambda r: r.isNotNull())


def is_comment(line: Column, language: str) -> Column:
    text = strip(line)
    return any_of([text.startswith(s) for s in C.COMMENT_STARTS[language]])


def scan(lines: DataFrame, rules: Sequence[tuple] | DataFrame = C.RULES, families=("SEC", "STYLE", "PERF")) -> DataFrame:
    """One finding per (line, rule). ``lines``: doc_id, path, language, line_no, line, ...

    The packaged rules run as one array expression per line. A rule table given
    as a DataFrame may hold any number of rules, see ``functions/needles.py``.
    """
    keep = [c for c in ("project", "doc_id", "path", "language") if c in lines.columns]
    if isinstance(rules, DataFrame):
        return _scan_with_table(lines, rules, keep)
    line = F.col("line")
    by_language = first_match(
        [
            (F.col("language") == lang, F.when(~is_comment(line, lang), _hits(line, rules_for(lang, families, rules))))
            for lang in C.EXTENSIONS
        ]
    )
    # The outer form keeps Spark from adding a "has elements" filter that would run every rule twice.
    df = lines.select(*keep, "line_no", "line", F.explode_outer(by_language).alias("r")).filter(F.col("r").isNotNull())
    return df.select(
        F.concat_ws("-", "r.rule_id", "line_no").alias("finding_id"),
        *keep,
        "line_no",
        "r.*",
        strip(line).alias("code"),
    )


def spanning_rules(rules: Sequence[tuple] = C.RULES) -> list[tuple]:
    """Rules that need more than one line; line by line they never fire."""
    return [r for r in rules if r"\n" in r[5]]


def scan_texts(files: DataFrame, rules: Sequence[tuple] | None = None) -> DataFrame:
    """One finding per match of a rule in a whole text. ``files``: doc_id, path, language, text, ...

    For rules that span lines, by default all of them. A text is cut at the matches; the line breaks in
    the pieces before a match, added up, give its line. A match that starts in a comment line is left out.
    Line breaks of all kinds count, the line that a match starts in is its ``code``.
    """
    keep = [c for c in ("project", "doc_id", "path", "language") if c in files.columns]
    rules = spanning_rules() if rules is None else rules
    df = files.select(*keep, sub(F.coalesce("text", F.lit("")), r"\r\n?", "\n").alias("text"))
    out = None
    for language in C.EXTENSIONS:
        for rule_id, severity, kind, cwe, _, pattern in rules_for(language, rules=rules):
            whole = "(?m)" + _pattern(kind, pattern)
            hit = df.filter((F.col("language") == language) & matches("text", whole))
            breaks = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n")))
            found = F.zip_with(
                F.split("text", whole, -1), F.regexp_extract_all("text", F.lit(whole), F.lit(0)),
                lambda piece, match: F.struct(piece.alias("piece"), match.alias("match"), (breaks(piece) + breaks(F.coalesce(match, F.lit("")))).alias("breaks")),
            )
            hit = hit.select(*keep, found.alias("_found"))
            before = F.aggregate(F.slice("_found", F.lit(1), F.col("_at")), F.lit(0), lambda n, x: n + x["breaks"])
            hit = hit.select("*", F.posexplode("_found").alias("_at", "_m")).filter(F.col("_m.match").isNotNull())
            start = F.concat(F.substring_index("_m.piece", "\n", -1), F.substring_index("_m.match", "\n", 1))
            hit = hit.select(*keep, (before + breaks(F.col("_m.piece")) + 1).cast("long").alias("line_no"), start.alias("_line"))
            hit = hit.filter(~is_comment(F.col("_line"), language)).select(
                F.concat_ws("-", F.lit(rule_id), "line_no").alias("finding_id"), *keep, "line_no",
                *[F.lit(v).alias(n) for n, v in (("rule_id", rule_id), ("severity", severity), ("type", kind), ("cwe", cwe))],
                strip("_line").alias("code"),
            )
            out = hit if out is None else out.unionByName(hit)
    return out


def with_messages(findings: DataFrame, messages: dict[str, tuple[str, str]] = C.MESSAGES) -> DataFrame:
    """Add ``message`` and ``suggestion`` by rule; empty for rules without them."""
    for place, name in enumerate(("message", "suggestion")):
        table = F.create_map(*[F.lit(x) for rule, texts in messages.items() for x in (rule, texts[place])])
        findings = findings.withColumn(name, F.coalesce(F.try_element_at(table, F.col("rule_id")), F.lit("")))
    return findings


def _scan_with_table(lines: DataFrame, rules: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Scan with a table: language, rule_id, severity, type, cwe, pattern (flags included), any number of rules.

    A line meets the rules of whose required text it holds some; only such pairs try the pattern. Rules
    that require no text run as expressions over every line, as the packaged ones do.
    """
    columns = ["rule_id", "severity", "type", "cwe"]
    rules = rules.select("language", *columns, "pattern")
    comment = any_of([(F.col("language") == lang) & is_comment(F.col("line"), lang) for lang in C.EXTENSIONS])
    chosen = lines.filter(~F.coalesce(comment, F.lit(False))).select(*dict.fromkeys([*keep, "language", "line_no", "line"]))
    out = None
    for part in slices(rules, "pattern"):
        needles = {r["_rule"]: required(r["pattern"]) for r in part if r["pattern"] is not None}
        met = meetings(chosen.withColumn("_language", F.col("language")), "line", [(k, *n) for k, n in needles.items() if n])
        met = rule_rows(met.drop("language"), part, rules)
        met = met.filter((F.col("_language") == F.col("language")) & F.regexp_like("line", "pattern"))
        found = [met.select(*[F.col("_language").alias(c) if c == "language" else F.col(c) for c in chosen.columns], *columns)]
        open_rules = [r for r in part if r["_rule"] in needles and not needles[r["_rule"]]]
        for at in range(0, len(open_rules), OPEN_RULES):
            tests = [
                F.when(
                    (F.col("language") == r["language"]) & F.regexp_like("line", F.lit(r["pattern"])),
                    F.struct(*[F.lit(r[c]).cast("string").alias(c) for c in columns]),
                )
                for r in open_rules[at : at + OPEN_RULES]
            ]
            hits = F.filter(F.array(*tests), lambda r: r.isNotNull())
            hit = chosen.select("*", F.explode_outer(hits).alias("r")).filter(F.col("r").isNotNull())
            found.append(hit.select(*chosen.columns, "r.*"))
        for df in found:
            out = df if out is None else out.unionByName(df)
    if out is None:
        out = rule_rows(meetings(chosen, "line", []).drop("language"), [], rules).select(*chosen.columns, *columns)
    return out.select(F.concat_ws("-", "rule_id", "line_no").alias("finding_id"), *keep, "line_no", *columns, strip("line").alias("code"))


def severity_order(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return first_match([(c == s, F.lit(i)) for i, s in enumerate(C.SEVERITIES)], F.lit(len(C.SEVERITIES)))


def ordered_findings(findings: DataFrame) -> DataFrame:
    """Findings from critical to info, then by file and line."""
    return findings.orderBy(severity_order("severity"), "path", "line_no", "rule_id")


def finding_stats(findings: DataFrame) -> DataFrame:
    """Counts by severity, by type, by rule and in total, from one pass to the finest level."""
    base = findings.groupBy("severity", "type", "rule_id").agg(F.count(F.lit(1)).alias("_n"))
    level = first_match(
        [
            (F.grouping("severity") == 0, F.lit("severity")),
            (F.grouping("type") == 0, F.lit("type")),
            (F.grouping("rule_id") == 0, F.lit("rule")),
        ],
        F.lit("total"),
    )
    keys = F.coalesce("severity", "type", "rule_id", F.lit("all"))
    return (
        base.groupingSets([["severity"], ["type"], ["rule_id"], []], "severity", "type", "rule_id")
        .agg(level.alias("level"), F.sum("_n").alias("findings"))
        .select("level", keys.alias("name"), "findings")
    )


def scan_totals(files: DataFrame, lines: DataFrame, findings: DataFrame) -> DataFrame:
    """Files, lines and findings per project; projects and files without findings count too."""
    f = files.groupBy("project").agg(F.count(F.lit(1)).alias("files"))
    n = lines.groupBy("project").agg(F.count(F.lit(1)).alias("lines"))
    h = findings.groupBy("project").agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("path").alias("files_hit"))
    df = f.join(n, "project", "left").join(h, "project", "left")
    return df.select(
        "project", "files", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("lines", "findings", "files_hit")]
    )


def findings_by_file(findings: DataFrame) -> DataFrame:
    """Findings per file: counts per severity, first line and worst grade."""
    worst = F.min(F.struct(severity_order("severity").alias("o"), "severity"))
    return findings.groupBy("path").agg(
        F.count(F.lit(1)).alias("findings"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in C.SEVERITIES],
        worst["severity"].alias("worst"),
        F.min("line_no").alias("first_line"),
    )


def scan_gate(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Fail flag per project of ``files``: any critical or high finding. A project without findings passes."""
    bad = findings.filter(F.col("severity").isin("critical", "high")).groupBy("project").agg(F.count("*").alias("blocking"))
    blocking = F.coalesce("blocking", F.lit(0).cast("long"))
    return files.select("project").distinct().join(bad, "project", "left").select(
        "project", (blocking > 0).alias("failed"), blocking.alias("blocking")
    )


def with_deadline(findings: DataFrame, deadlines: Sequence[tuple] = C.DEADLINES) -> DataFrame:
    """Add priority and deadline by severity."""
    found = first_match(
        [
            (F.col("severity") == s, F.struct(F.lit(p).alias("priority"), F.lit(d).alias("deadline")))
            for s, p, d in deadlines
        ]
    )
    return findings.withColumn("_d", found).select(*findings.columns, "_d.priority", "_d.deadline")


def suppress(findings: DataFrame, lines: DataFrame, size: int = ordered.CHUNK) -> DataFrame:
    """Drop findings between a ``disable=<rule>`` and an ``enable=<rule>`` line of the same file."""
    marker = rf"{C.SWITCH}(disable|enable)=({WORD}[-A-Za-z0-9_]*)"
    switches = lines.filter(F.col("line").contains(C.SWITCH)).select(
        "path",
        F.regexp_extract("line", marker, 2).alias("rule_id"),
        (F.col("line_no") * 2).alias("_pos"),
        (F.regexp_extract("line", marker, 1) == "disable").alias("_off"),
    )
    switches = switches.filter(F.col("rule_id") != "").withColumns({c: F.lit(None).cast(findings.schema[c].dataType) for c in findings.columns if c not in ("path", "rule_id")})
    marked = findings.withColumns({"_pos": F.col("line_no") * 2 + 1, "_off": F.lit(None).cast("boolean")})
    df = ordered.carry_forward(
        marked.unionByName(switches), ["path", "rule_id"], "_pos", {"_state": F.col("_off")}, size=size
    )
    return df.filter(F.col("_off").isNull() & ~F.coalesce("_state", F.lit(False))).select(*findings.columns)


def detect_language(files: DataFrame) -> DataFrame:
    """Language per project: by build file, else by the majority of source files, a tie is java.

    ``files``: project, path.
    """
    name = F.element_at(F.split("path", "/"), -1)
    has = lambda *names: F.count_if(name.isin(*names)) > 0
    df = files.groupBy("project").agg(
        has("pom.xml", "build.gradle").alias("_java"),
        has("requirements.txt", "setup.py").alias("_python"),
        F.count_if(F.col("path").endswith(".java")).alias("java_files"),
        F.count_if(F.col("path").endswith(".py")).alias("python_files"),
    )
    language = (
        F.when(F.col("_java"), "java")
        .when(F.col("_python"), "python")
        .when(F.col("java_files") >= F.col("python_files"), "java")
        .otherwise("python")
    )
    return df.select("project", "java_files", "python_files", language.alias("language"))


def extract_symbols(files: DataFrame) -> DataFrame:
    """Class and method names (java), function names (python) with the three test scenarios of each.

    ``files``: doc_id, path, language, text. Works on whole files inside the row.
    """
    klass = F.nullif(F.regexp_extract("text", r"(?U)class\s+(\w+)", 1), F.lit(""))
    stem = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    methods = F.regexp_extract_all("text", F.lit(r"(?U)(?:public|private|protected)\s+\w+\s+(\w+)\s*\([^)]*\)"), F.lit(1))
    functions = F.regexp_extract_all("text", F.lit(r"(?U)def\s+(\w+)\s*\([^)]*\)"), F.lit(1))
    java = F.col("language") == "java"
    symbols = F.when(java, methods).otherwise(functions)
    df = files.select(
        "doc_id",
        "path",
        "language",
        F.when(java, F.coalesce(klass, stem)).alias("class_name"),
        F.posexplode(symbols).alias("position", "symbol"),
    )
    scenarios = F.array(*[F.lit(s) for s in C.SCENARIOS])
    return df.withColumn("scenario", F.explode(scenarios))
