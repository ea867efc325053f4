"""SQL twins of the adapters and of the shared expressions, for checking with another engine."""

from __future__ import annotations

from ..adapters import AGENTS, JAVA_LINES, MODELS, PYTHON_LINES, PYTHON_PAIRS, REPEATED
from ..rules import models as M

SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
WORD = r"[\p{L}\p{N}_]"


def lit(s) -> str:
    if s is None:
        return "NULL"
    if isinstance(s, bool):
        return "TRUE" if s else "FALSE"
    if isinstance(s, float):
        return f"CAST({s!r} AS DOUBLE)"
    if isinstance(s, int):
        return str(s)
    out = str(s).replace("'", "''")
    return f"'{out}'"


def values(name: str, columns: str, rows, numbered: bool = True) -> str:
    """A literal table as one CTE."""
    body = ", ".join(
        "(" + ", ".join(([str(i)] if numbered else []) + [lit(v) for v in row]) + ")" for i, row in enumerate(rows)
    )
    return f"{name}({'ord, ' if numbered else ''}{columns}) AS (VALUES {body})"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '\A{SPACE}+|{SPACE}+\z', '', 'g')"


def half_up(x: str, places: int) -> str:
    return f"round(CAST({x} AS DOUBLE) + 1e-{places + 6}, {places})"


def ratio2(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN {half_up(f'CAST({a} AS DOUBLE) / {b}', 2)} ELSE CAST(0 AS DOUBLE) END"


def t3(x: str) -> str:
    return f"CAST(CASE WHEN length({x}) = 0 THEN 0 ELSE greatest(1, length({x}) // 3) END AS BIGINT)"


def rough(x: str) -> str:
    other = rf"length(regexp_replace({x}, '[\x{{4e00}}-\x{{9fff}}]', '', 'g'))"
    return f"CAST((length({x}) - {other}) // 2 + {other} // 4 + 1 AS BIGINT)"


def price(model: str, column: str) -> str:
    return (
        f"coalesce((SELECT p.{column} FROM prices p WHERE contains(lower({model}), p.key) "
        f"ORDER BY (lower({model}) = p.key) DESC, p.ord LIMIT 1), CAST(0 AS DOUBLE))"
    )


def any_contains(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(w)})" for w in words) + ")"


def pick(index: str, items) -> str:
    return f"list_extract([{', '.join(lit(i) for i in items)}], CAST({index} AS INTEGER) + 1)"


_NL = "chr(10)"
_RELAY = r"\] (?:DM|PM|Group|Chat)?\s*(?:from|in)?\s*\S*:\s*([\s\S]*)"
_SYS = "regexp_matches({0}, '\\A[Ss]ystem:')"


def _step(x: str) -> str:
    return (
        f"CASE WHEN regexp_matches({x}, '{_RELAY}') THEN {strip(f'''regexp_extract({x}, '{_RELAY}', 1)''')} "
        f"ELSE {strip(f'''substr({x}, instr({x}, ':') + 1)''')} END"
    )


def _sys(x: str) -> str:
    return _SYS.format(x)


_THINK = [r"<thinking>[\s\S]*?</thinking>", r"<reasoning>[\s\S]*?</reasoning>", r"`*`*`*thinking`*`*`*"]
_ENDS = ["---", "___", "\n\n\n答", "\n\n回答", "\n\n回复"]


def _split(part: str) -> str:
    arms = []
    for t in _THINK:
        found = f"regexp_extract(text, '{t}')"
        value = found if part == "thinking" else strip(f"replace(text, {found}, '')")
        arms.append(f"WHEN {found} <> '' THEN {value}")
    for e in _ENDS:
        at = f"instr(text, {lit(e)})"
        before = strip(f"substr(text, 1, {at} - 1)")
        after = strip(f"substr(text, {at} + {len(e)})")
        value = before if part == "thinking" else after
        arms.append(f"WHEN {at} > 0 AND {before} <> '' AND {after} <> '' THEN {value}")
    rest = "''" if part == "thinking" else "text"
    return f"CASE {' '.join(arms)} ELSE {rest} END"


_CODE = (
    "coalesce(list_sum(list_transform(regexp_extract_all(text, "
    rf"'```{WORD}*\n[\s\S]*?\n```'), lambda b: length(b))), 0)"
)

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, needs: tuple[str, ...], body: str) -> None:
    CTES[name] = (needs, body if body.startswith(name + "(") else f"{name} AS ({body})")


def sql(needs, body: str) -> str:
    """A statement with the named CTEs and everything they need in front."""
    needs = (needs,) if isinstance(needs, str) else tuple(needs)
    ordered: list[str] = []

    def visit(n: str) -> None:
        if n in ordered:
            return
        for d in CTES[n][0]:
            visit(d)
        ordered.append(n)

    for n in needs:
        visit(n)
    if not ordered:
        return body
    recursive = "RECURSIVE " if any("/*rec*/" in CTES[n][1] for n in ordered) else ""
    return f"WITH {recursive}" + ",\n".join(CTES[n][1] for n in ordered) + "\n" + body


cte("prices", (), values("prices", "key, price_in, price_out", M.PRICES))
cte("specs", (), values("specs", "key, context_window, max_tokens", M.SPECS))
cte("encodings", (), values("encodings", "key, encoding", M.ENCODINGS))

cte(
    "messages",
    (),
    f"""SELECT 'c' || conv_id AS conversation_id, turn AS message_index, role,
  CASE
    WHEN role = 'user' AND (conv_id * 3 + turn) % 10 = 0
      THEN 'System: [2024-01-01] DM from ou_x: ' || text || {_NL} || {_NL} || 'Conversation info (meta)' || {_NL} || 'x'
    WHEN role = 'user' AND (conv_id * 3 + turn) % 10 = 1 THEN '/new ' || text
    WHEN role = 'user' AND (conv_id * 3 + turn) % 10 = 2 THEN text || {_NL} || '[message_id: 12]'
    WHEN role = 'user' AND (conv_id * 3 + turn) % 10 = 3
      THEN 'System: [a] DM from x: System: [b] Group in y: ' || text
    WHEN role = 'assistant' AND (conv_id * 3 + turn) % 10 = 4
      THEN '<thinking>' || text || '</thinking>' || {_NL} || 'OK, done.' || {_NL}
    WHEN role = 'assistant' AND (conv_id * 3 + turn) % 10 = 5
      THEN text || text || {_NL} || {_NL} || '回答: ' || substr(text, 1, 60)
    WHEN role = 'assistant' AND (conv_id * 3 + turn) % 10 = 6
      THEN text || {_NL} || '```python' || {_NL} || 'print(1)' || {_NL} || '```' || {_NL}
    WHEN role = 'user' AND conv_id % 6 = 1 THEN {lit(REPEATED)} || text
    ELSE text END AS content,
  CASE WHEN role = 'assistant' AND conv_id % 11 = 3 THEN 'thinking' ELSE 'text' END AS content_type,
  {pick('conv_id % 7', MODELS)} AS model,
  make_timestamp(1704067200000000 + conv_id * 3600000000 + turn * 60000000) AS ts, conv_id
FROM conversations""",
)
cte(
    "prepared",
    ("messages",),
    rf"""SELECT *, CASE WHEN content_type IS NULL THEN NULL ELSE
    {_split('thinking')} END AS thinking0, {_split('answer')} AS answer0, {_CODE} AS code_chars,
    regexp_replace(regexp_replace(regexp_replace(b3, '\n\nConversation info[\s\S]*\z', ''),
      '\n\[message_id:[\s\S]*\z', ''), '\nou_{WORD}{{32}}: [\s\S]*\z', '') AS tailed
  FROM (SELECT *, CASE WHEN {_sys('text')} AND {_sys('b1')} AND {_sys('b2')} THEN {_step('b2')} ELSE b2 END AS b3
  FROM (SELECT *, CASE WHEN {_sys('text')} AND {_sys('b1')} AND regexp_matches(text, '{_RELAY}')
      THEN {_step('b1')} ELSE b1 END AS b2
  FROM (SELECT *, CASE WHEN {_sys('text')} THEN {_step('text')} ELSE text END AS b1
  FROM (SELECT *, {strip(rf"regexp_replace({strip('content')}, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g')")} AS text
  FROM messages))))""",
)
_T = strip("body")
_L = f"lower({_T})"
cte(
    "prep",
    ("prepared",),
    rf"""SELECT * EXCLUDE (thinking0, answer0),
  role = 'user' AND ({_T} = '' OR {_sys(_T)} OR starts_with({_T}, '/new') OR starts_with({_T}, '/reset')
    OR {any_contains(_L, ['a new session was started', 'queued messages while', 'exec completed', 'exec failed'])}
    OR starts_with({_T}, '[queued messages') OR starts_with({_T}, '[media attached') OR starts_with({_T}, 'media:')
    OR starts_with({_T}, 'system [') OR starts_with({_L}, 'conversation info') OR starts_with({_L}, 'message_id')
    OR regexp_matches({_T}, '\A\[\d{{4}}') OR NOT regexp_matches({_T}, '{WORD}')) AS machine_made,
  CASE WHEN role = 'assistant' THEN thinking0 ELSE '' END AS thinking,
  CASE WHEN role = 'assistant' THEN answer0 ELSE '' END AS answer
FROM (SELECT *, CASE WHEN role = 'user' THEN tailed ELSE text END AS body FROM prepared)""",
)
cte(
    "calls",
    ("messages",),
    f"""SELECT conversation_id, message_index AS call_index, CAST(before AS BIGINT) AS input, cache_read,
  CAST(0 AS BIGINT) AS cache_write, tokens AS output, CAST(before + cache_read + tokens AS BIGINT) AS total_tokens,
  model, role, ts
FROM (SELECT *, {t3('content')} AS tokens, (conv_id * 7 + message_index) % 500 AS cache_read,
  coalesce(sum({t3('content')}) OVER (PARTITION BY conversation_id ORDER BY message_index
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM messages)
WHERE role = 'assistant'""",
)
cte(
    "usage0",
    ("calls",),
    """SELECT conversation_id, CAST(sum(input) AS BIGINT) AS input_uncached, CAST(sum(cache_read) AS BIGINT) AS cache_read,
  CAST(sum(output) AS BIGINT) AS output, count(*) AS api_calls, max_by(model, call_index) AS model,
  min(ts) AS first_ts, max(ts) AS last_ts FROM calls GROUP BY conversation_id""",
)
cte(
    "usage",
    ("usage0", "prices"),
    f"""SELECT conversation_id, model, input_uncached + cache_read AS total_input, cache_read, output,
  input_uncached + cache_read + output AS total_tokens, api_calls, first_ts, last_ts,
  {half_up('input_uncached / 1e6 * pin + cache_read / 1e6 * pin * 0.5 + output / 1e6 * pout', 6)} AS cost,
  'real' AS accuracy
FROM (SELECT *, {price('model', 'price_in')} AS pin, {price('model', 'price_out')} AS pout FROM usage0)""",
)
cte(
    "said",
    ("prep",),
    """SELECT *, role = 'user' AND NOT machine_made AND text <> '' AS is_real,
  CASE WHEN role = 'user' AND NOT machine_made AND text <> '' THEN body
       WHEN role IN ('system', 'assistant') AND text <> '' THEN text END AS used FROM prep""",
)
cte(
    "sized",
    ("said",),
    """SELECT conversation_id, role, length(used) // 3 AS est,
  row_number() OVER (PARTITION BY conversation_id ORDER BY message_index) AS pos
FROM said WHERE used IS NOT NULL""",
)
cte(
    "context",
    ("said", "sized"),
    """SELECT a.*, coalesce(b.second_msg, '') AS second_msg, coalesce(c.sizes, '') AS sizes,
  coalesce(c.n_sizes, 0) AS n_sizes, coalesce(c.first6_user, 0) AS first6_user,
  coalesce(c.first6_assistant, 0) AS first6_assistant
FROM (SELECT conversation_id, coalesce(arg_min(body, message_index) FILTER (WHERE is_real), '') AS first_msg,
    coalesce(arg_max(body, message_index) FILTER (WHERE is_real), '') AS last_msg,
    count(*) FILTER (WHERE is_real) AS user_turns, count(*) FILTER (WHERE role = 'assistant') AS assistant_turns,
    count(*) AS total_messages,
    CAST(coalesce(sum(length(used)) FILTER (WHERE role IN ('user', 'assistant')), 0) AS BIGINT) AS total_chars,
    min(ts) AS time_start, max(ts) AS time_end,
    CAST(coalesce(sum(length(used) // 3) FILTER (WHERE role = 'system'), 0) AS BIGINT) AS system_tokens,
    CAST(coalesce(sum(length(thinking) // 3) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS thinking_tokens,
    CAST(coalesce(sum(length(answer) // 3) FILTER (WHERE role = 'assistant' AND thinking <> ''), 0) AS BIGINT)
      AS thinking_output_tokens
  FROM said GROUP BY conversation_id) a
LEFT JOIN (SELECT conversation_id, body AS second_msg FROM (SELECT *, row_number() OVER
    (PARTITION BY conversation_id ORDER BY message_index) AS rn FROM said WHERE is_real) WHERE rn = 2) b
  USING (conversation_id)
LEFT JOIN (SELECT conversation_id, string_agg(role || ':' || est, ',' ORDER BY pos) AS sizes, count(*) AS n_sizes,
    CAST(coalesce(sum(est) FILTER (WHERE role = 'user' AND pos <= 6), 0) AS BIGINT) AS first6_user,
    CAST(coalesce(sum(est) FILTER (WHERE role = 'assistant' AND pos <= 6), 0) AS BIGINT) AS first6_assistant
  FROM sized GROUP BY conversation_id) c USING (conversation_id)""",
)
cte(
    "origins",
    (),
    f"""SELECT 'c' || conv_id AS conversation_id, {pick('conv_id % 3', ['transcript', 'proxy', 'extension'])} AS source,
  'agent:a:' || {pick('conv_id % 5', ['feishu', 'main', 'telegram', '', 'other'])} || ':' || conv_id AS source_id,
  CASE WHEN conv_id % 4 = 0 THEN 'group' ELSE 'direct' END AS kind
FROM (SELECT DISTINCT conv_id FROM conversations)""",
)
_READABLE = (
    "CASE WHEN total_tokens >= 1000000 THEN CAST(CAST(round(total_tokens / 1e6 + 1e-7, 1) AS DECIMAL(20,1)) AS VARCHAR) || 'M' "
    "WHEN total_tokens >= 1000 THEN (total_tokens // 1000) || 'K' ELSE CAST(total_tokens AS VARCHAR) END"
)
cte(
    "sessions",
    ("usage", "context", "origins"),
    rf"""SELECT source || '_' || conversation_id AS id, source, source_id,
  CASE WHEN total_tokens > 10000 THEN short || ' (输入' || {_READABLE} || ')' ELSE short END AS title,
  model, total_input AS total_input_tokens, output AS total_output_tokens, cache_read AS total_cache_read_tokens,
  api_calls AS api_call_count, {ratio2('total_input', 'output')} AS input_output_ratio,
  total_messages AS message_count, cost AS cost_estimate, accuracy, first_ts AS start_time, last_ts AS end_time,
  channel,
  CASE WHEN mins >= 60 THEN (mins // 60) || 'h' WHEN mins > 0 THEN mins || 'm' ELSE '' END AS duration,
  CASE WHEN total_chars >= 10000 THEN (total_chars // 1000) || 'K'
       WHEN total_chars >= 1000
         THEN CAST(CAST(round(total_chars / 1000 + 1e-7, 1) AS DECIMAL(20,1)) AS VARCHAR) || 'K'
       WHEN total_chars > 0 THEN CAST(total_chars AS VARCHAR) ELSE '' END AS size,
  conversation_id, first_msg, second_msg, last_msg, user_turns, assistant_turns, total_messages, total_chars,
  time_start, time_end, system_tokens, thinking_tokens, thinking_output_tokens, sizes, n_sizes, first6_user,
  first6_assistant
FROM (SELECT *, long_title AS short
FROM (SELECT *, CASE WHEN first_msg <> '' THEN {strip(f"regexp_replace(first_msg, '{SPACE}+', ' ', 'g')")}
    WHEN kind IN ('', 'direct') OR kind IS NULL THEN channel ELSE channel || ' · ' || kind END AS long_title
FROM (SELECT u.*, c.* EXCLUDE (conversation_id), o.* EXCLUDE (conversation_id),
    date_diff('second', time_start, time_end) // 60 AS mins,
    CASE split_part(source_id, ':', 3) {' '.join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in M.SOURCE_CHANNELS)}
      WHEN '' THEN {lit(M.OTHER_CHANNEL)} ELSE split_part(source_id, ':', 3) END AS channel
  FROM usage u JOIN context c USING (conversation_id) LEFT JOIN origins o USING (conversation_id))))""",
)

# requests ---------------------------------------------------------------------
_USAGE = (
    "'{\"prompt_tokens\": ' || CASE WHEN event_id % 3 = 0 THEN '0' ELSE CAST(p AS VARCHAR) END || "
    "', \"input_tokens\": ' || (p + 1) || ', \"completion_tokens\": ' || k || ', \"total_tokens\": ' || (p + k) || '}'"
)
cte(
    "requests",
    (),
    f"""SELECT 'r' || event_id AS request_id,
  '{{"model": "' || {pick('user_id % 7', MODELS)} || '", "stream": true}}' AS request_body,
  CASE WHEN user_id % 10 = 0 THEN ' team ' ELSE '' END AS channel_header,
  CASE WHEN user_id % 3 = 0 THEN 8090 ELSE 9000 END AS port,
  CASE event_type {' '.join(f"WHEN {lit(t)} THEN {lit(a)}" for t, a in AGENTS.items())} ELSE '' END AS user_agent,
  CASE event_id % 7 WHEN 0 THEN '{{broken' WHEN 1 THEN '{{"id": "x", "choices": []}}'
    ELSE '{{"id": "x", "usage": ' || {_USAGE} || '}}' END AS body,
  CASE event_id % 7 WHEN 0 THEN 'data: [DONE]' || {_NL} || {_NL}
    WHEN 1 THEN 'data: {{"choices": []}}' || {_NL} || {_NL} || 'data: {{broken "usage"' || {_NL} || {_NL}
    ELSE 'data: {{"choices": [], "usage": {{"prompt_tokens": 1, "completion_tokens": 1, "total_tokens": 2}}}}'
      || {_NL} || {_NL} || 'data: {{"choices": []}}' || {_NL} || {_NL} || 'data: {{"usage": ' || {_USAGE}
      || '}}' || {_NL} || {_NL} || 'data: [DONE]' || {_NL} || {_NL} END AS stream_body,
  k AS response_time_ms, ts, event_id
FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(floor(value * 10) AS BIGINT) AS p FROM events)""",
)
_CHANNEL = (
    "CASE WHEN trim(channel_header) <> '' THEN trim(channel_header) "
    + " ".join(f"WHEN port = {p} THEN {lit(c)}" for p, c in M.PORT_CHANNELS)
    + " "
    + " ".join(f"WHEN regexp_matches(user_agent, {lit(p)}, 'i') THEN {lit(c)}" for p, c in M.AGENT_CHANNELS)
    + " ELSE 'unknown' END"
)
cte("channelled", ("requests",), f"SELECT *, {_CHANNEL} AS channel FROM requests")


def json_or(u: str, first: str, second: str) -> str:
    a = f"CAST(json_extract({u}, '$.{first}') AS BIGINT)"
    b = f"CAST(json_extract({u}, '$.{second}') AS BIGINT)"
    return f"coalesce(nullif({a}, 0), {b}, 0)"


cte(
    "used_requests",
    ("channelled",),
    f"""SELECT * EXCLUDE (j), json_extract_string(request_body, '$.model') AS model,
  {json_or("json_extract(j, '$.usage')", 'prompt_tokens', 'input_tokens')} AS pt,
  {json_or("json_extract(j, '$.usage')", 'completion_tokens', 'output_tokens')} AS ct,
  coalesce(CAST(json_extract(j, '$.usage.total_tokens') AS BIGINT), 0) AS tt,
  json_extract(j, '$.usage') IS NOT NULL AS has_usage
FROM (SELECT *, TRY_CAST(CASE WHEN json_valid(body) THEN body END AS JSON) AS j FROM channelled)""",
)
cte(
    "priced_requests",
    ("used_requests", "prices"),
    f"""SELECT request_id, model, channel, pt AS input_tokens, ct AS output_tokens, tt AS total_tokens, response_time_ms, ts,
  {half_up(f"pt / 1e6 * {price('model', 'price_in')} + ct / 1e6 * {price('model', 'price_out')}", 8)} AS cost
FROM used_requests WHERE has_usage""",
)

# source files -------------------------------------------------------------------


def text(s: str) -> str:
    """A literal that may hold line breaks and tabs."""
    return lit(s).replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '")


def pick_text(index: str, items) -> str:
    return f"list_extract([{', '.join(text(i) for i in items)}], CAST({index} AS INTEGER) + 1)"


def _line(index: str) -> str:
    return (
        f"CASE WHEN doc_id % 2 = 0 THEN {pick_text(f'({index}) % {len(JAVA_LINES)}', JAVA_LINES)} "
        f"ELSE {pick_text(f'({index}) % {len(PYTHON_LINES)}', PYTHON_LINES)} END"
    )


cte(
    "code_files",
    (),
    f"""SELECT 'd' || doc_id AS doc_id, source AS project,
  source || '/src/f' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.java' ELSE '.py' END AS path,
  CASE WHEN doc_id % 2 = 0 THEN 'java' ELSE 'python' END AS language,
  {_line('doc_id // 2')} || chr(10)
    || CASE WHEN doc_id % 4 = 3 THEN {pick_text(f'(doc_id // 4) % {len(PYTHON_PAIRS)}', PYTHON_PAIRS)} ELSE '' END
    || CASE WHEN doc_id % 4 = 1 THEN '# scan-rules: disable=PY-STYLE-002' || chr(10) ELSE '' END || text
    || CASE WHEN doc_id % 4 = 1 THEN chr(10) || '# scan-rules: enable=PY-STYLE-002' ELSE '' END
    || chr(10) || {_line('doc_id // 2 * 5 + 3')} AS text
FROM documents""",
)


def line_table(source: str, columns: str, text_column: str = "text") -> str:
    """Lines of a text column, numbered from 1."""
    clean = f"replace(replace(coalesce({text_column}, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    return (
        f"SELECT {columns}, unnest(string_split({clean}, chr(10))) AS line, "
        f"generate_subscripts(string_split({clean}, chr(10)), 1) AS line_no FROM {source}"
    )


cte("code_lines", ("code_files",), line_table("code_files", "doc_id, project, path, language"))


def re2(pattern: str) -> str:
    """A rule pattern for an engine whose classes are ASCII only and that knows no look-ahead."""
    if pattern.startswith("\\b"):
        pattern = rf"(?:\A|[^\p{{L}}\p{{N}}_]){pattern[2:]}"
    pattern = pattern.replace(
        r"(?!\s*with)", r"\s*(?:\z|[^w\s]|w(?:\z|[^i])|wi(?:\z|[^t])|wit(?:\z|[^h]))"
    )
    out, inside, i = [], False, 0
    while i < len(pattern):
        two, one = pattern[i : i + 2], pattern[i]
        if two in (r"\s", r"\w"):
            members = SPACE if two == r"\s" else WORD
            out.append(members[1:-1] if inside else members)
            i += 2
        elif one == "\\":
            out.append(two)
            i += 2
        else:
            inside = one == "[" or (inside and one != "]")
            out.append(one)
            i += 1
    return "".join(out)


def _rule_arms() -> str:
    from ..rules.code import RULES

    arms = []
    for rule_id, severity, kind, cwe, _, pattern in RULES:
        flag = "'c'" if kind == "style" else "'i'"
        lang = "java" if rule_id.startswith("JAVA") else "python"
        arms.append(
            f"SELECT *, {lit(rule_id)} AS rule_id, {lit(severity)} AS severity, {lit(kind)} AS type, {lit(cwe)} AS cwe "
            f"FROM plain_lines WHERE language = '{lang}' AND regexp_matches(line, {lit(re2(pattern)).replace(chr(10), '')}, {flag})"
        )
    return " UNION ALL ".join(arms)


cte(
    "plain_lines",
    ("code_lines",),
    f"""SELECT * FROM (SELECT *, {strip('line')} AS bare FROM code_lines) WHERE NOT (
  language = 'java' AND (starts_with(bare, '//') OR starts_with(bare, '*') OR starts_with(bare, '/*'))
  OR language = 'python' AND starts_with(bare, '#'))""",
)
cte(
    "findings",
    ("plain_lines",),
    f"""SELECT rule_id || '-' || line_no AS finding_id, project, doc_id, path, language, line_no, rule_id, severity, type,
  cwe, bare AS code FROM ({_rule_arms()})""",
)



def _spanning_arms() -> str:
    from ..operators.scan import spanning_rules

    arms = []
    for rule_id, severity, kind, cwe, _, pattern in spanning_rules():
        pattern = lit(("(?m)" if kind == "style" else "(?im)") + re2(pattern))
        lang = "java" if rule_id.startswith("JAVA") else "python"
        arms.append(
            f"SELECT *, {lit(rule_id)} AS rule_id, {lit(severity)} AS severity, {lit(kind)} AS type, {lit(cwe)} AS cwe, "
            f"string_split_regex(clean, {pattern}) AS pieces, regexp_extract_all(clean, {pattern}) AS found FROM clean_files WHERE language = '{lang}'"
        )
    return " UNION ALL ".join(arms)


cte("clean_files", ("code_files",), "SELECT *, replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS clean FROM code_files")
cte(
    "text_findings",
    ("clean_files",),
    f"""SELECT rule_id || '-' || line_no AS finding_id, project, doc_id, path, language, line_no, rule_id, severity, type, cwe, code FROM (
  SELECT *, 1 + length(ahead) - length(replace(ahead, chr(10), '')) AS line_no,
    {strip("string_split(ahead, chr(10))[-1] || string_split(found[nr], chr(10))[1]")} AS code FROM (
  SELECT *, array_to_string(list_transform(range(1, nr), lambda j: pieces[j] || found[j]), '') || pieces[nr] AS ahead FROM (
  SELECT *, unnest(generate_series(1, len(found))) AS nr FROM ({_spanning_arms()}) WHERE len(found) > 0)))
WHERE NOT starts_with(code, '#')""",
)

# technical documents ------------------------------------------------------------
from ..adapters import TEMPLATES  # noqa: E402

cte(
    "tech_docs",
    (),
    f"""SELECT 'd' || doc_id AS doc_id, source AS project, CASE
  WHEN doc_id % 5 = 4 THEN text
  WHEN doc_id % 2 = 0 THEN tpl || '编号 ' || doc_id || chr(10) || text
  ELSE '编号 ' || doc_id || chr(10) || tpl || text END AS text
FROM (SELECT *, CASE doc_id % 5 {' '.join(f"WHEN {i} THEN {text(t)}" for i, t in enumerate(TEMPLATES))} END AS tpl FROM documents)""",
)
cte("tech_lines", ("tech_docs",), line_table("tech_docs", "doc_id, project"))


def captured(x: str, patterns) -> str:
    """Trimmed group of the first matching pattern."""
    arms = " ".join(
        f"WHEN regexp_matches({x}, {lit(re2(p))}) THEN {strip(f'regexp_extract({x}, {lit(re2(p))}, 1)')}" for p in patterns
    )
    return f"CASE {arms} END"


def _check_arms() -> str:
    from ..rules import documents as D

    def row(name, required, passed, value):
        weight = D.REQUIRED_WEIGHT if required else D.BONUS_WEIGHT
        return (
            f"SELECT doc_id, project, {lit(name)} AS \"check\", {lit(required)} AS required, {passed} AS passed, "
            f"CAST({value} AS VARCHAR) AS value, CASE WHEN {passed} THEN {weight} ELSE 0 END AS score FROM tech_docs"
        )

    mark = "CASE " + " ".join(f"WHEN contains(text, {lit(m)}) THEN {lit(m)}" for m in D.TASK_MARKS) + " END"
    missing = "list_filter([" + ", ".join(
        f"CASE WHEN NOT {any_contains('text', w)} THEN {lit(p)} END" for p, w in D.API_PARTS.items()
    ) + "], lambda x: x IS NOT NULL)"
    has_path = "(" + " OR ".join(f"regexp_matches(text, {lit(re2(p))})" for p in D.PATHS) + ")"
    listed = "(" + " OR ".join(f"regexp_matches(text, {lit('(?m)' + re2(p))})" for p in D.CHECKLIST) + ")"
    accepted = f"({any_contains('text', D.ACCEPTANCE)} AND {listed})"
    dep, eff, pri = captured("text", D.DEPENDENCY), captured("text", D.EFFORT), captured("text", D.PRIORITY)
    bg = any_contains("text", D.BACKGROUND)
    return " UNION ALL ".join(
        [
            row("task_type", True, f"({mark}) IS NOT NULL", mark),
            row("dependencies", True, f"({dep}) IS NOT NULL", dep),
            row("api_definition", True, f"len({missing}) = 0",
                f"CASE WHEN len({missing}) = 0 THEN '完整' ELSE '缺少：' || array_to_string({missing}, ', ') END"),
            row("implementation", True, has_path,
                f"CASE WHEN {has_path} AND {any_contains('text', D.METHODS)} THEN '具体' WHEN {has_path} THEN '较具体' END"),
            row("acceptance_criteria", True, accepted, f"CASE WHEN {accepted} THEN '可执行' END"),
            row("effort", False, f"({eff}) IS NOT NULL", eff),
            row("priority", False, f"({pri}) IS NOT NULL", pri),
            row("background", False, bg, f"CASE WHEN {bg} THEN '有业务背景说明' END"),
        ]
    )


cte("doc_checks", ("tech_docs",), _check_arms())
cte(
    "doc_scores",
    ("doc_checks",),
    """SELECT *, CASE WHEN score >= 90 THEN '优秀' WHEN score >= 80 THEN '良好' WHEN score >= 70 THEN '合格'
  WHEN score >= 60 THEN '需改进' ELSE '不合格' END AS level FROM (
SELECT doc_id, project, CAST(least(sum(score), 100) AS INTEGER) AS score,
  CAST(count(*) FILTER (WHERE required AND passed) AS INTEGER) AS passed_checks FROM doc_checks GROUP BY doc_id, project)""",
)


def _vague() -> str:
    from ..rules import documents as D

    return values("vague", "phrase, hint", D.VAGUE + D.VAGUE_JAVA)


cte("vague", (), _vague())
cte(
    "vague_hits",
    ("tech_lines", "vague"),
    f"""SELECT doc_id, line_no, phrase, hint, {strip('line')} AS context FROM tech_lines JOIN vague ON contains(line, phrase)""",
)

# tasks ----------------------------------------------------------------------------
from ..adapters import EVENT_MODULES, RUN_STATUS, RUN_TYPES, SENTENCES, TYPES  # noqa: E402

cte(
    "tasks",
    (),
    f"""SELECT project, seq, module, content, task_type, section_path, k % 97 AS line_num,
  CASE WHEN seq % 10 = 0 THEN 'TODO 其他说明' WHEN seq % 10 = 1 THEN '第1步：' || content || '；' || repeat(base, 30)
    ELSE 'a. ' || content END AS raw_text
FROM (SELECT *, CASE (seq // {len(SENTENCES)}) % 3 WHEN 0 THEN base WHEN 1 THEN base || k ELSE base || '，编号' || seq END AS content
FROM (SELECT 'p' || user_id AS project, event_id AS seq, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
  {pick(f'event_id % {len(SENTENCES)}', SENTENCES)} AS base,
  CASE event_type {' '.join(f"WHEN {lit(t)} THEN {lit(m)}" for t, (m, _) in EVENT_MODULES.items())} END AS module,
  CASE event_type {' '.join(f"WHEN {lit(t)} THEN {lit(s)}" for t, (_, s) in EVENT_MODULES.items())} END AS section_path,
  {pick(f'event_id % {len(TYPES)}', TYPES)} AS task_type FROM events))""",
)
cte(
    "plan_tasks",
    ("tasks",),
    """SELECT project, seq, content AS description, CASE WHEN seq % 4 = 0 AND prev IS NOT NULL THEN
    CASE WHEN seq % 3 = 0 THEN 2 ELSE 1 END ELSE 0 END AS links
FROM (SELECT *, lag(seq) OVER (PARTITION BY project ORDER BY seq) AS prev FROM tasks)""",
)
cte(
    "records",
    (),
    """SELECT 'task-' || l_orderkey || '-' || l_linenumber AS task_content,
  CASE l_returnflag WHEN 'A' THEN '接口任务' WHEN 'N' THEN '数据库任务' ELSE '前端任务' END AS task_type,
  'm' || (l_suppkey % 20) AS module, l_quantity AS predicted_days,
  l_quantity * (CAST(1.0 AS DOUBLE) + l_discount) + l_tax AS actual_days, l_shipdate AS recorded_at FROM lineitem""",
)
cte(
    "runs",
    (),
    f"""SELECT 'p' || user_id AS project, 't' || event_id AS case_id, {pick('event_id % 5', RUN_TYPES)} AS type,
  CASE event_type {' '.join(f"WHEN {lit(e)} THEN {lit(s)}" for e, s in RUN_STATUS.items())} ELSE 'error' END AS status,
  CASE WHEN event_id % 20 = 0 THEN 'old' ELSE 'new' END AS cohort, value AS duration FROM events""",
)
