"""DuckDB SQL for the registered queries.

The SQL is written from the meaning of each operator, not from its Spark plan: blocks are matched
with plain range joins, counts are taken over the lines of a body, dialect gaps (no
lookahead) are closed by rewriting the line first.
"""

from __future__ import annotations

import re

from checks import queries as Q
from lintlake.catalog import dims, frameworks as FW, rules as R
from lintlake.config import ReviewConfig, user_rules
from lintlake.functions.regex import escape_literal
from lintlake.functions.text import WHITE_SPACE
from lintlake.sinks.reports import FOOTER  # noqa: F401
from lintlake.sources.derived import BLOCKS, DIRS, EXTS, LONG, ROOT


def compiles(pattern: str) -> bool:
    try:
        re.compile(pattern)
        return True
    except re.error:
        return False


def s(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def arr(items) -> str:
    return "[" + ", ".join(s(i) for i in items) + "]"


def rx(column: str, pattern: str, icase: bool = False) -> str:
    return f"regexp_matches({column}, {s(pattern)}{', ' + s('i') if icase else ''})"


def repl(column: str, pattern: str, by: str, flags: str = "g") -> str:
    return f"regexp_replace({column}, {s(pattern)}, {s(by)}, {s(flags)})"


WS = s(WHITE_SPACE)
LF = "chr(10)"


def trim(column: str) -> str:
    return f"trim({column}, {WS})"


def has(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {s(w)})" for w in words) + ")" if words else "false"


def starts(column: str, words) -> str:
    return "(" + " OR ".join(f"starts_with({column}, {s(w)})" for w in words) + ")"


def lang_in(langs) -> str:
    return "lang_id IN (" + ", ".join(s(x) for x in langs) + ")"


# corpora ---------------------------------------------------------------------------------------------------

BODY = f"""array_to_string(list_transform(range(0, o_orderkey % 5 + 1), lambda k: replace(
           ({arr(BLOCKS)})[(o_orderkey + k * (o_orderkey % 7)) % {len(BLOCKS)} + 1], '@', (o_orderkey * 10 + k)::VARCHAR)), {LF})"""
CODE = f"""code AS (
  SELECT '{ROOT}/' || ({arr(DIRS)})[(o_custkey // {len(EXTS)}) % {len(DIRS)} + 1] || '/f' || o_orderkey || '.' || ({arr(EXTS)})[o_custkey % {len(EXTS)} + 1] AS path,
         {BODY} AS content
  FROM orders)"""
LONG_FILES = f"""long_code AS (
  SELECT '{ROOT}/long/g' || (o_orderkey // {LONG}) || '.' || ({arr(EXTS)})[(o_orderkey // {LONG}) % {len(EXTS)} + 1] AS path,
         string_agg({BODY}, {LF} ORDER BY o_orderkey) AS content
  FROM orders GROUP BY o_orderkey // {LONG})"""
TEXT = """text_files AS (
  SELECT 'docs/' || source || '/d' || doc_id || '.html' AS path, text AS content FROM documents
  UNION ALL SELECT 'pages/p' || page_id || '.html', html FROM pages)"""
LANGS = ("langs(ext, lang_id, lang_name, family) AS (VALUES "
         + ", ".join("(" + ", ".join(s(x) for x in r) + ")" for r in dims.extension_rows()) + ")")
NORM = "replace(path, chr(92), '/')"
EXCLUDED = "(" + " OR ".join(
    f"contains({NORM}, '/{d}/') OR ends_with({NORM}, '/{d}') OR starts_with({NORM}, '{d}/')" for d in dims.EXCLUDED_DIRS) + ")"
EXT = """CASE WHEN ends_with(lower(path), 'dockerfile') OR contains(lower(path), 'dockerfile.') THEN '.dockerfile'
  ELSE regexp_extract(lower(path), '(\\.[^.]*)$', 1) END"""


def ready(source: str, name: str = "ready", where: str = "true") -> str:
    return f"""{name} AS (
  SELECT path, content, lang_id, lang_name, family FROM (SELECT *, {EXT} AS ext FROM {source}) JOIN langs USING (ext)
  WHERE NOT {EXCLUDED} AND {where})"""


def exploded(source: str, name: str = "lines") -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT path, lang_id, family, n_lines, unnest(range(1, n_lines + 1))::INTEGER AS line_no, unnest(ls) AS text
  FROM (SELECT *, string_split(content, {LF}) AS ls, len(string_split(content, {LF})) AS n_lines FROM {source}))"""


FLAGGED = f"""flagged AS (
  SELECT *, {starts('trimmed', ('//', '#', '*'))} AS skip_hash, {starts('trimmed', ('//', '#', '*', '<!--'))} AS skip_html,
         ({starts('trimmed', ('//', '#', '*'))} OR trimmed = '') AS skip_hash_blank, starts_with(trimmed, '//') AS skip_slashes
  FROM (SELECT *, {trim('text')} AS trimmed FROM lines))"""
CODE_LINES = [CODE, LANGS, ready("code"), exploded("ready"), FLAGGED]
BOTH = "both_files AS (SELECT * FROM code UNION ALL SELECT * FROM text_files)"
BOTH_LINES = [CODE, TEXT, BOTH, LANGS, ready("both_files"), exploded("ready"), FLAGGED]


def sql(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


# rules -----------------------------------------------------------------------------------------------------

def after_last(pattern: str) -> str:
    """Text after the last match of the pattern (null without a match)."""
    return f"CASE WHEN {rx('text', pattern)} THEN {repl('text', '^(?s:.*)(?:' + pattern + ')', '', '')} END"


def no_look_ahead() -> dict[str, str]:
    """Rules whose pattern RE2 cannot express, as conditions on rewritten lines."""
    c3 = "\x03"
    r01 = repl("text", r"(\w\.(?:if|while))\b", r"\1_")
    r01 = repl(r01, r"^(?s:.*)(?:\bi(f\b)|\bw(hile\b)|\?(\.))", r"\1\2\3", "")
    r03 = repl("text", r"\[(\w+)\](\s*[=?])", r"(\1\2")
    r05 = repl("text", r"(^|\s)await(\s)", rf"\1{c3}\2")
    p09 = repl("text", r";\s*WHERE", c3, "gi")
    return {
        "S06": rx("text", r"\.innerHTML\s*=(?:[^=]|$)|\.outerHTML\s*=(?:[^=]|$)|document\.write\s*\("),
        "P09": rx(p09, r"SELECT\s+[\s\S]*?FROM\s+\w+\s*(?:;|$)", True),
        "R01": rx(r01, r"\w\.(?:\w\w|\w(?:$|\s*(?:$|[^\s!=<>?]|\?(?:[^.]|$))))"),
        "R02": rx("text", r"/\s*\w+\s*[;,)\]]"),
        "R03": f"({rx(r03, r'\[\w+\]')} AND NOT {rx(repl(r03, r'^(?s:.*)\[\w+\]', '', ''), r'\b(?:length|size)\b')})",
        "R04": f"coalesce(NOT {rx('(' + after_last(r'new\s+Promise|\.then\s*\(') + ')', r'\.catch|\.finally')}, false)",
        "R05": rx(r05, r"(?:^|\s)\w+\s*\(\s*\)(?:\s*;)?\s*(?://.*)?$"),
        "R06": f"coalesce(NOT {rx('(' + after_last(r'(?:fs\.open|fopen|open)\s*\(') + ')', r'\.close|with\s|using\s|try\s')}, false)",
        "R08": f"coalesce(NOT {rx('(' + after_last(r'\w\.\w+\s*\(') + ')', r'\bnull\b|\bif\b')}, false)",
        "R12": rx("text", r"\bas\s+(?:\w\w|\w\s*(?:[^\s|]|$))"),
    }


SPECIAL = no_look_ahead()
SKIP = {"hash": "skip_hash", "html": "skip_html", "hash_blank": "skip_hash_blank", "slashes": "skip_slashes"}


def condition(r: R.Rule) -> str:
    tests = []
    if r.langs is not None:
        tests.append(lang_in(r.langs))
    if r.comment_mode != "none":
        tests.append("NOT " + SKIP[r.comment_mode])
    tests.append(SPECIAL.get(r.uid) or rx("text", r.pattern, r.ignore_case))
    if r.unless:
        tests.append("NOT " + rx("text", r.unless))
    return " AND ".join(tests)


def dim(rules) -> str:
    rows = ", ".join(f"({s(r.uid)}, {r.analyzer}, {r.step}, {s(r.rule_id)}, {s(dims.label(r.category))}, {s(r.severity)}, "
                     f"{dims.SEVERITY_RANK[r.severity]}, {r.confidence}::DOUBLE, {s(r.message)}, {s(r.explanation)}, {s(r.fix)})" for r in rules)
    return f"dim(uid, analyzer, step, rule_id, category, severity, sev_rank, confidence, message, explanation, suggested_fix) AS (VALUES {rows})"


ALL_RULES = list(R.BY_UID.values()) + user_rules([])
DIM = dim(ALL_RULES)
SLIM = "path, lang_id, line_no, end_line, uid, args, pos, ord, text"


def scan(rules, name: str, source: str = "flagged") -> str:
    hits = ", ".join(f"CASE WHEN {condition(r)} THEN {{'uid': {s(r.uid)}, 'ord': {n}}} END" for n, r in enumerate(rules))
    return f"""{name} AS (
  SELECT path, lang_id, line_no, NULL::INTEGER AS end_line, hit.uid AS uid, []::VARCHAR[] AS args, line_no AS pos, hit.ord AS ord, text
  FROM (SELECT path, lang_id, line_no, text, unnest([{hits}]) AS hit FROM {source}) WHERE hit IS NOT NULL)"""


def full(found: str, name: str = "full_findings") -> str:
    def filled(c: str) -> str:
        out = c
        for n in range(3):
            out = f"replace({out}, '{{{n}}}', coalesce(args[{n + 1}], '{{{n}}}'))"
        return f"{out} AS {c}"

    return f"""{name} AS MATERIALIZED (
  SELECT path, lang_id, line_no, end_line, severity, sev_rank, category, {filled('message')}, {filled('explanation')},
         {filled('suggested_fix')}, confidence, rule_id, analyzer, step, pos, ord, text FROM {found} JOIN dim USING (uid))"""


SHOWN = "SELECT path, line_no, severity, category, rule_id, message, confidence FROM full_findings"
NO_TEXT = "SELECT path, line_no, severity, category, rule_id, message FROM "


def found(name: str, body: str) -> str:
    """A finding CTE with the columns of the slim form."""
    return f"{name} AS (SELECT {SLIM} FROM ({body}))"


def shown(base: list[str], cte: str, name: str = "found", rules=None) -> str:
    return sql([*base, cte, DIM if rules is None else dim(rules), full(name)], SHOWN)


def row(uid: str, args: str = "[]::VARCHAR[]", line_no: str = "line_no", end: str = "NULL::INTEGER", pos: str = "line_no",
        ord: str = "0", text: str = "text") -> str:
    return (f"SELECT path, lang_id, {line_no} AS line_no, {end} AS end_line, {uid if '(' in uid or ' ' in uid else s(uid)} AS uid, {args} AS args, "
            f"{pos} AS pos, {ord} AS ord, {text} AS text")


MAGIC = next(r for r in R.STYLE_RULES if r.uid == "A07")
PLAIN_STYLE = [r for r in R.STYLE_RULES if r.uid != "A07"]
STYLE = [
    scan(PLAIN_STYLE, "style_plain"),
    found("style_magic", f"{row('A07', '[num]', ord=str(len(R.STYLE_RULES)))} FROM (SELECT *, regexp_extract(text, {s(MAGIC.pattern)}, 1) AS num "
          f"FROM flagged WHERE family IN ('c-style', 'scripting')) WHERE num <> '' AND num NOT IN ({', '.join(s(x) for x in R.MAGIC_ALLOWED)})"),
    "found_style AS (SELECT * FROM style_plain UNION ALL SELECT * FROM style_magic)",
]
TODO = found("found_todo", f"""{row('A12', f"[upper(regexp_extract(trimmed, {s(R.TODO_PATTERN)}, 1, 'i')), substring(regexp_extract(trimmed, {s(R.TODO_PATTERN)}, 2, 'i'), 1, 80)]", ord='1')}
  FROM flagged WHERE {rx('trimmed', R.TODO_PATTERN, True)}""")
NAMING = found("found_naming", f"""{row('A15', '[name]')} FROM (SELECT *, CASE WHEN lang_id = 'python' THEN regexp_extract(text, {s(R.SINGLE_LETTER_PYTHON)}, 1)
  WHEN family = 'c-style' THEN regexp_extract(text, {s(R.SINGLE_LETTER_C)}, 1) ELSE '' END AS name FROM flagged)
  WHERE name <> '' AND name NOT IN ({', '.join(s(x) for x in R.SINGLE_LETTER_ALLOWED)}) AND NOT {rx('text', r'\b(?:for|while)\b')}""")


def forbidden(names) -> str:
    parts = [f"{row('A14', f'[{s(n)}]', pos=str(i), ord='line_no')} FROM flagged WHERE NOT skip_hash AND {rx('text', r'\b' + escape_literal(n) + r'\s*\(')}"
             for i, n in enumerate(names)]
    return found("found_forbidden", " UNION ALL ".join(parts))


# sequences -------------------------------------------------------------------------------------------------

W = "OVER (PARTITION BY path ORDER BY line_no"
UNREACHABLE = f"""seq4 AS (
  SELECT *, list({{'line_no': line_no, 'trimmed': trimmed, 'text': text}}) {W} ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS nexts FROM flagged),
exits AS (SELECT path, lang_id, line_no AS origin,
  list_filter(nexts, lambda x: NOT (x.trimmed IN ('', '}}', ')') OR {starts('x.trimmed', ('//', '#', '*'))}))[1] AS hit FROM seq4
  WHERE {rx('trimmed', r'^(?:return|break|continue|throw|exit|sys\.exit|os\.Exit|panic)\b')}),
""" + found("found_unreachable", f"""{row('A11', '[hit.line_no::VARCHAR, origin::VARCHAR]', 'hit.line_no', pos='origin', text='hit.text')} FROM exits
  WHERE hit IS NOT NULL AND NOT {rx('hit.trimmed', r'^(?:case|default|catch|except|else|elif|elsif|finally|\}\s*(?:else|catch|finally))')}""")
EMPTY_CATCH = f"""seq3 AS (SELECT *, list(trimmed) {W} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS nexts FROM flagged),
""" + found("found_empty_catch", f"""{row('A13')} FROM seq3 WHERE
  (family = 'c-style' AND {rx('trimmed', r'\bcatch\s*\(')} AND ({rx('trimmed', r'\{\s*\}')}
     OR coalesce(list_filter(nexts, lambda x: x NOT IN ('', '{{'))[1] = '}}', false)))
  OR (lang_id = 'python' AND {rx('trimmed', r'^except\b')} AND coalesce(nexts[1] = 'pass', false))""")
JS = lang_in(R.JS_TS)
AWAITS = f"""seq1 AS (SELECT *, lead(trimmed) {W}) AS next1 FROM flagged WHERE {JS}),
""" + found("found_awaits", f"""{row('X07')} FROM seq1 WHERE {rx('trimmed', r'^(?:const|let|var)\s+\w+\s*=\s*await\b')}
  AND {rx("coalesce(next1, '')", r'^(?:const|let|var)\s+\w+\s*=\s*await\b')}""")
JSON_TRY = f"""tries AS (SELECT *, bool_or({rx('text', r'\btry\s*\{')} OR trimmed IN ('try:', 'try {{')) {W} ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS guarded
  FROM flagged WHERE {JS}),
""" + found("found_json", f"{row('X01')} FROM tries WHERE {rx('text', r'JSON\.parse\s*\(')} AND NOT guarded")
DESTRUCTURE = f"""checked AS (SELECT *, coalesce(bool_or(contains(text, '.length') OR contains(text, 'if (')) {W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), false) AS ok
  FROM flagged WHERE {JS}),
""" + found("found_destructure", f"{row('X06', ord='1')} FROM checked WHERE {rx('trimmed', r'(?:const|let)\s*\[.+\]\s*=')} AND NOT ok")
TIMEOUT = f"""looped AS (SELECT *, coalesce(bool_or({rx('text', r'\b(?:for|while|forEach|map)\b')}) {W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), false) AS near
  FROM flagged WHERE {JS}),
""" + found("found_timeout", f"{row('X10')} FROM looped WHERE {rx('text', r'\bsetTimeout\s*\(')} AND near")
NESTED = f"""moves AS (SELECT *, CASE WHEN {rx('trimmed', r'\b(?:for|while|do)\b\s*[\(\{:]')} THEN 1 ELSE 0 END AS inc,
    greatest(0, (length(text) - length(replace(text, '}}', ''))) - (length(text) - length(replace(text, '{{', '')))) AS dec FROM flagged),
run AS (SELECT *, sum(inc - dec) {W}) AS sm FROM moves),
clamped AS (SELECT *, sm - least(0, min(sm) {W})) AS d FROM run),
depths AS (SELECT *, coalesce(lag(d) {W}), 0) + inc AS at_depth FROM clamped),
outers AS (SELECT *, max(CASE WHEN inc = 1 AND at_depth = 1 THEN line_no END) {W}) AS outer_line FROM depths),
""" + found("found_nested", f"{row('P20', '[line_no::VARCHAR, outer_line::VARCHAR]')} FROM outers WHERE inc = 1 AND at_depth >= 3")

# blocks ----------------------------------------------------------------------------------------------------


def names_sql(patterns) -> str:
    parts = []
    for p in patterns:
        icase = p.startswith("(?i)")
        groups = re.compile(p).groups
        opts = ", 'i'" if icase else ""
        bare = p.removeprefix("(?i)")
        got = ", ".join(f"nullif(regexp_extract(text, {s(bare)}, {g}{opts}), '')" for g in range(1, groups + 1))
        parts.append(f"CASE WHEN {rx('text', bare, icase)} THEN coalesce({got}, 'anonymous') END")
    return f"coalesce({', '.join(parts)})" if len(parts) > 1 else parts[0]


FUNCTION_NAME = ("CASE lang_id " + " ".join(f"WHEN {s(l)} THEN {names_sql(p)}" for l, p in R.FUNCTION_STARTS.items() if l != "javascript")
                 + f" ELSE {names_sql(R.FUNCTION_STARTS['javascript'])} END")


def decisions(key: str) -> str:
    words, ops = R.DECISIONS[key]
    return f"len(regexp_extract_all(text, {s(rf'\b(?:{words}{'|' + ops if ops else ''})\b')}))"


DECISION_COUNT = (f"CASE lang_id WHEN 'python' THEN {decisions('python')} WHEN 'ruby' THEN {decisions('ruby')} "
                  f"WHEN 'go' THEN {decisions('go')} ELSE {decisions('default')} END")
# every brace with its place and the running depth after it; a start's base depth is the depth before its line
BRACES = """brace_rows AS (SELECT path, line_no, unnest(range(1, len(bs) + 1)) AS k, unnest(bs) AS b
  FROM (SELECT path, line_no, regexp_extract_all(text, '[{}]') AS bs FROM flagged)),
braces AS MATERIALIZED (SELECT *, sum(CASE b WHEN '{' THEN 1 ELSE -1 END) OVER (PARTITION BY path ORDER BY line_no, k) AS depth FROM brace_rows)"""


def closing(starts_cte: str, name: str) -> str:
    """Adds ``closed`` to the rows of a CTE with path, line_no."""
    return f"""{name}_base AS (SELECT st.path, st.line_no,
    coalesce((SELECT sum(CASE b.b WHEN '{{' THEN 1 ELSE -1 END) FROM braces b WHERE b.path = st.path AND b.line_no < st.line_no), 0) AS base,
    (SELECT min((b.line_no, b.k)) FROM braces b WHERE b.path = st.path AND b.line_no >= st.line_no AND b.b = '{{') AS opened
  FROM (SELECT DISTINCT path, line_no FROM {starts_cte}) st),
{name} AS MATERIALIZED (SELECT f.path, f.line_no, min(b.line_no) AS closed FROM {name}_base f
  LEFT JOIN braces b ON b.path = f.path AND b.depth = f.base AND f.opened IS NOT NULL AND (b.line_no, b.k) >= f.opened
  GROUP BY f.path, f.line_no)"""


FUNCTIONS = [
    BRACES,
    f"starts AS MATERIALIZED (SELECT * FROM (SELECT *, {FUNCTION_NAME} AS name, length(text) - length(ltrim(text, {WS})) AS indent FROM flagged) WHERE name IS NOT NULL)",
    "brace_starts AS (SELECT * FROM starts WHERE lang_id NOT IN ('python', 'ruby'))",
    closing("brace_starts", "closings"),
    f"indents AS (SELECT path, line_no, length(text) - length(ltrim(text, {WS})) AS indent FROM flagged WHERE lang_id IN ('python', 'ruby') AND trimmed <> '')",
    """indent_ends AS (SELECT st.path, st.line_no, coalesce(min(i.line_no) - 1, any_value(st.n_lines))::INTEGER AS end_line FROM starts st
  LEFT JOIN indents i ON i.path = st.path AND i.line_no > st.line_no AND i.indent <= st.indent
  WHERE st.lang_id IN ('python', 'ruby') GROUP BY st.path, st.line_no)""",
    """functions AS MATERIALIZED (SELECT st.path, st.lang_id, st.line_no, st.text, st.name,
    coalesce(i.end_line, c.closed, least(st.line_no + 49, st.n_lines))::INTEGER AS end_line
  FROM starts st LEFT JOIN closings c USING (path, line_no) LEFT JOIN indent_ends i USING (path, line_no))""",
]
COMPLEXITY = [
    f"decided AS MATERIALIZED (SELECT path, line_no, {DECISION_COUNT} AS n FROM flagged)",
    """measured AS MATERIALIZED (SELECT f.path, f.lang_id, f.line_no, f.text, f.name, f.end_line, f.end_line - f.line_no + 1 AS line_count,
    (1 + sum(d.n))::INTEGER AS complexity FROM functions f JOIN decided d ON d.path = f.path AND d.line_no BETWEEN f.line_no AND f.end_line
  GROUP BY ALL)""",
]


def long_found(limit: int) -> str:
    return found("found_long", f"""{row(f"(CASE WHEN line_count > {2 * limit} THEN 'C01H' ELSE 'C01' END)", f"[name, line_count::VARCHAR, '{limit}']", end='end_line')}
  FROM measured WHERE line_count > {limit}""")


def complex_found(limit: int) -> str:
    return found("found_complex", f"""{row(f"(CASE WHEN complexity > {2 * limit} THEN 'C02H' ELSE 'C02' END)", f"[name, complexity::VARCHAR, '{limit}']", end='end_line', ord='1')}
  FROM measured WHERE complexity > {limit}""")


def marked_lines(pattern: str, groups: str, source: str, name: str) -> str:
    """Lines of texts in which each match is preceded by chr(1) name chr(2)."""
    return f"""{name} AS (SELECT path, lang_id, n_lines, unnest(range(1, n_lines + 1))::INTEGER AS line_no, unnest(ls) AS marked FROM (
    SELECT path, lang_id, len(string_split(content, {LF})) AS n_lines,
           string_split(regexp_replace(content, {pattern}, chr(1) || {s(groups)} || chr(2) || '\\0', 'g'), {LF}) AS ls FROM {source}))"""


ASYNC = [
    f"async_files AS (SELECT * FROM ready WHERE {JS})",
    marked_lines(s(r"async\s+(?:function\s+)?(\w+)"), r"\1", "async_files", "async_lines"),
    """async_starts AS (SELECT path, lang_id, line_no, n_lines, unnest(range(0, len(ns))) AS k, unnest(ns) AS name, text
  FROM (SELECT *, regexp_extract_all(marked, chr(1) || '(\\w*)' || chr(2), 1) AS ns, regexp_replace(marked, chr(1) || '\\w*' || chr(2), '', 'g') AS text FROM async_lines))""",
    closing("async_starts", "async_ends"),
    """async_bodies AS (SELECT a.path, a.lang_id, a.line_no, a.k, a.name, a.text,
    bool_or(contains(l.text, 'await')) AS waits, bool_or(contains(l.text, 'try') OR contains(l.text, '.catch')) AS guards
  FROM async_starts a JOIN async_ends e USING (path, line_no)
  JOIN lines l ON l.path = a.path AND l.line_no BETWEEN a.line_no AND least(coalesce(e.closed, a.n_lines), a.line_no + 199) GROUP BY ALL)""",
    found("found_async", f"{row('X03', '[name]', ord='k')} FROM async_bodies WHERE waits AND NOT guards"),
]
SWITCH = [
    f"switches AS (SELECT * FROM flagged WHERE {rx('trimmed', r'\bswitch\s*\(')})",
    closing("switches", "switch_ends"),
    """switch_bodies AS (SELECT w.path, w.lang_id, w.line_no, w.text, least(coalesce(e.closed, w.n_lines), w.line_no + 199, w.n_lines)::INTEGER AS end_line,
    sum(contains(l.text, 'default:')::INTEGER + contains(l.text, 'default :')::INTEGER)::INTEGER AS defaults
  FROM switches w JOIN switch_ends e USING (path, line_no)
  JOIN lines l ON l.path = w.path AND l.line_no BETWEEN w.line_no AND least(coalesce(e.closed, w.n_lines), w.line_no + 199, w.n_lines) GROUP BY ALL)""",
    found("found_switch", f"{row('X05')} FROM switch_bodies WHERE defaults = 0"),
]

# names -----------------------------------------------------------------------------------------------------


def unused() -> list[str]:
    """Runs of '=' are masked first, so that '=(?!=)' can be written as '='."""
    parts = []
    for lang, p in R.DECLARATIONS.items():
        masked = lang in ("python", "ruby")
        source = f"(SELECT path, lang_id, {repl('content', '={2,}', chr(3)) if masked else 'content'} AS content FROM ready WHERE lang_id = {s(lang)})"
        parts.append("SELECT * FROM (WITH " + marked_lines(s(p.replace("(?!=)", "")), r"\1\2" if lang == "go" else r"\1", source, "m") + " SELECT * FROM m)")
    return [
        "decl_lines AS (" + " UNION ALL ".join(parts) + ")",
        """declared AS (SELECT path, lang_id, line_no, unnest(range(0, len(ns))) AS k, unnest(ns) AS name
  FROM (SELECT *, regexp_extract_all(marked, chr(1) || '(\\w*)' || chr(2), 1) AS ns FROM decl_lines))""",
        """words AS (SELECT path, word, count(*) AS n FROM (SELECT path, unnest(regexp_extract_all(content, '\\w+')) AS word FROM ready) GROUP BY ALL)""",
        found("found_unused", f"""{row('A10', '[name]', 'd.line_no', pos='d.line_no', ord='k').replace('SELECT path, lang_id', 'SELECT d.path, d.lang_id')}
  FROM declared d JOIN words w ON w.path = d.path AND w.word = d.name AND w.n = 1 JOIN lines l ON l.path = d.path AND l.line_no = d.line_no
  WHERE length(name) > 1 AND NOT starts_with(name, '_')"""),
    ]


LISTENERS = [
    f"""added AS (SELECT path, lang_id, content, unnest(range(0, len(es))) AS k, unnest(es) AS event FROM (SELECT *,
      regexp_extract_all(content, {s(r"\.addEventListener\s*\(\s*['" + '"' + r"`](\w+)['" + '"' + r"`]")}, 1) AS es FROM ready WHERE {JS}))""",
    f"""leaked AS (SELECT path, lang_id, event, min(k) AS k FROM added WHERE NOT list_contains(
      regexp_extract_all(content, {s(r"\.removeEventListener\s*\(\s*['" + '"' + r"`](\w+)['" + '"' + r"`]")}, 1), event) GROUP BY ALL)""",
    """leak_lines AS (SELECT a.path, a.lang_id, a.event, a.k, min(l.line_no) AS line_no, arg_min(l.text, l.line_no) AS text FROM leaked a
  JOIN lines l ON l.path = a.path AND contains(l.text, 'addEventListener') AND contains(l.text, a.event) GROUP BY ALL)""",
    found("found_listeners", f"{row('R20', '[event]', pos='k')} FROM leak_lines"),
]
INTERVALS = [found("found_intervals", f"""{row('X09')} FROM (SELECT path, lang_id, min(line_no) AS line_no, arg_min(text, line_no) AS text FROM lines
  WHERE {JS} AND contains(text, 'setInterval(') AND path NOT IN (SELECT path FROM lines WHERE contains(text, 'clearInterval(')) GROUP BY ALL)""")]


def frameworks(forced=(), source: str = "ready") -> str:
    parts = [f"SELECT {s(n)} AS framework WHERE EXISTS (SELECT 1 FROM {source} WHERE {' OR '.join(rx('content', p) for p in ps)})" for n, ps in FW.DETECT.items()]
    parts += [f"SELECT {s(n)}" for n in forced]
    return "active AS MATERIALIZED (" + " UNION ".join(parts) + ")"


def suppressed(text: str, rule: str | None, in_file: bool = False) -> str:
    parts = []
    for f in FW.SUPPRESS:
        rule_test = "true" if rule is None and "ai/code-duplication" in f.rule_ids else f"{rule} IN ({', '.join(s(x) for x in f.rule_ids)})"
        on = f"list_contains(fws, {s(f.framework)})" if in_file else f"{s(f.framework)} IN (SELECT framework FROM active)"
        parts.append(f"({on} AND {lang_in(f.langs)} AND {rule_test} AND {rx(text, f.pattern)})")
    return "(" + " OR ".join(parts) + ")"


# duplicates ------------------------------------------------------------------------------------------------

STRUCTURE = ("array_to_string(list_transform(regexp_extract_all(" +
             repl(repl("trimmed", "'[^']*'|\"[^\"]*\"|`[^`]*`", "$STR"), r"\b\d+(?:\.\d+)?\b", "$NUM") +
             f", '[A-Za-z0-9_]+|[^A-Za-z0-9_]+'), lambda t: CASE WHEN regexp_full_match(t, '[a-zA-Z_]\\w*') AND t NOT IN "
             f"({', '.join(s(w) for w in R.STRUCTURE_WORDS)}) THEN '$ID' ELSE t END), '')")
CODE_KEY = f"trim({repl(STRUCTURE, r'\s+', ' ')}, ' ')"
COUNTS = f"(length(trimmed) >= 20 AND NOT {starts('trimmed', ('//', '#', '*', '/*', 'import ', 'from '))})"


def duplicates(k: int, in_file: bool = False) -> list[str]:
    source = "flagged JOIN file_fws USING (path)" if in_file else "flagged"
    return [
        f"reduced AS (SELECT path, lang_id, line_no, n_lines, text, CASE WHEN {COUNTS} THEN {CODE_KEY} END AS code, "
        f"CASE WHEN {COUNTS} THEN {suppressed('trimmed', None, in_file)} END AS quiet FROM {source})",
        f"""windows AS (SELECT path, lang_id, line_no, n_lines, text, list(code) FILTER (code IS NOT NULL) {W} ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING) AS codes,
    coalesce(bool_or(quiet) {W} ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING), false) AS quiet FROM reduced)""",
        f"""firsts AS (SELECT *, min(line_no) OVER (PARTITION BY path, array_to_string(codes, {LF})) AS first_line FROM windows
  WHERE line_no <= n_lines - {k} + 1 AND len(codes) >= {k - 1} AND NOT quiet)""",
        found("found_duplicates", f"{row('X04', '[first_line::VARCHAR]', end=f'line_no + {k - 1}')} FROM firsts WHERE line_no > first_line"),
    ]


# findings for the filter, roll-up and report queries ---------------------------------------------------------

USER = scan(user_rules([]), "found_user")
BASE = [*CODE_LINES, scan(R.SECURITY_RULES, "found_security"), scan(R.PERFORMANCE_RULES, "found_performance"), *STYLE, USER, *unused(), JSON_TRY,
        "found AS (" + " UNION ALL ".join(f"SELECT {SLIM} FROM {n}" for n in
                                          ("found_security", "found_performance", "found_style", "found_user", "found_unused", "found_json")) + ")",
        DIM, full("found")]


def dedup(source: str, name: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT * FROM {source}
  QUALIFY row_number() OVER (PARTITION BY path, line_no, category, message ORDER BY analyzer, step, pos, ord) = 1)"""


KEPT = [*BASE, "confident AS (SELECT * FROM full_findings WHERE confidence >= 0.6)", dedup("confident", "kept")]
STATUS = f"""status AS (SELECT path, CASE WHEN {EXCLUDED} THEN 'excluded' ELSE coalesce(lang_name, 'unknown') END AS language
  FROM (SELECT path, {EXT} AS ext FROM code) LEFT JOIN langs USING (ext))"""
ORDER = "ORDER BY sev_rank DESC, line_no, analyzer, step, pos, ord"
REL = f"replace({NORM}, '{ROOT}/', '')"


def review(config: ReviewConfig, where: str = "true", source: str = "code", in_file: bool = False, ignores: bool = True) -> list[str]:
    """All analyzers, filters and dedup: CTE ``reviewed``. ``where`` limits the files, not those that frameworks are looked for in."""
    if ignores and config.ignore_paths:
        where = f"{where} AND NOT ({' OR '.join(f"contains({NORM}, '/{n}/')" for n in config.ignore_paths)})"
    parts = ["found_security", "found_performance", "found_runtime", "found_style", "found_user", "found_context", "found_todo", "found_naming",
             "found_forbidden", "found_unreachable", "found_empty_catch", "found_awaits", "found_json", "found_destructure", "found_timeout",
             "found_nested", "found_long", "found_complex", "found_async", "found_switch", "found_unused", "found_listeners", "found_intervals",
             "found_duplicates"]
    custom = user_rules(config.custom_rules, compiles)
    per_file = "file_fws AS MATERIALIZED (SELECT path, list_filter([" + ", ".join(
        f"CASE WHEN {' OR '.join(rx('content', p) for p in ps)}{' OR true' if n in config.enable_frameworks else ''} THEN {s(n)} END"
        for n, ps in FW.DETECT.items()) + "], lambda x: x IS NOT NULL) AS fws FROM ready)"
    return [
        *([CODE] if source == "code" else []), LANGS, ready(source, where=where), exploded("ready"), FLAGGED,
        scan(R.SECURITY_RULES, "found_security"), scan(R.PERFORMANCE_RULES, "found_performance"), scan(R.RUNTIME_RULES, "found_runtime"), *STYLE,
        scan(custom, "found_user"), scan([R.BY_UID[u] for u in ("X02", "X08", "X11")], "found_context"), TODO, NAMING,
        forbidden(config.forbidden_functions), UNREACHABLE, EMPTY_CATCH, AWAITS, JSON_TRY, DESTRUCTURE, TIMEOUT, NESTED, *FUNCTIONS, *COMPLEXITY,
        long_found(config.max_function_length), complex_found(config.max_complexity), *ASYNC, *SWITCH, *unused(), *LISTENERS, *INTERVALS,
        per_file, *([] if where == "true" else [ready(source, "ready_all")]), frameworks(source="ready" if where == "true" else "ready_all"),
        *duplicates(config.block_lines, in_file),
        "found AS (" + " UNION ALL ".join(f"SELECT {SLIM} FROM {n}" for n in parts) + ")",
        dim(list(R.BY_UID.values()) + custom), full("found"),
        f"""filtered AS (SELECT * FROM full_findings JOIN file_fws USING (path) WHERE sev_rank >= {dims.SEVERITY_RANK[config.severity_threshold]}
  AND confidence >= {config.confidence_threshold} AND NOT {suppressed('text', 'rule_id', in_file)})""",
        dedup("filtered", "reviewed"),
    ]


LISTS = """tracked AS (SELECT '  docs/d' || doc_id || '.html ' || chr(13) AS value FROM labels),
untracked AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN '   ' ELSE 'docs/d' || (o_orderkey % 2000) || '.html' END AS value FROM orders)"""


def listed(source: str, root: str) -> str:
    return f"SELECT '{root}/' || {trim('value')} AS path FROM {source} WHERE {trim('value')} <> ''"


def blocks_of_report(markdown: bool) -> str:
    if markdown:
        block = ("'---' || chr(10) || chr(10) || '**Line ' || line_no || '**' || chr(10) || '**Severity:** ' || severity || chr(10) || '**Category:** ' || category "
                 "|| chr(10) || '**Issue:** ' || message || chr(10) || '**Explanation:** ' || explanation || chr(10) || '**Suggested Fix:** ' || suggested_fix "
                 "|| chr(10) || '**Confidence:** ' || floor(confidence * 100 + 0.5)::INTEGER || '%' || chr(10) || '**Rule:** ' || rule_id || chr(10)")
        head = f"'### File: ' || {REL} || chr(10) || chr(10) || 'Language: ' || language || ' | Issues: ' || count(*) || ' | Scanned: {Q.AT}' || chr(10) || chr(10)"
        tail = ""
    else:
        block = ("chr(10) || '  Line ' || line_no || chr(10) || '  Severity: ' || severity || chr(10) || '  Issue: ' || message || chr(10) || '  Explanation: ' "
                 "|| explanation || chr(10) || '  Suggested Fix: ' || suggested_fix")
        bar = "-" * 40
        head = f"'{bar}' || chr(10) || 'FILE: ' || {REL} || chr(10) || 'Language: ' || language || ' | Issues: ' || count(*) || chr(10) || '{bar}' || chr(10)"
        tail = " || chr(10)"
    return f"SELECT path, {head} || string_agg({block}, chr(10) {ORDER}){tail} AS section FROM kept JOIN status USING (path) GROUP BY path, language"


def header_of_report(markdown: bool) -> str:
    n = {x: f"(SELECT count(*) FROM kept WHERE severity = '{x}')" for x in ("Critical", "High", "Medium", "Low")}
    files, total = "(SELECT count(*) FROM status)", "(SELECT count(*) FROM kept)"
    if markdown:
        cats = "(SELECT string_agg('| ' || category || ' | ' || c || ' |', chr(10) ORDER BY c DESC, category) FROM (SELECT category, count(*) AS c FROM kept GROUP BY category))"
        sev = " || chr(10) || ".join(f"'| {k} | ' || {v} || ' |'" for k, v in n.items())
        lines = [f"'# Code Review Report'", "''", "'**Project:** corpus'", f"'**Date:** {Q.AT}'", f"'**Scanned Files:** ' || {files}", f"'**Total Issues:** ' || {total}",
                 "'**Duration:** 0ms'", "''", "'## Severity Breakdown'", "''", "'| Severity | Count |'", "'|----------|-------|'", sev, "''", "'## Category Breakdown'",
                 "''", "'| Category | Count |'", "'|----------|-------|'", cats, "''", "'## Detailed Findings'", "''"]
    else:
        sev = " || chr(10) || ".join(f"'  {k:<10} ' || {v}" for k, v in n.items())
        lines = [f"'{'=' * 60}'", "'CODE REVIEW REPORT'", f"'{'=' * 60}'", "''", "'Project:       corpus'", f"'Date:          {Q.AT}'", f"'Scanned Files: ' || {files}",
                 f"'Total Issues:  ' || {total}", "'Duration:      0ms'", "''", f"'{'-' * 40}'", "'SEVERITY BREAKDOWN'", f"'{'-' * 40}'", sev, "''"]
    return "SELECT '' AS path, " + " || chr(10) || ".join(lines) + " AS section"


FIXED = f"""choices AS MATERIALIZED (SELECT path, line_no, arg_min(rule_id, CASE rule_id WHEN 'ast/unused-variable' THEN 0 WHEN 'ast/no-var' THEN 1 WHEN 'ast/strict-equality' THEN 2 ELSE 3 END) AS rule_id
  FROM kept WHERE rule_id IN ('ast/unused-variable', 'ast/no-var', 'ast/strict-equality', 'ai/json-parse-no-try') GROUP BY ALL),
edited AS MATERIALIZED (SELECT l.path, l.line_no, l.text AS old_text, c.rule_id, CASE c.rule_id WHEN 'ast/unused-variable' THEN NULL
    WHEN 'ast/no-var' THEN regexp_replace(l.text, '\\bvar\\b', 'const')
    WHEN 'ast/strict-equality' THEN regexp_replace(l.text, '([^!=<>])={{2}}([^=])', '\\1===\\2')
    WHEN 'ai/json-parse-no-try' THEN regexp_extract(l.text, '^(\\s*)', 1) || 'try {{' || chr(10) || l.text || chr(10) || regexp_extract(l.text, '^(\\s*)', 1)
      || '}} catch (e) {{' || chr(10) || regexp_extract(l.text, '^(\\s*)', 1) || '    console.error(''JSON parse error:'', e);' || chr(10) || regexp_extract(l.text, '^(\\s*)', 1) || '}}'
    ELSE l.text END AS new_text FROM lines l LEFT JOIN choices c USING (path, line_no))"""
DIGEST = "SELECT path, length(content) AS n_chars, md5(content) AS digest FROM "
CHANGED = rx("path", r"[05]\.[a-z]+$")
HASH = """list_reduce(list_transform(list_filter(string_split(content, ''), lambda x: x <> ''), lambda x: unicode(x)::BIGINT),
  lambda h, c: CASE WHEN c > 65535 THEN ((h * 31 + 55296 + (c - 65536) // 1024) % 4294967296 * 31 + 56320 + (c - 65536) % 1024) % 4294967296
    ELSE (h * 31 + c) % 4294967296 END, 0::BIGINT)"""


def build() -> dict[str, str]:
    strict = Q.strict()
    out = {
        "scan_corpus": sql([CODE, TEXT, BOTH, LANGS], DIGEST + f"""both_files WHERE NOT {EXCLUDED} AND NOT ({' OR '.join(f"contains(path, '/{d}/')" for d in dims.DEFAULT_IGNORE_PATHS)})
  AND EXISTS (SELECT 1 FROM langs WHERE ends_with(path, ext)) AND NOT ends_with(path, '.php') AND NOT contains(path, '/tools/')"""),
        "scan_table": sql([TEXT], DIGEST + "(SELECT 'talk/' || conv_id || '/' || turn AS path, text AS content FROM conversations UNION ALL SELECT * FROM text_files)"),
        "scan_change_list": sql([LISTS], f"{listed('tracked', '/work/tree')} UNION {listed('untracked', '/work/tree')}"),
        "scan_staged_list": sql([LISTS], listed("untracked", "/work/tree")),
        "distinct_paths": sql([LISTS], f"{listed('tracked', 'r')} UNION {listed('untracked', 'r')}"),
        "scan_ignore_file": sql(BOTH_LINES, "SELECT trimmed AS pattern, count(*) AS n FROM flagged WHERE trimmed <> '' AND NOT starts_with(trimmed, '#') GROUP BY ALL"),
        "filter_excluded_dirs": sql([CODE], f"SELECT path FROM code WHERE NOT {EXCLUDED}"),
        "filter_ignore_paths": sql([CODE], f"""SELECT path FROM code WHERE NOT ({' OR '.join(f"contains(path, '/{d}/')" for d in dims.DEFAULT_IGNORE_PATHS + ['core'])})"""),
        "filter_ignore_patterns": sql([CODE], "SELECT path FROM code WHERE NOT (path LIKE '%.txt' OR path LIKE '%.sql' OR path LIKE '%/api/%' OR path LIKE '%f1.%')"),
        "filter_size_cap": sql([TEXT], f"""SELECT path, length(content) AS n_chars FROM text_files
  WHERE length(content) + len(list_filter(string_split(content, ''), lambda x: x <> '' AND unicode(x) > 65535)) <= 4000"""),
        "detect_language": sql([CODE, LANGS, """named AS (SELECT CASE WHEN contains(path, '5.') THEN upper(path) WHEN contains(path, '7.rs') THEN 'a.b/Dockerfile.dev' ELSE path END AS path FROM code)"""],
                               f"SELECT lang_id, lang_name, family, count(*) AS n, min(path) AS first_path FROM (SELECT *, {EXT} AS ext FROM named) LEFT JOIN langs USING (ext) GROUP BY ALL"),
        "result_status": sql([CODE, LANGS, STATUS], "SELECT path, language FROM status"),
        "explode_lines": sql(BOTH_LINES, "SELECT path, line_no, text FROM lines"),
        "comment_skip": sql(BOTH_LINES, "SELECT path, line_no, skip_hash, skip_html, skip_hash_blank, skip_slashes FROM flagged"),
        "lang_gate": sql([CODE, LANGS, ready("code"), "gates(uid, langs) AS (VALUES " + ", ".join(
            f"({s(r.uid)}, {arr(r.langs) if r.langs else 'NULL'})" for r in R.SECURITY_RULES + R.RUNTIME_RULES) + ")"],
            "SELECT uid, lang_id, count(*) AS n FROM ready JOIN gates ON langs IS NULL OR list_contains(langs, lang_id) GROUP BY ALL"),
        "scan_catalog": shown(BOTH_LINES, scan([*R.SECURITY_RULES, *R.PERFORMANCE_RULES, *R.RUNTIME_RULES], "found")),
        "scan_security": shown(BOTH_LINES, scan(R.SECURITY_RULES, "found")),
        "scan_performance": shown(BOTH_LINES, scan(R.PERFORMANCE_RULES, "found")),
        "scan_runtime": shown(BOTH_LINES, scan(R.RUNTIME_RULES, "found")),
        "scan_user_rules": shown(BOTH_LINES, scan(user_rules(Q.CUSTOM, compiles), "found"), rules=user_rules(Q.CUSTOM, compiles)),
        "scan_forbidden": shown(CODE_LINES, forbidden(("eval", "exec", "document.write", "render")), "found_forbidden"),
        "scan_line_style": shown([*CODE_LINES, *STYLE], "found AS (SELECT * FROM found_style)"),
        "scan_todo": shown(BOTH_LINES, TODO, "found_todo"),
        "scan_naming": shown(CODE_LINES, NAMING, "found_naming"),
        "scan_parseint": shown(CODE_LINES, scan([R.BY_UID["X02"]], "found")),
        "scan_goroutine": shown(CODE_LINES, scan([R.BY_UID["X08"]], "found")),
        "scan_open_no_with": shown(CODE_LINES, scan([R.BY_UID["X11"]], "found")),
        "win_unreachable": sql([*CODE_LINES, UNREACHABLE, DIM, full("found_unreachable")], "SELECT path, line_no, severity, rule_id, pos AS origin FROM full_findings"),
        "win_empty_catch": shown(CODE_LINES, EMPTY_CATCH, "found_empty_catch"),
        "win_sequential_awaits": shown(CODE_LINES, AWAITS, "found_awaits"),
        "win_json_parse_no_try": shown(CODE_LINES, JSON_TRY, "found_json"),
        "win_destructure_no_check": shown(CODE_LINES, DESTRUCTURE, "found_destructure"),
        "win_timeout_in_loop": shown(CODE_LINES, TIMEOUT, "found_timeout"),
        "win_nested_loops": sql([*CODE_LINES, NESTED], "SELECT path, line_no, args[2]::INTEGER AS outer_line FROM found_nested"),
        "window_prefix_counts": sql([*CODE_LINES], f"""SELECT path, line_no, sum({DECISION_COUNT}) {W})::BIGINT AS decisions, sum(contains(text, 'await')::INTEGER) {W})::BIGINT AS awaits,
  sum(contains(text, 'try')::INTEGER) {W})::BIGINT AS tries, sum(contains(text, '.catch')::INTEGER) {W})::BIGINT AS catches,
  sum(contains(text, 'default:')::INTEGER + contains(text, 'default :')::INTEGER) {W})::BIGINT AS defaults FROM flagged"""),
        "brace_extent": sql([*CODE_LINES, *FUNCTIONS], "SELECT path, line_no, closed::INTEGER AS closed FROM brace_starts JOIN closings USING (path, line_no)"),
        "brace_body": sql([*CODE_LINES, BRACES, *SWITCH], "SELECT path, line_no, end_line, defaults FROM switch_bodies"),
        "indent_extent": sql([*CODE_LINES, *FUNCTIONS], "SELECT path, line_no, end_line FROM indent_ends"),
        "extract_functions": sql([*CODE_LINES, *FUNCTIONS], "SELECT path, name, line_no, end_line, end_line - line_no + 1 AS line_count FROM functions"),
        "cyclomatic": sql([*CODE_LINES, *FUNCTIONS, *COMPLEXITY], "SELECT path, name, line_no AS start_line, complexity FROM measured"),
        "long_functions": shown([*CODE_LINES, *FUNCTIONS, *COMPLEXITY], long_found(strict.max_function_length), "found_long"),
        "complex_functions": shown([*CODE_LINES, *FUNCTIONS, *COMPLEXITY], complex_found(strict.max_complexity), "found_complex"),
        "async_no_error_handling": shown([*CODE_LINES, BRACES], ",\n".join(ASYNC), "found_async"),
        "switch_no_default": shown([*CODE_LINES, BRACES], ",\n".join(SWITCH), "found_switch"),
        "unused_variables": shown(CODE_LINES, ",\n".join(unused()), "found_unused"),
        "listener_leaks": shown(CODE_LINES, ",\n".join(LISTENERS), "found_listeners"),
        "interval_leaks": shown(CODE_LINES, ",\n".join(INTERVALS), "found_intervals"),
        "first_line": sql(BOTH_LINES, "SELECT path, min(line_no) AS line_no FROM lines WHERE contains(text, 'const ') GROUP BY path"),
        "detect_frameworks": sql([CODE, LANGS, ready("code"), frameworks(("react",))], "SELECT framework FROM active"),
        "normalize_structure": sql(CODE_LINES, f"SELECT path, line_no, {CODE_KEY} AS code FROM flagged WHERE {COUNTS}"),
        "duplicate_blocks": sql([*CODE_LINES, frameworks(), *duplicates(4)], "SELECT path, line_no, end_line, args[1]::INTEGER AS first_line FROM found_duplicates"),
        "suppress_framework_blocks": sql([*CODE_LINES, frameworks()], f"SELECT path, line_no FROM flagged WHERE {suppressed('trimmed', None)}"),
        "filter_severity": sql(BASE, NO_TEXT + "full_findings WHERE severity IN ('High', 'Critical')"),
        "filter_confidence": sql(BASE, NO_TEXT + "full_findings WHERE confidence >= 0.6"),
        "filter_whitelist_names": sql(BASE, NO_TEXT + f"full_findings WHERE NOT {has('text', Q.NAMES)}"),
        "filter_whitelist_table": sql([*KEPT, "listed AS (SELECT 'kept' || (o_orderkey * 10) AS word FROM orders WHERE o_orderkey % 64 = 0)",
                                       "held AS (SELECT DISTINCT text FROM (SELECT DISTINCT text FROM kept) t JOIN listed ON contains(text, word))"],
                                      NO_TEXT + "kept WHERE text NOT IN (SELECT text FROM held)"),
        "filter_whitelist_patterns": sql(BASE, NO_TEXT + f"full_findings WHERE NOT ({rx('text', Q.PATTERNS[0])} OR {rx('text', Q.PATTERNS[2])})"),
        "filter_framework": sql([*BASE, frameworks()], NO_TEXT + f"full_findings WHERE NOT {suppressed('text', 'rule_id')}"),
        "union_findings": sql([*CODE_LINES, scan(R.SECURITY_RULES, "a"), scan(R.RUNTIME_RULES, "b"), TODO, DIM,
                               f"found AS (SELECT {SLIM} FROM a UNION ALL SELECT {SLIM} FROM b UNION ALL SELECT {SLIM} FROM found_todo)", full("found")],
                              "SELECT path, line_no, rule_id, message, analyzer, ord FROM full_findings"),
        "dedup_findings": sql([*BASE, """twice AS (SELECT * REPLACE (9 AS analyzer, 0.99::DOUBLE AS confidence) FROM full_findings UNION ALL SELECT * FROM full_findings)""",
                               dedup("twice", "once")], "SELECT path, line_no, category, message, rule_id, confidence FROM once"),
        "sort_findings": sql(KEPT, "SELECT path, line_no, severity, rule_id, message FROM kept ORDER BY path, sev_rank DESC, line_no, analyzer, step, pos, ord"),
        "agg_severity": sql(KEPT, "SELECT severity, count(kept.path) AS n FROM (VALUES ('Low'), ('Medium'), ('High'), ('Critical')) d(severity) LEFT JOIN kept USING (severity) GROUP BY severity"),
        "agg_category": sql(KEPT, "SELECT category, count(*) AS n FROM kept GROUP BY category ORDER BY n DESC, category"),
        "agg_file": sql([*KEPT, STATUS], f"""SELECT path, language, count(kept.rule_id) AS n,
  coalesce(string_agg(line_no || ':' || rule_id, ',' {ORDER}), '') AS issue_order FROM status LEFT JOIN kept USING (path) GROUP BY path, language"""),
        "run_summary": sql([*KEPT, STATUS], f"""SELECT 'corpus' AS project, (SELECT count(*) FROM status) AS scanned_files, count(*) AS total_issues, 7::BIGINT AS duration_ms,
  {', '.join(f"count(*) FILTER (severity = '{x}') AS n_{x.lower()}" for x in dims.SEVERITY_RANK)},
  count(DISTINCT category)::INTEGER AS n_categories, count(*) FILTER (category = 'Unused Variable') AS n_unused FROM kept"""),
        "sink_json": sql([*KEPT, STATUS], f"""SELECT path AS file, language, '{Q.AT}' AS "scannedAt", (row_number() OVER (PARTITION BY path {ORDER}) - 1)::INTEGER AS k, line_no AS line,
  end_line AS "endLine", severity, category, message, suggested_fix AS "suggestedFix", confidence, rule_id AS "ruleId" FROM kept JOIN status USING (path)"""),
        "sink_markdown": sql([*KEPT, STATUS], f"{blocks_of_report(True)} UNION ALL {header_of_report(True)}"),
        "sink_text": sql([*KEPT, STATUS], f"{blocks_of_report(False)} UNION ALL {header_of_report(False)}"),
        "relative_path": sql([CODE], f"SELECT CASE WHEN contains(path, '/lib') THEN replace(path, '/', chr(92)) ELSE path END AS path, substring(path, {len(ROOT) + 2}) AS rel FROM code"),
        "fix_lines": sql([*KEPT, FIXED.replace("LEFT JOIN choices", "JOIN choices")], "SELECT path, line_no, old_text, new_text, rule_id FROM edited WHERE rule_id IS NOT NULL"),
        "apply_fixes": sql([*KEPT, FIXED], f"""SELECT path, coalesce(string_agg(new_text, {LF} ORDER BY line_no) FILTER (new_text IS NOT NULL), '') AS content FROM edited GROUP BY path"""),
        "fix_hint": sql(KEPT, "SELECT DISTINCT path, line_no, rule_id, 'Fix: ' || substring(suggested_fix, 1, 80) AS hint FROM kept"),
        "review_full": sql(review(strict), NO_TEXT + "reviewed"),
        "review_long": sql([LONG_FILES, *review(strict, source="long_code")], NO_TEXT + "reviewed"),
        "review_changed": sql(review(strict, CHANGED, ignores=False), NO_TEXT + "reviewed"),
        "review_staged": sql(review(Q.strict(severity_threshold="Medium"), CHANGED, ignores=False), NO_TEXT + "reviewed"),
        "review_path_prefix": sql(review(strict, f"starts_with(path, '{ROOT}/src/')", in_file=True), NO_TEXT + "reviewed"),
        "content_hash": sql([CODE, TEXT, BOTH], f"SELECT path, (CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END)::INTEGER AS hash32 FROM (SELECT path, {HASH} AS h FROM both_files)"),
        "ledger_review": sql(review(strict), NO_TEXT + "reviewed"),
        "incremental_review": sql(review(strict), NO_TEXT + "reviewed"),
        "continuous_review": sql(["docs AS (SELECT 'docs/d' || doc_id || '.html' AS path, text AS content FROM documents)",
                                  *review(ReviewConfig(custom_rules=Q.CUSTOM, enable_frameworks=("angular", "react", "node")), source="docs", in_file=True)], NO_TEXT + "reviewed"),
    }
    return out
