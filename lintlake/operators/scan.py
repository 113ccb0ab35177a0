"""Rule-catalog scans: every line against every rule of its language.

The patterns are literals, so each is compiled once and the whole scan is one
projection over the exploded lines: no join and no shuffle. Cheap tests stand in front
of each regex: language, comment flag, a literal the match cannot do without.

Literals of several characters are not looked for one by one: a single expression, a tree of all of them, goes over
the line once, and what it finds names the rules that are tried. The cost of a line then hardly grows with the number of rules.

Where whole files are at hand (``file_hits``), rules are tried file by file first: a rule looks at the lines of a file only if
the file has its language and holds the literals it needs, which few rules and files do.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.catalog import rules as R
from lintlake.config import ReviewConfig
from lintlake.functions.literals import SHORTEST, beginnings, needed_test, required_literals, word_tree
from lintlake.functions.regex import escape_literal, java_regex
from lintlake.functions.sqltext import contains_sql, quoted, quoted_list, rlike_sql, trim_sql
from lintlake.functions.text import WHITE_SPACE, split_lines
from lintlake.operators.files import comment_flags
from lintlake.operators.findings import FIND, from_arrays, passing, wanted


@dataclass(frozen=True)
class Line:
    """What the expressions of a rule call a line and what is known of it."""

    text: str
    trimmed: str
    lowered: str
    line_no: str
    skips: dict[str, str]       # by comment mode


def _comment(beginnings: str) -> str:
    return rlike_sql("x", f"^[{WHITE_SPACE}]*(?:{beginnings})")


#: A row per line, with comment_flags
ROW = Line("text", "trimmed", "lowered", "line_no", {"hash": "skip_hash", "html": "skip_html", "hash_blank": "skip_hash_blank", "slashes": "skip_slashes"})
#: An element of a file's lines: what few lines need is made only for them
ELEMENT = Line("x", trim_sql("x"), "lower(x)", "(i + 1)", {
    "hash": _comment(r"//|#|\*"), "html": _comment(r"//|#|\*|<!--"), "hash_blank": _comment(r"//|#|\*|\z"), "slashes": _comment("//")})


@dataclass(frozen=True)
class Hit:
    """A finding that a rule makes of a line. The line is named by ``Line``; all tests must hold, in whatever order."""

    uid: str
    ord: str
    tests: tuple[str, ...]          # on the line
    file: tuple[str, ...] = ()      # the same for all lines of a file
    skip: str = "none"              # comment mode
    args: tuple[str, ...] = ()
    pos: str = ""                   # the line number, if not given
    holds: tuple[str, ...] = ()     # on ``content`` and ``low``, its lower case: true of a file if the tests are true of a line
    words: tuple[str, ...] = ()     # such a line holds one of them (lower-case, whatever the line's case)

    def in_line(self) -> str:
        """SQL for the finding on a row of one line: a struct, or null."""
        skip = (f"NOT {ROW.skips[self.skip]}",) if self.skip != "none" else ()
        out = hit(" AND ".join((*self.file, *skip, *self.tests)), self.uid, self.ord, self.args, self.pos or ROW.line_no)
        return chosen(out, self.words)

    def in_file(self) -> str:
        """SQL for the findings on the lines of a file: an array, or null."""
        skip = (f"NOT {ELEMENT.skips[self.skip]}",) if self.skip != "none" else ()
        own = _struct(self.uid, self.ord, self.args, self.pos or ELEMENT.line_no, f"CAST({ELEMENT.line_no} AS INT)", ELEMENT.text)
        found = f"filter(transform(lines, (x, i) -> CASE WHEN {' AND '.join((*self.tests, *skip))} THEN {own} END), f -> f IS NOT NULL)"
        return f"CASE WHEN {' AND '.join((*self.file, *self.holds))} THEN {found} END" if self.file or self.holds else found


def rule_hit(rule: R.Rule, line: Line, ord: str | int, exact_edges: bool = False, args: tuple[str, ...] = ()) -> Hit:
    """The finding of a rule, cheap tests first."""
    file, tests, holds = [], [], []
    if rule.langs is not None:
        file.append(f"lang_id IN ({quoted_list(rule.langs)})")
    if rule.families is not None:
        file.append(f"family IN ({quoted_list(rule.families)})")
    if rule.needs:
        tests.append(contains_sql(line.text, rule.needs))
        holds.append(contains_sql("content", rule.needs))
    if rule.needs_lower:
        tests.append(f"exists(array({line.lowered}), l -> {contains_sql('l', rule.needs_lower)})")
        holds.append(contains_sql("low", rule.needs_lower))
    if not (rule.needs or rule.needs_lower or rule.ignore_case) and (needed := needed_test(rule.pattern, line.text)):
        tests.append(f"({needed})")
        holds.append(f"({needed_test(rule.pattern, 'content')})")
    words = words_of(rule) or ()
    if not holds and words:
        holds.append(contains_sql("low", words))
    if rule.also:
        tests.append(rlike_sql(line.text, java_regex(rule.also)))
    tests.append(rlike_sql(line.text, java_regex(rule.pattern, rule.ignore_case, exact_edges)))
    if rule.unless:
        tests.append("NOT " + rlike_sql(line.text, java_regex(rule.unless)))
    return Hit(rule.uid, str(ord), tuple(tests), tuple(file), rule.comment_mode, args, holds=tuple(holds), words=words)


def _struct(uid: str, ord: str | int, args: tuple[str, ...], pos: str, line_no: str = "", text: str = "") -> str:
    values = ", ".join(f"CAST({a} AS STRING)" for a in args)
    place = (f"'line_no', {line_no}, 'end_line', CAST(NULL AS INT), ", f", 'text', {text}") if line_no else ("", "")
    return (f"named_struct({place[0]}'uid', {quoted(uid)}, 'args', CAST(array({values}) AS ARRAY<STRING>), "
            f"'pos', CAST({pos} AS INT), 'ord', CAST({ord} AS INT){place[1]})")


def hit(condition: str, uid: str, ord: str | int, args: tuple[str, ...] = (), pos: str = "line_no") -> str:
    """SQL for the finding of one rule on a line: a struct, or null."""
    return f"CASE WHEN {condition} THEN {_struct(uid, ord, args, pos)} END"


#: So many words are found sooner by one expression than one by one
MANY_WORDS = 40


class Chosen(str):
    """SQL for a finding that is tried only where the line holds one of ``words`` (lower-case, whatever the line's case)."""

    words: tuple[str, ...] = ()


def words_of(rule: R.Rule) -> tuple[str, ...] | None:
    """Words of which every line that the rule matches holds one."""
    known = tuple(w.lower() for w in (*rule.needs, *rule.needs_lower) if w.isascii()) if not (rule.needs and rule.needs_lower) else ()
    if known and min(map(len, known)) >= SHORTEST:
        return known
    return required_literals(rule.pattern)


def chosen(condition_hit: str, words: tuple[str, ...] | None) -> str:
    if not words:
        return condition_hit
    out = Chosen(condition_hit)
    out.words = words
    return out


def _by_word(hits: list[Chosen]) -> tuple[list[str], list[list[int]]]:
    """Words of the hits, and for each the numbers of the hits to try where it is the longest word found at a place."""
    rules: dict[str, list[int]] = {}
    for n, h in enumerate(hits):
        for word in h.words:
            rules.setdefault(word, []).append(n)
    # a longer word found at a place stands for those it begins with
    return list(rules), [sorted({n for b in beginnings(w, set(rules)) for n in rules[b]}) for w in rules]


def _tried(hits: list[Chosen], lowered: str) -> str:
    """SQL for an array of what the hits give whose words ``lowered`` holds."""
    words, numbers = _by_word(hits)
    table = "map_from_arrays(array({}), array({}))".format(quoted_list(words), ", ".join(f"array({', '.join(map(str, ns))})" for ns in numbers))
    found = f"regexp_extract_all({lowered}, {quoted(f'(?=({word_tree(words)}))')}, 1)"
    names = f"array_distinct(flatten(transform(array_distinct({found}), w -> element_at({table}, w))))"
    return f"array_compact(transform({names}, n -> {_one_of(hits, 0)}))"


def _split(hits: list[str], enough: int) -> tuple[list[Chosen], list[str]]:
    """Hits to choose by their words, if there are enough words, and the others."""
    many = len({w for h in hits if isinstance(h, Chosen) for w in h.words}) >= enough
    return [h for h in hits if many and isinstance(h, Chosen)], [h for h in hits if not (many and isinstance(h, Chosen))]


def hits_sql(hits: list[str]) -> str:
    """SQL for the array of findings on a line."""
    tried, plain = _split(hits, MANY_WORDS)
    arrays = [f"array_compact(array({', '.join(plain)}))"] if plain else []
    if tried:
        arrays.append(_tried(tried, "lowered"))
    return f"concat({', '.join(arrays)})" if len(arrays) > 1 else arrays[0]


#: So many words are found sooner by one expression than one by one in a whole file, where rules of other languages are passed over
MANY_WORDS_OF_FILE = 200


def file_hits_sql(hits: list[Hit]) -> str:
    """SQL for the array of findings on the lines of a file (``lines``, ``content`` and ``low``, its lower case)."""
    tried, plain = _split([chosen(h.in_file(), h.words) for h in hits], MANY_WORDS_OF_FILE)
    arrays = [f"array_compact(array({', '.join(plain)}))"] if plain else []
    if tried:
        arrays.append(_tried(tried, "low"))
    return f"flatten({f'concat({", ".join(arrays)})' if len(arrays) > 1 else arrays[0]})"


def _one_of(hits: list[str], first: int) -> str:
    """The hit of number n, found by halving."""
    if len(hits) == 1:
        return hits[0]
    half = len(hits) // 2
    return f"CASE WHEN n < {first + half} THEN {_one_of(hits[:half], first)} ELSE {_one_of(hits[half:], first + half)} END"


def findings_of(lines: DataFrame, hits: list[Hit]) -> DataFrame:
    """Slim findings of ``hits`` (made for ROW) on each line."""
    if not hits:
        return from_arrays(lines, F.array().cast(f"array<{FIND}>"))
    own = (f"transform({hits_sql([h.in_line() for h in hits])}, h -> named_struct('line_no', line_no, 'end_line', CAST(NULL AS INT), "
           "'uid', h.uid, 'args', h.args, 'pos', h.pos, 'ord', h.ord, 'text', text))")
    return from_arrays(comment_flags(lines), F.expr(own))


def catalog_hits(rules: list[R.Rule], exact_edges: bool = False, line: Line = ELEMENT) -> list[Hit]:
    return [rule_hit(r, line, n, exact_edges) for n, r in enumerate(rules) if r.langs is None or r.langs]


def scan_rules(lines: DataFrame, rules: list[R.Rule], exact_edges: bool = False) -> DataFrame:
    """Slim findings of ``rules`` that need no values in their texts."""
    return findings_of(lines, catalog_hits(rules, exact_edges, ROW))


def scan_catalog(lines: DataFrame, config: ReviewConfig | None = None) -> DataFrame:
    """The three catalogs in one pass over the lines."""
    return findings_of(lines, [h for rules in (R.SECURITY_RULES, R.PERFORMANCE_RULES, R.RUNTIME_RULES) for h in catalog_hits(passing(rules, config), line=ROW)])


def security_hits(config: ReviewConfig | None = None, line: Line = ELEMENT) -> list[Hit]:
    return catalog_hits(passing(R.SECURITY_RULES, config), line=line)


def scan_security(lines: DataFrame, config: ReviewConfig | None = None) -> DataFrame:
    return findings_of(lines, security_hits(config, ROW))


def performance_hits(config: ReviewConfig | None = None, line: Line = ELEMENT) -> list[Hit]:
    return catalog_hits(passing(R.PERFORMANCE_RULES, config), line=line)


def scan_performance(lines: DataFrame, config: ReviewConfig | None = None) -> DataFrame:
    return findings_of(lines, performance_hits(config, ROW))


def scan_runtime(lines: DataFrame, config: ReviewConfig | None = None) -> DataFrame:
    return scan_rules(lines, passing(R.RUNTIME_RULES, config))


def user_hits(config: ReviewConfig, prune: bool = False, line: Line = ELEMENT) -> list[Hit]:
    return catalog_hits(passing(list(config.user_rules), config if prune else None), True, line)


def scan_user_rules(lines: DataFrame, config: ReviewConfig, prune: bool = False) -> DataFrame:
    return findings_of(lines, user_hits(config, prune, ROW))


def forbidden_rules(config: ReviewConfig) -> list[tuple[str, str]]:
    return [(name, java_regex(r"\b" + escape_literal(name) + r"\s*\(", exact_edges=True)) for name in config.forbidden_functions]


def forbidden_hits(config: ReviewConfig, line: Line = ELEMENT) -> list[Hit]:
    """All lines for one name are reported before all lines for the next."""
    return [Hit("A14", line.line_no, (contains_sql(line.text, (n,)), rlike_sql(line.text, p)), skip="hash", args=(quoted(n),), pos=str(i),
                holds=(contains_sql("content", (n,)),)) for i, (n, p) in enumerate(forbidden_rules(config))]


def scan_forbidden(lines: DataFrame, config: ReviewConfig) -> DataFrame:
    return findings_of(lines, forbidden_hits(config, ROW))


def _plain_style(config: ReviewConfig | None) -> list[R.Rule]:
    return [r for r in passing(R.STYLE_RULES, config) if r.uid != "A07"]


def _extracted(uid: str, file: str, pattern: str, known: list[str], line: Line, ord: int, also: tuple[str, ...] = ()) -> Hit:
    """A finding that names what the first group of the pattern holds, unless it is known."""
    name = f"regexp_extract({line.text}, {quoted(pattern)}, 1)"
    needed, whole = ((f"({t})",) if (t := needed_test(pattern, text)) else () for text in (line.text, "content"))
    return Hit(uid, str(ord), (*needed, f"{name} NOT IN ('', {quoted_list(known)})", *also), (file,), args=(name,), holds=whole)


def magic_hits(line: Line = ELEMENT) -> list[Hit]:
    magic = R.BY_UID["A07"]
    return [_extracted("A07", f"family IN ({quoted_list(magic.families)})", java_regex(magic.pattern), R.MAGIC_ALLOWED, line, len(R.STYLE_RULES))]


def style_hits(config: ReviewConfig | None = None, line: Line = ELEMENT) -> list[Hit]:
    return catalog_hits(_plain_style(config), line=line) + (magic_hits(line) if wanted("A07", config) else [])


def scan_line_style(lines: DataFrame, config: ReviewConfig | None = None) -> DataFrame:
    return findings_of(lines, style_hits(config, ROW))


def todo_hits(line: Line = ELEMENT) -> list[Hit]:
    pattern = java_regex(R.TODO_PATTERN, ignore_case=True)
    tag, rest = (f"regexp_extract({line.trimmed}, {quoted(pattern)}, {g})" for g in (1, 2))
    opened = ("//", "#", "*")
    return [Hit("A12", "1", (contains_sql(line.text, opened), rlike_sql(line.trimmed, pattern)), args=(f"upper({tag})", f"substring({rest}, 1, 80)"),
                holds=(contains_sql("content", opened), contains_sql("low", R.TODO_TAGS)))]


def scan_todo(lines: DataFrame) -> DataFrame:
    return findings_of(lines, todo_hits(ROW))


def naming_hits(line: Line = ELEMENT) -> list[Hit]:
    loop = "NOT " + rlike_sql(line.text, java_regex(r"\b(?:for|while)\b"))
    return [_extracted("A15", gate, pattern, R.SINGLE_LETTER_ALLOWED, line, 0, (loop,))
            for gate, pattern in (("lang_id = 'python'", R.SINGLE_LETTER_PYTHON), ("family = 'c-style'", R.SINGLE_LETTER_C))]


def scan_naming(lines: DataFrame) -> DataFrame:
    return findings_of(lines, naming_hits(ROW))


def scan_parseint(lines: DataFrame) -> DataFrame:
    return scan_rules(lines, [R.BY_UID["X02"]])


def scan_goroutine(lines: DataFrame) -> DataFrame:
    return scan_rules(lines, [R.BY_UID["X08"]])


def scan_open_no_with(lines: DataFrame) -> DataFrame:
    return scan_rules(lines, [R.BY_UID["X11"]])


def all_hits(config: ReviewConfig, line: Line = ELEMENT) -> list[Hit]:
    """Every single-line rule that passes the thresholds; ``ord`` rises along each analyzer's list."""
    known = [*R.SECURITY_RULES, *R.PERFORMANCE_RULES, *R.RUNTIME_RULES]
    single = [*passing(known, config), *_plain_style(config), *passing([R.BY_UID[u] for u in ("X02", "X08", "X11")], config)]
    hits = catalog_hits(single, line=line) + catalog_hits(passing(list(config.user_rules), config), True, line)
    for uid, more in (("A07", magic_hits), ("A12", todo_hits), ("A15", naming_hits)):
        hits += more(line) if wanted(uid, config) else []
    return hits + (forbidden_hits(config, line) if wanted("A14", config) else [])


def file_hits(hits: list[Hit]) -> Column:
    """The findings of single-line rules on a file (``content`` and ``lines``) as an array of ``find`` structs."""
    return F.expr(file_hits_sql(hits)) if hits else F.array().cast(f"array<{FIND}>")


def files_found(files: DataFrame, hits: list[Hit], arrays: list[Column] = (), carry: tuple[str, ...] = ()) -> DataFrame:
    """Slim findings of single-line rules and of rules over the lines of a file (see sequence, tokens), in one pass over the files."""
    none = F.array().cast(f"array<{FIND}>")
    rows = files.withColumns({"lines": split_lines(F.col("content")), "low": F.lower("content")})
    return from_arrays(rows, F.concat(none, *[F.coalesce(a, none) for a in (*arrays, file_hits(hits))]), carry)
