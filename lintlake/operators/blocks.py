"""Functions and braced bodies: where a block that starts on a line ends, and what it holds.

Braces are matched without looping: with P the running brace depth and B its value
before the start line, the block ends at the first brace, from the first opening brace
at or after the start on, where P = B. Starts and braces are put in one sequence per
file, and "the next brace at depth B" is a window over (path, depth). Indented blocks end
before the next line that is not deeper, found the same way over (path, level).

In the operators on exploded lines only lines with a brace, a counted word or a start are shuffled, once, by path, so a window
partition holds such lines of one file; files too long for that are reviewed in pieces (see
pieces). Body contents are differences of running counts; bodies are never assembled.

The review has whole files at hand and needs no shuffle for the same extents: starts are found in the row of the file, and a file's braces,
indents and marked decision words are gone through once, in Arrow batches (``file_extents``), n log n in the file.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lintlake.catalog.rules import DECISIONS, FUNCTION_STARTS, JS_TS
from lintlake.config import ReviewConfig
from lintlake.functions.literals import needed_test
from lintlake.functions.regex import java_regex
from lintlake.functions.sqltext import quoted, rlike_sql
from lintlake.functions.text import MARK_OPEN, MARK_OTHER, any_of, contains_any, let, mark_matches, marked_names, split_lines, unmarked
from lintlake.operators.findings import FIND, existing, find, from_arrays, slim, wanted
from lintlake.sources.local import kept

INDENTED = ("python", "ruby")
ASYNC = r"async\s+(?:function\s+)?(\w+)"
UNCLOSED_LINES, BODY_LINES = 50, 200
MARK_DECISION = "\x04"


def _first_group(text: str, pattern: str) -> str:
    """SQL for the name in a function start: first non-empty group, ``anonymous`` if none, null without a match."""
    java = java_regex(pattern)
    parts = "".join(f"nullif(regexp_extract({text}, {quoted(java)}, {g}), ''), " for g in range(1, re.compile(pattern).groups + 1))
    needed = needed_test(pattern, text)
    return f"CASE WHEN {f'{needed} AND ' if needed else ''}{rlike_sql(text, java)} THEN coalesce({parts}'anonymous') END"


def function_name(text: str) -> str:
    """SQL; languages without patterns of their own use the JavaScript ones."""
    def named(lang: str) -> str:
        return f"coalesce({', '.join(_first_group(text, p) for p in FUNCTION_STARTS[lang])}, NULL)"

    cases = " ".join(f"WHEN {quoted(lang)} THEN {named(lang)}" for lang in FUNCTION_STARTS if lang != "javascript")
    return f"(CASE lang_id {cases} ELSE {named('javascript')} END)"


def _names_of_lines() -> str:
    """SQL for the function names of all lines of a file (``content``, ``lines``), null where no line can start a function."""
    def named(lang: str) -> str:
        patterns = FUNCTION_STARTS[lang]
        found = f"transform(lines, x -> coalesce({', '.join(_first_group('x', p) for p in patterns)}, NULL))"
        tests = [needed_test(p, "content") for p in patterns]
        return f"CASE WHEN ({') OR ('.join(tests)}) THEN {found} END" if all(tests) else found

    cases = " ".join(f"WHEN {quoted(lang)} THEN {named(lang)}" for lang in FUNCTION_STARTS if lang != "javascript")
    return f"(CASE lang_id {cases} ELSE {named('javascript')} END)"


def _decision_pattern(key: str) -> str:
    words, operators = DECISIONS[key]
    pattern = rf"(?<!\w)(?:{words})(?!\w)"
    return pattern + rf"|(?<=\w)(?:{operators})(?=\w)" if operators else pattern


def _decisions_marked() -> Column:
    """``content`` with a mark instead of each decision word, line by line those that decision_count counts."""
    def marked(key: str) -> str:
        return f"regexp_replace(t, {quoted(_decision_pattern(key).replace(r'\s', r'[ \t\x0B\f\r]'))}, {quoted(MARK_DECISION)})"

    cases = " ".join(f"WHEN {quoted(lang)} THEN {marked(lang)}" for lang in DECISIONS if lang != "default")
    return F.expr(
        f"element_at(transform(array(replace(content, {quoted(MARK_DECISION)}, {quoted(MARK_OTHER)})), "
        f"t -> CASE lang_id {cases} ELSE {marked('default')} END), 1)")


def decision_count(text: str) -> str:
    """SQL for the number of decision words in a line."""
    def count(key: str) -> str:
        pattern = _decision_pattern(key)
        return f"CASE WHEN {needed_test(pattern, text)} THEN regexp_count({text}, {quoted(pattern)}) ELSE 0 END"

    cases = " ".join(f"WHEN {quoted(lang)} THEN {count(lang)}" for lang in DECISIONS if lang != "default")
    return f"(CASE lang_id {cases} ELSE {count('default')} END)"


def _of_line(made: str) -> Column:
    """SQL on the line ``x`` as a column over ``text``. The patterns of all languages in one generated method are too long to be compiled on the JVM;
    inside a lambda they are evaluated as they are, in half the time."""
    return F.expr(f"element_at(transform(array(text), x -> {made}), 1)")


def _numbered(files: DataFrame) -> DataFrame:
    base = files.select("path", "lang_id", split_lines(F.col("content")).alias("lines"))
    return base.select("path", "lang_id", F.size("lines").alias("n_lines"), F.posexplode_outer("lines").alias("i", "text")).select(
        "path", "lang_id", "n_lines", (F.col("i") + 1).alias("line_no"), "text")


#: Keys of a file's rows. Paths mostly begin alike, and sorts look at the first bytes of the first key before they compare rows: its hash comes first
FILE = ("file", "path")


def _filed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("file", F.xxhash64("path"))


#: Text whose blocks are looked for in one task: sorting its braces takes some hundred MB
BYTES_OF_TASK = 8 << 20


def by_path(rows: DataFrame, files: DataFrame | int) -> DataFrame:
    """Rows of ``files`` (or of files of so many bytes) by path, in tasks that do not grow with the corpus: adaptive execution would join parts up to 64 MB of shuffled
    bytes, which are many times that when four windows sort them. One more read of the texts' lengths."""
    size = files if isinstance(files, int) else files.agg(F.sum(F.octet_length("content").cast("long"))).first()[0] or 0
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-size // BYTES_OF_TASK)), "path")


def brace_extent(lines: DataFrame, counts: dict[str, int], files: DataFrame | int | None = None) -> DataFrame:
    """Ends of the blocks that start on lines with a non-null ``start``.

    lines: path, lang_id, line_no, n_lines, text, start, and one integer column per key of ``counts``, whose
    value is a number of lines. Result: one row per start with ``closed`` (line of the closing brace, null if
    never closed) and for each count c its sum over the lines above the start (``c_before``), through the
    closing line (``c_closed``) and through that many lines from the start on (``c_reach``). ``files``: what the lines are of, whose
    size decides on the number of tasks.
    """
    some_brace = F.contains("text", F.lit("{")) | F.contains("text", F.lit("}"))
    braces = F.when(some_brace, F.regexp_extract_all("text", F.lit(r"[{}]"), 0)).otherwise(F.array().cast("array<string>"))
    # the filter stands inside the generator: as a WHERE it would be pushed down and every regex run twice
    line = F.struct("start", F.when(F.col("start").isNotNull(), F.col("text")).alias("text"), braces.alias("braces"), *counts)
    useful = F.filter(F.array(line), lambda r: any_of([F.size(r["braces"]) > 0, r["start"].isNotNull(), *[r[c] > 0 for c in counts]]))
    rows = lines.select("path", "lang_id", "line_no", "n_lines", F.inline_outer(useful)).where(F.col("braces").isNotNull())
    rows = _filed(by_path(rows, files) if files is not None else rows)

    by_line = W.partitionBy(*FILE).orderBy("line_no")
    sums = {}
    for c, reach in counts.items():
        sums[f"{c}_here"] = F.sum(c).over(by_line.rangeBetween(W.unboundedPreceding, 0))
        sums[f"{c}_reach"] = F.sum(c).over(by_line.rangeBetween(W.unboundedPreceding, reach - 1))
    rows = rows.withColumns(sums).withColumns({f"{c}_before": F.col(f"{c}_here") - F.col(c) for c in counts})

    # a start is an event of its own in front of the braces of its line
    marks = F.when(F.col("start").isNotNull(), F.array_insert("braces", 1, F.lit(""))).otherwise(F.col("braces"))
    events = rows.select(*[c for c in rows.columns if c != "braces"], F.posexplode_outer(marks).alias("k", "mark"))
    by_pos = W.partitionBy(*FILE).orderBy("line_no", "k")
    # "the next one" is a running minimum from the end: a frame that grows, which is linear; one that shrinks is made anew for each row
    from_end = W.partitionBy(*FILE).orderBy(F.desc("line_no"), F.desc("k"))
    step = F.when(F.col("mark") == "{", 1).when(F.col("mark") == "}", -1).otherwise(0)
    here = F.struct("line_no", "k")
    events = (events.where(F.col("mark").isNotNull()).withColumn("depth", F.sum(step).over(by_pos.rowsBetween(W.unboundedPreceding, 0)))
              .withColumn("opening", F.min(F.when(F.col("mark") == "{", here)).over(
                  from_end.rowsBetween(W.unboundedPreceding, 0))))

    is_start = F.col("mark") == ""
    spot = F.when(is_start, F.col("opening")).otherwise(here)
    at_depth = W.partitionBy(*FILE, "depth").orderBy(F.desc("spot.line_no"), F.desc("spot.k"), F.col("is_start").asc())
    carried = F.struct("line_no", "k", *[f"{c}_here" for c in counts])
    closed = (events.withColumn("spot", spot).withColumn("is_start", is_start)
              .where(F.col("spot").isNotNull() | F.col("is_start"))
              .withColumn("end", F.min(F.when(~F.col("is_start"), carried)).over(
                  at_depth.rowsBetween(W.unboundedPreceding, 0)))
              .where("is_start"))
    never = F.col("spot").isNull()
    return closed.select(
        "path", "lang_id", "line_no", "n_lines", "text", "start",
        F.when(~never, F.col("end.line_no")).alias("closed"),
        *[F.col(f"{c}_{n}") for c in counts for n in ("before", "reach")],
        *[F.when(~never, F.col(f"end.{c}_here")).alias(f"{c}_closed") for c in counts])


def brace_body(lines: DataFrame, counts: list[str]) -> DataFrame:
    """Body of at most 200 lines: ``end_line`` and, per count c, the number ``c`` inside it."""
    return _bodies(brace_extent(lines, dict.fromkeys(counts, BODY_LINES)), counts)


def _bodies(ends: DataFrame, counts: list[str]) -> DataFrame:
    capped = F.least(F.col("line_no") + BODY_LINES - 1, "n_lines")
    inside = F.col("closed") <= capped
    return ends.select(
        "path", "lang_id", "line_no", "text", "start",
        F.when(inside, F.col("closed")).otherwise(capped).alias("end_line"),
        *[(F.when(inside, F.col(f"{c}_closed")).otherwise(F.col(f"{c}_reach")) - F.col(f"{c}_before")).alias(c) for c in counts])


def indent_extent(lines: DataFrame, counts: list[str]) -> DataFrame:
    """Ends of the indented blocks that start on lines with a non-null ``start``; same input as
    ``brace_extent`` plus ``indent``, ``closes`` (levels that may end on the line)."""
    by_line = W.partitionBy(*FILE).orderBy("line_no")
    rows = _filed(lines)
    sums = {}
    for c in counts:
        for name, frame in (("before", by_line.rowsBetween(W.unboundedPreceding, -1)),
                            ("all", W.partitionBy(*FILE))):
            sums[f"{c}_{name}"] = F.coalesce(F.sum(c).over(frame), F.lit(0))
    rows = rows.withColumns(sums) if sums else rows

    own = F.when(F.col("start").isNotNull(), F.array(F.struct(F.col("indent").alias("level"), F.lit(True).alias("is_start"))))
    shut = F.transform("closes", lambda x: F.struct(x.alias("level"), F.lit(False).alias("is_start")))
    marks = F.concat(F.coalesce(own, F.array().cast("array<struct<level:int,is_start:boolean>>")), shut)
    events = rows.select(*[c for c in rows.columns if c not in ("closes", "indent")], F.inline_outer(marks))
    by_level = W.partitionBy(*FILE, "level").orderBy(F.desc("line_no"), F.desc("is_start"))
    carried = F.struct("line_no", *[f"{c}_before" for c in counts])
    ends = (events.where(F.col("level").isNotNull()).withColumn("end", F.min(F.when(~F.col("is_start"), carried)).over(by_level.rowsBetween(W.unboundedPreceding, -1)))
            .where("is_start"))
    return ends.select(
        "path", "lang_id", "line_no", "n_lines", "text", "start",
        F.coalesce(F.col("end.line_no") - 1, "n_lines").alias("end_line"),
        *[(F.coalesce(F.col(f"end.{c}_before"), f"{c}_all") - F.col(f"{c}_before")).alias(c) for c in counts])


def _indented_lines(files: DataFrame) -> DataFrame:
    """Non-blank lines of Python and Ruby files that start a function, hold a counted word, or may
    end a block: a line ends blocks only if it is not deeper than the line before it, and only at
    levels between the two indents."""
    base = files.where(F.col("lang_id").isin(*INDENTED)).select(
        "path", "lang_id", split_lines(F.col("content")).alias("lines"))
    rows = base.select(
        "path", "lang_id", F.size("lines").alias("n_lines"),
        F.expr("filter(transform(lines, (x, i) -> named_struct('line_no', i + 1, 'text', x, 'indent', "
               f"length(regexp_extract(x, {quoted(r'^(\s*)\S')}, 0)) - 1, 'start', {function_name('x')})), r -> r.indent >= 0)").alias("rows"))
    zipped = F.arrays_zip(
        F.col("rows").alias("row"),
        F.concat(F.array(F.lit(None).cast("int")), F.transform("rows", lambda r: r["indent"])).alias("prev"))
    levels = F.array_distinct(F.transform(F.filter("rows", lambda r: r["start"].isNotNull()), lambda r: r["indent"]))
    some = rows.select("path", "lang_id", "n_lines", levels.alias("levels"), zipped.alias("zipped"))
    lines = some.select("path", "lang_id", "n_lines", "levels",
                        F.explode_outer(F.when(F.size("levels") > 0, F.col("zipped"))).alias("z")).where(
        F.col("z.row").isNotNull())
    closes = F.when(F.col("z.row.indent") <= F.col("z.prev"),
                    F.filter("levels", lambda v: (v >= F.col("z.row.indent")) & (v <= F.col("z.prev"))))
    line = F.struct("z.row.line_no", F.when(F.col("z.row.start").isNotNull(), F.col("z.row.text")).alias("text"), "z.row.indent", "z.row.start",
                    F.coalesce(closes, F.array().cast("array<int>")).alias("closes"), F.expr(decision_count("z.row.text")).alias("decisions"))
    useful = F.filter(F.array(line), lambda r: r["start"].isNotNull() | (F.size(r["closes"]) > 0) | (r["decisions"] > 0))
    return lines.select("path", "lang_id", "n_lines", F.inline_outer(useful)).where(F.col("line_no").isNotNull())


def braced_functions(files: DataFrame) -> DataFrame:
    lines = _numbered(files.where(~F.col("lang_id").isin(*INDENTED)))
    lines = lines.withColumn("start", _of_line(function_name("x"))).withColumn("decisions", _of_line(decision_count("x")))
    return brace_extent(lines, {"decisions": UNCLOSED_LINES}, files)


def indented_functions(files: DataFrame, size: int | None = None) -> DataFrame:
    indented = files.where(F.col("lang_id").isin(*INDENTED))
    return indent_extent(by_path(_indented_lines(indented), indented if size is None else size), ["decisions"])


def _functions(ends: DataFrame) -> DataFrame:
    fallback = F.least(F.col("line_no") + UNCLOSED_LINES - 1, "n_lines")
    return ends.select(
        "path", "lang_id", "line_no", "text", F.col("start").alias("name"), F.coalesce("closed", fallback).alias("end_line"),
        (F.coalesce("decisions_closed", "decisions_reach") - F.col("decisions_before") + 1).alias("complexity"))


def extract_functions(files: DataFrame, by_brace: DataFrame | None = None) -> DataFrame:
    """Functions with name, extent, length and cyclomatic complexity."""
    by_brace = _functions(braced_functions(files)) if by_brace is None else by_brace
    by_indent = indented_functions(files).select(
        "path", "lang_id", "line_no", "text", F.col("start").alias("name"), "end_line",
        (F.col("decisions") + 1).alias("complexity"))
    both = by_brace.unionByName(by_indent)
    return both.withColumn("line_count", F.col("end_line") - F.col("line_no") + 1)


def cyclomatic(functions: DataFrame) -> DataFrame:
    return functions.select("path", "name", F.col("line_no").alias("start_line"), "complexity")


def long_functions(functions: DataFrame, config: ReviewConfig) -> DataFrame:
    limit = config.max_function_length
    found = functions.where(F.col("line_count") > limit)
    uid = F.when(F.col("line_count") > 2 * limit, "C01H").otherwise("C01")
    return slim(found, uid, args=[F.col("name"), F.col("line_count"), F.lit(limit)], end_line=F.col("end_line"))


def complex_functions(functions: DataFrame, config: ReviewConfig) -> DataFrame:
    limit = config.max_complexity
    found = functions.where(F.col("complexity") > limit)
    uid = F.when(F.col("complexity") > 2 * limit, "C02H").otherwise("C02")
    return slim(found, uid, args=[F.col("name"), F.col("complexity"), F.lit(limit)], end_line=F.col("end_line"), ord=F.lit(1))


def function_hits(name: Column, end_line: Column, size: Column, complexity: Column, config: ReviewConfig) -> Column:
    """Both function rules as an array of findings on a row with ``line_no`` and ``text``."""
    length, decisions = config.max_function_length, config.max_complexity

    def one(uid: str, value: Column, limit: int, ord: int) -> Column:
        return find(uid, F.col("line_no"), F.col("text"), [name, value, F.lit(limit)], end_line=end_line, ord=ord)

    keep = {uid: wanted(uid, config) for uid in ("C01", "C01H", "C02", "C02H")}
    no = F.lit(None).cast(FIND)
    long = F.when(size > 2 * length, one("C01H", size, length, 0) if keep["C01H"] else no).when(
        size > length, one("C01", size, length, 0) if keep["C01"] else no)
    hard = F.when(complexity > 2 * decisions, one("C02H", complexity, decisions, 1) if keep["C02H"] else no).when(
        complexity > decisions, one("C02", complexity, decisions, 1) if keep["C02"] else no)
    return existing(F.array(long, hard))


def _has(text: Column, word: str) -> Column:
    return F.contains(text, F.lit(word)).cast("int")


GUARDS = {"waits": ("await",), "guards": ("try", ".catch"), "defaults": ("default:", "default :")}
SWITCH = java_regex(r"\bswitch\s*\(")


def _counted(*names: str) -> dict[str, Column]:
    return {n: sum((_has(F.col("text"), w) for w in GUARDS[n][1:]), _has(F.col("text"), GUARDS[n][0])) for n in names}


def _async_marked(files: DataFrame) -> DataFrame:
    """A match of ``async name`` may span lines, so matches are marked in the whole text first."""
    here = F.col("lang_id").isin(*JS_TS) & F.contains("content", F.lit("async")) & F.contains("content", F.lit("await"))
    return files.withColumn("content", F.when(here, mark_matches(F.col("content"), ASYNC, 1)).otherwise(F.col("content")))


def _async_names(lines: DataFrame) -> DataFrame:
    """``asyncs``: names of the matches that begin on the line (null if none); ``text`` without the marks."""
    marked = F.contains("text", F.lit(MARK_OPEN)) & F.col("lang_id").isin(*JS_TS)
    return lines.withColumns({"asyncs": F.when(marked, F.nullif(marked_names(F.col("text")), F.array().cast("array<string>"))),
                              "text": F.when(marked, unmarked(F.col("text"))).otherwise(F.col("text"))})


def _async_findings(bodies: DataFrame) -> DataFrame:
    risky = bodies.where((F.col("waits") > 0) & (F.col("guards") == 0))
    found = risky.select("path", "lang_id", "line_no", "text", F.posexplode_outer("start").alias("k", "name"))
    return slim(found.where(F.col("name").isNotNull()), "X03", args=[F.col("name")], ord=F.col("k"))


def async_no_error_handling(files: DataFrame) -> DataFrame:
    js = files.where(F.col("lang_id").isin(*JS_TS) & F.contains("content", F.lit("async")))
    lines = _async_names(_numbered(_async_marked(js)))
    lines = lines.withColumns({"start": F.col("asyncs"), **_counted("waits", "guards")}).drop("asyncs")
    return _async_findings(brace_body(lines, ["waits", "guards"]))


def switch_bodies(files: DataFrame) -> DataFrame:
    lines = _numbered(files.where(F.contains("content", F.lit("switch"))))
    lines = lines.withColumns({"start": F.when(F.col("text").rlike(SWITCH), F.lit("")), **_counted("defaults")})
    return brace_body(lines, ["defaults"])


def switch_no_default(files: DataFrame) -> DataFrame:
    return slim(switch_bodies(files).where(F.col("defaults") == 0), "X05")


EVENT = re.compile(f"[{{}}\n{MARK_DECISION}]")
BLANK = " \t\n\x0b\f\r"


def file_extents(text: str, starts: list[int], by_indent: bool) -> list[tuple[int | None, int, int | None]]:
    """For blocks that start on these lines: the line of the closing brace (None if never closed), the decision marks inside, and the last line
    of the block by indent (None if the file has braces). Without a closing brace marks are counted for UNCLOSED_LINES lines."""
    line, opens, braces, marks, places, depth = 1, [], [], [], {}, [0]
    for found in EVENT.finditer(text):
        mark = found[0]
        if mark == "\n":
            line += 1
        elif mark == MARK_DECISION:
            marks.append(line)
        else:
            if mark == "{":
                opens.append(len(braces))
            depth.append(depth[-1] + (1 if mark == "{" else -1))
            places.setdefault(depth[-1], []).append(len(braces))
            braces.append(line)
    lasts = _indent_ends(text, line) if by_indent else None
    out = []
    for start in starts:
        first = bisect_left(braces, start)
        opening = bisect_left(opens, first)
        ends = places.get(depth[first], []) if opening < len(opens) else []
        end = bisect_left(ends, opens[opening]) if ends else 0
        closed = braces[ends[end]] if end < len(ends) else None
        last = lasts[start - 1] if lasts else None
        through = last or closed or start + UNCLOSED_LINES - 1
        out.append((closed, bisect_left(marks, through + 1) - bisect_left(marks, start), last))
    return out


def _indent_ends(text: str, n_lines: int) -> list[int]:
    """For each line the one before the next line that is neither blank nor deeper."""
    out, later = [], []
    for no, code in zip(range(n_lines, 0, -1), reversed(text.split("\n"))):
        bare = code.lstrip(BLANK)
        indent = len(code) - len(bare)
        while later and bare and later[-1][0] > indent:
            later.pop()
        out.append(later[-1][1] - 1 if later else n_lines)
        if bare:
            later.append((indent, no))
    return out[::-1]


def _extents(text: Column, starts: Column, by_indent: Column) -> Column:
    """file_extents of each row as an array of structs, in Arrow batches."""
    kind = pa.struct([("closed", pa.int32()), ("decided", pa.int32()), ("last", pa.int32())])

    @F.arrow_udf("array<struct<closed:int,decided:int,last:int>>")
    def extents(texts: pa.Array, starts: pa.Array, by_indent: pa.Array) -> pa.Array:
        rows = [file_extents(*row) for row in zip(texts.to_pylist(), starts.to_pylist(), by_indent.to_pylist())]
        return pa.array([[dict(zip(("closed", "decided", "last"), e)) for e in row] for row in rows], pa.list_(kind))

    return extents(text, starts, by_indent)


def block_starts(files: DataFrame, functions: bool, asyncs: bool = False, switches: bool = False) -> DataFrame:
    """One row per line that starts a block: path, lang_id, n_lines, line_no, text, function (its name), asyncs (names), switch, the block's extent
    (closed, decided, last: see file_extents), unguarded (an async body waits without a guard) and bare (a switch has no default).

    A file is one row until its blocks are known: nothing is shuffled, and files in which no block starts are left out first.
    """
    marked = F.lit(False)
    rows = files.select("path", "lang_id", "content")
    if asyncs:
        rows = _async_marked(rows.withColumn("whole", F.col("content"))).withColumnsRenamed({"content": "marked", "whole": "content"})
        marked = F.col("lang_id").isin(*JS_TS) & F.contains("marked", F.lit(MARK_OPEN))
    rows = rows.withColumn("lines", split_lines(F.col("marked" if asyncs else "content")))
    if asyncs:
        on_lines = F.transform("lines", lambda x: F.when(F.contains(x, F.lit(MARK_OPEN)), F.nullif(marked_names(x), F.array().cast("array<string>"))))
        rows = rows.withColumns({"asyncs": F.when(marked, on_lines), "lines": F.when(marked, F.transform("lines", lambda x: F.when(
            F.contains(x, F.lit(MARK_OPEN)), unmarked(x)).otherwise(x))).otherwise(F.col("lines"))})

    def starts(names: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            return F.struct((i + 1).alias("line_no"), x.alias("text"), F.get(names, i).alias("function"),
                            (F.get("asyncs", i) if asyncs else F.lit(None).cast("array<string>")).alias("asyncs"),
                            (F.contains(x, F.lit("switch")) & x.rlike(SWITCH) if switches else F.lit(False)).alias("switch"))

        some = [F.exists(names, lambda n: n.isNotNull()), *([F.col("asyncs").isNotNull()] if asyncs else []), *([F.contains("content", F.lit("switch"))] if switches else [])]
        return F.when(any_of(some), F.filter(F.transform("lines", one), lambda r: r["function"].isNotNull() | r["asyncs"].isNotNull() | r["switch"]))

    names = F.expr(_names_of_lines()) if functions else F.lit(None).cast("array<string>")
    # the test stands inside the generator: as a WHERE it would be pushed down and everything made twice
    held = let(let(names, starts), lambda s: F.when(F.size(s) > 0, F.struct(s.alias("starts"), (_decisions_marked() if functions else F.col("content")).alias("marked"))))
    rows = rows.select("path", "lang_id", "lines", F.inline_outer(F.array(held))).where(F.col("starts").isNotNull())
    ends = _extents(F.col("marked"), F.transform("starts", lambda s: s["line_no"]), F.col("lang_id").isin(*INDENTED))
    rows = rows.select("path", "lang_id", "lines", "starts", ends.alias("ends"))

    def whole(s: Column, n: Column) -> Column:
        e = F.get("ends", n)
        body = F.least(e["closed"], s["line_no"] + BODY_LINES - 1) - s["line_no"] + 1  # least leaves nulls out
        text = F.array_join(F.slice("lines", s["line_no"], body), "\n")
        unguarded = let(text, lambda t: contains_any(t, GUARDS["waits"]) & ~contains_any(t, GUARDS["guards"]))
        return F.struct(*[s[c].alias(c) for c in ("line_no", "text", "function", "asyncs", "switch")], *[e[c].alias(c) for c in ("closed", "decided", "last")],
                        F.when(s["asyncs"].isNotNull(), unguarded).alias("unguarded"), F.when(s["switch"], ~contains_any(text, GUARDS["defaults"])).alias("bare"))

    return rows.select("path", "lang_id", F.size("lines").alias("n_lines"), F.inline_outer(F.transform("starts", whole))).where(F.col("line_no").isNotNull())


def block_findings(files: DataFrame, config: ReviewConfig, functions: bool, asyncs: bool, switches: bool) -> DataFrame:
    """All block rules over one read of the files, without a shuffle of their lines. Paths are looked through first: where some come more than once, the rows of
    each of these are taken together, which needs one."""
    several = kept(files.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select("path"), "several")
    if several.first() is None:
        return _findings_in_rows(files, config, functions, asyncs, switches)
    return _findings_in_rows(files.join(several, "path", "left_anti"), config, functions, asyncs, switches).unionByName(
        _findings_by_path(files.join(several, "path", "left_semi"), config, functions, asyncs, switches))


def _findings_in_rows(files: DataFrame, config: ReviewConfig, functions: bool, asyncs: bool, switches: bool) -> DataFrame:
    starts = block_starts(files, functions, asyncs, switches)
    text = F.col("text")
    # one explode instead of one branch per rule, so that the extents are computed once
    none = F.array().cast(f"array<{FIND}>")
    found = []
    if functions:
        end = F.coalesce("last", "closed", F.least(F.col("line_no") + UNCLOSED_LINES - 1, "n_lines"))
        found.append(F.when(F.col("function").isNotNull(), function_hits(F.col("function"), end, end - F.col("line_no") + 1, F.col("decided") + 1, config)))
    if asyncs:
        found.append(F.when(F.col("unguarded"), F.transform("asyncs", lambda n, k: find("X03", F.col("line_no"), text, [n], ord=k))))
    if switches:
        found.append(F.when(F.col("bare"), F.array(find("X05", F.col("line_no"), text))))
    return from_arrays(starts, F.concat(*[F.coalesce(f, none) for f in found]))


def _findings_by_path(files: DataFrame, config: ReviewConfig, functions: bool, asyncs: bool, switches: bool) -> DataFrame:
    """The same over one shuffle of the braced lines (and one of the indented): the lines of all rows of a path are taken together."""
    text = F.col("text")
    lines = _async_names(_numbered(_async_marked(files) if asyncs else files))
    braced = ~F.col("lang_id").isin(*INDENTED)
    start = F.struct(
        (F.when(braced, _of_line(function_name("x"))) if functions else F.lit(None).cast("string")).alias("function"),
        F.col("asyncs").alias("asyncs"), (text.rlike(SWITCH) if switches else F.lit(False)).alias("switch"))
    counts = {**({"decisions": UNCLOSED_LINES} if functions else {}),
              **({"waits": BODY_LINES, "guards": BODY_LINES} if asyncs else {}), **({"defaults": BODY_LINES} if switches else {})}
    columns = _counted(*[c for c in counts if c != "decisions"])
    if functions:
        columns["decisions"] = F.when(braced, _of_line(decision_count("x"))).otherwise(0)
    any_start = F.col("start.function").isNotNull() | F.col("start.asyncs").isNotNull() | F.col("start.switch")
    lines = lines.withColumns({"start": start, **columns}).withColumn("start", F.when(any_start, F.col("start"))).drop("asyncs")
    length, indents = F.octet_length("content").cast("long"), F.col("lang_id").isin(*INDENTED)
    size, indented_size = files.agg(F.sum(length), F.sum(F.when(indents, length))).first()
    ends = brace_extent(lines, counts, size or 0)

    capped = F.least(F.col("line_no") + BODY_LINES - 1, "n_lines")

    def inside(c: str) -> Column:
        return F.when(F.col("closed") <= capped, F.col(f"{c}_closed")).otherwise(F.col(f"{c}_reach")) - F.col(f"{c}_before")

    # one explode instead of one branch per rule, so that the extents are computed once
    none = F.array().cast(f"array<{FIND}>")
    found = []
    if functions:
        end = F.coalesce("closed", F.least(F.col("line_no") + UNCLOSED_LINES - 1, "n_lines"))
        size = end - F.col("line_no") + 1
        hard = F.coalesce("decisions_closed", "decisions_reach") - F.col("decisions_before") + 1
        found.append(F.when(F.col("start.function").isNotNull(), function_hits(F.col("start.function"), end, size, hard, config)))
    if asyncs:
        found.append(F.when(F.col("start.asyncs").isNotNull() & (inside("waits") > 0) & (inside("guards") == 0), F.transform(
            "start.asyncs", lambda n, k: find("X03", F.col("line_no"), text, [n], ord=k))))
    if switches:
        found.append(F.when(F.col("start.switch") & (inside("defaults") == 0), F.array(find("X05", F.col("line_no"), text))))
    out = from_arrays(ends, F.concat(*[F.coalesce(f, none) for f in found]))
    if functions:
        by_indent = indented_functions(files, indented_size or 0)
        size = F.col("end_line") - F.col("line_no") + 1
        out = out.unionByName(from_arrays(by_indent, function_hits(F.col("start"), F.col("end_line"), size, F.col("decisions") + 1, config)))
    return out


def window_prefix_counts(files: DataFrame) -> DataFrame:
    """Running counts through each line; a body's content is the difference of two of them.

    The extents above carry these sums themselves, for the lines they need.
    """
    text = F.col("text")
    counts = _numbered(files).select(
        "path", "line_no", _of_line(decision_count("x")).alias("decisions"), _has(text, "await").alias("awaits"),
        _has(text, "try").alias("tries"), _has(text, ".catch").alias("catches"),
        (_has(text, "default:") + _has(text, "default :")).alias("defaults"))
    so_far = W.partitionBy("path").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    return counts.select("path", "line_no", *[F.sum(c).over(so_far).alias(c) for c in counts.columns[2:]])
