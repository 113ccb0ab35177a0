"""Rules over the lines of one file in their order.

A file is one row and its lines are an array in it (long files: see pieces), so a rule that looks at the
next four lines, at the twenty before, or keeps a running loop depth is a function of that
array. None of these rules shuffles or sorts. Each ``*_hits`` gives an array of findings
and is guarded by the language and a word the file must hold; the review puts them together
in one pass over the files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.catalog.rules import JS_TS
from lintlake.functions.regex import java_regex
from lintlake.functions.text import contains_any, let, split_lines, starts_with_any, trim_all
from lintlake.operators.findings import FIND, existing, find, from_arrays

EXITS = ("return", "break", "continue", "throw", "exit", "Exit", "panic")
EXIT = java_regex(r"^(?:return|break|continue|throw|exit|sys\.exit|os\.Exit|panic)\b")
STILL_REACHED = r"^(?:case|default|catch|except|else|elif|elsif|finally|\}\s*(?:else|catch|finally))"
AWAIT_DECLARATION = java_regex(r"^(?:const|let|var)\s+\w+\s*=\s*await\b")
LOOPS = ("for", "while", "do")
LOOP = java_regex(r"\b(?:for|while|do)\b\s*[\(\{:]")


def with_lines(files: DataFrame) -> DataFrame:
    return files.withColumn("lines", split_lines(F.col("content")))


def _js() -> Column:
    return F.col("lang_id").isin(*JS_TS)


def _run(files: DataFrame, hits: Callable[[], Column]) -> DataFrame:
    return from_arrays(with_lines(files), hits())


def unreachable_hits() -> Column:
    """The first of the four lines after an exit that is neither blank, comment nor a lone bracket,
    unless it begins a branch."""
    def after(x: Column, i: Column) -> Column:
        four = F.transform(F.slice("lines", i + 2, 4), lambda t, n: F.struct(
            (i + n + 2).alias("line_no"), t.alias("text"), trim_all(t).alias("code")))
        passed = F.filter(four, lambda r: ~r["code"].isin("", "}", ")") & ~starts_with_any(r["code"], ("//", "#", "*")))
        report = let(F.get(passed, F.lit(0)), lambda r: F.when(
            r.isNotNull() & ~r["code"].rlike(STILL_REACHED),
            find("A11", r["line_no"], r["text"], [r["line_no"], i + 1], pos=i + 1)))
        return F.when(contains_any(x, EXITS) & trim_all(x).rlike(EXIT), report)

    return F.when(contains_any(F.col("content"), EXITS), existing(F.transform("lines", after)))


def win_unreachable(files: DataFrame) -> DataFrame:
    return _run(files, unreachable_hits)


def empty_catch_hits() -> Column:
    """C-style catch blocks and Python except blocks (other languages are recognised, never reported)."""
    caught = java_regex(r"\bcatch\s*\(")

    def c_style(x: Column, i: Column) -> Column:
        nexts = F.filter(F.transform(F.slice("lines", i + 2, 3), trim_all), lambda t: ~t.isin("", "{"))
        empty = x.rlike(r"\{\s*\}") | (F.coalesce(F.get(nexts, F.lit(0)), F.lit("")) == "}")
        return F.when(x.rlike(caught) & empty, find("A13", i + 1, x))

    def python(x: Column, i: Column) -> Column:
        passes = trim_all(F.coalesce(F.get("lines", i + 1), F.lit(""))) == "pass"
        return F.when(trim_all(x).rlike(java_regex(r"^except\b")) & passes, find("A13", i + 1, x))

    return (F.when((F.col("family") == "c-style") & F.contains("content", F.lit("catch")), existing(F.transform("lines", c_style)))
            .when(F.col("lang_id") == "python", existing(F.transform("lines", python))))


def win_empty_catch(files: DataFrame) -> DataFrame:
    return _run(files, empty_catch_hits)


def sequential_await_hits() -> Column:
    def pair(x: Column, i: Column) -> Column:
        following = trim_all(F.coalesce(F.get("lines", i + 1), F.lit("")))
        return F.when(trim_all(x).rlike(AWAIT_DECLARATION) & following.rlike(AWAIT_DECLARATION), find("X07", i + 1, x))

    return F.when(_js() & F.contains("content", F.lit("await")), existing(F.transform("lines", pair)))


def win_sequential_awaits(files: DataFrame) -> DataFrame:
    return _run(files, sequential_await_hits)


def _by_context(uid: str, word: str, hit: Callable[[Column], Column], context: Callable[[Column], Column], before: int,
                own_line: bool, present: bool, ord: int = 0) -> Column:
    """Lines where ``hit`` holds and (``context`` holds somewhere in the frame before) = ``present``."""
    def test(flags: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            first = F.greatest(i + 1 - before, F.lit(1))
            near = F.exists(F.slice(flags, first, i + 1 - first + (1 if own_line else 0)), lambda b: b)
            return F.when(hit(x) & (near if present else ~near), find(uid, i + 1, x, ord=ord))

        return existing(F.transform("lines", one))

    return F.when(_js() & F.contains("content", F.lit(word)), let(F.transform("lines", context), test))


def json_parse_hits() -> Column:
    opened = java_regex(r"\btry\s*\{")
    return _by_context("X01", "JSON.parse", lambda x: x.rlike(r"JSON\.parse\s*\("),
                       lambda x: x.rlike(opened) | (trim_all(x) == "try:"), 20, True, False)


def win_json_parse_no_try(files: DataFrame) -> DataFrame:
    return _run(files, json_parse_hits)


def destructure_hits() -> Column:
    return _by_context("X06", "[", lambda x: x.rlike(r"(?:const|let)\s*\[.+\]\s*="),
                       lambda x: F.contains(x, F.lit(".length")) | F.contains(x, F.lit("if (")), 3, False, False, ord=1)


def win_destructure_no_check(files: DataFrame) -> DataFrame:
    return _run(files, destructure_hits)


def timeout_hits() -> Column:
    timer, loop = java_regex(r"\bsetTimeout\s*\("), java_regex(r"\b(?:for|while|forEach|map)\b")
    return _by_context("X10", "setTimeout", lambda x: x.rlike(timer), lambda x: x.rlike(loop), 5, False, True)


def win_timeout_in_loop(files: DataFrame) -> DataFrame:
    return _run(files, timeout_hits)


def _count(text: Column, ch: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(ch)))


CHUNK = 256


def loop_moves(lines: Column, first: Column) -> Column:
    """The lines that open a loop (inc) or close more braces than they open (dec); first: the number of the first line."""
    return F.filter(F.transform(lines, lambda x, i: F.struct(
        (i + first).alias("line_no"), F.when(contains_any(x, LOOPS) & x.rlike(LOOP), 1).otherwise(0).alias("inc"),
        F.greatest(F.lit(0), _count(x, "}") - _count(x, "{")).alias("dec"), x.alias("text"))),
        lambda m: (m["inc"] > 0) | (m["dec"] > 0))


def loop_walk(moves: Column, depth: Column) -> Column:
    """depth, outer and hits (a list of lists) after a running depth over the moves that never falls below zero."""
    state = f"struct<depth:int,outer:int,hits:array<{FIND}>>"
    whole = f"struct<depth:int,outer:int,hits:array<array<{FIND}>>>"
    # an array that grows by one is copied: hits grow inside chunks, chunks in a list of their own
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(moves) - 1) / CHUNK).cast("int")), lambda c: F.slice(moves, c * CHUNK + 1, CHUNK))
    chunks = F.when(F.size(moves) > 0, chunks).otherwise(F.slice(F.array(moves), 1, 0))
    zero = F.struct(depth.alias("depth"), F.lit(None).cast("int").alias("outer"), F.array().alias("hits")).cast(whole)

    def step(acc: Column, m: Column) -> Column:
        at = acc["depth"] + m["inc"]
        outer = F.when((m["inc"] == 1) & (at == 1), m["line_no"]).otherwise(acc["outer"])
        hit = find("P20", m["line_no"], m["text"], [m["line_no"], outer])
        hits = F.when((m["inc"] == 1) & (at >= 3), F.array_append(acc["hits"], hit)).otherwise(acc["hits"])
        return F.struct(F.greatest(F.lit(0), at - m["dec"]).alias("depth"), outer.alias("outer"), hits.alias("hits")).cast(state)

    def walk(acc: Column, chunk: Column) -> Column:
        start = F.struct(acc["depth"].alias("depth"), acc["outer"].alias("outer"), F.array().alias("hits")).cast(state)
        return F.aggregate(chunk, start, step, lambda end: F.struct(
            end["depth"].alias("depth"), end["outer"].alias("outer"), F.array_append(acc["hits"], end["hits"]).alias("hits")).cast(whole))

    return F.aggregate(chunks, zero, walk)


def nested_loop_hits() -> Column:
    """Loops at depth three or more. Files with fewer than three loops cannot reach that depth."""
    some = contains_any(F.col("content"), LOOPS) & (F.regexp_count("content", F.lit(LOOP)) >= 3)
    return F.when(some, F.flatten(loop_walk(loop_moves(F.col("lines"), F.lit(1)), F.lit(0))["hits"]))


def win_nested_loops(files: DataFrame) -> DataFrame:
    return _run(files, nested_loop_hits)


HITS = {"A11": unreachable_hits, "A13": empty_catch_hits, "X07": sequential_await_hits, "X01": json_parse_hits,
        "X06": destructure_hits, "X10": timeout_hits, "P20": nested_loop_hits}
