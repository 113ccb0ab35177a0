"""Spark SQL text for expressions generated from catalogs.

A catalog of fifty regex rules is some two thousand column calls, and every call is a round trip to
the JVM; as text the whole expression is handed over once.
"""

from __future__ import annotations

from collections.abc import Iterable

from lintlake.functions.text import WHITE_SPACE


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def quoted_list(items: Iterable[str]) -> str:
    return ", ".join(quoted(i) for i in items)


def any_sql(tests: Iterable[str]) -> str:
    tests = list(tests)
    return "(" + " OR ".join(tests) + ")" if tests else "false"


def contains_sql(expr: str, words: Iterable[str]) -> str:
    return any_sql(f"contains({expr}, {quoted(w)})" for w in words)


def starts_sql(expr: str, words: Iterable[str]) -> str:
    return any_sql(f"startswith({expr}, {quoted(w)})" for w in words)


def rlike_sql(expr: str, java_pattern: str) -> str:
    return f"rlike({expr}, {quoted(java_pattern)})"


def trim_sql(expr: str) -> str:
    return f"btrim({expr}, {quoted(WHITE_SPACE)})"
