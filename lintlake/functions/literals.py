"""Literals a regular expression cannot match without, and one expression that finds many literals at once."""

from __future__ import annotations

import re
import re._constants as C
import re._parser as parser
from collections.abc import Iterable

from lintlake.functions.regex import escape_literal
from lintlake.functions.sqltext import contains_sql, quoted

#: Literals shorter than this stand on most lines and choose nothing
SHORTEST = 3
#: A run of characters with so many spellings at most is spelt out
SPELLINGS = 16


def required_literals(pattern: str) -> tuple[str, ...] | None:
    """Lower-case ASCII words of which every match holds one, in any case; None if no such words are found.

    Longer words are preferred. Patterns that the parser of the common dialect does not take have none.
    """
    try:
        found = _needed(parser.parse(pattern))
    except (re.error, OverflowError, RecursionError):
        return None
    return tuple(sorted(found)) if found and min(map(len, found)) >= SHORTEST else None


def needed_test(pattern: str, text: str) -> str:
    """SQL that holds wherever the pattern matches ``text``, by its literals alone (in their case); empty if it needs none.
    A search for literals costs a small part of a search for a pattern."""
    try:
        tree = parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return ""
    return "" if tree.state.flags & re.IGNORECASE else _test(tree, text)


def _test(items, text: str) -> str:
    """All literal runs of a sequence and what its other elements need."""
    tests, run = [], ""
    for op, arg in [*items, (None, None)]:
        if op is C.LITERAL:
            run += chr(arg)
            continue
        tests += [f"contains({text}, {quoted(run)})"] if run else []
        run = ""
        if op is C.BRANCH:
            ways = [f"({t})" if ' AND ' in (t := _test(way, text)) else t for way in arg[1]]
            tests += [f"({' OR '.join(dict.fromkeys(ways))})"] if all(ways) else []
        elif op is C.IN and len(arg) <= 4 and all(o is C.LITERAL for o, _ in arg):
            tests.append(contains_sql(text, [chr(a) for _, a in arg]))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and arg[0] > 0:
            tests.append(_test(arg[2], text))
        elif op is C.SUBPATTERN and not arg[1] & re.IGNORECASE:
            tests.append(_test(arg[3], text))
        elif op is C.ATOMIC_GROUP:
            tests.append(_test(arg, text))
    return " AND ".join(dict.fromkeys(t for t in tests if t))


def _spelt(op, arg) -> set[str] | None:
    """All strings the element can match, lower-case; None if they are not few."""
    if op is C.LITERAL:
        return {chr(arg).lower()} if arg < 128 else None
    if op is C.IN:
        parts = [chr(a).lower() if o is C.LITERAL and a < 128 else None for o, a in arg]
        return None if None in parts or len(set(parts)) > 4 else set(parts)
    if op is C.SUBPATTERN:
        return _spelt_all(arg[3])
    if op is C.BRANCH:
        ways = [_spelt_all(way) for way in arg[1]]
        return None if None in ways or sum(map(len, ways)) > SPELLINGS else set().union(*ways)
    if op in (C.AT, C.ASSERT, C.ASSERT_NOT):
        return {""}
    return None


def _spelt_all(items) -> set[str] | None:
    out = {""}
    for op, arg in items:
        more = _spelt(op, arg)
        if more is None or len(out) * len(more) > SPELLINGS:
            return None
        out = {a + b for a in out for b in more}
    return out


def _needed(items) -> set[str] | None:
    """The best set of words for a sequence: a run of spelt elements, or what one of its elements needs."""
    best, run = None, {""}

    def consider(words: set[str] | None) -> None:
        nonlocal best
        if words and "" not in words and (best is None or (min(map(len, words)), -len(words)) > (min(map(len, best)), -len(best))):
            best = words

    for op, arg in items:
        spelt = _spelt(op, arg)
        if spelt is not None and len(run) * len(spelt) <= SPELLINGS:
            run = {a + b for a in run for b in spelt}
            continue
        consider(run)
        run = spelt if spelt is not None else {""}
        if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            if arg[0] > 0:
                consider(_needed(arg[2]))
        elif op is C.SUBPATTERN:
            consider(_needed(arg[3]))
        elif op is C.BRANCH:
            ways = [_needed(way) for way in arg[1]]
            consider(None if None in ways else set().union(*ways))
        elif op is C.ATOMIC_GROUP:
            consider(_needed(arg))
    consider(run)
    return best


def word_tree(words: Iterable[str]) -> str:
    """One expression for the longest of the words that begins at a place: common beginnings are written once, and where many
    characters can follow, classes of them are told apart by halving."""
    root: dict = {}
    for word in words:
        node = root
        for ch in word:
            node = node.setdefault(ch, {})
        node[""] = {}

    def one_of(node: dict, chars: list[str]) -> str:
        if len(chars) <= 3:
            return "|".join(escape_literal(ch) + text(node[ch]) for ch in chars)
        half = len(chars) // 2
        parts = []
        for some in (chars[:half], chars[half:]):
            parts.append(f"(?=[{''.join(escape_in_class(ch) for ch in some)}])(?:{one_of(node, some)})")
        return "|".join(parts)

    def text(node: dict) -> str:
        chars = [ch for ch in sorted(node) if ch]
        if not chars:
            return ""
        body = escape_literal(chars[0]) + text(node[chars[0]]) if len(chars) == 1 and "" not in node else f"(?:{one_of(node, chars)})"
        return body + ("?" if "" in node else "")

    return text(root)


def escape_in_class(ch: str) -> str:
    return ch if ch.isalnum() else "\\" + ch


def beginnings(word: str, words: set[str]) -> list[str]:
    """Those of the words that the word begins with, itself included."""
    return [word[:n] for n in range(1, len(word) + 1) if word[:n] in words]
