"""Regex texts are kept in the common dialect; this adapts them to java.util.regex.

Two meanings differ on the JVM: ``\\b`` looks at Unicode letters (the rules mean
ASCII words) and ``$`` also matches before a final line terminator.
"""

from __future__ import annotations

import re

_ASCII_EDGE = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"


def java_regex(pattern: str, ignore_case: bool = False, exact_edges: bool = False) -> str:
    """Return ``pattern`` for RLIKE. ``exact_edges`` keeps both readings of every ``\\b``."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        two = pattern[i:i + 2]
        if two[0] == "\\":
            if two == r"\b" and not in_class:
                out.append(_ASCII_EDGE if exact_edges else _edge(pattern, i))
            else:
                out.append(two)
            i += 2
            continue
        ch = pattern[i]
        if ch == "[":
            out.append(r"\[" if in_class else ch)
            in_class = True
        elif ch == "]" and in_class:
            in_class = False
            out.append(ch)
        elif ch == "$" and not in_class:
            out.append(r"\z")
        else:
            out.append(ch)
        i += 1
    return ("(?i)" if ignore_case else "") + "".join(out)


def _edge(pattern: str, at: int) -> str:
    """Word start if a word element follows, word end otherwise."""
    rest = pattern[at + 2:]
    return r"(?<!\w)" if re.match(r"[A-Za-z0-9_(]|\\[wd]", rest) else r"(?!\w)"


def escape_literal(text: str) -> str:
    return re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", text)
