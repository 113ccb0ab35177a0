"""Column helpers over text and over arrays of lines."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that trimming removes.
WHITE_SPACE = (
    "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
MARK_OPEN, MARK_CLOSE, MARK_OTHER = "\x01", "\x02", "\x03"


def trim_all(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITE_SPACE))


def any_of(conditions: list[Column]) -> Column:
    """OR of the conditions, false when there are none."""
    result = F.lit(False) if not conditions else conditions[0]
    for c in conditions[1:]:
        result = result | c
    return result


def contains_any(col: Column, words: tuple[str, ...] | list[str]) -> Column:
    return any_of([F.contains(col, F.lit(w)) for w in words])


def starts_with_any(col: Column, words: tuple[str, ...] | list[str]) -> Column:
    return any_of([F.startswith(col, F.lit(w)) for w in words])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it as often as needed in ``body``.

    Without it the optimizer may inline an array into a lambda and rebuild it per element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def split_lines(content: Column) -> Column:
    return F.split(content, "\n")


def mark_matches(content: Column, pattern: str, groups: int) -> Column:
    """Put ``<open>name<close>`` in front of each match, so that lines split later know
    which matches begin on them even when a match spans lines."""
    safe = F.replace(F.replace(content, F.lit(MARK_OPEN), F.lit(MARK_OTHER)), F.lit(MARK_CLOSE), F.lit(MARK_OTHER))
    name = "".join(f"${g}" for g in range(1, groups + 1))
    return F.regexp_replace(safe, pattern, f"{MARK_OPEN}{name}{MARK_CLOSE}$0")


def marked_names(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(f"{MARK_OPEN}(\\w*){MARK_CLOSE}"), 1)


def unmarked(line: Column) -> Column:
    return F.regexp_replace(line, f"{MARK_OPEN}\\w*{MARK_CLOSE}", "")


def hash32(content: Column) -> Column:
    """The 32-bit polynomial hash h*31+c over UTF-16 units, wrapped to a signed int: a sum of units times powers of 31, made
    in Arrow batches (a fold over an array of characters costs several times that)."""
    @F.arrow_udf("int")
    def hashes(texts: pa.Array) -> pa.Array:
        powers, out = np.ones(1, np.uint32), []
        for text in texts:
            if (text := text.as_py()) is None:
                out.append(None)
                continue
            units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2")
            if len(units) > len(powers):
                powers = np.cumprod(np.r_[1, np.full(2 * len(units), 31)].astype(np.uint32), dtype=np.uint32)
            out.append(int((units * powers[:len(units)][::-1]).sum(dtype=np.uint32).astype(np.int32)))
        return pa.array(out, pa.int32())

    return hashes(content)
