"""URL filter: a bit-parallel wildcard automaton over canonical URLs.

All glob rules are packed into the bits of a few 64-bit words (Shift-And). One step reads one byte of every URL of a batch and
moves all rules at once: shift, and with the byte's mask, or with the states that a wildcard keeps alive. Words are joined by
carried bits, so there may be any number of rules. Work per URL is its length times the number of words.

Globs: `*` any run without `/`, `**` any run, `?` one byte, else the byte itself. A rule must match the whole canonical
URL: a dot, the host with A-Z lower-cased, the path (up to `?`, `#` or the end). The leading dot lets one glob, `*.org/**`,
stand for a host and its subdomains: `*` cannot leave the host.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# List rules, host and path prefix with verdict
LIST_RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))

#: The method's own rules, for URLs that no list rule fits: globs over canonical URLs. The rest is allowed.
GLOBS = (("*spam*/**", "block"), ("*spam*", "block"), ("*cheap-pills*/**", "block"), ("*cheap-pills*", "block"), ("*casino*/**", "block"), ("*casino*", "block"),
         ("*.xxx/**", "block"), ("**/wp-login.php", "block"), ("**.exe", "block"), ("**/porn*", "block"))


@dataclass
class Rule:
    """A glob with its verdict; `listed` is the text of a list rule, which wins over others, the longest first."""

    glob: str
    verdict: str
    listed: str | None = None


def rules_of(listed=LIST_RULES, globs=GLOBS) -> list[Rule]:
    """List rules (host, then path prefix) as globs for the host and all its subdomains, then the method's own."""
    out = [Rule(f"*.{r.partition('/')[0]}/{r.partition('/')[2]}**", v, r) for r, v in sorted(listed, key=lambda x: (-len(x[0]), x[0]))]
    return out + [Rule(g, v) for g, v in globs]


def parsed(glob: str) -> tuple[list[int], list[str]]:
    """Symbols of a glob (-1: any byte) and, before each and after the last, the kind of run allowed: "", "*" or "**"."""
    symbols, runs, raw, i = [], [""], glob.encode(), 0
    while i < len(raw):
        if raw[i] == 42:
            double = raw[i + 1:i + 2] == b"*"
            runs[-1] = "**" if double or runs[-1] == "**" else "*"
            i += 1 + double
        else:
            symbols.append(-1 if raw[i] == 63 else raw[i])
            runs.append("")
            i += 1
    return symbols, runs


@dataclass
class Automaton:
    """State j of a rule: its first j symbols are matched. Bits of all rules side by side in words of 64."""

    rules: list[Rule]
    words: int = 0
    step: np.ndarray = field(default=None)
    stay: np.ndarray = field(default=None)
    start: np.ndarray = field(default=None)
    ends: list[int] = field(default_factory=list)

    def __post_init__(self):
        shapes = [parsed(r.glob) for r in self.rules]
        self.words = max(1, -(-sum(len(s) + 1 for s, _ in shapes) // 64))
        bits = np.zeros((256, self.words * 64), bool)
        stay = np.zeros((256, self.words * 64), bool)
        start = np.zeros(self.words * 64, bool)
        slash = np.arange(256) == ord("/")
        at = 0
        for symbols, runs in shapes:
            start[at] = True
            for j, run in enumerate(runs):
                if run:
                    stay[:, at + j] = True if run == "**" else ~slash
                if j:
                    bits[:, at + j] = True if symbols[j - 1] < 0 else np.arange(256) == symbols[j - 1]
            self.ends.append(at + len(symbols))
            at += len(symbols) + 1

        def packed(x):
            return np.packbits(x, axis=-1, bitorder="little").view(np.uint64)

        self.step, self.stay, self.start = packed(bits), packed(stay), packed(start)

    def matches(self, urls: list[bytes]) -> np.ndarray:
        """(urls, rules): whether the rule matches the whole URL. URLs are taken longest first, so each step has the unfinished in front."""
        lengths = np.fromiter(map(len, urls), np.int64, len(urls))
        order = np.argsort(-lengths, kind="stable")
        flat = np.frombuffer(b"".join(urls), np.uint8)
        firsts = (np.cumsum(lengths) - lengths)[order]
        sizes = lengths[order]
        state = np.repeat(self.start[None, :], len(urls), axis=0)
        live = len(urls)
        for t in range(int(sizes[0]) if len(urls) else 0):
            while live and sizes[live - 1] <= t:
                live -= 1
            now = state[:live]
            byte = flat[firsts[:live] + t]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:live] = (moved & self.step[byte]) | (now & self.stay[byte])
        ends = np.array(self.ends, np.int64)
        found = (state[:, ends // 64] >> (ends % 64).astype(np.uint64)) & np.uint64(1)
        out = np.empty((len(urls), len(ends)), bool)
        out[order] = found.astype(bool)
        return out


def judge(pages: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every page.

    host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: from there up to `?`, `#` or the end; a
    null url or one without `://` has both empty. rule: the longest fitting list rule, else null; verdict: that rule's,
    else that of the first of the method's globs that matches, else allow. Rows repeat as in pages; other columns
    are not read. Only page_id and url leave the scan.
    """
    automaton = Automaton(rules if rules is not None else rules_of())
    after = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract("_after", r"^[^/?#]*", 0)
    parts = (pages.select("page_id", F.coalesce(after, F.lit("")).alias("_after")).withColumn("_host", host)
             .select("page_id", F.translate("_host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"),
                     F.regexp_extract(F.expr("substring(_after, char_length(_host) + 1)"), r"^[^?#]*", 0).alias("path")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            urls = [b"." + h.encode() + p.encode() for h, p in zip(b.column("host").to_pylist(), b.column("path").to_pylist())]
            found = automaton.matches(urls)
            first = np.where(found.any(axis=1), found.argmax(axis=1), -1).tolist() if automaton.rules else [-1] * len(urls)
            listed = [automaton.rules[i].listed if i >= 0 else None for i in first]
            verdicts = [automaton.rules[i].verdict if i >= 0 else "allow" for i in first]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("host"), b.column("path"), pa.array(listed, pa.string()), pa.array(verdicts, pa.string())],
                                             ["page_id", "host", "path", "rule", "verdict"])

    kind = dict(pages.dtypes)["page_id"]
    return parts.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")


def judge_sql(globs=GLOBS) -> str:
    """The same in DuckDB SQL; the globs as regular expressions."""
    def regex(glob: str) -> str:
        symbols, runs = parsed(glob)
        out = ""
        for j, run in enumerate(runs):
            if j:
                out += "." if symbols[j - 1] < 0 else "".join("\\" + chr(symbols[j - 1]) if not chr(symbols[j - 1]).isalnum() else chr(symbols[j - 1]))
            out += {"": "", "*": "[^/]*", "**": ".*"}[run]
        return f"(?s)^{out}$"

    listed = sorted(LIST_RULES, key=lambda x: (-len(x[0]), x[0]))
    fits = {r: f"('.' || host) LIKE '%.{r.partition('/')[0]}' AND starts_with(path, '/{r.partition('/')[2]}')" for r, _ in listed}
    rule = "CASE " + " ".join(f"WHEN {fits[r]} THEN '{r}'" for r, _ in listed) + " END"
    own = "CASE " + " ".join(f"WHEN regexp_matches('.' || host || path, '{regex(g)}') THEN '{v}'" for g, v in globs) + " ELSE 'allow' END"
    verdict = "CASE " + " ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in listed) + f" ELSE {own} END"
    return f"""
WITH a AS (SELECT page_id, coalesce(CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END, '') AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r AS (SELECT *, {rule} AS rule FROM p)
SELECT page_id, host, path, rule, {verdict} AS verdict FROM r"""
