"""Random files against plain loops, and lookahead rules against another regex engine."""

import random
import re

from pyspark.sql import functions as F

from lintlake.catalog import rules as R
from lintlake.operators import blocks, duplicates, files as fo, scan, sequence, tokens
from lintlake.config import ReviewConfig


def random_text(rnd, parts, n):
    return "\n".join(" " * rnd.choice([0, 0, 2, 4]) + "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 4))) for _ in range(rnd.randint(1, n)))


def corpus(seed, ext, parts, count=120, n=25):
    rnd = random.Random(seed)
    return {f"f{i}.{ext}": random_text(rnd, parts, n) for i in range(count)}


def braced_end(lines, start):
    depth, opened = 0, False
    for at in range(start, len(lines)):
        for c in re.findall("[{}]", lines[at]):
            depth += 1 if c == "{" else -1
            opened = opened or c == "{"
            if opened and depth == 0:
                return at + 1
    return None


def test_brace_extents(files_of):
    texts = corpus(1, "js", ["{", "}", "function a() {", " x ", "} else {", "{}", "}}"])
    ready = fo.reviewable(files_of(texts))
    got = {(r.path, r.line_no): r.closed for r in blocks.braced_functions(ready).collect()}
    assert len(got) > 100
    for (path, line_no), closed in got.items():
        assert closed == braced_end(texts[path].split("\n"), line_no - 1), (path, line_no)


def test_counts_inside_blocks(files_of):
    texts = corpus(2, "js", ["{", "}", "function a() {", " if ", " for ", "} else {", " a?b "])
    ready = fo.reviewable(files_of(texts))
    words = re.compile(r"\b(?:if|else\s+if|for|\?)\b", re.A)
    rows = blocks.extract_functions(ready).collect()
    assert len(rows) > 100
    for r in rows:
        lines = texts[r.path].split("\n")
        end = braced_end(lines, r.line_no - 1) or min(r.line_no + 49, len(lines))
        assert r.end_line == end
        assert r.complexity == 1 + sum(len(words.findall(x)) for x in lines[r.line_no - 1:end])


def test_indented_extents(files_of):
    texts = corpus(3, "py", ["def f(", "x", "if y", ""], n=30)
    for r in blocks.indented_functions(fo.reviewable(files_of(texts))).collect():
        lines = texts[r.path].split("\n")
        own = len(lines[r.line_no - 1]) - len(lines[r.line_no - 1].lstrip())
        later = [i for i in range(r.line_no, len(lines)) if lines[i].strip() and len(lines[i]) - len(lines[i].lstrip()) <= own]
        assert r.end_line == (later[0] if later else len(lines))


def test_loop_depth(files_of):
    texts = corpus(4, "js", ["for (", "while {", "do:", "}", "{", " x"])
    want = set()
    for path, text in texts.items():
        depth = 0
        for n, line in enumerate(text.split("\n"), 1):
            loop = re.search(r"\b(?:for|while|do)\b\s*[({:]", line) is not None
            depth += loop
            if loop and depth > 2:
                want.add((path, n))
            depth = max(0, depth - max(0, line.count("}") - line.count("{")))
    got = {(r.path, r.line_no) for r in sequence.win_nested_loops(fo.reviewable(files_of(texts))).collect()}
    assert got == want and want


def test_unused_names(files_of):
    texts = corpus(5, "ts", ["const aa =", "let\nbb: T =", "aa", "bb ", "'cc'", "var cc= ", "let _d = ", "éaa "])
    declared = re.compile(r"(?:const|let|var)\s+(\w+)\s*(?::\s*\S+\s*)?=", re.A)
    want = set()
    for path, text in texts.items():
        words = re.findall(r"\w+", text, re.A)
        for m in declared.finditer(text):
            if len(m[1]) > 1 and m[1][0] != "_" and words.count(m[1]) == 1:
                want.add((path, text[:m.start()].count("\n") + 1, m[1]))
    got = {(r.path, r.line_no, r.args[0]) for r in tokens.unused_variables(fo.reviewable(files_of(texts))).collect()}
    assert got == want and want


def test_duplicates(files_of):
    parts = ["  const a = compute(b, 'c');", "  const long = combine(x, y);", "  return something(else_, 12);", "short", "// a comment that is long enough", ""]
    rnd = random.Random(6)
    texts = {f"f{i}.js": "\n".join(rnd.choice(parts) for _ in range(rnd.randint(1, 25))) for i in range(80)}
    files = fo.reviewable(files_of(texts)).withColumn("frameworks", F.array().cast("array<string>"))
    got = {(r.path, r.line_no, int(r.args[0])) for r in duplicates.duplicate_blocks(files, ReviewConfig(min_duplicate_lines=3)).collect()}
    shape = {p: i if i != 1 else 1 for i, p in enumerate(parts)}
    want = set()
    for path, text in texts.items():
        lines, seen = text.split("\n"), {}
        for i in range(len(lines) - 2):
            kept = tuple(shape[x] for x in lines[i:i + 3] if len(x.strip()) >= 20 and not x.startswith("//"))
            if len(kept) >= 2:
                if kept in seen:
                    want.add((path, i + 1, seen[kept]))
                else:
                    seen[kept] = i + 1
    assert got == want and want


def test_rules_against_another_engine(spark):
    rnd = random.Random(7)
    bits = ["a.b", "if", "while", "?.", " ", "=", "(", ")", "[x]", ".then(", ".catch", "open(", "with ", "null", "go", "await ", "/ y", ";", "as T", "|",
            "length", "SELECT a FROM t", " WHERE", ".innerHTML", "==", "new Promise", "x", "for", "+ = 'q'", "+='", "'"]
    lines = ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 7))) for _ in range(3000)]
    rules = [r for r in R.SECURITY_RULES + R.PERFORMANCE_RULES + R.RUNTIME_RULES if r.uid != "S14"]
    df = spark.createDataFrame([(i, x, lang, "c-style") for i, x in enumerate(lines) for lang in ("typescript", "java", "sql")],
                               "n int, text string, lang_id string, family string")
    rows = df.select(F.col("n").cast("string").alias("path"), "lang_id", "family", F.lit(1).alias("line_no"), "text")
    got = {(int(r.path), r.lang_id, r.uid) for r in scan.scan_rules(rows, rules).collect()}
    want = set()
    for r in rules:
        pattern = re.compile(re.sub(r"\$$", r"\\Z", r.pattern.replace("[^[\\]]", r"[^\[\]]")).replace("|$)", r"|\Z)"), re.A | (re.I if r.ignore_case else 0))
        for lang in ("typescript", "java", "sql"):
            if r.langs is None or lang in r.langs:
                want |= {(i, lang, r.uid) for i, x in enumerate(lines) if not x.strip().startswith(("//", "#", "*")) and x.strip() and pattern.search(x)}
    assert got == want
    assert len({u for _, _, u in want}) > 8
