"""Block rules of the review, made in the rows of files, against the operators on exploded lines."""

import random

from lintlake import ReviewConfig
from lintlake.operators import blocks, files as fo

PARTS = ["function f(x) {", "}", "} else {", "{ {", "} }", "  if (a&&b) { go(); }", "  while (x) {", "async function g() {", "const h = async (x) =>", "  await go();",
         "async", "function far() {", "try {", "p.catch(go);", "switch (x) {", "  default:", "default :", "} function odd(q) { if (q) {", "def one(a):", "    def two(b):",
         "        if a and b:", "\treturn 1", "", "   ", "else", "if (x) y = a?b : c;", "let k = (a) => { return a||b; }", "}}", "rescue", "func go(a) { if x { select {", "x\x04if\x01y\x02"]
NAMES = ["a.js", "b.ts", "c.py", "d.rb", "e.go", "f.java", "g.c", "h.sh"]


def texts(seed, n, longest):
    rnd = random.Random(seed)
    return {f"{k}{rnd.choice(NAMES)}": "\n".join(rnd.choice(PARTS) for _ in range(rnd.randrange(longest))) for k in range(n)}


def test_extents_in_rows_are_those_of_windows(files_of):
    files = fo.reviewable(files_of({**texts(1, 300, 40), **texts(2, 6, 500)})).cache()
    starts = blocks.block_starts(files, True, True, True).cache()
    got = {(r["path"], r["line_no"], r["function"], r["last"] or r["closed"] or min(r["line_no"] + 49, r["n_lines"]), r["decided"] + 1) for r in starts.where("function IS NOT NULL").collect()}
    assert got == {(r["path"], r["line_no"], r["name"], r["end_line"], r["complexity"]) for r in blocks.extract_functions(files).collect()} and len(got) > 500
    config = ReviewConfig()
    found = [(r["path"], r["line_no"], r["uid"], *r["args"], r["ord"], r["text"]) for r in blocks.block_findings(files, config, False, True, True).collect()]
    want = blocks.async_no_error_handling(files).unionByName(blocks.switch_no_default(files)).collect()
    assert sorted(found) == sorted((r["path"], r["line_no"], r["uid"], *r["args"], r["ord"], r["text"]) for r in want) and len(found) > 100


def test_block_rules_of_the_review_do_not_shuffle(files_of, capsys):
    files = fo.reviewable(files_of(texts(3, 5, 20)))
    blocks.block_findings(files, ReviewConfig(), True, True, True).explain()
    plan = capsys.readouterr().out
    assert "Window" not in plan and "Exchange hashpartitioning" not in plan


def test_rows_of_one_path_are_taken_together(files_of):
    files = fo.reviewable(files_of({"a.js": "function f(x) {\n  if (x) {\n  }\n}\n", "b.js": "function g(x) {\n  if (x) {\n  }\n}\n"}))
    both, config = files.unionByName(files.where("path = 'a.js'")), ReviewConfig(max_complexity=1)
    found = {(r["path"], r["line_no"], *r["args"]) for r in blocks.block_findings(both, config, True, True, True).where("uid LIKE 'C02%'").collect()}
    want = blocks.complex_functions(blocks.extract_functions(both), config).collect()
    assert found == {(r["path"], r["line_no"], *r["args"]) for r in want} and ("b.js", 1, "g", "2", "1") in found and ("a.js", 1, "f", "3", "1") in found


def test_extents_are_not_quadratic():
    nested = "function f() {\n" * 50_000 + "}\n" * 50_000
    ends = blocks.file_extents(nested, list(range(1, 50_001)), False)
    assert ends[0] == (100_000, 0, None) and ends[-1] == (50_001, 0, None)
    assert blocks.file_extents("def f():\n" + "  x\n" * 50_000, list(range(1, 50_001)), True)[0][2] == 50_002
