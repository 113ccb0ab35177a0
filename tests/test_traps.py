"""Hand-written files for the corner cases of the rules."""

import pytest
from pyspark.sql import functions as F

from lintlake import ReviewConfig, review_files
from lintlake.functions.text import hash32
from lintlake.operators import blocks, duplicates, files as fo, findings as fi, scan, sequence, tokens
from lintlake.operators.filters import filter_whitelists

LONG = "x" * 30


@pytest.fixture(scope="module")
def rows(spark, files_of):
    """rule hits per file: {path: [(line_no, rule_id, message)]} with every rule shown."""
    texts = {
        "else.js": "if (x) {\n  go();\n} else {\n  stop();\n}",
        "ops.js": "function f(a) {\n  r = a && b;\n  s = a&&b;\n  t = a?b:c;\n}",
        "after.js": "function f() {\n  return 1;\n}\nfunction g() {\n}",
        "crlf.js": "p.then(go);\r\nq.then(go);",
        "accent.js": "éif(x);\néeval(x);\nevalé(x);",
        "twice.py": "API_KEY = 'sk-0123456789abcdefghijklmnopqrstuvwxyz'",
        "open.js": "function f() {\n" + "  a();\n" * 70,
        "body.rb": "def a\n  if x\n\n  end\nend\ndef b\n  y\nend",
        "nested.py": "class A:\n    def f(self):\n        if x:\n\n            y()\n    def g(self): pass\nz = 1",
        "loops.js": "for (;;) {\n  do {\n    while (x) {\n      go();\n    }\n  } while (y);\n}\nfor (;;) {\n}",
        "split.js": "let\n  lonely = 1;\nlet used = 2; go(used);\nlet _quiet = 1, x = 2;",
        "listen.js": "a.addEventListener('dblclick', f);\nb.addEventListener('click', f);\nb.removeEventListener('dblclick', f);",
        "far.js": "try {\n" + "\n" * 18 + "JSON.parse(a);\n\nJSON.parse(b);",
        "Dockerfile": "RUN md5(x)",
        "dockerfile.dev": "RUN md5(x)",
        "a.b/Makefile": "RUN md5(x)",
        "x.js/README": "eval(x)",
        "dist\\x.js": "eval(x)",
        "DIST\\x.js": "eval(x)",
        "dist": "eval(x)",
        "empty.js": "",
        "ends.js": "eval(x);\n",
    }
    config = ReviewConfig(confidence_threshold=0.0, max_function_length=0, max_complexity=0, min_duplicate_lines=2, framework_scope="file")
    out = {p: [] for p in texts}
    for r in review_files(files_of(texts), config).collect():
        out[r.path].append((r.line_no, r.rule_id, r.message))
    return out


def having(rows, path, rule):
    return sorted((n, m) for n, r, m in rows[path] if r == rule)


def test_else_line_ends_at_once(rows):
    assert (3, 'Function "else" is 1 lines long (max: 0)') not in having(rows, "else.js", "complexity/function-length")
    assert (1, 'Function "if" is 3 lines long (max: 0)') in having(rows, "else.js", "complexity/function-length")


def test_operators_count_between_word_characters_only(rows):
    # 1 + a&&b + a?b: the spaced && does not count
    assert (1, 'Function "f" has cyclomatic complexity 3 (max: 0)') in having(rows, "ops.js", "complexity/cyclomatic")


def test_code_after_the_closing_brace_is_reported(rows):
    assert [n for n, _ in having(rows, "after.js", "ast/unreachable-code")] == [4]


def test_carriage_return_hides_the_promise_rule(rows):
    assert [n for n, _ in having(rows, "crlf.js", "runtime/Runtime Risk (Predicted)") if "Promise" in _] == [2]


def test_words_are_ascii(rows):
    # é is no word character: "éeval(" holds the word eval, "evalé(" is not a call of eval
    assert [n for n, _ in having(rows, "accent.js", "ast/forbidden-function")] == [2]


def test_two_rules_of_one_category_both_stay(rows):
    assert len(having(rows, "twice.py", "security/Hardcoded Secret")) == 2


def test_unclosed_function_reaches_fifty_lines(rows):
    assert (1, 'Function "f" is 50 lines long (max: 0)') in having(rows, "open.js", "complexity/function-length")


def test_indented_extents(rows):
    lengths = [m for _, m in having(rows, "body.rb", "complexity/function-length")]
    assert lengths == ['Function "a" is 4 lines long (max: 0)', 'Function "b" is 2 lines long (max: 0)']
    lengths = [m for _, m in having(rows, "nested.py", "complexity/function-length")]
    assert lengths == ['Function "f" is 4 lines long (max: 0)', 'Function "g" is 1 lines long (max: 0)']


def test_loop_depth_is_clamped(rows):
    # the while that closes the do counts as a loop line too
    assert [n for n, _ in having(rows, "loops.js", "performance/nested-loops")] == [3, 6]


def test_declaration_over_two_lines(rows):
    assert having(rows, "split.js", "ast/unused-variable") == [(1, 'Variable "lonely" is declared but appears to be unused')]


def test_listener_line_is_the_first_that_holds_the_name(rows):
    assert having(rows, "listen.js", "runtime/event-listener-leak") == [(1, "Event listener 'click' added but never removed")]


def test_try_counts_for_twenty_lines(rows):
    assert [n for n, _ in having(rows, "far.js", "ai/json-parse-no-try")] == [22]


def test_languages_and_exclusion(rows):
    assert having(rows, "Dockerfile", "security/Security Vulnerability")
    assert having(rows, "dockerfile.dev", "security/Security Vulnerability")
    assert not rows["a.b/Makefile"] and not rows["x.js/README"]
    assert not rows["dist\\x.js"] and rows["DIST\\x.js"] and not rows["dist"]
    assert [n for n, _ in having(rows, "ends.js", "ast/forbidden-function")] == [1]


def test_lines(files_of):
    got = fo.explode_lines(files_of({"a": "", "b": "x\n", "c": "x\r\ny"})).collect()
    assert sorted((r.path, r.line_no, r.text) for r in got) == [("a", 1, ""), ("b", 1, "x"), ("b", 2, ""), ("c", 1, "x\r"), ("c", 2, "y")]


def test_structure(spark):
    rows = spark.createDataFrame([("a = 'abc' + 12.5",), ("a = \"x\" + b",), ("if (x1 == `t`)  { return  y; }",), ("'open + 1a",)], "t string")
    got = [r.c for r in rows.select(F.expr(duplicates.normalize_structure("t")).alias("c")).collect()]
    assert got == ["$ID = $$ID + $$ID", "$ID = $$ID + $ID", "if ($ID == $$ID) { return $ID; }", "'$ID + 1a"]


def test_threshold_is_inclusive(files_of):
    files = files_of({"a.js": "let lonely = 1;"})
    rules = {r.rule_id for r in review_files(files, ReviewConfig(confidence_threshold=0.6)).collect()}
    assert "ast/unused-variable" in rules
    assert not review_files(files, ReviewConfig(confidence_threshold=0.61)).collect()


def test_user_rules(spark, files_of):
    config = ReviewConfig(custom_rules=({"id": "bad", "pattern": "(x", "severity": "High", "message": "m"},
                                        {"id": "odd", "pattern": r"\btodo\b", "severity": "urgent", "message": "note"}))
    lines = fo.explode_lines(fo.reviewable(files_of({"a.sql": "todo\n// todo\nétodo", "b.txt": "todo"})))
    got = fi.hydrate(scan.scan_user_rules(lines, config), config).collect()
    assert sorted((r.line_no, r.rule_id, r.severity, r.explanation) for r in got) == [(n, "rule/odd", "Low", "note") for n in (1, 2, 3)]


def test_framework_scopes(files_of):
    lines = "\n".join(f"  const name{n} = inject(ServiceNumber{n});" for n in range(1))
    texts = {"a.ts": lines, "b.ts": "import { X } from '@angular/core';"}
    shown = {s: {r.path for r in review_files(files_of(texts), ReviewConfig(framework_scope=s)).collect() if r.rule_id == "ast/unused-variable"}
             for s in ("corpus", "file")}
    assert shown == {"corpus": set(), "file": {"a.ts"}}


def test_whitelists(spark):
    found = spark.createDataFrame([("eval(a) keep",), ("eval(b)",), ("  eval(c)",)], "text string")
    config = ReviewConfig(whitelisted_functions=("keep",), whitelisted_patterns=(r"^\s+eval", "(broken"))
    assert [r.text for r in filter_whitelists(found, config).collect()] == ["eval(b)"]


def test_size_cap_counts_utf16_units(files_of):
    files = files_of({"a": "ab" * 3, "b": "\U0001f600" * 3, "c": "abc", "d": "\U0001f600" * 2})
    assert sorted(r.path for r in fo.filter_size_cap(files, 5).collect()) == ["c", "d"]


def test_hash32(files_of):
    def plain(text):
        h = 0
        units = text.encode("utf-16-be")
        for i in range(0, len(units), 2):
            h = (h * 31 + units[i] * 256 + units[i + 1]) % 2**32
        return h - 2**32 if h >= 2**31 else h

    texts = {"a": "", "b": "hello world, hello", "c": "é\U0001f600x", "d": "z" * 500}
    got = {r.path: r.h for r in files_of(texts).select("path", hash32(F.col("content")).alias("h")).collect()}
    assert got == {k: plain(v) for k, v in texts.items()}
