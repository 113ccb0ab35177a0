"""Single-line rules tried file by file: the findings of the rules tried line by line, from one pass over the files."""

import random

from checks import queries
from lintlake.config import ReviewConfig
from lintlake.functions.text import WHITE_SPACE
from lintlake.operators import files as fo, scan, tokens

BITS = ["eval(", "x", ")", " ", "\t", " ", "//", "#", "*", "<!-- ", "var ", "let q = 1;", "a == b", "===", "md5(", "'SELECT * FROM t'", "+ 'update'", "../", "for (", "if (", "while",
        "return", " 77", "password = 'abcd1'", "console.log(", "TODO: z", "fixme", "parseInt(s)", "İ", "ΑΣ", "\r", "\x85", "", "v, _ := f", "def f(a=[]):", "except:", " ", "debugger", "licence"]


def some_files(spark, n=300):
    rnd = random.Random(11)
    exts = ["js", "ts", "py", "go", "java", "rs", "sql", "sh", "rb", "php", "c", "html", "cs"]
    rows = [(f"s/f{i}.{rnd.choice(exts)}", "\n".join("".join(rnd.choice(BITS) for _ in range(rnd.randint(0, 6))) for _ in range(rnd.randint(0, 9)))) for i in range(n)]
    rows += [(f"s/w{i}.js", f"{w}// eval(x)\n{w}eval(x)\n{w}") for i, w in enumerate(WHITE_SPACE)] + [("s/none.js", None), ("s/same.js", "eval(x)"), ("s/same.js", "eval(x)")]
    return fo.reviewable(spark.createDataFrame(rows, "path string, content string"))


def found(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def test_rules_by_file_find_what_rules_by_line_find(spark, monkeypatch):
    files = some_files(spark)
    config = ReviewConfig(forbidden_functions=("eval", "exec"), confidence_threshold=0.0, custom_rules=tuple(
        {"id": f"u{n}", "pattern": p, "severity": "High", "message": "m"} for n, p in enumerate((r"^\s*x", r"$", r"licen[sc]e", r"(?i)EVAL\b", r"\bΑΣ"))))
    by_line = found(scan.findings_of(fo.explode_lines(files), scan.all_hits(config, scan.ROW)))
    assert len(by_line) > 2000 and len({r[4] for r in by_line}) > 25
    for many in (1, 10**9):  # chosen by words, or tried one by one
        monkeypatch.setattr(scan, "MANY_WORDS_OF_FILE", many)
        assert found(scan.files_found(files, scan.all_hits(config))) == by_line


def test_base_findings_read_the_files_once(spark, capsys):
    queries.base_findings(spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert plan.count("FileScan") == 1 and plan.count("Generate") == 1


def test_unused_names_sort_no_word_but_those_declared_once(spark, files_of, capsys):
    files = fo.reviewable(files_of({"a.js": "let ab = 1;\nlet cd = 2; go(cd);\nlet ab = 3;\nconst ef = 4;\nlet gh = 5; let gh2 = gh;", "b.py": "qq = 1\nrr = qq\n", "c.rb": "x1 = 2\nx1 == 2\nzz = 1"}))
    rows = tokens.unused_variables(files)
    assert {(r["path"], r["line_no"], r["args"][0]) for r in rows.collect()} == {("a.js", 4, "ef"), ("a.js", 5, "gh2"), ("b.py", 2, "rr"), ("c.rb", 3, "zz")}
    rows.explain()
    assert "array_intersect" in capsys.readouterr().out
