"""Cheap tests in front of work on whole files."""

import random

from pyspark.sql.classic.dataframe import DataFrame

from lintlake.config import ReviewConfig
from lintlake.operators import blocks, duplicates, files as fo
from lintlake.operators.sequence import with_lines


def test_blocks_are_made_only_where_enough_lines_stand_together(spark):
    rnd = random.Random(5)
    rows = [("".join(rnd.choice("001") if i % 2 else rnd.choice("011") for _ in range(rnd.randint(0, 14))),) for i in range(400)]
    texts = with_lines(spark.createDataFrame([(s, "\n".join("y" * 25 if ch == "1" else "z" for ch in s)) for s, in rows], "s string, content string"))
    for k in (2, 3, 5, 7, 20):
        for r in texts.select("s", duplicates.may_hold_block(k).alias("may")).collect():
            need = len(r.s) > k and (any(r.s[i:i + k].count("1") >= k - 1 for i in range(len(r.s) - k + 1)))
            assert r.may or not need, (k, r.s)
            assert need or k > duplicates.SPELT_BLOCK or not r.may, (k, r.s)


def test_block_rules_read_the_lengths_once(spark, files_of, monkeypatch):
    files = fo.reviewable(files_of({"a.js": "function f(x) {\n}\n", "b.py": "def g():\n    return 1\n"}))
    jobs, real = [], DataFrame.first
    monkeypatch.setattr(DataFrame, "first", lambda self: jobs.append(1) or real(self))
    found = blocks.block_findings(files, ReviewConfig(max_function_length=1), True, True, True)
    assert len(jobs) == 1
    assert {(r["path"], r["line_no"]) for r in found.collect()} == {("a.js", 1), ("b.py", 1)}


def test_blocks_sort_by_a_hash_of_the_path_first(spark, files_of, capsys):
    files = fo.reviewable(files_of({f"/one/long/beginning/a{n}.js": "function f(x) {\n}\n" for n in range(3)}))
    blocks.braced_functions(files).explain()
    plan = capsys.readouterr().out
    assert "Sort [file" in plan and "Sort [path" not in plan
