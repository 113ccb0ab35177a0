"""Work that is done once, and margins no rule needs."""

from pyspark.sql import functions as F

from lintlake import ReviewConfig, review_files
from lintlake.operators import changes, lists, pieces, tokens
from lintlake.operators.ledger import Ledger

FILES = {"a.js": "import React from 'react';\neval(x);\n", "b.ts": "const kept = 1;\neval(kept);\n"}


def found(df):
    return sorted((r["path"], r["line_no"], r["rule_id"]) for r in df.collect())


def refuse(*args, **kw):
    raise AssertionError("made again")


def test_findings_of_a_long_list_are_made_once(spark, files_of, monkeypatch):
    names, real = [], lists.kept
    monkeypatch.setattr(lists, "kept", lambda rows, name: names.append(name) or real(rows, name))
    findings = files_of({"a.js": "keep me", "b.js": "drop me"}).withColumnRenamed("content", "text")
    left = lists.filter_whitelist_table(findings, spark.createDataFrame([("keep",)], "word string"))
    assert [r["path"] for r in left.collect()] == ["b.js"] and names.count("findings") == 1


def test_frameworks_of_an_increment_are_looked_for_once(files_of, monkeypatch):
    files, config = files_of(FILES), ReviewConfig()
    state, old = changes.next_state(files.where("path = 'a.js'"), config), review_files(files.where("path = 'a.js'"), config, corpus=files)
    want = found(review_files(files, config))
    monkeypatch.setattr(tokens, "attach_frameworks", refuse)
    assert found(changes.incremental_review(files, state, old, config)) == want


def test_log_gives_the_review_its_frameworks(spark, files_of, tmp_path, monkeypatch):
    want = found(review_files(files_of(FILES)))
    monkeypatch.setattr(tokens, "framework_flags", refuse)  # the log has its own
    log = Ledger(spark, str(tmp_path))
    monkeypatch.setattr(Ledger, "_finding_schema", lambda self: "path string, line_no int, rule_id string")
    log.update(files_of(FILES))
    assert found(log.findings()) == want


def test_margins_behind_are_clipped_unless_blank(files_of):
    text = "\n".join([*("go();" for _ in range(9)), "const", *("" for _ in range(30)), "far", *("x();" for _ in range(60)), "y"])
    cut = pieces.cut(files_of({"a.js": text}), 10, 50)
    sizes = {r["own_first"]: r["n"] for r in pieces.clipped(cut, 5).select("own_first", F.size(F.split("content", "\n")).alias("n")).collect()}
    assert sizes[1] == 60 and sizes[41] == 20 + 10 + pieces.NEAR
