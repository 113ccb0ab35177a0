"""Work that must not grow beside the input: tasks, margins, repeated plans."""

import zlib

from pyspark.sql import functions as F

from checks import queries
from lintlake.catalog.rules import DECISIONS, FUNCTION_STARTS
from lintlake.functions.literals import needed_test
from lintlake.functions.regex import java_regex
from lintlake.functions.text import hash32
from lintlake.operators import blocks, files as fo, pieces
from lintlake.sources import local


def test_stream_reads_a_table_that_is_a_folder(spark, tmp_path):
    rows = [(1, "<script>go()</script>", "en", "web", 21), (2, "plain", "en", "web", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.QUERIES["continuous_review"](spark, str(tmp_path)).collect()
    assert [(r["path"], r["line_no"]) for r in found if r["rule_id"] == "rule/inline-script"] == [("docs/d1.html", 1)]


def test_findings_of_reports_are_computed_once(spark, monkeypatch):
    calls, real = [], queries.kept_findings
    monkeypatch.setattr(queries, "kept_findings", lambda *a: calls.append(a) or real(*a))
    for name in ("sink_markdown", "sink_text"):
        calls.clear()
        queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert len(calls) == 1


def test_hash32_is_no_fold_over_characters(spark, capsys):
    def want(text):
        units, h = text.encode("utf-16-le"), 0
        for n in range(0, len(units), 2):
            h = (h * 31 + units[n] + 256 * units[n + 1]) % 2**32
        return h - 2**32 if h >= 2**31 else h

    texts = ["", "a", "héllo \U0001f600 wörld", "x" * 5000, "\U0010ffff" * 700 + "\n\0z", str(zlib.crc32(b"q")) * 40]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", hash32(F.col("t")).alias("h"))
    assert {r["t"]: r["h"] for r in df.collect()} == {**{t: want(t) for t in texts}, None: None}
    df.explain()
    assert "aggregate(" not in capsys.readouterr().out


def test_reading_tasks_hold_bounded_rows(spark, monkeypatch, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/t")
    monkeypatch.setattr(local, "ROWS_OF_TASK", 10, raising=False)
    assert local.spread(spark.read.parquet(f"{tmp_path}/t")).rdd.getNumPartitions() == 100


def test_block_tasks_hold_bounded_text(spark, files_of, monkeypatch):
    monkeypatch.setattr(blocks, "BYTES_OF_TASK", 100, raising=False)
    files = fo.reviewable(files_of({f"a{n}.js": "function f(x) {\n}\n" for n in range(200)}))
    ends = blocks.braced_functions(files)
    assert ends.rdd.getNumPartitions() == 36 and ends.count() == 200


def test_rules_see_no_wider_piece_than_they_need(files_of):
    cut = pieces.cut(files_of({"a.js": "\n".join(f"go({n});" for n in range(1000))}), 64, 200)
    widest = pieces.narrowed(cut, pieces.NEAR).agg(F.max(F.size(F.split("content", "\n"))).alias("n")).first()["n"]
    assert widest == 64 + pieces.BEFORE + pieces.NEAR
    assert pieces.holding(cut, "go(999)").count() == 1


def test_literal_tests_hold_wherever_the_pattern_matches(spark):
    code = "\n".join(queries.code_files(spark, "/root/testdata/sf0.001").limit(300).agg(F.array_join(F.collect_list("content"), "\n").alias("c")).first())
    lines = spark.createDataFrame([(x,) for x in {*code.split("\n"), "a?b", "if", "} else   if (x) {", "pub fn go<T>(x)", "g() {", "sub func x", "def q"}], "t string").cache()
    patterns = [p for ps in FUNCTION_STARTS.values() for p in ps] + [rf"(?<!\w)(?:{w})(?!\w)" + (rf"|(?<=\w)(?:{o})(?=\w)" if o else "") for w, o in DECISIONS.values()]
    tested = [(java_regex(p), needed_test(p, "t")) for p in patterns if needed_test(p, "t")]
    assert len(tested) > 15 and needed_test("(?i)function", "t") == ""
    missed = [F.count_if(F.col("t").rlike(p) & ~F.expr(n)) for p, n in tested]
    assert not any(lines.agg(*[m.alias(f"c{i}") for i, m in enumerate(missed)]).first())
