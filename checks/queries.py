"""Registered queries: every operator over corpora derived from the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.catalog import dims
from lintlake.config import ReviewConfig
from lintlake.functions.text import hash32, trim_all
from lintlake.operators import blocks, changes, duplicates, files as fo, filters, findings as fi, fixes, lists, scan, sequence, summary, tokens
from lintlake.operators.ledger import Ledger
from lintlake.plans.review import review_files, review_long_files
from lintlake.sinks import reports
from lintlake.sources import corpus
from lintlake.sources.derived import ROOT, code_files, long_files, text_files
from lintlake.sources.local import kept, run_folder, small_table
from lintlake.streaming.continuous import continuous_review

AT = "2024-01-01T00:00:00.000Z"
CUSTOM = (
    {"id": "no-any", "pattern": r":\s*any\b", "severity": "Medium", "message": "Avoid any", "languages": ["typescript"]},
    {"id": "plain-http", "pattern": r"https?://[a-z]+\.example\.com", "severity": "high", "message": "Address in text"},
    {"id": "inline-script", "pattern": r"<script>", "severity": "urgent", "message": "Inline script",
     "explanation": "Scripts belong in files.", "suggestedFix": "Move it.", "languages": ["html"]},
    {"id": "license", "pattern": r"(?:licen[sc]e|copyright)", "severity": "CRITICAL", "message": "License line"},
    {"id": "broken", "pattern": r"(unclosed", "severity": "High", "message": "never"},
)
ENTRY_CONFIG = dict(max_function_length=5, max_complexity=3)
NAMES = ("forEach", "render", "kept")
PATTERNS = (r"catch\s*\(e\)", r"(broken", r"^\s+const")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def strict(**kw) -> ReviewConfig:
    return ReviewConfig(**{**ENTRY_CONFIG, **kw})


def ready(spark: SparkSession, sf: str) -> DataFrame:
    return fo.reviewable(code_files(spark, sf))


def texts(spark: SparkSession, sf: str) -> DataFrame:
    return fo.reviewable(text_files(spark, sf))


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return fo.explode_lines(ready(spark, sf))


def both_lines(spark: SparkSession, sf: str) -> DataFrame:
    return fo.explode_lines(ready(spark, sf).unionByName(texts(spark, sf)))


def shown(found: DataFrame, config: ReviewConfig | None = None) -> DataFrame:
    full = fi.hydrate(found, config)
    return full.select("path", "line_no", "severity", "category", "rule_id", "message", "confidence")


def base_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Findings that the filter, roll-up and report queries work on."""
    return fi.hydrate(_base(spark, sf))


def _base(spark: SparkSession, sf: str) -> DataFrame:
    """Security, performance and style rules, the default rules of users, unused names and unguarded parsing, in one pass over the files."""
    single = [*scan.security_hits(), *scan.performance_hits(), *scan.style_hits(), *scan.user_hits(ReviewConfig())]
    return scan.files_found(ready(spark, sf), single, [tokens.unused_hits(), sequence.json_parse_hits()])


def kept_findings(spark: SparkSession, sf: str) -> DataFrame:
    return filters.dedup_findings(filters.filter_confidence(base_findings(spark, sf), 0.6))


def slim_full(df: DataFrame) -> DataFrame:
    return df.select("path", "line_no", "severity", "category", "rule_id", "message")


# sources -------------------------------------------------------------------------------------------------

@query
def scan_corpus(spark, sf):
    raw = code_files(spark, sf).unionByName(text_files(spark, sf)).select(
        "path", F.octet_length("content").cast("bigint").alias("length"), F.encode("content", "UTF-8").alias("content"))
    got = corpus.scan_corpus(raw, ignore_patterns=("*.php", "/tools/"))
    return got.select("path", F.length("content").alias("n_chars"), F.md5("content").alias("digest"))


@query
def scan_table(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    got = corpus.scan_table(turns, F.concat_ws("/", F.lit("talk"), "conv_id", "turn"), F.col("text")).unionByName(text_files(spark, sf))
    return got.select("path", F.length("content").alias("n_chars"), F.md5("content").alias("digest"))


def _lists(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    tracked = labels.select(F.concat(F.lit("  docs/d"), F.col("doc_id").cast("string"), F.lit(".html \r")).alias("value"))
    untracked = orders.select(F.when(F.col("o_orderkey") % 3 == 0, F.lit("   ")).otherwise(
        F.concat(F.lit("docs/d"), (F.col("o_orderkey") % 2000).cast("string"), F.lit(".html"))).alias("value"))
    return tracked, untracked


@query
def scan_change_list(spark, sf):
    return corpus.scan_change_list(*_lists(spark, sf), "/work/tree/")


@query
def scan_staged_list(spark, sf):
    return corpus.scan_staged_list(_lists(spark, sf)[1], "/work/tree")


@query
def distinct_paths(spark, sf):
    a, b = _lists(spark, sf)
    return corpus.distinct_paths(corpus.listed_paths(a, "r"), corpus.listed_paths(b, "r"))


@query
def scan_ignore_file(spark, sf):
    raw = both_lines(spark, sf).select(F.col("text").alias("value"))
    return corpus.scan_ignore_file(raw).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


# files and lines -----------------------------------------------------------------------------------------

@query
def filter_excluded_dirs(spark, sf):
    return fo.filter_excluded_dirs(code_files(spark, sf)).select("path")


@query
def filter_ignore_paths(spark, sf):
    return fo.filter_ignore_paths(code_files(spark, sf), ReviewConfig().ignore_paths + ("core",)).select("path")


@query
def filter_ignore_patterns(spark, sf):
    return fo.filter_ignore_patterns(code_files(spark, sf), ("*.txt", "/api/", "f1.", "*.sql")).select("path")


@query
def filter_size_cap(spark, sf):
    return fo.filter_size_cap(text_files(spark, sf), 4000).select("path", F.length("content").alias("n_chars"))


@query
def detect_language(spark, sf):
    named = code_files(spark, sf).withColumn("path", F.when(F.contains("path", F.lit("5.")), F.upper("path")).when(
        F.contains("path", F.lit("7.rs")), F.lit("a.b/Dockerfile.dev")).otherwise(F.col("path")))
    got = fo.detect_language(named.select("path", "content"))
    return got.groupBy("lang_id", "lang_name", "family").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path"))


@query
def result_status(spark, sf):
    return fo.result_status(fo.detect_language(code_files(spark, sf)))


@query
def explode_lines(spark, sf):
    return both_lines(spark, sf).select("path", "line_no", "text")


@query
def comment_skip(spark, sf):
    return fo.comment_flags(both_lines(spark, sf)).select("path", "line_no", "skip_hash", "skip_html", "skip_hash_blank", "skip_slashes")


@query
def lang_gate(spark, sf):
    from lintlake.catalog.rules import RUNTIME_RULES, SECURITY_RULES

    rows = [(r.uid, ",".join(r.langs) if r.langs else None) for r in SECURITY_RULES + RUNTIME_RULES]
    rules = small_table(spark, rows, ["uid", "langs"]).select("uid", F.split("langs", ",").alias("languages"))
    gated = fo.lang_gate(ready(spark, sf).select("path", "lang_id"), rules)
    return gated.groupBy("uid", "lang_id").agg(F.count(F.lit(1)).alias("n"))


# scans ---------------------------------------------------------------------------------------------------

@query
def scan_catalog(spark, sf):
    """The three catalogs in one pass."""
    return shown(scan.scan_catalog(both_lines(spark, sf)))


@query
def scan_security(spark, sf):
    return shown(scan.scan_security(both_lines(spark, sf)))


@query
def scan_performance(spark, sf):
    return shown(scan.scan_performance(both_lines(spark, sf)))


@query
def scan_runtime(spark, sf):
    return shown(scan.scan_runtime(both_lines(spark, sf)))


@query
def scan_user_rules(spark, sf):
    config = ReviewConfig(custom_rules=CUSTOM)
    return shown(scan.scan_user_rules(both_lines(spark, sf), config), config)


@query
def scan_forbidden(spark, sf):
    return shown(scan.scan_forbidden(lines(spark, sf), ReviewConfig(forbidden_functions=("eval", "exec", "document.write", "render"))))


@query
def scan_line_style(spark, sf):
    return shown(scan.scan_line_style(lines(spark, sf)))


@query
def scan_todo(spark, sf):
    return shown(scan.scan_todo(both_lines(spark, sf)))


@query
def scan_naming(spark, sf):
    return shown(scan.scan_naming(lines(spark, sf)))


@query
def scan_parseint(spark, sf):
    return shown(scan.scan_parseint(lines(spark, sf)))


@query
def scan_goroutine(spark, sf):
    return shown(scan.scan_goroutine(lines(spark, sf)))


@query
def scan_open_no_with(spark, sf):
    return shown(scan.scan_open_no_with(lines(spark, sf)))


# sequences -----------------------------------------------------------------------------------------------

@query
def win_unreachable(spark, sf):
    found = fi.hydrate(sequence.win_unreachable(ready(spark, sf)))
    return found.select("path", "line_no", "severity", "rule_id", F.col("seq.pos").alias("origin"))


@query
def win_empty_catch(spark, sf):
    return shown(sequence.win_empty_catch(ready(spark, sf)))


@query
def win_sequential_awaits(spark, sf):
    return shown(sequence.win_sequential_awaits(ready(spark, sf)))


@query
def win_json_parse_no_try(spark, sf):
    return shown(sequence.win_json_parse_no_try(ready(spark, sf)))


@query
def win_destructure_no_check(spark, sf):
    return shown(sequence.win_destructure_no_check(ready(spark, sf)))


@query
def win_timeout_in_loop(spark, sf):
    return shown(sequence.win_timeout_in_loop(ready(spark, sf)))


@query
def win_nested_loops(spark, sf):
    return sequence.win_nested_loops(ready(spark, sf)).select("path", "line_no", F.get("args", F.lit(1)).cast("int").alias("outer_line"))


@query
def window_prefix_counts(spark, sf):
    return blocks.window_prefix_counts(ready(spark, sf))


# blocks --------------------------------------------------------------------------------------------------

@query
def brace_extent(spark, sf):
    ends = blocks.braced_functions(ready(spark, sf))
    return ends.select("path", "line_no", "closed")


@query
def brace_body(spark, sf):
    return blocks.switch_bodies(ready(spark, sf)).select("path", "line_no", "end_line", F.col("defaults").cast("int").alias("defaults"))


@query
def indent_extent(spark, sf):
    return blocks.indented_functions(ready(spark, sf)).select("path", "line_no", "end_line")


@query
def extract_functions(spark, sf):
    return blocks.extract_functions(ready(spark, sf)).select("path", "name", "line_no", "end_line", "line_count")


@query
def cyclomatic(spark, sf):
    got = blocks.cyclomatic(blocks.extract_functions(ready(spark, sf)))
    return got.withColumn("complexity", F.col("complexity").cast("int"))


@query
def long_functions(spark, sf):
    c = strict()
    return shown(blocks.long_functions(blocks.extract_functions(ready(spark, sf)), c), c)


@query
def complex_functions(spark, sf):
    c = strict()
    return shown(blocks.complex_functions(blocks.extract_functions(ready(spark, sf)), c), c)


@query
def async_no_error_handling(spark, sf):
    return shown(blocks.async_no_error_handling(ready(spark, sf)))


@query
def switch_no_default(spark, sf):
    return shown(blocks.switch_no_default(ready(spark, sf)))


# names ---------------------------------------------------------------------------------------------------

@query
def unused_variables(spark, sf):
    return shown(tokens.unused_variables(ready(spark, sf)))


@query
def listener_leaks(spark, sf):
    return shown(tokens.listener_leaks(ready(spark, sf)))


@query
def interval_leaks(spark, sf):
    return shown(tokens.interval_leaks(ready(spark, sf)))


@query
def first_line(spark, sf):
    return tokens.first_line(ready(spark, sf).unionByName(texts(spark, sf)), "const ")


@query
def detect_frameworks(spark, sf):
    return tokens.detect_frameworks(ready(spark, sf), ReviewConfig(enable_frameworks=("React", "unknown")))


# duplicates ----------------------------------------------------------------------------------------------

@query
def normalize_structure(spark, sf):
    trimmed = lines(spark, sf).select("path", "line_no", trim_all(F.col("text")).alias("t")).where(duplicates.counts_for_blocks("t"))
    return trimmed.select("path", "line_no", F.expr(duplicates.normalize_structure("t")).alias("code"))


@query
def duplicate_blocks(spark, sf):
    c = ReviewConfig(min_duplicate_lines=4)
    found = duplicates.duplicate_blocks(tokens.with_frameworks(ready(spark, sf), c), c)
    return found.select("path", "line_no", "end_line", F.get("args", F.lit(0)).cast("int").alias("first_line"))


@query
def suppress_framework_blocks(spark, sf):
    rows = fo.explode_lines(tokens.with_frameworks(ready(spark, sf), ReviewConfig()))
    rows = rows.withColumn("text", trim_all(F.col("text")))
    return filters.suppress_framework_blocks(rows).where("quiet").select("path", "line_no")


# filters, dedup, order -----------------------------------------------------------------------------------

@query
def filter_severity(spark, sf):
    return slim_full(filters.filter_severity(base_findings(spark, sf), "High"))


@query
def filter_confidence(spark, sf):
    return slim_full(filters.filter_confidence(base_findings(spark, sf), 0.6))


@query
def filter_whitelist_names(spark, sf):
    return slim_full(filters.filter_whitelist_names(base_findings(spark, sf), NAMES))


@query
def filter_whitelist_table(spark, sf):
    """Names of a table: the numbers of some orders, which stand in the names of their files' code."""
    orders = spark.read.parquet(f"{sf}/orders.parquet").where("o_orderkey % 64 = 0")
    names = orders.select(F.concat(F.lit("kept"), (F.col("o_orderkey") * 10).cast("string")).alias("word"))
    return slim_full(lists.filter_whitelist_table(kept_findings(spark, sf), names))


@query
def filter_whitelist_patterns(spark, sf):
    return slim_full(filters.filter_whitelist_patterns(base_findings(spark, sf), PATTERNS))


@query
def filter_framework(spark, sf):
    found = tokens.attach_frameworks(base_findings(spark, sf), ReviewConfig(), ready(spark, sf))
    return slim_full(filters.filter_framework(found))


@query
def union_findings(spark, sf):
    found = fi.union_findings([scan.scan_security(lines(spark, sf)), scan.scan_runtime(lines(spark, sf)), scan.scan_todo(lines(spark, sf))])
    return fi.hydrate(found).select("path", "line_no", "rule_id", "message", F.col("seq.analyzer").alias("analyzer"), F.col("seq.ord").alias("ord"))


@query
def dedup_findings(spark, sf):
    twice = base_findings(spark, sf)
    moved = twice.withColumn("seq", F.col("seq").withField("analyzer", F.lit(9))).withColumn("confidence", F.lit(0.99))
    return filters.dedup_findings(moved.unionByName(twice)).select(
        "path", "line_no", "category", "message", "rule_id", "confidence")


@query
def sort_findings(spark, sf):
    return filters.sort_findings(kept_findings(spark, sf)).select("path", "line_no", "severity", "rule_id", "message")


# roll-ups and reports ------------------------------------------------------------------------------------

def _status(spark, sf):
    return fo.result_status(fo.detect_language(code_files(spark, sf)))


def _per_file(spark, sf, found=None):
    return summary.agg_file(_status(spark, sf), kept_findings(spark, sf) if found is None else found)


@query
def agg_severity(spark, sf):
    return summary.agg_severity(kept_findings(spark, sf)).select("severity", "n")


@query
def agg_category(spark, sf):
    return summary.agg_category(kept_findings(spark, sf))


@query
def agg_file(spark, sf):
    order = F.array_join(F.transform("issues", lambda i: F.concat_ws(":", i["line_no"].cast("string"), i["rule_id"])), ",")
    return _per_file(spark, sf).select("path", "language", "n", order.alias("issue_order"))


@query
def run_summary(spark, sf):
    one = summary.run_summary(_status(spark, sf), kept_findings(spark, sf), "corpus", 7)
    return one.select("project", "scanned_files", "total_issues", "duration_ms",
                      *[F.coalesce(F.element_at("severity_breakdown", F.lit(s)), F.lit(0)).alias(f"n_{s.lower()}") for s in dims.SEVERITY_RANK],
                      F.size("category_breakdown").alias("n_categories"),
                      F.element_at("category_breakdown", F.lit(dims.label("UnusedVariable"))).alias("n_unused"))


@query
def sink_json(spark, sf):
    rows = reports.json_files(_per_file(spark, sf), AT).select("file", "language", "scannedAt", F.posexplode("issues").alias("k", "i"))
    return rows.select("file", "language", "scannedAt", "k", F.col("i.line").alias("line"), F.col("i.endLine").alias("endLine"),
                       F.col("i.severity").alias("severity"), F.col("i.category").alias("category"), F.col("i.message").alias("message"),
                       F.col("i.suggestedFix").alias("suggestedFix"), F.col("i.confidence").alias("confidence"), F.col("i.ruleId").alias("ruleId"))


@query
def sink_markdown(spark, sf):
    found = kept(kept_findings(spark, sf), "findings")  # read twice: header and sections
    one = summary.run_summary(_status(spark, sf), found, "corpus")
    head = reports.markdown_header(one, AT).select(F.lit("").alias("path"), "section")
    return reports.markdown_file(_per_file(spark, sf, found), ROOT, AT).unionByName(head)


@query
def sink_text(spark, sf):
    found = kept(kept_findings(spark, sf), "findings")  # read twice: header and sections
    one = summary.run_summary(_status(spark, sf), found, "corpus")
    head = reports.text_header(one, AT).select(F.lit("").alias("path"), "section")
    return reports.text_file(_per_file(spark, sf, found), ROOT).unionByName(head)


@query
def relative_path(spark, sf):
    both = code_files(spark, sf).withColumn("path", F.when(F.contains("path", F.lit("/lib")), F.translate("path", "/", "\\")).otherwise(F.col("path")))
    return both.select("path", reports.relative_path(F.col("path"), ROOT + "/").alias("rel"))


# fixes ---------------------------------------------------------------------------------------------------

@query
def fix_lines(spark, sf):
    return fixes.fix_lines(lines(spark, sf), kept_findings(spark, sf))


@query
def apply_fixes(spark, sf):
    got = fixes.apply_fixes(ready(spark, sf), kept_findings(spark, sf))
    return got.select("path", "content")


@query
def fix_hint(spark, sf):
    return kept_findings(spark, sf).select("path", "line_no", "rule_id", fixes.fix_hint(F.col("suggested_fix")).alias("hint")).distinct()


# parts of the corpus, increments, streams ----------------------------------------------------------------

def _changed(spark, sf):
    return code_files(spark, sf).where(F.col("path").rlike("[05]\\.[a-z]+$")).select("path")


def reviewed(df: DataFrame) -> DataFrame:
    return df.select("path", "line_no", "severity", "category", "rule_id", "message")


@query
def review_full(spark, sf):
    return reviewed(review_files(code_files(spark, sf), strict()))


@query
def review_long(spark, sf):
    """Long files in pieces of 64 lines: the findings of the whole files."""
    return reviewed(review_long_files(long_files(spark, sf), strict(), lines=64))


@query
def review_changed(spark, sf):
    return reviewed(changes.review_changed(code_files(spark, sf), _changed(spark, sf), strict()))


@query
def review_staged(spark, sf):
    staged = _changed(spark, sf)
    return reviewed(changes.review_staged(code_files(spark, sf), staged.unionByName(staged), strict(severity_threshold="Medium")))


@query
def review_path_prefix(spark, sf):
    return reviewed(changes.review_path_prefix(code_files(spark, sf), f"{ROOT}/src", strict(framework_scope="file")))


@query
def content_hash(spark, sf):
    both = text_files(spark, sf).unionByName(code_files(spark, sf))
    return both.select("path", hash32(F.col("content")).alias("hash32"))


@query
def incremental_review(spark, sf):
    """State and findings of an earlier version of the corpus in which every fifth file was different."""
    config = strict()
    now = code_files(spark, sf)
    before = now.withColumn("content", F.when(F.col("path").rlike("[05]\\.[a-z]+$"), F.concat("content", F.lit("\nold();"))).otherwise(F.col("content")))
    folder = run_folder(spark, "incremental")
    changes.next_state(before, config).write.parquet(f"{folder}/state")
    review_files(before, config).write.parquet(f"{folder}/findings")
    got = changes.incremental_review(fo.reviewable(now).select("path", "content"), spark.read.parquet(f"{folder}/state"),
                                     spark.read.parquet(f"{folder}/findings"), config)
    return reviewed(got)


@query
def ledger_review(spark, sf):
    """A log of five batches: an earlier corpus, with files that go again (and a framework with them) and others that differ; invalidated and
    removed paths; a change list; the corpus as it is now. Findings are those of a full review."""
    config, now = strict(), code_files(spark, sf)
    fifth = F.col("path").rlike("[05]\\.[a-z]+$")
    gone = now.where(F.col("path").rlike("[27]\\.[a-z]+$")).select(F.regexp_replace("path", "/f(\\d+)", "/gone$1").alias("path"), F.concat("content", F.lit("\nimport React from 'react';")).alias("content"))
    before = now.withColumn("content", F.when(fifth, F.concat("content", F.lit("\nold();"))).otherwise(F.col("content")))
    log = Ledger(spark, run_folder(spark, "ledger"), config)
    log.update(before.unionByName(gone))
    log.invalidate(now.where(F.col("path").rlike("3\\.js$")).select("path"))
    log.remove(gone.where(F.col("path").rlike("2\\.[a-z]+$")).select("path"))
    log.change(now.where(F.col("path").rlike("0\\.[a-z]+$")))
    log.update(now)
    return reviewed(log.findings())


@query
def continuous_review_stream(spark, sf):
    """The documents arrive as a stream of Parquet files."""
    config = ReviewConfig(custom_rules=CUSTOM, framework_scope="file", enable_frameworks=("angular", "react", "node"))
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf}/documents*.parquet")  # files or folders of files
    arriving = stream.select(F.concat(F.lit("docs/d"), F.col("doc_id").cast("string"), F.lit(".html")).alias("path"), F.col("text").alias("content"))
    folder = run_folder(spark, "stream")
    continuous_review(arriving, folder, config).awaitTermination()
    return reviewed(spark.read.parquet(f"{folder}/findings"))


QUERIES["continuous_review"] = QUERIES.pop("continuous_review_stream")
__all__ = ["QUERIES"]
