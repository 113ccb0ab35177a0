"""Filters over findings, then their order: severity, confidence, whitelists, frameworks; dedup; sort.

Thresholds are properties of rules (see findings.passing). Whitelists and framework
patterns are settings of bounded size, so they become literal predicates on the source
line that a finding carries: no lookup, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lintlake.catalog import frameworks as FW
from lintlake.catalog.dims import SEVERITY_RANK
from lintlake.config import ReviewConfig, usable_regex
from lintlake.functions.literals import needed_test
from lintlake.functions.regex import java_regex
from lintlake.functions.sqltext import any_sql, quoted, quoted_list, rlike_sql
from lintlake.functions.text import any_of, contains_any


def filter_severity(findings: DataFrame, threshold: str) -> DataFrame:
    return findings.where(F.col("sev_rank") >= SEVERITY_RANK[threshold])


def filter_confidence(findings: DataFrame, threshold: float) -> DataFrame:
    return findings.where(F.col("confidence") >= threshold)


def filter_whitelist_names(findings: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return findings.where(~contains_any(F.col("text"), names)) if names else findings


def filter_whitelist_patterns(findings: DataFrame, patterns: tuple[str, ...]) -> DataFrame:
    usable = [p for p in patterns if usable_regex(p)]
    hits = [F.col("text").rlike(java_regex(p, exact_edges=True)) for p in usable]
    return findings.where(~any_of(hits)) if hits else findings


def suppressed_by_framework(text: str, rule_id: str, lang_id: str = "lang_id", active: str = "frameworks") -> str:
    """SQL: whether an active framework explains the line for this rule and language. Arguments are SQL too."""
    return any_sql(
        f"({lang_id} IN ({quoted_list(s.langs)}) AND {rule_id} IN ({quoted_list(s.rule_ids)}) AND {needed_test(s.pattern, text) or 'true'} "
        f"AND array_contains({active}, {quoted(s.framework)}) AND {rlike_sql(text, java_regex(s.pattern))})" for s in FW.SUPPRESS)


SUPPRESSIBLE = sorted({r for s in FW.SUPPRESS for r in s.rule_ids})


def suppress_framework_blocks(lines: DataFrame) -> DataFrame:
    """Mark lines (path, lang_id, text, frameworks) whose blocks are not reported as duplicates."""
    return lines.withColumn("quiet", F.expr(suppressed_by_framework("text", "'ai/code-duplication'")))


def filter_framework(findings: DataFrame) -> DataFrame:
    """findings need ``rule_id``, ``lang_id``, ``text`` and ``frameworks``."""
    return findings.where(F.expr(f"NOT (rule_id IN ({quoted_list(SUPPRESSIBLE)}) AND {suppressed_by_framework('text', 'rule_id')})"))


def filter_whitelists(findings: DataFrame, config: ReviewConfig) -> DataFrame:
    return filter_whitelist_patterns(filter_whitelist_names(findings, config.whitelisted_functions), config.whitelisted_patterns)


def filter_findings(findings: DataFrame, config: ReviewConfig) -> DataFrame:
    out = filter_confidence(filter_severity(findings, config.severity_threshold), config.confidence_threshold)
    return filter_framework(filter_whitelists(out, config))


def dedup_findings(findings: DataFrame) -> DataFrame:
    """Per file the first finding for (line, category, message)."""
    keys = ("path", "line_no", "category", "message")
    # sorts look at the first bytes of the first key before they compare rows, and paths mostly begin alike
    w = W.partitionBy(F.xxhash64(*keys), *keys).orderBy("seq")
    return findings.withColumn("rn", F.row_number().over(w)).where(F.col("rn") == 1).drop("rn")



def sort_findings(findings: DataFrame) -> DataFrame:
    """Severity falling, then line, then the order in which analyzers report; by file."""
    return findings.orderBy("path", F.col("sev_rank").desc(), "line_no", "seq")
