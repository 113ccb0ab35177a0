"""Roll-ups of findings. Counts aggregate map-side first; nothing is gathered into one row but
the four severities and the categories."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.catalog.dims import CATEGORIES, SEVERITY_RANK, label
from lintlake.sources.local import small_table

ISSUE = ["line_no", "end_line", "severity", "category", "message", "explanation", "suggested_fix", "confidence", "rule_id"]


def agg_severity(findings: DataFrame) -> DataFrame:
    """Count per severity, all four present."""
    dim = small_table(findings.sparkSession, list(SEVERITY_RANK.items()), ["severity", "sev_rank"], {"sev_rank": pa.int32()})
    counts = findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    return dim.join(counts, "severity", "left").select("severity", "sev_rank", F.coalesce("n", F.lit(0)).alias("n"))


def agg_category(findings: DataFrame) -> DataFrame:
    """Count per category present, most frequent first."""
    return findings.groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "category")


def issue_list() -> Column:
    """Aggregate: the findings of one file in report order, as one list."""
    order = F.struct((-F.col("sev_rank")).alias("o1"), F.col("line_no").alias("o2"), F.col("seq").alias("o3"))
    items = F.sort_array(F.collect_list(F.struct(order.alias("o"), F.struct(*ISSUE).alias("issue"))))
    return F.transform(items, lambda x: x["issue"])


def agg_file(status: DataFrame, findings: DataFrame) -> DataFrame:
    """Per file: language, number of findings, findings in report order. Files without findings stay."""
    per_file = findings.groupBy("path").agg(F.count(F.lit(1)).alias("n"), issue_list().alias("issues"))
    none = F.array().cast(per_file.schema["issues"].dataType)
    return status.join(per_file, "path", "left").select(
        "path", "language", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("issues", none).alias("issues"))


def run_summary(status: DataFrame, findings: DataFrame, project: str, duration_ms: int = 0) -> DataFrame:
    """One row: counts and the two breakdowns. The list of scanned files is ``status`` itself."""
    totals = findings.groupBy().agg(
        F.count(F.lit(1)).alias("total_issues"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITY_RANK],
        *[F.count_if(F.col("category") == label(c)).alias(c) for c in CATEGORIES])
    files = status.groupBy().agg(F.count(F.lit(1)).alias("scanned_files"))
    severities = F.map_from_arrays(F.array(*[F.lit(s) for s in SEVERITY_RANK]), F.array(*SEVERITY_RANK))
    categories = F.map_filter(F.map_from_arrays(F.array(*[F.lit(label(c)) for c in CATEGORIES]), F.array(*CATEGORIES)),
                              lambda k, v: v > 0)
    return totals.select(
        F.lit(project).alias("project"), files.scalar().alias("scanned_files"), "total_issues",
        severities.alias("severity_breakdown"), categories.alias("category_breakdown"),
        F.lit(duration_ms).cast("bigint").alias("duration_ms"))
