"""Reports: one JSON object per file, Markdown and plain text in parts.

A report is written as a folder of parts in order (header, files, end), so that no task
and no driver has to hold a whole report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.catalog.dims import SEVERITY_RANK
from lintlake.functions.regex import escape_literal

FOOTER = "Generated by lintlake"
SEVERITIES = list(reversed(SEVERITY_RANK))


def relative_path(path: Column, root: str) -> Column:
    clean = root.replace("\\", "/").rstrip("/")
    return F.regexp_replace(F.translate(path, "\\", "/"), f"^{escape_literal(clean)}/+", "") if clean else F.translate(path, "\\", "/")


def percent(confidence: Column) -> Column:
    return F.floor(confidence * 100 + 0.5).cast("int")


def json_files(per_file: DataFrame, scanned_at: str) -> DataFrame:
    """One row per file in the shape of the JSON report."""
    return per_file.select(
        F.col("path").alias("file"), "language", F.lit(scanned_at).alias("scannedAt"), F.lit(0).cast("bigint").alias("duration"),
        F.transform("issues", lambda i: F.struct(
            i["line_no"].alias("line"), i["end_line"].alias("endLine"), i["severity"].alias("severity"),
            i["category"].alias("category"), i["message"].alias("message"), i["explanation"].alias("explanation"),
            i["suggested_fix"].alias("suggestedFix"), i["confidence"].alias("confidence"), i["rule_id"].alias("ruleId"))).alias("issues"))


def json_header(summary: DataFrame, scanned_at: str) -> DataFrame:
    return summary.select(
        F.col("project").alias("projectName"), F.lit(scanned_at).alias("date"), F.col("scanned_files").alias("scannedFiles"),
        F.col("total_issues").alias("totalIssues"), F.col("duration_ms").alias("duration"),
        F.col("severity_breakdown").alias("severityBreakdown"), F.col("category_breakdown").alias("categoryBreakdown"))


def sink_json(per_file: DataFrame, summary: DataFrame, folder: str, scanned_at: str) -> None:
    json_files(per_file, scanned_at).write.mode("overwrite").json(f"{folder}/results")
    json_header(summary, scanned_at).write.mode("overwrite").json(f"{folder}/summary")


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _num(name: str) -> Column:
    return F.col(name).cast("string")


def _severity_rows(pad: bool) -> Column:
    def row(s: str) -> Column:
        n = F.coalesce(F.element_at("severity_breakdown", F.lit(s)), F.lit(0)).cast("string")
        return _text(f"  {s:<10} ", n) if pad else _text(f"| {s} | ", n, " |")

    return F.concat_ws("\n", *[row(s) for s in SEVERITIES])


def _category_rows() -> Column:
    entries = F.transform(F.map_entries("category_breakdown"), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("k")))
    return F.array_join(F.transform(F.sort_array(entries), lambda e: _text("| ", e["k"], " | ", (-e["n"]).cast("string"), " |")), "\n")


def markdown_file(per_file: DataFrame, root: str, scanned_at: str) -> DataFrame:
    """(path, section): the section of each file that has findings."""
    def block(i: Column) -> Column:
        return _text(
            "---\n\n**Line ", i["line_no"].cast("string"), "**\n**Severity:** ", i["severity"], "\n**Category:** ", i["category"],
            "\n**Issue:** ", i["message"], "\n**Explanation:** ", i["explanation"], "\n**Suggested Fix:** ", i["suggested_fix"],
            "\n**Confidence:** ", percent(i["confidence"]).cast("string"), "%",
            F.coalesce(_text("\n**Rule:** ", i["rule_id"]), F.lit("")), "\n")

    head = _text("### File: ", relative_path(F.col("path"), root), "\n\nLanguage: ", F.col("language"), " | Issues: ", _num("n"),
                 f" | Scanned: {scanned_at}\n\n")
    return per_file.where(F.col("n") > 0).select("path", _text(head, F.array_join(F.transform("issues", block), "\n")).alias("section"))


def text_file(per_file: DataFrame, root: str) -> DataFrame:
    def block(i: Column) -> Column:
        return _text("\n  Line ", i["line_no"].cast("string"), "\n  Severity: ", i["severity"], "\n  Issue: ", i["message"],
                     "\n  Explanation: ", i["explanation"], "\n  Suggested Fix: ", i["suggested_fix"])

    rule = "-" * 40
    head = _text(f"{rule}\nFILE: ", relative_path(F.col("path"), root), "\nLanguage: ", F.col("language"), " | Issues: ", _num("n"),
                 f"\n{rule}\n")
    return per_file.where(F.col("n") > 0).select(
        "path", _text(head, F.array_join(F.transform("issues", block), "\n"), "\n").alias("section"))


def markdown_header(summary: DataFrame, scanned_at: str) -> DataFrame:
    return summary.select(_text(
        "# Code Review Report\n\n**Project:** ", F.col("project"), f"\n**Date:** {scanned_at}\n**Scanned Files:** ", _num("scanned_files"),
        "\n**Total Issues:** ", _num("total_issues"), "\n**Duration:** ", _num("duration_ms"),
        "ms\n\n## Severity Breakdown\n\n| Severity | Count |\n|----------|-------|\n", _severity_rows(False),
        "\n\n## Category Breakdown\n\n| Category | Count |\n|----------|-------|\n", _category_rows(),
        "\n\n## Detailed Findings\n").alias("section"))


def text_header(summary: DataFrame, scanned_at: str) -> DataFrame:
    double, single = "=" * 60, "-" * 40
    return summary.select(_text(
        f"{double}\nCODE REVIEW REPORT\n{double}\n\nProject:       ", F.col("project"), f"\nDate:          {scanned_at}\nScanned Files: ",
        _num("scanned_files"), "\nTotal Issues:  ", _num("total_issues"), "\nDuration:      ", _num("duration_ms"),
        f"ms\n\n{single}\nSEVERITY BREAKDOWN\n{single}\n", _severity_rows(True), "\n").alias("section"))


def _ordered(parts: list[tuple[int, DataFrame]]) -> DataFrame:
    """Parts of a report in order: by part, then by path (a range-partitioned sort)."""
    out = None
    for n, df in parts:
        path = F.col("path") if "path" in df.columns else F.lit("")
        rows = df.select(F.lit(n).alias("part"), path.alias("path"), "section")
        out = rows if out is None else out.unionByName(rows)
    return out.orderBy("part", "path").select("section")


def _line(spark, text: str) -> DataFrame:
    return spark.range(1).select(F.lit(text).alias("section"))


def sink_markdown(per_file: DataFrame, summary: DataFrame, root: str, scanned_at: str, folder: str) -> None:
    spark = per_file.sparkSession
    listed = per_file.select("path", _text("- ", relative_path(F.col("path"), root)).alias("section"))
    _ordered([(0, markdown_header(summary, scanned_at)), (1, markdown_file(per_file, root, scanned_at)),
              (2, _line(spark, "## Scanned Files\n")), (3, listed), (4, _line(spark, f"\n---\n*{FOOTER}*"))]
             ).write.mode("overwrite").text(folder)


def sink_text(per_file: DataFrame, summary: DataFrame, root: str, scanned_at: str, folder: str) -> None:
    spark = per_file.sparkSession
    _ordered([(0, text_header(summary, scanned_at)), (1, text_file(per_file, root)),
              (2, _line(spark, f"{'=' * 60}\n{FOOTER}"))]).write.mode("overwrite").text(folder)
