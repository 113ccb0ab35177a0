"""Headline timings: python bench.py -> one JSON line. BENCH_SF_DIR, BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import queries as Q
from lintlake.operators import blocks, changes, duplicates, findings as fi, scan, sequence, summary, tokens
from lintlake.operators.files import explode_lines, reviewable
from lintlake.plans.review import review_files
from lintlake.config import ReviewConfig
from lintlake.sources.derived import code_files, text_files

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def ready(spark: SparkSession) -> DataFrame:
    return reviewable(code_files(spark, SF_DIR))


def catalog_scan(spark):
    lines = explode_lines(ready(spark).unionByName(reviewable(text_files(spark, SF_DIR))))
    return scan.scan_catalog(lines)


def sequence_rules(spark):
    files = ready(spark)
    return fi.union_findings([sequence.win_unreachable(files), sequence.win_empty_catch(files), sequence.win_nested_loops(files),
                              sequence.win_json_parse_no_try(files)])


def block_rules(spark):
    return blocks.block_findings(ready(spark), Q.strict(), True, True, True)


def name_rules(spark):
    return tokens.unused_variables(ready(spark)).unionByName(tokens.listener_leaks(ready(spark)))


def duplicate_blocks(spark):
    config = ReviewConfig()
    return duplicates.duplicate_blocks(tokens.with_frameworks(ready(spark), config), config)


def full_review(spark):
    return review_files(code_files(spark, SF_DIR), ReviewConfig())


def severity_counts(spark):
    return summary.agg_severity(review_files(code_files(spark, SF_DIR), ReviewConfig()))


def changed_review(spark):
    """Files of one in twenty orders."""
    listed = code_files(spark, SF_DIR).where(F.col("path").rlike(r"/f\d*[05]5\.")).select("path")
    return changes.review_changed(code_files(spark, SF_DIR), listed, ReviewConfig())


BENCH = {"catalog_scan": catalog_scan, "sequence_rules": sequence_rules, "block_rules": block_rules, "name_rules": name_rules,
         "duplicate_blocks": duplicate_blocks, "full_review": full_review, "severity_counts": severity_counts, "changed_review": changed_review}


def main() -> None:
    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS)
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or list(BENCH)
    n_lines = explode_lines(ready(spark)).count()
    took = {}
    for name in names:
        start = time.perf_counter()
        BENCH[name](spark).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    total = round(sum(took.values()), 3)
    out = {"metric": "review_queries_total", "value": total, "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR.rstrip("/")),
           "code_lines": n_lines}
    if "full_review" in took:
        out["full_review_lines_per_sec"] = round(n_lines / took["full_review"])
    print(json.dumps(out))


if __name__ == "__main__":
    main()
