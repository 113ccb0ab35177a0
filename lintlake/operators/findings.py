"""The shape of findings.

Operators produce *slim* findings: where, which rule, the values for its texts and
the source line. Severity, texts and confidence are functions of the rule and are
joined back once, at the end, from the catalog.

    path, lang_id, line_no, end_line, uid, args ARRAY<STRING>, pos, ord, text

``pos`` and ``ord`` order findings of one analyzer step as they are met.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.catalog.dims import SEVERITY_RANK, label
from lintlake.catalog.rules import BY_UID, Rule
from lintlake.config import ReviewConfig
from lintlake.operators.files import MAX_BROADCAST_RULES
from lintlake.sources.local import small_table

SLIM = ["path", "lang_id", "line_no", "end_line", "uid", "args", "pos", "ord", "text"]
FULL = ["path", "lang_id", "line_no", "end_line", "severity", "sev_rank", "category", "message",
        "explanation", "suggested_fix", "confidence", "rule_id", "seq", "text"]


def slim(df: DataFrame, uid: str | Column, args: list[Column] | None = None, line_no: str = "line_no",
         end_line: Column | None = None, pos: Column | None = None, ord: Column | None = None) -> DataFrame:
    values = F.array(*[a.cast("string") for a in args]) if args else F.array().cast("array<string>")
    return df.select(
        "path", "lang_id", F.col(line_no).cast("int").alias("line_no"),
        (end_line if end_line is not None else F.lit(None)).cast("int").alias("end_line"),
        (F.lit(uid) if isinstance(uid, str) else uid).alias("uid"), values.alias("args"),
        (pos if pos is not None else F.col(line_no)).cast("int").alias("pos"),
        (ord if ord is not None else F.lit(0)).cast("int").alias("ord"), "text")


FIND = "struct<line_no:int,end_line:int,uid:string,args:array<string>,pos:int,ord:int,text:string>"


def find(uid: str, line_no: Column, text: Column, args: list[Column] | None = None, end_line: Column | None = None,
         pos: Column | None = None, ord: Column | int = 0) -> Column:
    """One finding as a struct, for rules that work on the array of lines of a file."""
    values = F.array(*[a.cast("string") for a in args]) if args else F.array().cast("array<string>")
    return F.struct(
        line_no.cast("int").alias("line_no"), (F.lit(None) if end_line is None else end_line).cast("int").alias("end_line"),
        F.lit(uid).alias("uid"), values.alias("args"), (line_no if pos is None else pos).cast("int").alias("pos"),
        (F.lit(ord) if isinstance(ord, int) else ord).cast("int").alias("ord"), text.alias("text"))


def existing(found: Column) -> Column:
    """The array without its nulls."""
    return F.filter(found, lambda f: f.isNotNull())


def from_arrays(rows: DataFrame, found: Column, carry: tuple[str, ...] = ()) -> DataFrame:
    """Slim findings (and columns to carry) from a column with an array of ``find`` structs."""
    return rows.select("path", "lang_id", *carry, F.inline_outer(found)).where(F.col("uid").isNotNull()).select(*SLIM, *carry)


def union_findings(parts: list[DataFrame]) -> DataFrame:
    """All analyzers' findings, UNION ALL."""
    return reduce(DataFrame.unionByName, [p.select(*SLIM) for p in parts])


def active_rules(config: ReviewConfig) -> list[Rule]:
    return [*BY_UID.values(), *config.user_rules]


def passing(rules: list[Rule], config: ReviewConfig | None) -> list[Rule]:
    """Severity and confidence belong to the rule, so both thresholds prune rules before any scan."""
    if config is None:
        return list(rules)
    floor = SEVERITY_RANK[config.severity_threshold]
    return [r for r in rules if SEVERITY_RANK[r.severity] >= floor and r.confidence >= config.confidence_threshold]


def wanted(uid: str, config: ReviewConfig | None) -> bool:
    return bool(passing([BY_UID[uid]], config))


def rule_dim(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    names = ["uid", "analyzer", "step", "rule_id", "category", "severity", "sev_rank", "confidence",
             "message", "explanation", "suggested_fix"]
    rows = [(r.uid, r.analyzer, r.step, r.rule_id, label(r.category), r.severity, SEVERITY_RANK[r.severity],
             r.confidence, r.message, r.explanation, r.fix) for r in rules]
    return small_table(spark, rows, names, {"analyzer": pa.int32(), "step": pa.int32(), "sev_rank": pa.int32(),
                                            "confidence": pa.float64()})


def catalog(spark: SparkSession, config: ReviewConfig) -> DataFrame:
    rules = active_rules(config)
    table = rule_dim(spark, rules)
    return F.broadcast(table) if len(rules) <= MAX_BROADCAST_RULES else table


def _filled(name: str) -> Column:
    out = F.col(name)
    for n in range(3):
        out = F.replace(out, F.lit(f"{{{n}}}"), F.coalesce(F.get("args", F.lit(n)), F.lit(f"{{{n}}}")))
    return F.when(F.size("args") == 0, F.col(name)).otherwise(out)


def named(findings: DataFrame, config: ReviewConfig) -> DataFrame:
    """Slim findings with what filters and dedup look at: rule_id, category, message, seq."""
    dim = catalog(findings.sparkSession, config).select("uid", "analyzer", "step", "rule_id", "category", "message")
    return findings.join(dim, "uid").select(
        *SLIM, "rule_id", "category", _filled("message").alias("message"), F.struct("analyzer", "step", "pos", "ord").alias("seq"))


def completed(findings: DataFrame, config: ReviewConfig) -> DataFrame:
    """Named findings with all columns. Explanations and fixes are the long texts: they come in here,
    after the last shuffle."""
    dim = catalog(findings.sparkSession, config).select("uid", "severity", "sev_rank", "confidence", "explanation", "suggested_fix")
    return findings.join(dim, "uid").select(
        "path", "lang_id", "line_no", "end_line", "severity", "sev_rank", "category", "message",
        _filled("explanation").alias("explanation"), _filled("suggested_fix").alias("suggested_fix"), "confidence", "rule_id",
        "seq", "text")


def hydrate(findings: DataFrame, config: ReviewConfig | None = None) -> DataFrame:
    """Slim findings -> full findings."""
    config = config or ReviewConfig()
    return completed(named(findings, config), config)
