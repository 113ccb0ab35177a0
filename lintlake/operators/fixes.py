"""Quick fixes as a rewrite of the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions.regex import java_regex
from lintlake.functions.text import split_lines

# rule -> order in which it wins when a line has several fixes
FIXABLE = {"ast/unused-variable": 0, "ast/no-var": 1, "ast/strict-equality": 2, "ai/json-parse-no-try": 3}


def fixed_text(line: Column, rule_id: Column) -> Column:
    """The line after its fix; null means the line is deleted."""
    var = F.regexp_replace(line, rf"^(.*?){java_regex(r'\bvar\b')}", "$1const")
    strict = F.regexp_replace(line, r"^(.*?[^!=<>])==([^=])", "$1===$2")
    indent = F.regexp_extract(line, r"^(\s*)", 1)
    wrapped = F.concat(indent, F.lit("try {\n"), line, F.lit("\n"), indent, F.lit("} catch (e) {\n"), indent,
                       F.lit("    console.error('JSON parse error:', e);\n"), indent, F.lit("}"))
    return (F.when(rule_id == "ast/unused-variable", F.lit(None).cast("string")).when(rule_id == "ast/no-var", var)
            .when(rule_id == "ast/strict-equality", strict).when(rule_id == "ai/json-parse-no-try", wrapped).otherwise(line))


def chosen_fixes(findings: DataFrame) -> DataFrame:
    """(path, line_no, rule_id): per line the one fix that is applied."""
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in FIXABLE.items() for x in kv]), F.col("rule_id"))
    return findings.where(F.col("rule_id").isin(*FIXABLE)).groupBy("path", "line_no").agg(
        F.min(F.struct(rank.alias("rank"), F.col("rule_id"))).alias("fix")).select("path", "line_no", F.col("fix.rule_id").alias("rule_id"))


def fix_lines(lines: DataFrame, findings: DataFrame) -> DataFrame:
    """(path, line_no, old_text, new_text, rule_id) for each line with a fix; new_text null = deleted."""
    fixes = chosen_fixes(findings)
    joined = lines.select("path", "line_no", "text").join(fixes, ["path", "line_no"])
    return joined.select("path", "line_no", F.col("text").alias("old_text"),
                         fixed_text(F.col("text"), F.col("rule_id")).alias("new_text"), "rule_id")


def apply_fixes(files: DataFrame, findings: DataFrame) -> DataFrame:
    """(path, content) of every file, rewritten. Edits (a few per file) travel to their file; lines
    are rewritten and joined inside its row, so the text itself is shuffled at most once."""
    rank = F.col("line_no")
    edits = chosen_fixes(findings).groupBy("path").agg(F.sort_array(F.collect_list(F.struct(rank, "rule_id"))).alias("edits"))
    joined = files.select("path", "content").join(edits, "path", "left")
    rule_of = F.map_from_entries("edits")
    both = joined.select("path", "content", rule_of.alias("rule_of"), split_lines(F.col("content")).alias("lines"))
    rewritten = F.filter(F.transform("lines", lambda x, i: fixed_text(x, F.coalesce(F.element_at("rule_of", i + 1), F.lit("")))),
                         lambda x: x.isNotNull())
    return both.select("path", F.when(F.col("rule_of").isNull(), F.col("content")).otherwise(
        F.array_join(rewritten, "\n")).alias("content"))


def fix_hint(suggested_fix: Column) -> Column:
    return F.concat(F.lit("Fix: "), F.substring(suggested_fix, 1, 80))
