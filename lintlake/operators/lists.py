"""Long lists of words as tables: which texts hold any of them, without an expression per word.

A word is found through one short part of it, the one that the fewest texts have; texts are cut into their distinct parts of that length and
joined by equality, and only the pairs that meet are compared as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.sources.local import kept

PART = 3


def parts_of(text: Column, n: Column) -> Column:
    """Distinct parts of n characters; none if the text is shorter."""
    whole = F.transform(F.sequence(F.lit(1), F.char_length(text) - n + 1), lambda i: F.substring(text, i, n))
    return F.when(F.char_length(text) >= n, F.array_distinct(whole)).otherwise(F.array().cast("array<string>"))


def texts_with_any(texts: DataFrame, words: DataFrame) -> DataFrame:
    """The distinct texts (column ``text``) that hold one of the words (column ``word``), in any place. Null and empty words are left out."""
    words = kept(words.where(F.char_length("word") > 0).select("word").distinct(), "words")
    texts = kept(texts.where("text IS NOT NULL").select("text").distinct(), "texts")
    sizes = words.select(F.least(F.char_length("word"), F.lit(PART)).alias("n")).distinct()  # at most PART rows
    lengths = [r["n"] for r in sizes.collect()]
    if not lengths:
        return texts.limit(0)
    parts = F.concat(*[parts_of(F.col("text"), F.lit(n)) for n in sorted(lengths)])
    pieces = words.select("word", F.explode(parts_of(F.col("word"), F.least(F.char_length("word"), F.lit(PART)))).alias("part"))
    seen = texts.select("text", F.explode(parts).alias("part"))
    often = seen.join(pieces.select("part").distinct(), "part", "left_semi").groupBy("part").agg(F.count("*").alias("often"))
    # a part that no text has leaves its word out: inner join, then the rarest part of each word whose parts all occur
    counted = pieces.join(often, "part", "left").groupBy("word").agg(
        F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "part")).alias("rarest")).where("rarest.often > 0").select("word", F.col("rarest.part").alias("part"))
    return seen.join(counted, "part").where(F.contains("text", F.col("word"))).select("text").distinct()


def filter_whitelist_table(findings: DataFrame, names: DataFrame) -> DataFrame:
    """Findings whose source line holds none of the names (a table with the column ``word``). They are read twice, so they are made once and kept."""
    findings = kept(findings, "findings")
    return findings.join(texts_with_any(findings.select("text"), names), "text", "left_anti").select(findings.columns)
