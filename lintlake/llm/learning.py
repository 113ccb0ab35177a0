"""Labelled samples and held-out marks for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import doc_bytes, remainder

SAMPLE = 12_000


def labelled(docs: DataFrame, labels: DataFrame, column: str, modulus: int, held: int, sample: int = SAMPLE) -> DataFrame:
    """doc_id, text (bytes), y: at most `sample` labelled documents of the learning part, chosen by the hash of the id, one row each.

    Rows whose crc32(doc_id) mod `modulus` is `held` are never used; ids labelled both ways are left out; null labels and ids too.
    Of the rows of a repeated id the text of the least hash is used (of equal hashes the least text), chosen where the rows lie
    before anything is shuffled, so no id brings more than its one row. Empty and null texts are texts like any other.
    """
    ids = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y")).where("y IS NOT NULL AND doc_id IS NOT NULL")
           .groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").where(remainder("doc_id", modulus) != held)
           .join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")
           .orderBy(F.xxhash64(F.lit(column), "doc_id"), "doc_id").limit(sample).select("doc_id", "y"))
    rows = doc_bytes(docs, F.col("doc_id").cast("long").alias("doc_id")).join(F.broadcast(ids), "doc_id")
    return rows.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("mark"), F.col("text"))).alias("least")).select("doc_id", "least.text", "y")


def scored(docs: DataFrame, modulus: int, held: int) -> DataFrame:
    """Every row as doc_id, held_out, text (bytes)."""
    out: Column = (remainder("doc_id", modulus) == held).alias("held_out")
    return doc_bytes(docs, F.col("doc_id").cast("long").alias("doc_id"), out)
