"""The corpus pipeline: documents in, a clean and balanced mixture out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again before the next. All stages but the
last return the columns of documents. Rows without a doc_id go through every stage; near-dedup cannot name them and keeps them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm import decontaminate, mixing, secrets, simhash, toxicity
from lintlake.llm.common import Written, table
from lintlake.llm.learning import labelled

#: Near-duplicates as op10_simhash links them: shingles of three words, 64-bit fingerprints, at most 3 differing bits
SHINGLE, RADIUS = 3, 3


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    return toxicity.not_toxic(docs, toxicity.train(labelled(docs, table(spark, sf_dir, "labels"), "toxic", 3, 1)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that fingerprints link one stays, the one of the least id; documents without an id stay."""
    return simhash.one_of_each(docs, SHINGLE, RADIUS)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all documents stay."""
    out = secrets.redact(secrets.find_secrets(docs, secrets.train(secrets.labelled_strings(docs))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.char_length("text").cast(dict(docs.dtypes)["n_chars"]), F.col("n_chars")))
    return out.select([f"`{c}`" for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the mixture takes, with the number of copies."""
    return mixing.taken_rows(docs, mixing.mix(docs))


STAGES = [("toxicity", toxic_out), ("near_dedup", near_dedup), ("decontamination", benchmark_out), ("secrets", secrets_out), ("mixing", mixture)]

#: Training, fingerprints and the random moves of the mixture are not SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Written(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = w.put(stage(spark, docs, sf_dir), name)
    return docs
