"""Registered queries of the operators: (spark, sf_dir) -> the whole result over the whole table; SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm import covertree, decontaminate, lm, mixing, negatives, quality, secrets, simhash, substrings, topk, toxicity, turntree, urls
from lintlake.llm.common import table
from lintlake.llm.learning import labelled


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified overlaps of documents with benchmark items: doc_id, item_id and where."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(table(spark, sf_dir, "documents"))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(labelled(docs, table(spark, sf_dir, "labels"), "toxic", 3, 1)))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(mixing.mix(table(spark, sf_dir, "documents")))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(labelled(docs, table(spark, sf_dir, "labels"), "quality", 5, 0)))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.digest(secrets.find_secrets(docs, secrets.train(secrets.labelled_strings(docs))))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_neardup_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_vectors(table(spark, sf_dir, "embeddings"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turntree.rebuilt_trie(table(spark, sf_dir, "conversations"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.expr(negatives.ANCHOR), F.expr(negatives.LABEL))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_substrings, op3_urls, op4_lm, op5_toxicity, op6_mixing, op7_topk, op8_quality, op9_secrets, op10_simhash,
                                   op11_neardup_vectors, op12_conversations, op13_hard_negatives)}
ORACLE = {"op3_urls": urls.judge_sql(), "op7_topk": topk.top_k_sql(), "op11_neardup_vectors": covertree.near_vectors_sql(), "op12_conversations": turntree.rebuilt_trie_sql(),
          "op13_hard_negatives": negatives.hard_negatives_sql()}
