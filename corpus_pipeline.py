"""Corpus pipeline: five stages over ``documents``, each of them one operator on whole tables.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns the next
documents. All stages take nulls in any column, empty and very long texts, repeated rows, empty tables and further columns of
any name: rows with a null doc_id and null or empty texts are documents like others, further columns pass through, and an empty table stays empty. ``run`` writes each stage's result to the shared folder and reads it again, so that a
stage starts from data and not from a long lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudgrain.llm import bpe, decontaminate, near_dedup, pii, toxicity
from cloudgrain.storage import settle

#: Documents at least as likely toxic as not are rejected.
MAX_TOXICITY = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below ``MAX_TOXICITY``; learnt from all labelled rows. All documents if these are too few for a model.

    Equal texts have equal scores, so repeated rows stay or go together. A null or empty text has the score of a text without evidence.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    return toxicity.keep_below(docs, model, MAX_TOXICITY)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: of its least doc_id, and of several rows of that one whose text sorts first.

    Texts without words and rows without doc_id stay.
    """
    return near_dedup.drop_near_duplicates(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents of which more than half the words are hit go. Null texts are not hit; rows are judged one by one."""
    return decontaminate.remove_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; overlapping finds become one. Null texts stay null."""
    return pii.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of ids and decoded text. A null text is encoded as an empty one; every row has its result."""
    return bpe.encode(docs, ("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("decontamination", remove_benchmark),
    ("personal_data", hide_personal_data), ("bpe", encode),
]

#: Scores, sketches and tokens are not expressible in SQL; tests/llm compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = settle(docs)
    return docs
