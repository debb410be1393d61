"""A corpus pipeline over documents: quality, near duplicates, personal data, mixing, token ids.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; all but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataquery.llm import bpe, mixing, near_dup, pii, quality
from strataquery.llm.shared import materialize, table


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs, model, keep=docs.columns, names=("__held_out", "__score", "__predicted"))
    return scored.where("__predicted = 1").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: that of the smallest id."""
    return near_dup.keep_one(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind; n_chars follows the new text."""
    masked = pii.mask_pii(docs)
    return masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's documents as often as its target asks for; a document's copies are equal rows."""
    return mixing.emit(mixing.mix_plan(docs), docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with a check that they decode."""
    return bpe.encode_documents(docs, bpe.vocabulary_path("word_bpe_49k.json"), keep=["doc_id", "source"])


STAGES = [
    ("quality classifier", judge_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("PII", mask_personal_data),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode_tokens),
]

#: SQL expresses neither the fitted classifier nor the merges of the vocabulary; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{i + 1}")
    return docs
