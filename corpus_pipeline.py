"""From raw documents to token ids: quality, near-duplicates, secrets, source mix, SentencePiece.

Each stage reads all that the one before it kept, as a written table, and all but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.llm import fair_mix, piece_codec, quality_trees, secret_scan, shingle_join
from cohortflow.llm.common import table
from cohortflow.session import materialize

#: Documents below this score are rejected.
LEAST_QUALITY = 0.5
#: Near-duplicates: words per n-gram, percent of similarity.
WORDS, PERCENT = 5, 80


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from all labels, does not reject."""
    forest = quality_trees.learn(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return quality_trees.score(docs, forest).where(F.col("score") >= LEAST_QUALITY).select("row.*")


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return shingle_join.distinct_documents(docs, WORDS, PERCENT)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, a mark in place of each secret; n_chars follows the text."""
    return secret_scan.redacted(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return fair_mix.mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row."""
    return piece_codec.encode(docs, keep=["doc_id", "lang", "source"]).select("row.*", "n_tokens", "round_trip", "parity", "token_ids")


STAGES = [
    ("quality", good_documents),
    ("near_duplicates", distinct_documents),
    ("secrets", without_secrets),
    ("mix", mixed),
    ("pieces", tokens),
]

#: Learned scores, unbounded components and token ids have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        rows = materialize(stage(spark, rows, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, rows, sf_dir)
