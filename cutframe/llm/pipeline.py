"""Corpus pipeline: quality, near-duplicates, contamination, personal data, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the columns of documents;
the last returns windows of tokens with the texts of their pieces. SQL cannot express the classifier, the similarities or the pseudonyms,
so ORACLE_SQL is None; tests hold each stage to a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, near_copies, packing, pii, quality, token_counts
from .common import materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Pieces in one shard of windows: their texts are in one task.
SHARD_PIECES = 4096


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    labels = table(spark, sf_dir, "labels").where(~quality.held_out(F.col("doc_id")))
    model = quality.fit(docs, labels)
    return quality.score(docs.select(*COLUMNS), model, out="_score").where(F.col("_score") >= quality.THRESHOLD).select(*COLUMNS)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard similarity 0.8 or more."""
    return near_copies.deduplicate(docs.select(*COLUMNS))


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate."""
    return decontaminate.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms in place of personal data."""
    return pii.pseudonymize(docs.select(*COLUMNS), key=pii.session_key(spark)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of at most packing.CAPACITY tokens: their documents, and their pieces with texts."""
    named = docs.select("doc_id", "source", packing.content_cluster(F.col("text")).cast("string").alias("cluster"), "text")
    cut = materialize(token_counts.token_pieces(named, packing.CAPACITY), "pieces")  # counted, then packed: encoded once
    return packing.pack_windows(cut, packing.CAPACITY, SHARD_PIECES)


STAGES = [
    ("quality", good_quality),
    ("near_copies", no_near_copies),
    ("benchmark", no_benchmark),
    ("personal_data", no_personal_data),
    ("packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
