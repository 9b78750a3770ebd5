"""The corpus pipeline: quality, near-duplicates, personal data, mixing, pieces. Part of the subpackage llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callwise.llm import mixing, near_dup, pieces, pii, quality
from callwise.llm.common import written
from callwise.llm.queries import PIECE_MODEL, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the neighbours' vote calls poor; the vote is learnt from the labels."""
    model = spark.sparkContext.broadcast(quality.fit(docs, table(spark, sf_dir, "labels")))
    return quality.score(docs, model, out="_quality").where("predicted = 1").select(*docs.columns)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates."""
    return near_dup.one_per_class(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts marks in place of personal data; n_chars follows the text."""
    weights = spark.sparkContext.broadcast(pii.fit(docs))
    clean = pii.redact(docs, weights)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that the sources meet their targets."""
    return mixing.apply_mix(docs)


def encoded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, its length in pieces and the scores of its best paths."""
    encoded = pieces.encode(docs.select("doc_id", "source", "text"), pieces.share_vocabulary(spark, PIECE_MODEL))
    return encoded.select("doc_id", "source", "ids", F.size("ids").alias("n_pieces"), "score",
                          F.col("alternatives.score").alias("other_scores"))


STAGES = [
    ("quality", good_documents),
    ("near_duplicates", distinct_documents),
    ("personal_data", without_personal_data),
    ("mixing", mixed_documents),
    ("pieces", encoded_documents),
]

#: No SQL can express the stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
