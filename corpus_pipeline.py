"""Documents to training sequences: quality, exact and near duplicates, benchmark passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import decontaminate, exact, neardup, packing, quality
from tallyloom.llm.queries import GOOD
from tallyloom.llm.shared import written

#: The pipeline's trees, tokens and links have no SQL form; tests hold it against a brute-force version.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.7 or more by trees fitted on the labelled ones among them, outside the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    model = quality.fit_quality(docs, labels)
    score = "quality_score"
    while score in docs.columns:
        score += "_"
    return quality.score_quality(docs, model, score_col=score).where(F.col(score) >= GOOD).drop(score)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text the one with the smallest doc_id."""
    return exact.drop_exact_duplicates(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id."""
    return neardup.drop_near_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 2,048 tokens, with their ids."""
    return packing.pack(docs)


STAGES = [
    ("quality", good_quality), ("exact_dedup", without_copies), ("near_dedup", without_near_copies), ("decontamination", without_benchmark), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
