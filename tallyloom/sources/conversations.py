"""Conversation documents as message rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.scalars import file_name

SCHEMA = """
    conversation_id string, title string, created_at double, updated_at double,
    messages array<struct<role: string, content: string, timestamp: double, message_id: string,
                          metadata: map<string, string>>>,
    metadata map<string, string>, data_files array<string>, compressed_context string, context_summary string,
    _corrupt_record string
"""


def scan_conversations(spark: SparkSession, path: str | list[str], multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """(one row per message, files that are no valid JSON)."""
    documents = spark.read.schema(SCHEMA).json(
        path, multiLine=multi_line, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record"
    ).withColumn("source_file", file_name(F.col("_metadata.file_path")))
    good = documents.where("_corrupt_record is null")
    messages = good.select(
        "conversation_id", "title", "created_at", "updated_at", "data_files", "source_file",
        F.posexplode("messages").alias("turn", "m"),
    ).select(
        "conversation_id", "title", "created_at", "updated_at", "data_files", "source_file", "turn",
        "m.role", "m.content", "m.timestamp", "m.message_id")
    # Spark refuses to read the raw record alone, hence the (always true) look at the id.
    bad = documents.where("_corrupt_record is not null and length(coalesce(conversation_id, '')) >= 0").select("source_file", F.lit("invalid JSON").alias("error"))
    return messages, bad
