"""The operators of this subpackage on their whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import counts, decontaminate, exact, jaccard, licenses, merkle, neardup, packing, quality, shards, sql, toxicity, trie, warc

SHARDS = 24
GOOD = 0.7


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(_table(spark, sf_dir, "documents"), keep="largest")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = shards.shuffle_into_shards(_table(spark, sf_dir, "documents").select("doc_id", "text"), SHARDS, ["doc_id"])
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return dealt.select(
        "doc_id", shards.utf8_size(F.col("text")).alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_quality(documents, _table(spark, sf_dir, "labels").where(~_held_out()))
    scored = quality.score_quality(documents, model)
    return scored.select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(_table(spark, sf_dir, "pages")).drop("url")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(documents, _table(spark, sf_dir, "labels").where(~_held_out()))
    return toxicity.score_toxicity(documents, model)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents")).drop("ids")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.document_tokens(_table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(_table(spark, sf_dir, "conversations"), shared_heads=True)


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.ngram_join(_table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    altered = F.translate("text", sql.A_TO_Z, sql.A_TO_Z.lower())
    given = merkle.leaf_digest([F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, altered).otherwise(F.col("text")) if c == "text" else F.col(c) for c in fields])
    proven = merkle.manifest(_table(spark, sf_dir, "documents"), "doc_id", "source", fields, {"given": given})
    folded = proven.withColumn("folded_root", merkle.fold(F.col("given"), F.col("witness")))
    return folded.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings_text(F.col("witness")), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {f.__name__: f for f in (
    op1_decontamination, op2_exact_dedup, op3_sharding, op4_quality, op5_warc, op6_toxicity, op7_packing, op8_near_dedup, op9_token_counts, op10_licenses,
    op11_conversation_trie, op12_ngram_join, op13_merkle_manifest)}

SQL = {
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op5_warc": """
        WITH hashed AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h,
                   min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id
            FROM pages)
        SELECT page_id, payload_bytes,
               list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + ((CAST('0x' || substr(h, 1 + 5 * CAST(floor(i / 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31), 1)),
                   'string_agg', '') AS payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM hashed""",
    "op11_conversation_trie": sql.conversation_trie(),
    "op12_ngram_join": sql.ngram_join(),
    "op13_merkle_manifest": sql.merkle_manifest(),
}
