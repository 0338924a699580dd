"""Read a large input piece by piece, and keep totals while reading."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.scalars import col, to_number
from tallyloom.session import scratch_dir
from tallyloom.sources.probe import list_files


def incremental_scan(
    spark: SparkSession, path: str, fmt: str = "parquet", schema=None, files_per_trigger: int = 100, **options,
) -> DataFrame:
    """A streaming frame over the files; each micro-batch takes a bounded number of files."""
    schema = schema or spark.read.format(fmt).options(**options).load(path).schema
    first = list_files(spark, path).select("path").first()
    if first and first[0].rstrip("/").endswith(path.rstrip("/").split(":", 1)[-1]):
        path = f"{path[:-1]}[{path[-1]}]"  # one file: the file source wants a folder or a glob
    return (
        spark.readStream.format(fmt).schema(schema).options(**options)
        .option("maxFilesPerTrigger", files_per_trigger).load(path)
    )


def drain(stream: DataFrame, path: str, checkpoint: str | None = None) -> DataFrame:
    """Run the stream over everything there is, append to ``path`` and read it back.

    With the same checkpoint a second run takes only new files.
    """
    spark = stream.sparkSession
    checkpoint = checkpoint or scratch_dir(spark, "stream-state")
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(path)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def stream_totals(sources: Mapping[str, tuple[DataFrame, str]], path: str, checkpoint: str | None = None) -> DataFrame:
    """Running count and sum per source over streaming frames; the state after all input, no rows if there never was any."""
    parts = [
        df.select(F.lit(name).alias("source"), to_number(col(amount)).alias("amount"))
        for name, (df, amount) in sources.items()
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    totals = rows.groupBy("source").agg(F.sum("amount").alias("total"), F.count("*").alias("rows"))
    spark = rows.sparkSession
    checkpoint = checkpoint or scratch_dir(spark, "stream-state")

    def store(batch: DataFrame, number: int) -> None:
        # Complete mode: every batch carries all totals, one row per source.
        batch.write.mode("overwrite").parquet(path)

    query = (
        totals.writeStream.outputMode("complete").foreachBatch(store)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    try:
        stored = spark.read.schema(totals.schema).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], totals.schema)  # without input no batch ran
    return stored.select("source", F.round("total", 2).alias("total"), "rows")
