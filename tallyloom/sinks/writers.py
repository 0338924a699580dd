"""Write tables and check what was written."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.scalars import col
from tallyloom.operators.profile import per_column
from tallyloom.operators.schema import create_table_sql, sql_types


def _track(df: DataFrame, history: str | None, path: str, fmt: str) -> None:
    """Append one row per export to the history folder."""
    if history:
        df.sparkSession.range(1).select(
            F.lit(path).alias("path"), F.lit(fmt).alias("format"), F.lit(",".join(df.columns)).alias("columns"),
            F.current_timestamp().alias("exported_at")).write.mode("append").parquet(history)


def write_csv(df: DataFrame, path: str, *, mode: str = "errorifexists", history: str | None = None, **options) -> None:
    """CSV with a header in every part file; quotes are doubled."""
    df.write.mode(mode).options(header=True, escape='"', **options).csv(path)
    _track(df, history, path, "csv")


def write_json(df: DataFrame, path: str, *, mode: str = "errorifexists", history: str | None = None) -> None:
    """JSON lines; NULL fields are written."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)
    _track(df, history, path, "json")


def split_output(df: DataFrame, path: str, max_rows: int, *, mode: str = "errorifexists") -> None:
    """CSV parts of at most ``max_rows`` rows, each with a header."""
    write_csv(df, path, mode=mode, maxRecordsPerFile=max_rows)


def write_table(
    df: DataFrame, table: str, *, mode: str = "append", primary_keys: tuple[str, ...] = (),
    path: str | None = None, jdbc: Mapping[str, str] | None = None,
) -> str:
    """Append to or create a table, in the catalog or by JDBC; returns the DDL text."""
    if jdbc:
        df.write.format("jdbc").options(dbtable=table, **jdbc).mode(mode).save()
    else:
        writer = df.write.mode(mode).format("parquet")
        (writer.option("path", path) if path else writer).saveAsTable(table)
    return create_table_sql(table, sql_types(df), primary_keys)


def _checksums(df: DataFrame) -> DataFrame:
    """Rows, values and an order-free hash sum per column."""
    return per_column(df, df.columns, {
        "rows": lambda c: F.count(F.lit(1)),
        "values": lambda c: F.count(col(c)),
        "checksum": lambda c: F.coalesce(
            F.sum(F.when(col(c).isNotNull(), F.xxhash64(col(c).cast("string"))).cast("decimal(38,0)")), F.lit(0)).cast("string"),
    })


def validate_export(df: DataFrame, path: str, fmt: str = "csv") -> DataFrame:
    """Re-read an export and compare counts and checksums per column."""
    spark: SparkSession = df.sparkSession
    reader = spark.read.schema(df.schema)
    if fmt == "csv":
        reader = reader.options(header=True, escape='"')
    written = _checksums(reader.format(fmt).load(path)).withColumnsRenamed(
        {"rows": "rows_written", "values": "values_written", "checksum": "checksum_written"})
    return _checksums(df).join(written, "column", "left").withColumn("is_same", F.expr(
        "rows <=> rows_written and values <=> values_written and checksum <=> checksum_written"))
