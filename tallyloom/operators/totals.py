"""Counts, sums and means across several tables, with the answer as text."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.scalars import col, constant_rows, grouped_number, money, to_number

Tables = Mapping[str, tuple[DataFrame, str | None]]


def tagged_amounts(tables: Tables) -> DataFrame:
    """All rows of all tables as (source, amount). Each table brings (frame, amount column)."""
    parts = [
        df.select(
            F.lit(source).alias("source"),
            (to_number(col(amount)) if amount else F.lit(None).cast("double")).alias("amount"),
        )
        for source, (df, amount) in tables.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _with_empty_tables(grouped: DataFrame, tables: Tables) -> DataFrame:
    """A table without rows is still part of the answer."""
    names = constant_rows(grouped.sparkSession, [(n,) for n in tables], "source string")
    return names.join(grouped, "source", "left")


def total_across(tables: Tables) -> DataFrame:
    """Sum and count per table and, in the row ``(all)``, over all tables."""
    per_table = _with_empty_tables(
        tagged_amounts(tables).groupBy("source").agg(F.sum("amount").alias("value"), F.count("*").alias("rows")),
        tables)
    both = F.explode(F.array(F.col("source"), F.lit("(all)")))
    return (
        per_table.withColumn("source", both).groupBy("source")
        .agg(
            F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 2).alias("total"),
            F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        )
        .withColumn("answer", F.when(
            F.col("source") == "(all)", F.concat(F.lit("Total across all files: "), money(F.col("total"))),
        ).otherwise(F.concat(
            F.lit("• "), F.col("source"), F.lit(": "), money(F.col("total")),
            F.lit(" ("), grouped_number(F.col("rows")), F.lit(" transactions)"))))
    )


def count_across(tables: Tables) -> DataFrame:
    """Rows per table and over all tables."""
    per_table = _with_empty_tables(
        tagged_amounts(tables).groupBy("source").agg(F.count("*").alias("rows")), tables)
    both = F.explode(F.array(F.col("source"), F.lit("(all)")))
    return (
        per_table.withColumn("source", both).groupBy("source")
        .agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
        .withColumn("answer", F.when(
            F.col("source") == "(all)",
            F.concat(F.lit("Total transactions across all files: "), grouped_number(F.col("rows"))),
        ).otherwise(F.concat(
            F.lit("• "), F.col("source"), F.lit(": "), grouped_number(F.col("rows")), F.lit(" transactions"))))
    )


def mean_across(tables: Tables) -> DataFrame:
    """Mean per table; ``(all)`` is the plain mean of the positive table means, NULL if none."""
    per_table = _with_empty_tables(
        tagged_amounts(tables).groupBy("source").agg(F.avg("amount").alias("mean")), tables)
    own = F.struct(F.col("source").alias("source"), F.col("mean").alias("mean"))
    all_ = F.struct(F.lit("(all)").alias("source"), F.when(F.col("mean") > 0, F.col("mean")).alias("mean"))
    return (
        per_table.select(F.explode(F.array(own, all_)).alias("s")).select("s.*")
        .groupBy("source").agg(F.round(F.avg("mean"), 6).alias("mean"))
        .withColumn("answer", F.when(
            F.col("source") == "(all)", F.concat(F.lit("Average across all files: "), money(F.col("mean"))),
        ).otherwise(F.concat(F.lit("• "), F.col("source"), F.lit(": "), money(F.col("mean")), F.lit(" average"))))
    )


def dataset_overview(tables: Tables) -> DataFrame:
    """Rows, columns and amount figures per table and in total."""
    sizes = constant_rows(next(iter(tables.values()))[0].sparkSession, [(n, len(df.columns)) for n, (df, _) in tables.items()], "source string, columns int")
    per_table = sizes.join(
        tagged_amounts(tables).groupBy("source").agg(
            F.count("*").alias("rows"), F.sum("amount").alias("total"), F.count("amount").alias("amounts"),
            F.min("amount").alias("lowest"), F.max("amount").alias("highest")),
        "source", "left")
    both = F.explode(F.array(F.col("source"), F.lit("(all)")))
    summed = per_table.withColumn("source", both).groupBy("source").agg(
        F.count("*").alias("tables"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.sum("columns").alias("columns"),
        F.round(F.sum("total"), 2).alias("total"),
        F.round(F.try_divide(F.sum("total"), F.sum("amounts").cast("double")), 6).alias("average"),
        F.min("lowest").alias("lowest"), F.max("highest").alias("highest"),
    )
    overall = F.concat_ws(
        "\n", F.lit("Dataset Overview:"),
        F.concat(F.lit("• Total files: "), F.col("tables").cast("string")),
        F.concat(F.lit("• Total transactions: "), grouped_number(F.col("rows"))),
        F.concat(F.lit("• Total amount: "), money(F.col("total"))))
    own = F.concat(
        F.lit("• "), F.col("source"), F.lit(": "), grouped_number(F.col("rows")), F.lit(" rows"),
        F.when(F.col("total").isNotNull(), F.concat(F.lit(", "), money(F.col("total")), F.lit(" total"))).otherwise(""))
    return summed.withColumn("answer", F.when(F.col("source") == "(all)", overall).otherwise(own)).drop("tables")


def issue_rollup(issues: DataFrame, type_column: str = "type") -> DataFrame:
    """Issues counted by type."""
    return issues.groupBy(col(type_column).alias("type")).agg(F.count("*").alias("issues"))


def response_stats(
    responses: DataFrame, success: str = "success", time_ms: str = "response_time_ms",
    score: str = "confidence_score", provider: str = "provider",
) -> DataFrame:
    """Number of responses and successes, mean time, provider of the best success."""
    good = col(success) & col(score).isNotNull()
    best = F.min(F.when(good, F.struct((-col(score)).alias("s"), col(provider).alias("p"))))
    return responses.agg(
        F.count("*").alias("responses"),
        F.countDistinct(col(provider)).alias("providers"),
        F.count_if(col(success)).alias("successful"),
        F.round(F.avg(col(time_ms)), 6).alias("average_time_ms"),
        best["p"].alias("best_provider"),
    )
