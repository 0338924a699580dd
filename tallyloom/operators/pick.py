"""Find the amount column and the key column of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import fixed_values as fixed
from tallyloom.functions.scalars import col, columns_of, constant_rows, to_number


def amount_evidence(df: DataFrame) -> DataFrame:
    """Per column: how many values are numbers, and their mean. One pass."""
    usable = columns_of(df, "integer", "decimal", "text")
    if not usable:
        return constant_rows(df.sparkSession, [], "position int, column string, numbers bigint, mean double")
    aggs = []
    for i, name in enumerate(usable):
        number = to_number(col(name))
        aggs += [F.count(number).alias(f"n{i}"), F.avg(number).alias(f"m{i}")]
    rows = F.array(*[
        F.struct(
            F.lit(df.columns.index(n)).alias("position"), F.lit(n).alias("column"),
            F.col(f"n{i}").alias("numbers"), F.col(f"m{i}").alias("mean"),
        )
        for i, n in enumerate(usable)
    ])
    return df.agg(*aggs).select(F.inline(rows))


def rank_amount_columns(df: DataFrame) -> DataFrame:
    """Evidence with the step (1 listed name, 2 name part, 3 mean in range) that would pick it."""
    listed = F.array_position(F.array(*[F.lit(n) for n in fixed.AMOUNT_NAMES]), F.col("column"))
    hinted = F.lit(False)
    for word in fixed.AMOUNT_WORDS:
        hinted = hinted | F.lower("column").contains(word)
    has_numbers = F.col("numbers") > 0
    in_range = F.col("mean").between(fixed.AMOUNT_MEAN_LOW, fixed.AMOUNT_MEAN_HIGH)
    step = (
        F.when(has_numbers & (listed > 0), 1)
        .when(has_numbers & hinted, 2)
        .when(has_numbers & in_range, 3)
    )
    return (
        amount_evidence(df)
        .withColumn("step", step)
        .withColumn("order_in_step", F.when(step == 1, listed).otherwise(F.col("position").cast("bigint")))
    )


def find_amount_column(df: DataFrame) -> str | None:
    """The column holding the amounts, or None."""
    best = (
        rank_amount_columns(df).where(F.col("step").isNotNull())
        .orderBy("step", "order_in_step").select("column").first()
    )
    return best[0] if best else None


def find_id_column(df: DataFrame) -> str | None:
    """First listed key name, else the first column with ``id`` in its name."""
    for name in fixed.ID_NAMES:
        if name in df.columns:
            return name
    return next((n for n in df.columns if "id" in n.lower()), None)
