"""Compare two tables by amount, key or category.

Matching and missing rows are only counted and summed, so both sides are
grouped by the match key in one shuffle ("key tally") and no row-to-row join
is needed. Equal keys collapse before the shuffle: a key that holds a third
of all rows costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.scalars import col, grouped_number, money, share, to_number


def amount_key(amount: Column) -> Column:
    """Amounts match when they agree to the cent."""
    return F.round(to_number(amount), 2)


def key_tally(
    a: DataFrame, key_a: Column, b: DataFrame, key_b: Column,
    amount_a: Column | None = None, amount_b: Column | None = None,
) -> DataFrame:
    """One row per distinct key: rows and amount sums on either side."""
    none = F.lit(None).cast("double")
    left = a.select(
        key_a.alias("key"), F.lit(1).alias("in_a"), F.lit(0).alias("in_b"),
        (to_number(amount_a) if amount_a is not None else none).alias("amount_a"), none.alias("amount_b"))
    right = b.select(
        key_b.alias("key"), F.lit(0).alias("in_a"), F.lit(1).alias("in_b"),
        none.alias("amount_a"), (to_number(amount_b) if amount_b is not None else none).alias("amount_b"))
    return left.unionByName(right).groupBy("key").agg(
        F.sum("in_a").alias("rows_a"), F.sum("in_b").alias("rows_b"),
        F.sum("amount_a").alias("sum_a"), F.sum("amount_b").alias("sum_b"),
    )


def _matched() -> Column:
    """Key on both sides; a NULL key never matches."""
    return F.col("key").isNotNull() & (F.col("rows_a") > 0) & (F.col("rows_b") > 0)


def _missing() -> Column:
    return (F.col("rows_a") > 0) & ~_matched()


def _count_and_sum(tally: DataFrame, chosen: Column, prefix: str) -> DataFrame:
    return tally.agg(
        F.coalesce(F.sum(F.when(chosen, F.col("rows_a"))), F.lit(0)).alias(f"{prefix}_count"),
        F.round(F.coalesce(F.sum(F.when(chosen, F.col("sum_a"))), F.lit(0.0)), 2).alias(f"{prefix}_amount"),
    )


def _amount_tally(a, b, amount_a, amount_b):
    return key_tally(
        a, amount_key(col(amount_a)), b, amount_key(col(amount_b)), col(amount_a), col(amount_b))


def match_by_amount(a: DataFrame, b: DataFrame, amount_a: str, amount_b: str) -> DataFrame:
    """Rows of A whose amount occurs in B: count and sum."""
    return _count_and_sum(_amount_tally(a, b, amount_a, amount_b), _matched(), "common")


def missing_by_amount(a: DataFrame, b: DataFrame, amount_a: str, amount_b: str) -> DataFrame:
    """Rows of A whose amount does not occur in B: count and sum."""
    return _count_and_sum(_amount_tally(a, b, amount_a, amount_b), _missing(), "missing")


def missing_by_key(a: DataFrame, b: DataFrame, key_a: str, key_b: str, amount_a: str) -> DataFrame:
    """Rows of A whose key does not occur in B: count and sum."""
    tally = key_tally(a, col(key_a), b, col(key_b), col(amount_a))
    return _count_and_sum(tally, _missing(), "missing")


def missing_rows(a: DataFrame, b: DataFrame, key_a: Column, key_b: Column) -> DataFrame:
    """The rows of A themselves. Rows with a NULL key are missing as well."""
    keys = b.select(key_b.alias("_key")).where("_key is not null").distinct()
    keyed = a.withColumn("_key", key_a)
    missing = keyed.where("_key is not null").join(keys, "_key", "left_anti")
    return missing.unionByName(keyed.where("_key is null")).drop("_key")  # NULL keys skip the shuffle


def matching_rows(a: DataFrame, b: DataFrame, key_a: Column, key_b: Column) -> DataFrame:
    keys = b.select(key_b.alias("_key")).where("_key is not null").distinct()
    return a.withColumn("_key", key_a).join(keys, "_key", "left_semi").drop("_key")


def match_with_tolerance(
    a: DataFrame, b: DataFrame, amount_a: str, amount_b: str,
    tolerance_units: int = 1, units_per_one: int = 100,
) -> DataFrame:
    """Rows of A with an amount of B within the tolerance: count and sum.

    Amounts are counted in whole units (cents by default), so "within one
    cent" is exact. Buckets are as wide as the tolerance. Any value of B in
    the same bucket matches, in the bucket below only the largest can be
    nearest, above only the smallest. Lowest and highest value per bucket are
    therefore enough: no pairs are formed, however full a bucket is.
    """
    width = max(1, tolerance_units)

    def in_units(name):
        return F.round(to_number(col(name)) * units_per_one).cast("bigint")

    left = (
        a.select(in_units(amount_a).alias("units"), to_number(col(amount_a)).alias("amount"))
        .where("units is not null")
        .groupBy("units").agg(F.count("*").alias("rows"), F.sum("amount").alias("amount"))
        .withColumn("bucket", F.floor(F.col("units") / width))
    )
    buckets = (
        b.select(in_units(amount_b).alias("units")).where("units is not null")
        .groupBy(F.floor(F.col("units") / width).alias("bucket"))
        .agg(F.min("units").alias("low"), F.max("units").alias("high"))
        .select(
            F.explode(F.array(
                F.struct((F.col("bucket") - 1).alias("bucket"), F.col("low").alias("nearest_low"), F.col("low").alias("nearest_high")),
                F.struct(F.col("bucket").alias("bucket"), F.col("low").alias("nearest_low"), F.col("high").alias("nearest_high")),
                F.struct((F.col("bucket") + 1).alias("bucket"), F.col("high").alias("nearest_low"), F.col("high").alias("nearest_high")),
            )).alias("s"))
        .select("s.*")
    )
    near = (
        (F.abs(F.col("units") - F.col("nearest_low")) <= tolerance_units)
        | (F.abs(F.col("units") - F.col("nearest_high")) <= tolerance_units)
        | F.col("units").between(F.col("nearest_low"), F.col("nearest_high"))
    )
    return (
        left.join(buckets, "bucket").where(near)
        .groupBy("units").agg(F.first("rows").alias("rows"), F.first("amount").alias("amount"))
        .agg(
            F.coalesce(F.sum("rows"), F.lit(0)).alias("common_count"),
            F.round(F.coalesce(F.sum("amount"), F.lit(0.0)), 2).alias("common_amount"),
        )
    )


def inclusion_ratio(a: DataFrame, b: DataFrame, column_a: str, column_b: str) -> DataFrame:
    """Share of the rows of A whose value occurs in B, and whether any does."""
    tally = key_tally(a, col(column_a), b, col(column_b))
    found = F.coalesce(F.sum(F.when(_matched(), F.col("rows_a"))), F.lit(0))
    return tally.agg(
        F.sum("rows_a").alias("rows"), found.alias("found"),
    ).select(
        "rows", "found", share(F.col("found"), F.col("rows")).alias("ratio"),
        (F.col("found") > 0).alias("any_overlap"),
    )


def subset_check(a: DataFrame, b: DataFrame, column_a: str, column_b: str) -> DataFrame:
    """Is every value of B.y a value of A.x? With the number of values that are not."""
    tally = key_tally(a, col(column_a), b, col(column_b)).where("key is not null and rows_b > 0")
    return tally.agg(
        F.count("*").alias("values_b"),
        F.count_if(F.col("rows_a") == 0).alias("not_in_a"),
    ).withColumn("is_subset", F.col("not_in_a") == 0)


def compare_categories(a: DataFrame, b: DataFrame, column_a: str, column_b: str | None = None) -> DataFrame:
    """Row counts per value on both sides, 0 where a value is absent."""
    tally = key_tally(a, col(column_a), b, col(column_b or column_a)).where("key is not null")
    return tally.select(F.col("key").alias("category"), F.col("rows_a").alias("count_a"), F.col("rows_b").alias("count_b"))


def common_amounts(a: DataFrame, b: DataFrame, amount_a: str, amount_b: str) -> DataFrame:
    """Distinct amounts found on both sides."""
    return _key_sets(a, b, amount_a, amount_b).where(_matched()).select(F.col("key").alias("amount"))


def amounts_only_in_a(a: DataFrame, b: DataFrame, amount_a: str, amount_b: str) -> DataFrame:
    """Distinct amounts of A that B does not have."""
    sets = _key_sets(a, b, amount_a, amount_b)
    return sets.where("key is not null and rows_a > 0 and rows_b = 0").select(F.col("key").alias("amount"))


def _key_sets(a, b, amount_a, amount_b):
    return key_tally(a, amount_key(col(amount_a)), b, amount_key(col(amount_b)))


def category_universe(a: DataFrame, b: DataFrame, column_a: str, column_b: str) -> DataFrame:
    """All distinct values of the two columns."""
    values = a.select(col(column_a).alias("category")).unionByName(b.select(col(column_b).alias("category")))
    return values.where("category is not null").distinct()


def compare_tables(
    a: DataFrame, b: DataFrame, amount_a: str, amount_b: str, name_a: str = "A", name_b: str = "B",
) -> DataFrame:
    """Counts, sums and differences of two tables, matches, and the answer as text.

    All figures come from one key tally: one scan of each table, one shuffle.
    """
    tally = _amount_tally(a, b, amount_a, amount_b)

    def total(expr, empty):
        return F.coalesce(F.sum(expr), F.lit(empty))

    figures = tally.agg(
        total(F.col("rows_a"), 0).alias("count_a"), F.round(total(F.col("sum_a"), 0.0), 2).alias("total_a"),
        total(F.col("rows_b"), 0).alias("count_b"), F.round(total(F.col("sum_b"), 0.0), 2).alias("total_b"),
        total(F.when(_matched(), F.col("rows_a")), 0).alias("common_count"),
        F.round(total(F.when(_matched(), F.col("sum_a")), 0.0), 2).alias("common_amount"),
        total(F.when(_missing(), F.col("rows_a")), 0).alias("missing_count"),
        F.round(total(F.when(_missing(), F.col("sum_a")), 0.0), 2).alias("missing_amount"),
    )
    figures = figures.withColumns({
        "count_difference": F.abs(F.col("count_a") - F.col("count_b")),
        "amount_difference": F.round(F.abs(F.col("total_a") - F.col("total_b")), 2),
    })

    def side(name, count, amount):
        return F.concat(F.lit(f"• {name}: "), grouped_number(F.col(count)), F.lit(" transactions, "), money(F.col(amount)))

    lines = [
        F.lit("Direct comparison results:"),
        side(name_a, "count_a", "total_a"),
        side(name_b, "count_b", "total_b"),
        side("Difference", "count_difference", "amount_difference"),
        F.concat(F.lit("• Common transactions: "), F.col("common_count").cast("string"), F.lit(" found")),
        F.when(F.col("missing_count") > 0, F.concat(
            F.lit(f"• Missing from {name_b}: "), F.col("missing_count").cast("string"),
            F.lit(" transactions, "), money(F.col("missing_amount")))),
    ]
    return figures.withColumn("answer", F.concat_ws("\n", *lines))
