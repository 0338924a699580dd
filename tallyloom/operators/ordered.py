"""Ordered operations per group that survive a group of any size.

A window partitioned by group runs each group in one task. That is fine while
no group is larger than ``max_rows``. If one is, rows are range-partitioned by
(group, order), so a big group spreads over many tasks; the windows run inside
each range and only one summary row per group and range is carried over.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.scalars import col, null_safe_join
from tallyloom.session import cut_lineage

MAX_ROWS = 2_000_000
_SEG = "_segment"


def with_segments(df: DataFrame, group: list[str], order: list[str], max_rows: int = MAX_ROWS) -> tuple[DataFrame, bool]:
    """Add a segment number: 0 everywhere while all groups are small, else the range partition."""
    if group:
        largest = df.groupBy(*[col(g) for g in group]).count().agg(F.max("count")).first()[0] or 0
    else:
        largest = df.count()
    if largest <= max_rows:
        return df.withColumn(_SEG, F.lit(0)), False
    parts = -(-df.count() // max_rows) * 2
    ranged = df.repartitionByRange(parts, *[col(c) for c in group + order]).withColumn(_SEG, F.spark_partition_id())
    # Range bounds are sampled, so the assignment is fixed once and for all.
    return cut_lineage(ranged), True


def _within(group: list[str], order: list[str]):
    return Window.partitionBy(*[col(g) for g in group], F.col(_SEG)).orderBy(*[col(o) for o in order])


def _segments_of(group: list[str]):
    return Window.partitionBy(*[col(g) for g in group]).orderBy(_SEG)


def _join_back(df: DataFrame, summary: DataFrame, group: list[str]) -> DataFrame:
    return null_safe_join(df, summary, [*group, _SEG])


def with_row_number(df: DataFrame, group: list[str], order: list[str], name: str = "row_no", max_rows: int = MAX_ROWS) -> DataFrame:
    """1-based position in the group; ``order`` must be a total order. No group means the whole table."""
    segmented, split = with_segments(df, group, order, max_rows)
    numbered = segmented.withColumn(name, F.row_number().over(_within(group, order)).cast("bigint"))
    if split:
        before = _segments_of(group).rowsBetween(Window.unboundedPreceding, -1)
        offsets = (
            segmented.groupBy(*[col(g) for g in group], F.col(_SEG)).agg(F.count("*").alias("_n"))
            .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
        )
        numbered = _join_back(numbered, offsets, group).withColumn(name, F.col(name) + F.col("_before")).drop("_before")
    return numbered.drop(_SEG)


def with_previous(df: DataFrame, group: list[str], order: list[str], previous: Mapping[str, Column], max_rows: int = MAX_ROWS) -> DataFrame:
    """Values of the row just before, in the group: ``previous`` maps new names to expressions."""
    segmented, split = with_segments(df, group, order, max_rows)
    within = _within(group, order)
    result = segmented.withColumns({n: F.lag(e).over(within) for n, e in previous.items()})
    if split:
        result = result.withColumn("_rn", F.row_number().over(within))
        lasts = (
            segmented.groupBy(*[col(g) for g in group], F.col(_SEG))
            .agg(F.max_by(F.struct(*[e.alias(n) for n, e in previous.items()]), F.struct(*[col(o) for o in order])).alias("_last"))
            .withColumn("_carry", F.lag("_last").over(_segments_of(group))).drop("_last")
        )
        result = _join_back(result, lasts, group).withColumns({
            n: F.when(F.col("_rn") == 1, F.col("_carry")[n]).otherwise(F.col(n)) for n in previous
        }).drop("_carry", "_rn")
    return result.drop(_SEG)


def with_last_known(df: DataFrame, group: list[str], order: list[str], known: Mapping[str, Column], max_rows: int = MAX_ROWS) -> DataFrame:
    """Latest non-null value so far, this row included: ``known`` maps new names to expressions."""
    segmented, split = with_segments(df, group, order, max_rows)
    running = _within(group, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    result = segmented.withColumns({n: F.last(e, ignorenulls=True).over(running) for n, e in known.items()})
    if split:
        position = F.struct(*[col(o) for o in order])
        lasts = segmented.groupBy(*[col(g) for g in group], F.col(_SEG)).agg(*[
            F.max_by(e, F.when(e.isNotNull(), position)).alias(f"_l_{n}") for n, e in known.items()
        ])
        before = _segments_of(group).rowsBetween(Window.unboundedPreceding, -1)
        carried = lasts.withColumns({
            f"_c_{n}": F.last(f"_l_{n}", ignorenulls=True).over(before) for n in known
        }).drop(*[f"_l_{n}" for n in known])
        result = _join_back(result, carried, group).withColumns({
            n: F.coalesce(F.col(n), F.col(f"_c_{n}")) for n in known
        }).drop(*[f"_c_{n}" for n in known])
    return result.drop(_SEG)


def first_per_group(df: DataFrame, group: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows per group. Each task passes on at most n rows per group."""
    window = Window.partitionBy(*[col(g) for g in group]).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") <= n).drop("_rn")
