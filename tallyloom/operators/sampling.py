"""First rows, random rows, and rows in time order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.scalars import col, columns_of
from tallyloom.operators.clean import count_non_dates, date_named


def head_sample(df: DataFrame, order: list[str], n: int = 10) -> DataFrame:
    """The first ``n`` rows in the given order."""
    return df.orderBy(*[col(o) for o in order]).limit(n)


def random_sample(df: DataFrame, key: list[str], n: int = 10_000, seed: int = 42) -> DataFrame:
    """``n`` rows in the order of a seeded hash of the key; all rows of a smaller table.

    The same rows come back for the same seed, whatever the partitioning.
    Each task keeps at most ``n`` rows.
    """
    shuffled = F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(k).cast("string") for k in key]))
    return df.orderBy(shuffled, *[col(k) for k in key]).limit(n)


def find_date_column(df: DataFrame) -> str | None:
    """First timestamp column, else the first date-named text column that parses throughout."""
    stamps = columns_of(df, "timestamp")
    if stamps:
        return stamps[0]
    named = date_named(df, ("date", "time"))
    bad = count_non_dates(df, named)
    return next((n for n in named if bad[n] == 0), None)


def time_series(df: DataFrame, value: str, date: str | None = None) -> DataFrame:
    """(date, value) ordered by date; rows without a date are left out."""
    date = date or find_date_column(df)
    if date is None:
        raise ValueError("no date column found")
    stamp = col(date) if date in columns_of(df, "timestamp") else F.try_to_timestamp(col(date))
    return df.select(stamp.alias("date"), col(value).alias("value")).where("date is not null").orderBy("date", "value")
