"""Column and table statistics over the full data.

Most figures come from one wide aggregate turned into one row per column,
the survey, which also sketches ranks and distinct counts. A second scan
places the exact quantiles, a third one counts values through 16-byte digests,
one shuffle for all columns together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from itertools import combinations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tallyloom.functions import fixed_values as fixed
from tallyloom.functions.scalars import (
    col, columns_of, constant_rows, hashable, kinds, numeric_columns, row_digest, share, text_columns,
    value_digest,
)
from tallyloom.operators.gram import correlations
from tallyloom.operators.quantiles import ACCURACY, exact_quantiles, placed_quantiles, rank_measures, with_points

# Aggregates per pass; beyond this a wide table takes several passes.
WIDE_LIMIT = 600
# Relative deviation of the sketched distinct counts.
DISTINCT_DEVIATION = 0.01
# Texts up to here are shuffled to find the most frequent one.
SHORT = 100


def per_column(df: DataFrame, columns: Iterable[str], measures: Mapping[str, Callable[[str], Column]]) -> DataFrame:
    """One row per column with the given aggregates, computed in one pass."""
    columns = list(columns)
    step = max(1, WIDE_LIMIT // max(1, len(measures)))
    parts = []
    for start in range(0, len(columns), step):
        batch = columns[start:start + step]
        wide = df.agg(*[
            measure(c).alias(f"{label}__{i}") for i, c in enumerate(batch) for label, measure in measures.items()
        ])
        rows = F.array(*[
            F.struct(F.lit(c).alias("column"), *[F.col(f"{label}__{i}").alias(label) for label in measures])
            for i, c in enumerate(batch)
        ])
        parts.append(wide.select(F.inline(rows)))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def constants_per_column(df: DataFrame, values: Mapping[str, Mapping[str, object]], schema: str) -> DataFrame:
    """A small frame from driver-side facts, one row per column name."""
    return constant_rows(df.sparkSession, [(c, *v.values()) for c, v in values.items()], schema)


def survey(
    df: DataFrame, columns: Iterable[str], measures: Mapping[str, Callable[[str], Column]], numeric: Iterable[str] = (),
    probabilities: Iterable[float] = (0.5,), accuracy: int = ACCURACY,
) -> dict[str, Row]:
    """The first scan: per column the measures and, for the numeric ones, where their quantiles lie."""
    wide = per_column(df, columns, {**measures, **rank_measures(numeric, accuracy)})
    return {r["column"]: r for r in with_points(wide, list(probabilities), accuracy).collect()}  # one row per column


def value_tally(df: DataFrame, marks: Mapping[str, Column | None], rows: bool = False) -> DataFrame:
    """(i, mark, n) per distinct non-null value of the i-th column: one scan and one shuffle for all columns.

    ``mark`` is something that follows from the value, such as its text. With ``rows`` whole rows are values too, of
    number -1.
    """
    none = F.lit(None).cast("string")
    cells = [
        F.when(col(c).isNotNull(), F.struct(F.lit(i).alias("i"), *value_digest(df, c), (none if mark is None else mark.cast("string")).alias("mark")))
        for i, (c, mark) in enumerate(marks.items())]
    if rows:
        cells.append(F.struct(F.lit(-1).alias("i"), *row_digest([hashable(df, c) for c in df.columns]), none.alias("mark")))
    if not cells:
        return constant_rows(df.sparkSession, [], "i int, mark string, n bigint")
    found = df.select(F.inline(F.array_compact(F.array(*cells)))).where("i is not null")
    return found.groupBy("i", "_h1", "_h2", "mark").agg(F.count("*").alias("n")).select("i", "mark", "n")


def tally_figures(tally: DataFrame, k: int) -> DataFrame:
    """(i, unique, values, top): distinct values, their rows, and the ``k`` most frequent marks as (rank, value, rows), equal ones by value.

    Both halves use the whole tally, so they share its scan and shuffle.
    """
    order = Window.partitionBy("i").orderBy(F.col("mark").isNull(), F.desc("n"), "mark")
    best = tally.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    marked = F.when(F.col("mark").isNotNull(), F.struct("rank", F.col("mark").alias("value"), F.col("n").alias("rows")))
    tops = best.groupBy("i").agg(F.sort_array(F.collect_list(marked)).alias("top"))
    return tally.groupBy("i").agg(F.count("*").alias("unique"), F.sum("n").alias("values")).join(tops, "i")


def distinct_counts(df: DataFrame, columns: Iterable[str], approx: bool = False) -> DataFrame:
    """(column, unique_count) of non-null values.

    Exact: one shuffle of value digests for all columns together. ``approx``:
    sketches in one pass without a shuffle, for tables where every value of
    many columns is different.
    """
    columns = list(columns)
    if approx:
        return per_column(df, columns, {"unique_count": lambda c: F.approx_count_distinct(hashable(df, c), 0.01)})
    cells = F.array(*[
        F.when(col(c).isNotNull(), F.struct(F.lit(i).alias("i"), *value_digest(df, c)))
        for i, c in enumerate(columns)
    ])
    counted = (
        df.select(F.explode(cells).alias("v")).where("v is not null").select("v.*").distinct()
        .groupBy("i").agg(F.count("*").alias("unique_count"))
    )
    names = constant_rows(df.sparkSession, list(enumerate(columns)), "i int, column string")
    return names.join(counted, "i", "left").select(
        "column", F.coalesce("unique_count", F.lit(0)).alias("unique_count"))


def value_frequencies(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """(column, value as text, rows) of non-null values."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.inline(cells)).where("value is not null").groupBy("column", "value").agg(F.count("*").alias("rows"))


def top_values(df: DataFrame, columns: Iterable[str], k: int) -> DataFrame:
    """The k most frequent values per column; ties go to the smaller value.

    The rank filter is applied before the shuffle as well (group limit), so at
    most k rows per task and column travel.
    """
    order = Window.partitionBy("column").orderBy(F.desc("rows"), F.asc("value"))
    return value_frequencies(df, columns).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def most_frequent(df: DataFrame, columns: Iterable[str], short: int = 100) -> DataFrame:
    """(column, top_value, top_count): the smallest of the most frequent values as text.

    Columns of short values are counted by value, the others by digest.
    """
    columns = list(columns)
    longest = dict(zip(columns, df.agg(*[F.max(F.length(col(c).cast("string"))).alias(f"n{i}") for i, c in enumerate(columns)]).first()))
    by_value = [c for c in columns if (longest[c] or 0) <= short]
    by_digest = [c for c in columns if c not in by_value]
    parts = []
    if by_value:
        names = constant_rows(df.sparkSession, [(c,) for c in by_value], "column string")
        top = top_values(df, by_value, 1).select("column", F.col("value").alias("top_value"), F.col("rows").alias("top_count"))
        parts.append(names.join(top, "column", "left"))
    if by_digest:
        parts.append(_most_frequent_long(df, by_digest))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _most_frequent_long(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count digests; look up again only the values with the highest count."""
    cells = df.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("i"), *value_digest(df, c), col(c).cast("string").alias("value"))
        for i, c in enumerate(columns)
    ]))).where("value is not null")
    counts = cells.groupBy("i", "_h1", "_h2").agg(F.count("*").alias("n"))
    highest = {r["i"]: r["n"] for r in counts.groupBy("i").agg(F.max("n").alias("n")).collect()}  # one row per column
    facts = constant_rows(df.sparkSession, [(i, c, highest.get(i)) for i, c in enumerate(columns)], "i int, column string, top_count bigint")
    repeated = [i for i, n in highest.items() if n > 1]
    # Where no value repeats, all are equally frequent and the smallest one wins.
    smallest = cells.where(~F.col("i").isin(repeated)).groupBy("i").agg(F.min("value").alias("top_value"))
    if repeated:
        is_top = F.lit(False)
        for i in repeated:
            is_top = is_top | ((F.col("i") == i) & (F.col("n") == highest[i]))
        winners = cells.where(F.col("i").isin(repeated)).join(counts.where(is_top), ["i", "_h1", "_h2"], "left_semi")
        smallest = smallest.unionByName(winners.groupBy("i").agg(F.min("value").alias("top_value")))
    return facts.join(smallest, "i", "left").select("column", "top_value", F.col("top_count"))


def type_names(df: DataFrame) -> dict[str, str]:
    names = {"integer": "int64", "decimal": "float64", "text": "object", "boolean": "bool",
             "timestamp": "datetime64[ns]", "other": "object"}
    return {c: names[k] for c, k in kinds(df).items()}


def column_statistics(df: DataFrame, columns: Iterable[str] | None = None, approx_distinct: bool = False) -> DataFrame:
    """Type, counts, numeric statistics and top-5 shares of every column.

    Top values are looked for only in columns that turn out categorical, so
    long or unique texts are never shuffled.
    """
    columns = list(columns or df.columns)
    numeric = [c for c in numeric_columns(df) if c in columns]
    text = [c for c in text_columns(df) if c in columns]
    types = type_names(df)

    def number(c, agg):
        return agg(col(c).cast("double")) if c in numeric else F.lit(None).cast("double")

    found = survey(df, columns, {
        "row_count": lambda c: F.count(F.lit(1)),
        "count": lambda c: F.count(col(c)),
        "min": lambda c: number(c, F.min),
        "max": lambda c: number(c, F.max),
        "mean": lambda c: number(c, F.avg),
        "std": lambda c: number(c, F.stddev_samp),
        "sum": lambda c: number(c, F.sum),
        "distinct": lambda c: F.approx_count_distinct(hashable(df, c), DISTINCT_DEVIATION),
    }, numeric)
    medians = placed_quantiles(df, {c: found[c] for c in numeric}, [0.5])
    # The sketch is within a few percent, so a column beyond the margin can't be categorical.
    margin = 1 + 10 * DISTINCT_DEVIATION
    likely = [c for c in text if found[c]["distinct"] < found[c]["row_count"] * fixed.CATEGORICAL_RATIO * margin]
    facts = constant_rows(df.sparkSession, [(
        i, c, types[c], *[r[k] for k in ("row_count", "count", "min", "max", "mean", "std", "sum", "distinct")], medians.get(c, [None])[0], c in text, c in likely)
        for i, c in enumerate(columns) for r in [found[c]]],
        "i int, column string, type string, row_count bigint, count bigint, min double, max double, mean double, std double, sum double, "
        "distinct bigint, median double, is_text boolean, is_likely boolean")
    tally = value_tally(df, {c: col(c) if c in likely else None for c in columns if c in likely or not approx_distinct})
    if approx_distinct:  # only the likely columns are tallied, so they are numbered anew
        tally = tally.replace({i: columns.index(c) for i, c in enumerate(c for c in columns if c in likely)}, subset=["i"]) if likely else tally
    unique = F.col("distinct") if approx_distinct else F.coalesce("unique", F.lit(0))
    missing = F.col("row_count") - F.col("count")
    ratio = share(F.col("unique_count"), F.col("row_count"))
    shares = F.array_join(F.transform("top", lambda t: F.concat(t["value"], F.lit("="), F.format_number(t["rows"] / F.col("values"), 4))), "|")
    categorical = F.coalesce(ratio < fixed.CATEGORICAL_RATIO, F.lit(False))
    return facts.join(tally_figures(tally, 5), "i", "left").withColumn("unique_count", unique).select(
        "column", "type", "row_count", "count", missing.alias("missing_count"),
        F.round(F.coalesce(share(missing, F.col("row_count")), F.lit(0.0)), 6).alias("missing_ratio"),
        "unique_count", F.round(F.coalesce(ratio, F.lit(0.0)), 6).alias("unique_ratio"),
        "min", "max", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), F.round("std", 6).alias("std"), F.round("sum", 2).alias("sum"),
        F.when(F.col("is_text"), categorical).alias("appears_categorical"),
        F.when(F.col("is_text") & categorical, shares).alias("top_categories"))


def quartile_bounds(quartiles: Mapping[str, list[float | None]]) -> dict[str, dict[str, float | None]]:
    """The quartiles by name, with the bounds beyond which values are outliers."""
    result = {}
    for c, (q1, median, q3) in quartiles.items():
        width = None if q1 is None else (q3 - q1) * fixed.IQR_FACTOR
        result[c] = {
            "q1": q1, "median": median, "q3": q3,
            "low": None if q1 is None else q1 - width, "high": None if q1 is None else q3 + width,
        }
    return result


def outside(value: Column, bounds: Mapping[str, float | None]) -> Column:
    if bounds["low"] is None:
        return F.lit(False)
    return (value < bounds["low"]) | (value > bounds["high"])


QUARTILES = [0.25, 0.5, 0.75]


def _numeric_summary(df: DataFrame, columns: list[str], accuracy: int) -> tuple[DataFrame, dict[str, dict[str, float | None]]]:
    """Spread and quartiles per column, and the outlier bounds: two scans."""
    found = survey(df, columns, {
        "missing_count": lambda c: F.count_if(col(c).isNull()),
        "count": lambda c: F.count(col(c)),
        "min": lambda c: F.min(col(c).cast("double")),
        "max": lambda c: F.max(col(c).cast("double")),
        "mean": lambda c: F.avg(col(c)).cast("double"),
        "std": lambda c: F.stddev_samp(col(c)),
    }, columns, QUARTILES, accuracy)
    bounds = quartile_bounds(placed_quantiles(df, {c: found[c] for c in columns}, QUARTILES, accuracy))
    facts = constant_rows(df.sparkSession, [(
        c, *[found[c][k] for k in ("missing_count", "count", "min", "max", "mean", "std")], *[bounds[c][k] for k in ("q1", "median", "q3")]) for c in columns],
        "column string, missing_count bigint, count bigint, min double, max double, mean double, std double, q1 double, median double, q3 double")
    return facts.withColumns({k: F.round(k, 6) for k in ("mean", "std", "q1", "median", "q3")}), bounds


def profile_numeric(df: DataFrame, columns: Iterable[str] | None = None, accuracy: int = ACCURACY) -> DataFrame:
    """Spread, quartiles and IQR outliers of the numeric columns."""
    columns = list(columns or numeric_columns(df))
    facts, bounds = _numeric_summary(df, columns, accuracy)
    outliers = per_column(df, columns, {"outlier_count": lambda c: F.count_if(outside(col(c), bounds[c]))})
    return facts.join(outliers, "column").select(
        "column", "missing_count", "count", "min", "max", "mean", "std", "outlier_count", "q1", "median", "q3",
        F.round(share(F.col("outlier_count") * 100, F.col("count")), 6).alias("outlier_percentage"))


def profile_string(df: DataFrame, columns: Iterable[str] | None = None, top_below: int = 100) -> DataFrame:
    """Lengths, distinct values and, for few distinct values, the top-10 shares."""
    columns = list(columns or text_columns(df))
    unique = {r["column"]: r["unique_count"] for r in distinct_counts(df, columns).collect()}  # one row per column
    few = [c for c in columns if unique[c] < top_below]
    facts = constants_per_column(df, {c: {"u": unique[c]} for c in columns}, "column string, unique_count bigint")
    stats = per_column(df, columns, {
        "missing_count": lambda c: F.count_if(col(c).isNull()),
        "count": lambda c: F.count(col(c)),
        "min_length": lambda c: F.min(F.length(col(c))),
        "max_length": lambda c: F.max(F.length(col(c))),
        "avg_length": lambda c: F.round(F.avg(F.length(col(c))), 6),
    }).join(facts, "column").withColumn(
        "unique_percentage", F.round(share(F.col("unique_count") * 100, F.col("count")), 6))
    if not few:
        return stats.withColumn("top_values", F.lit(None).cast("string"))
    tops = (
        top_values(df, few, 10).groupBy("column")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "value", "rows"))).alias("top"))
    )
    listed = F.array_join(F.transform("top", lambda t: F.concat(
        t["value"], F.lit("="), F.format_number(t["rows"] * 100 / F.col("count"), 4))), "|")
    return stats.join(tops, "column", "left").withColumn("top_values", listed).drop("top")


def profile_datetime(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """First, last, range in days, weekend dates and month shares."""
    columns = list(columns or columns_of(df, "timestamp"))

    def seconds(value):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), value) / 1_000_000

    measures = {
        "missing_count": lambda c: F.count_if(col(c).isNull()),
        "count": lambda c: F.count(col(c)),
        "first": lambda c: F.min(col(c).cast("timestamp_ntz")),
        "last": lambda c: F.max(col(c).cast("timestamp_ntz")),
        "has_weekend_dates": lambda c: F.coalesce(F.max(F.weekday(col(c)) >= 5), F.lit(False)),
    }
    for m in range(1, 13):
        measures[f"m{m}"] = lambda c, m=m: F.count_if(F.month(col(c)) == m)
    stats = per_column(df, columns, measures)
    months = F.array_join(F.array_compact(F.array(*[
        F.when(F.col(f"m{m}") > 0, F.concat(
            F.lit(f"{m}="), F.format_number(F.col(f"m{m}") * 100 / F.col("count"), 4)))
        for m in range(1, 13)
    ])), "|")
    return stats.select(
        "column", "missing_count", "count", "first", "last",
        F.round((seconds(F.col("last")) - seconds(F.col("first"))) / 86400, 6).alias("range_days"),
        "has_weekend_dates", months.alias("month_shares"))


def null_report(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Nulls, percent and completeness per column and, as ``(table)``, for the table."""
    columns = list(columns or df.columns)
    stats = per_column(df, columns, {
        "rows": lambda c: F.count(F.lit(1)),
        "nulls": lambda c: F.count_if(col(c).isNull()),
    })
    both = F.explode(F.array(F.col("column"), F.lit("(table)")))
    return (
        stats.withColumn("column", both).groupBy("column").agg(F.sum("rows").alias("cells"), F.sum("nulls").alias("nulls"))
        .withColumns({
            "null_percent": F.round(F.coalesce(share(F.col("nulls") * 100, F.col("cells")), F.lit(0.0)), 6),
            "completeness": F.round(F.lit(1.0) - F.coalesce(share(F.col("nulls"), F.col("cells")), F.lit(0.0)), 6),
        })
    )


def duplicate_rows(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Rows that repeat an earlier row: number and percent. NULLs equal NULLs.

    Rows are grouped by digest, so the shuffle carries 16 bytes per distinct
    row and copies collapse before it.
    """
    columns = list(columns or df.columns)
    groups = df.select(*row_digest([hashable(df, c) for c in columns])).groupBy("_h1", "_h2").agg(F.count("*").alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("distinct_rows"),
    ).select(
        "rows", (F.col("rows") - F.col("distinct_rows")).alias("duplicates"),
        F.round(F.coalesce(
            share((F.col("rows") - F.col("distinct_rows")) * 100, F.col("rows")), F.lit(0.0)), 6).alias("duplicate_percent"))


def table_profile(df: DataFrame) -> DataFrame:
    """One row per column and one row ``(table)`` in long form: measure, number, text."""
    types = kinds(df)
    numeric, text = numeric_columns(df), text_columns(df)

    def number(c, agg):
        return agg(col(c).cast("double")) if c in numeric else F.lit(None).cast("double")

    found = survey(df, df.columns, {
        "rows": lambda c: F.count(F.lit(1)),
        "missing_pct": lambda c: F.avg(col(c).isNull().cast("double")) * 100,
        "mean": lambda c: number(c, F.avg),
        "std": lambda c: number(c, F.stddev_samp),
        "min": lambda c: number(c, F.min),
        "max": lambda c: number(c, F.max),
        "longest": lambda c: F.max(F.length(col(c))) if c in text else F.lit(None).cast("int"),
    }, numeric)
    medians = placed_quantiles(df, {c: found[c] for c in numeric}, [0.5])
    classes = {"integer": "numeric", "decimal": "numeric", "text": "categorical", "timestamp": "datetime",
               "boolean": "boolean", "other": "other"}
    long = [c for c in text if (found[c]["longest"] or 0) > SHORT]
    held = [found[c] for c in df.columns]
    rows, missing = (held[0]["rows"], [r["missing_pct"] for r in held if r["missing_pct"] is not None]) if held else (0, [])
    kinds_found = ",".join(f"{k}={sum(classes[types[c]] == k for c in df.columns)}" for k in ("numeric", "categorical", "datetime", "boolean", "other"))
    facts = [(
        text.index(c) if c in text else None, c, classes[types[c]], *[r[k] for k in ("rows", "missing_pct", "mean", "std", "min", "max")], medians.get(c, [None])[0])
        for c in df.columns for r in [found[c]]]
    facts.append((-1, "(table)", kinds_found, rows, sum(missing) / len(missing) if missing else None, None, None, None, None, None))
    stats = constant_rows(df.sparkSession, facts, (
        "i int, column string, class string, rows bigint, missing_pct double, mean double, std double, min double, max double, median double"))
    # One scan for the distinct and most frequent values of all text columns and for the copies of rows. Of columns
    # with long texts only digests are shuffled; their most frequent value is looked up again.
    figures = tally_figures(value_tally(df, {c: None if c in long else col(c) for c in text}, rows=True), 1)
    result = stats.join(figures, "i", "left").withColumns({"top_value": F.get("top", F.lit(0))["value"], "top_count": F.get("top", F.lit(0))["rows"]})
    if long:
        looked_up = _most_frequent_long(df, long).select("column", F.col("top_value").alias("long_value"), F.col("top_count").alias("long_count"))
        result = result.join(looked_up, "column", "left").withColumns({"top_value": F.coalesce("top_value", "long_value"), "top_count": F.coalesce("top_count", "long_count")})
    return result.select(
        "column", "class", "rows", F.round("missing_pct", 6).alias("missing_pct"), F.round("mean", 6).alias("mean"),
        F.round("median", 6).alias("median"), F.round("std", 6).alias("std"), "min", "max",
        F.when(F.col("i") >= 0, F.coalesce("unique", F.lit(0))).alias("unique_count"), "top_value", "top_count",
        F.when(F.col("i") == -1, F.round(F.coalesce(share((F.col("values") - F.col("unique")) * 100, F.col("values")), F.lit(0.0)), 6)).alias("duplicate_pct"))


def value_counts(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The k most frequent values with count and share of the non-null rows."""
    counts = df.where(col(column).isNotNull()).groupBy(col(column).alias("value")).agg(F.count("*").alias("rows"))
    total = df.agg(F.count(col(column))).scalar()
    return (
        counts.orderBy(F.desc("rows"), F.asc("value")).limit(k)
        .withColumn("share", F.round(share(F.col("rows"), total), 6))
    )


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width bins over the non-null values, with mean and median of the column."""
    value = col(column).cast("double")
    low, high, mean, rows = df.agg(F.min(value), F.max(value), F.avg(value), F.count(value)).first()
    if not rows:
        return constant_rows(df.sparkSession, [], "bin int, bin_start double, bin_end double, rows bigint, mean double, median double")
    median = exact_quantiles(df, [column], [0.5])[column][0]
    width = (high - low) / bins if high > low else 1.0
    index = F.least(F.floor((value - low) / width), F.lit(bins - 1)).cast("int")
    counts = df.where(value.isNotNull()).groupBy(index.alias("bin")).agg(F.count("*").alias("rows"))
    all_bins = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return all_bins.join(counts, "bin", "left").select(
        "bin",
        F.round(F.lit(low) + F.col("bin") * F.lit(width), 6).alias("bin_start"),
        F.round(F.lit(low) + (F.col("bin") + 1) * F.lit(width), 6).alias("bin_end"),
        F.coalesce("rows", F.lit(0)).alias("rows"),
        F.round(F.lit(mean), 6).alias("mean"), F.round(F.lit(median), 6).alias("median"))


def describe(df: DataFrame, columns: Iterable[str] | None = None, accuracy: int = ACCURACY) -> DataFrame:
    """count, mean, std, min, quartiles and max, exact."""
    facts, _ = _numeric_summary(df, list(columns or numeric_columns(df)), accuracy)
    return facts.select("column", "count", "mean", "std", "min", "q1", "median", "q3", "max")


def outlier_rows(df: DataFrame, column: str, accuracy: int = ACCURACY) -> DataFrame:
    """Rows outside the IQR bounds, with the bounds and the share of such rows."""
    bounds = quartile_bounds(exact_quantiles(df, [column], QUARTILES, accuracy=accuracy))[column]
    value = col(column)
    rows, out = df.agg(F.count(value), F.count_if(outside(value, bounds))).first()
    return df.where(outside(value, bounds)).withColumns({
        "lower_bound": F.round(F.lit(bounds["low"]).cast("double"), 6),
        "upper_bound": F.round(F.lit(bounds["high"]).cast("double"), 6),
        "outlier_percent": F.round(F.lit(100.0 * out / rows if rows else None).cast("double"), 6),
    })


def correlation_matrix(df: DataFrame, threshold: float = 0.0, columns: Iterable[str] | None = None) -> DataFrame:
    """Pearson correlation of all numeric pairs; NULL under the threshold and where a column is constant or not finite.

    The pairs of up to 16 columns are one aggregate of one scan. Wider tables go by blocks of columns
    (``gram``): two scans for up to 2,000 columns.
    """
    columns = list(columns or numeric_columns(df))
    if len(columns) * (len(columns) - 1) // 2 > WIDE_LIMIT // 5:  # five aggregates a pair
        r = F.round("r", 6)
        return correlations(df, columns).select("column_a", "column_b", F.when(F.abs(r) >= threshold, r).alias("correlation"))
    pairs = list(combinations(columns, 2))
    by_pair = {f"{i}": p for i, p in enumerate(pairs)}

    def known(i):
        x, y = by_pair[i]
        return [F.when(col(x).isNotNull() & col(y).isNotNull(), col(c).cast("double")) for c in (x, y)]

    def r_of(i):  # corr itself divides by 0 for a constant column, or by what rounding leaves of it
        x, y = known(i)
        varies = [F.stddev_pop(v) > F.abs(F.avg(v)) * 1e-13 for v in (x, y)]
        return F.when(varies[0] & varies[1], F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))

    measured = per_column(df, list(by_pair), {"r": r_of})
    names = constant_rows(df.sparkSession, [(i, a, b) for i, (a, b) in by_pair.items()], "column string, column_a string, column_b string")
    r = F.when(~F.isnan("r"), F.round("r", 6))
    return measured.join(names, "column").select(
        "column_a", "column_b", F.when(F.abs(r) >= threshold, r).alias("correlation"))


def high_correlation(df: DataFrame, above: float = 0.9) -> DataFrame:
    """Numeric pairs of the same type with a correlation beyond ``above``."""
    types = dict(df.dtypes)
    parts = []
    for data_type in sorted(set(types[c] for c in numeric_columns(df))):
        same = [c for c in numeric_columns(df) if types[c] == data_type]
        if len(same) > 1:
            parts.append(correlation_matrix(df, columns=same))
    if not parts:
        return constant_rows(df.sparkSession, [], "column_a string, column_b string, correlation double")
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.where(F.abs("correlation") > above)


def duplicate_columns(df: DataFrame) -> DataFrame:
    """Pairs of equal columns of the same type (NULL equals NULL).

    Each column's hashes, salted by all columns of their row, are summed up (24 bits each); only columns of equal sums are compared.
    """
    types = dict(df.dtypes)
    salt = F.xxhash64(*[hashable(df, c) for c in df.columns])
    known = per_column(df, df.columns, {
        "digest": lambda c: F.sum(F.shiftrightunsigned(F.xxhash64(salt, hashable(df, c), hashable(df, c).isNull()), 40))})
    digests = {r["column"]: r["digest"] for r in known.collect()}
    pairs = {f"{i}": p for i, p in enumerate(
        (x, y) for x, y in combinations(df.columns, 2) if types[x] == types[y] and digests.get(x) == digests.get(y))}
    if not pairs:
        return constant_rows(df.sparkSession, [], "column_a string, column_b string")
    measured = per_column(df, list(pairs), {
        "different": lambda i: F.count_if(~hashable(df, pairs[i][0]).eqNullSafe(hashable(df, pairs[i][1])))})
    names = constant_rows(df.sparkSession, [(i, a, b) for i, (a, b) in pairs.items()], "column string, column_a string, column_b string")
    return measured.where("different = 0").join(names, "column").select("column_a", "column_b")


def side_by_side(a: DataFrame, b: DataFrame, name_a: str = "A", name_b: str = "B") -> DataFrame:
    """Type, non-null, null and distinct counts of every column of two tables."""
    parts = []
    for name, df in ((name_a, a), (name_b, b)):
        types = constants_per_column(df, {c: {"t": t} for c, t in type_names(df).items()}, "column string, type string")
        stats = per_column(df, df.columns, {
            "non_null": lambda c: F.count(col(c)), "nulls": lambda c: F.count_if(col(c).isNull())})
        parts.append(
            stats.join(types, "column").join(distinct_counts(df, df.columns), "column")
            .select(F.lit(name).alias("table"), "column", "type", "non_null", "nulls", "unique_count"))
    return parts[0].unionByName(parts[1])
