"""Quality scores, issue lists and cleaning advice."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import fixed_values as fixed
from tallyloom.functions.scalars import (
    col, constant_rows, hashable, is_digits, is_lower, is_title, is_upper, numeric_columns, share, text_columns,
)
from tallyloom.operators.clean import date_string_columns
from tallyloom.operators.profile import (
    DISTINCT_DEVIATION, QUARTILES, duplicate_rows, null_report, outside, per_column, quartile_bounds, survey, value_tally,
)
from tallyloom.operators.quantiles import ACCURACY, placed_quantiles


def severity(ratio: Column, medium: float, high: float) -> Column:
    return F.when(ratio > high, "high").when(ratio > medium, "medium").otherwise("low")


def mixed_types(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Text columns with digit-only and other values; flagged when the minority is over 5%."""
    columns = list(columns or text_columns(df))
    if not columns:
        return constant_rows(df.sparkSession, [], "column string, digit_values bigint, other_values bigint, minority_ratio double, is_mixed boolean")
    counts = per_column(df, columns, {
        "digit_values": lambda c: F.count_if(is_digits(col(c))),
        "other_values": lambda c: F.count_if(~is_digits(col(c))),
    })
    minority = share(F.least("digit_values", "other_values"), F.col("digit_values") + F.col("other_values"))
    return counts.withColumns({
        "minority_ratio": F.round(minority, 6),
        "is_mixed": F.coalesce(minority > fixed.SHARE_FLAG, F.lit(False)),
    })


def inconsistent_case(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Text columns where lower, upper and title case all occur."""
    columns = list(columns or text_columns(df))
    if not columns:
        return constant_rows(df.sparkSession, [], (
            "column string, any_lower boolean, any_upper boolean, any_title boolean, is_inconsistent boolean"))

    def seen(test):
        return lambda c: F.coalesce(F.max(test(col(c))), F.lit(False))

    flags = per_column(df, columns, {"any_lower": seen(is_lower), "any_upper": seen(is_upper), "any_title": seen(is_title)})
    return flags.withColumn("is_inconsistent", F.expr("any_lower and any_upper and any_title"))


def quality_scorecard(df: DataFrame, approx_distinct: bool = False, accuracy: int = ACCURACY) -> DataFrame:
    """Scores and issues in long form: (item, column, value, severity).

    ``score`` rows hold completeness, validity, uniqueness, consistency and
    their mean; ``issue`` rows the percentages over the cut-offs. Three scans:
    counts and sketches, quartiles, then distinct values and outliers.
    """
    numeric, text = numeric_columns(df), text_columns(df)
    kind = lambda c, test: F.count_if(test(is_digits(col(c)))) if c in text else F.lit(None).cast("bigint")
    found = survey(df, df.columns, {
        "rows": lambda c: F.count(F.lit(1)),
        "values": lambda c: F.count(col(c)),
        "digit_values": lambda c: kind(c, lambda digits: digits),
        "other_values": lambda c: kind(c, lambda digits: ~digits),
        "distinct": lambda c: F.approx_count_distinct(hashable(df, c), DISTINCT_DEVIATION) if approx_distinct else F.lit(None).cast("bigint"),
    }, numeric, QUARTILES, accuracy)
    bounds = quartile_bounds(placed_quantiles(df, {c: found[c] for c in numeric}, QUARTILES, accuracy))
    if approx_distinct:
        outliers = per_column(df, numeric, {"n": lambda c: F.count_if(outside(col(c), bounds[c]))}).collect() if numeric else []
        out, unique = {r["column"]: r["n"] for r in outliers}, {c: found[c]["distinct"] for c in df.columns}
    else:  # whether a value is an outlier follows from the value
        tally = value_tally(df, {c: F.when(outside(col(c), bounds[c]), F.lit("out")) if c in numeric else None for c in df.columns})
        counted = {r["i"]: r for r in tally.groupBy("i").agg(F.count("*").alias("unique"), F.sum(F.when(F.col("mark") == "out", F.col("n"))).alias("out")).collect()}
        out = {c: (counted[i]["out"] or 0) if i in counted else 0 for i, c in enumerate(df.columns)}
        unique = {c: counted[i]["unique"] if i in counted else 0 for i, c in enumerate(df.columns)}
    stats = constant_rows(df.sparkSession, [
        (c, r["rows"], r["values"], out[c] if c in numeric else None, unique[c], r["digit_values"], r["other_values"]) for c in df.columns for r in [found[c]]],
        "column string, rows bigint, values bigint, outliers bigint, unique_count bigint, digit_values bigint, other_values bigint")
    ratios = stats.select(
        "column",
        (F.lit(1.0) - F.coalesce(share(F.col("values"), F.col("rows")), F.lit(1.0))).alias("null_ratio"),
        F.when(F.col("values") > 0, share(F.col("outliers"), F.col("values"))).alias("outlier_ratio"),
        F.when(F.col("values") > 0, share(F.col("unique_count"), F.col("values"))).alias("uniqueness"),
        share(F.least("digit_values", "other_values"), F.col("values")).alias("mixed_ratio"),
    )
    mixed = F.coalesce(F.col("mixed_ratio") > fixed.SHARE_FLAG, F.lit(False))
    scores = ratios.agg(
        (F.lit(1.0) - F.avg("null_ratio")).alias("completeness"),
        F.coalesce(F.avg(F.lit(1.0) - F.col("outlier_ratio")), F.lit(0.0)).alias("validity"),
        F.coalesce(F.avg("uniqueness"), F.lit(0.0)).alias("uniqueness"),
        (F.lit(1.0) - F.avg(mixed.cast("double"))).alias("consistency"),
    ).withColumn("overall", F.expr("(completeness + validity + uniqueness + consistency) / 4"))
    score_rows = scores.select(F.inline(F.array(*[
        F.struct(F.lit("score").alias("item"), F.lit(s).alias("name"), F.lit(None).cast("string").alias("column"),
                 F.round(F.col(s), 6).alias("value"), F.lit(None).cast("string").alias("severity"))
        for s in ("completeness", "validity", "uniqueness", "consistency", "overall")
    ])))

    def issue(name, ratio, flag, medium, high):
        return F.when(F.col(ratio) > flag, F.struct(
            F.lit("issue").alias("item"), F.lit(name).alias("name"), F.col("column").alias("column"),
            F.round(F.col(ratio) * 100, 6).alias("value"), severity(F.col(ratio), medium, high).alias("severity")))

    issues = ratios.select(F.inline(F.array_compact(F.array(
        issue("high_null_percentage", "null_ratio", fixed.NULL_FLAG, fixed.NULL_MEDIUM, fixed.NULL_HIGH),
        issue("high_outlier_percentage", "outlier_ratio", fixed.SHARE_FLAG, fixed.SHARE_MEDIUM, fixed.SHARE_HIGH),
        issue("mixed_data_types", "mixed_ratio", fixed.SHARE_FLAG, fixed.SHARE_MEDIUM, fixed.SHARE_HIGH),
    ))))
    return score_rows.unionByName(issues)


def quality_score_simple(df: DataFrame) -> DataFrame:
    """Completeness less a penalty per table issue, never under 0.3.

    ``high_missing_data`` below 70% completeness, else ``moderate_missing_data``
    when over half of the columns are more than half empty.
    """
    report = null_report(df)
    is_table = F.col("column") == "(table)"
    figures = report.agg(
        F.max(F.when(is_table, F.lit(1.0) - F.coalesce(share(F.col("nulls"), F.col("cells")), F.lit(0.0)))).alias("completeness"),
        F.count_if(~is_table & (share(F.col("nulls"), F.col("cells")) > 0.5)).alias("columns_mostly_missing"),
    )
    high = F.col("completeness") < 0.7
    moderate = ~high & (F.col("columns_mostly_missing") > len(df.columns) * 0.5)
    issues = F.when(high, F.lit(1)).when(moderate, F.lit(1)).otherwise(0)
    return figures.select(
        F.round("completeness", 6).alias("completeness"), "columns_mostly_missing",
        F.when(high, "high_missing_data").when(moderate, "moderate_missing_data").alias("issue"),
        F.round(F.greatest(F.lit(0.3), F.col("completeness") - F.least(F.lit(0.3), issues * 0.05)), 6).alias("score"))


def null_issue_rows(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """One issue per column with nulls: count and percent."""
    report = null_report(df, columns).where("nulls > 0 and column <> '(table)'")
    return report.select(
        F.lit("null_values").alias("type"), "column", F.col("nulls").alias("count"), F.col("null_percent").alias("percentage"))


def cleaning_recommendations(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Missing values, duplicate rows, mixed casing and dates kept as text, per table."""
    parts = []
    for name, df in tables.items():
        nulls = null_issue_rows(df).agg(
            F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("column")), ",").alias("c")
        ).where("n > 0").select(
            F.lit("missing_values").alias("type"), F.col("c").alias("columns"), F.col("n").alias("found"))
        copies = duplicate_rows(df).where("duplicates > 0").select(
            F.lit("duplicates").alias("type"), F.lit("").alias("columns"), F.col("duplicates").alias("found"))
        casing = inconsistent_case(df).where("is_inconsistent").select(
            F.lit("inconsistent_formatting").alias("type"), F.col("column").alias("columns"), F.lit(1).cast("bigint").alias("found"))
        dates = date_string_columns(df).where("is_date_string").select(
            F.lit("incorrect_data_type").alias("type"), F.col("column").alias("columns"), F.lit(1).cast("bigint").alias("found"))
        for part in (nulls, copies, casing, dates):
            parts.append(part.select(F.lit(name).alias("table"), "type", "columns", "found"))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result

