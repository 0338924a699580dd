"""Projections, filters and typing of messy tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions import fixed_values as fixed
from tallyloom.functions.scalars import (
    any_word_pattern, blank_to_null, col, columns_of, constant_rows, is_integer, kinds, normal_name, text_columns,
    to_number,
)


def map_columns(df: DataFrame, mapping: Mapping[str, str], schema: Mapping[str, str]) -> DataFrame:
    """Rename by ``mapping``, keep the columns of ``schema`` in order, NULL where absent.

    A column the mapping does not mention keeps its name. Values that do not
    fit the target type become NULL.
    """
    source_of = {mapping.get(name, name): name for name in df.columns}
    targets = []
    for target, sql_type in schema.items():
        source = source_of.get(target)
        value = col(source).try_cast(sql_type) if source else F.lit(None).cast(sql_type)
        targets.append(value.alias(target))
    return df.select(*targets)


def normalize_names(df: DataFrame) -> DataFrame:
    """Lower-case names, blanks to underscores."""
    return df.toDF(*[normal_name(name) for name in df.columns])


def cast_by_schema(df: DataFrame, schema: Mapping[str, str]) -> DataFrame:
    """Cast the listed columns to int / float / str.

    A Spark column has one type, so a value that cannot convert is kept in
    ``<name>_raw`` and marked in ``<name>_failed``.
    """
    spark_types = {"int": "bigint", "float": "double", "str": "string"}
    result = []
    for name in df.columns:
        if name not in schema:
            result.append(col(name))
            continue
        cast = col(name).try_cast(spark_types[schema[name]])
        failed = cast.isNull() & col(name).isNotNull()
        result += [
            cast.alias(name),
            F.when(failed, col(name).cast("string")).alias(f"{name}_raw"),
            failed.alias(f"{name}_failed"),
        ]
    return df.select(*result)


def retype_whole_columns(df: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """Make a text column numeric only when every non-null value parses: bigint if all are whole numbers, else double."""
    names = list(text_columns(df) if names is None else names)
    if not names:
        return df
    text = {n: col(n).cast("string") for n in names}
    facts = df.agg(*[agg for i, n in enumerate(names) for agg in (
        F.count_if(text[n].isNotNull() & to_number(text[n]).isNull()).alias(f"t{i}"),
        F.count_if(text[n].isNotNull() & ~is_integer(text[n])).alias(f"f{i}"), F.count(text[n]).alias(f"n{i}"))]).first()
    typed = {
        n: text[n].try_cast("bigint") if facts[f"n{i}"] and facts[f"f{i}"] == 0 else to_number(text[n])
        for i, n in enumerate(names) if facts[f"t{i}"] == 0
    }
    return df.select(*[typed[n].alias(n) if n in typed else col(n) for n in df.columns])


def to_numeric_coerce(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.withColumns({n: to_number(col(n)) for n in names})


def date_named(df: DataFrame, words: Iterable[str] = ("date", "time")) -> list[str]:
    return [n for n in text_columns(df) if any(w in n.lower() for w in words)]


def _stamp(value: Column, fmt: str | None) -> Column:
    return F.try_to_timestamp(value, F.lit(fmt)) if fmt else F.try_to_timestamp(value)


def count_non_dates(df: DataFrame, names: Iterable[str], fmt: str | None = None) -> dict[str, int]:
    names = list(names)
    if not names:
        return {}
    row = df.agg(*[
        F.count_if(col(n).isNotNull() & _stamp(col(n), fmt).isNull()).alias(f"c{i}")
        for i, n in enumerate(names)
    ]).first()
    return dict(zip(names, row))


def parse_dates(
    df: DataFrame,
    names: Iterable[str] | None = None,
    fmt: str | None = None,
    on_error: str = "coerce",
    words: Iterable[str] = ("date", "time", "dt", "day"),
) -> DataFrame:
    """Parse date columns, given or found by name.

    ``coerce``: values that do not parse become NULL. ``keep``: a column with
    any such value stays text (one counting pass).
    """
    names = date_named(df, words) if names is None else list(names)
    if on_error == "keep":
        bad = count_non_dates(df, names, fmt)
        names = [n for n in names if bad[n] == 0]
    return df.withColumns({n: _stamp(col(n), fmt) for n in names})


def date_string_columns(df: DataFrame, fmt: str | None = None) -> DataFrame:
    """Text columns named like dates: values that fail to parse, and whether none does."""
    names = date_named(df)
    if not names:
        return constant_rows(df.sparkSession, [], "column string, failed bigint, is_date_string boolean")
    counts = df.agg(*[
        F.count_if(col(n).isNotNull() & _stamp(col(n), fmt).isNull()).alias(f"c{i}")
        for i, n in enumerate(names)
    ])
    rows = F.array(*[
        F.struct(F.lit(n).alias("column"), F.col(f"c{i}").alias("failed"))
        for i, n in enumerate(names)
    ])
    return counts.select(F.inline(rows)).withColumn("is_date_string", F.col("failed") == 0)


def select_columns(
    df: DataFrame, wanted: Iterable[str] | Iterable[int] | Callable[[str], bool]
) -> DataFrame:
    """Keep columns by name, by position or by a predicate on the name."""
    if callable(wanted):
        names = [n for n in df.columns if wanted(n)]
    else:
        names = [df.columns[w] if isinstance(w, int) else w for w in wanted]
    return df.select(*[col(n) for n in names])


def drop_blank_rows(df: DataFrame) -> DataFrame:
    """Drop rows whose cells are all NULL or blank."""
    types = kinds(df)
    cells = [
        (blank_to_null(col(n)) if types[n] == "text" else col(n)).isNotNull() for n in df.columns
    ]
    keep = F.lit(False)
    for cell in cells:
        keep = keep | cell
    return df.where(keep)


def is_summary_row(df: DataFrame, word_boundary: bool = False) -> Column:
    """True for total rows and for rows with too few filled cells.

    The default takes summary words as substrings anywhere in a text cell, so
    "consumer" and "summary" count too; ``word_boundary=True`` asks for words.
    """
    pattern = any_word_pattern(fixed.SUMMARY_WORDS, word_boundary)
    summary = F.lit(False)
    for name in text_columns(df):
        summary = summary | F.coalesce(F.lower(col(name)).rlike(pattern), F.lit(False))
    needed = max(fixed.SUMMARY_MIN_CELLS, len(df.columns) * fixed.SUMMARY_MIN_SHARE)
    filled = sum((col(n).isNotNull().cast("int") for n in df.columns), F.lit(0))
    return summary | (filled < needed)


def filter_summary_rows(df: DataFrame, word_boundary: bool = False) -> DataFrame:
    return df.where(~is_summary_row(df, word_boundary))


def confidence_filter(
    df: DataFrame, confidence: str = "conf", text: str = "text", above: float = 70
) -> DataFrame:
    """Tokens read with more than ``above`` confidence and not blank."""
    return df.where((col(confidence) > above) & (F.trim(col(text)) != ""))


_RANGES = [
    ("tinyint", T.ByteType, -(2 ** 7), 2 ** 7 - 1),
    ("smallint", T.ShortType, -(2 ** 15), 2 ** 15 - 1),
    ("int", T.IntegerType, -(2 ** 31), 2 ** 31 - 1),
    ("bigint", T.LongType, -(2 ** 63), 2 ** 63 - 1),
]


def narrowest_types(df: DataFrame) -> DataFrame:
    """Range of every integer column and the smallest type that holds it."""
    names = columns_of(df, "integer")
    wide = df.agg(*[
        agg for i, n in enumerate(names)
        for agg in (F.min(col(n)).cast("bigint").alias(f"lo{i}"), F.max(col(n)).cast("bigint").alias(f"hi{i}"))
    ])
    rows = F.array(*[
        F.struct(F.lit(n).alias("column"), F.col(f"lo{i}").alias("lowest"), F.col(f"hi{i}").alias("highest"))
        for i, n in enumerate(names)
    ])
    fits = F.lit("bigint")
    for name, _, low, high in reversed(_RANGES[:-1]):
        fits = F.when((F.col("lowest") >= low) & (F.col("highest") <= high), name).otherwise(fits)
    return wide.select(F.inline(rows)).withColumn("narrow_type", fits)


def narrow_types(df: DataFrame) -> DataFrame:
    """Cast integer columns to the smallest type that holds all values (one pass).

    Doubles stay doubles: single precision would lose cents.
    """
    if not columns_of(df, "integer"):
        return df
    types = {r["column"]: r["narrow_type"] for r in narrowest_types(df).collect()}
    return df.select(*[
        col(n).cast(types[n]).alias(n) if n in types else col(n) for n in df.columns
    ])


def stringify_complex(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text, for display."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[
        F.to_json(col(f.name)).alias(f.name) if isinstance(f.dataType, nested) else col(f.name)
        for f in df.schema.fields
    ])


def check_rules(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Add ``failed_rules`` (array of names). Like a CHECK, a NULL result passes."""
    failed = F.array_compact(F.array(*[
        F.when(~F.coalesce(rule, F.lit(True)), F.lit(name)) for name, rule in rules.items()
    ]))
    return df.withColumn("failed_rules", failed)


def validate_constraints(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rows that break a rule with the names of the rules)."""
    checked = check_rules(df, rules)
    valid = checked.where(F.size("failed_rules") == 0).drop("failed_rules")
    return valid, checked.where(F.size("failed_rules") > 0)


def metadata_rules(table: str) -> dict[str, Column]:
    """The CHECK and NOT NULL rules of the metadata tables."""
    def one_of(name, values):
        return F.col(name).isin(values)

    percent = lambda name: F.col(name).between(0, 100)
    return {
        "user_sessions": {
            "id_set": F.col("id").isNotNull(),
            "session_data_size": F.length(F.to_json("session_data")) <= fixed.SESSION_DATA_LIMIT,
        },
        "file_metadata": {
            "id_set": F.col("id").isNotNull(),
            "filename_set": F.col("filename").isNotNull(),
            "status_known": one_of("processing_status", fixed.PROCESSING_STATUSES),
        },
        "processing_states": {
            "id_set": F.col("id").isNotNull(),
            "progress_in_range": percent("progress_percentage"),
        },
        "conversation_history": {
            "id_set": F.col("id").isNotNull(),
            "content_set": F.col("content").isNotNull(),
            "type_known": one_of("message_type", fixed.MESSAGE_TYPES),
        },
        "data_insights": {
            "id_set": F.col("id").isNotNull(),
            "score_in_range": percent("quality_score"),
        },
        "resource_usage": {
            "id_set": F.col("id").isNotNull(),
            "cpu_in_range": percent("cpu_percent"),
            "memory_in_range": percent("memory_percent"),
            "disk_in_range": percent("disk_usage_percent"),
        },
    }[table]
