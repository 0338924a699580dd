"""Describe, suggest and unify schemas, and migrate tables to the unified one."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import fixed_values as fixed
from tallyloom.functions.scalars import col, constant_rows, kinds, normal_name, text_columns
from tallyloom.operators.clean import map_columns
from tallyloom.operators.profile import constants_per_column, distinct_counts, per_column, value_frequencies
from tallyloom.operators.quality import null_issue_rows


def sql_types(df: DataFrame) -> dict[str, str]:
    return {c: fixed.SQL_TYPES.get(k, "TEXT") for c, k in kinds(df).items()}


def extract_schema(df: DataFrame, order_by: Iterable[str], samples: int = 5) -> DataFrame:
    """SQL type, nulls, distinct values (full data) and the first sample values per column.

    Samples are the first non-null values in the given order.
    """
    stats = per_column(df, df.columns, {"null_count": lambda c: F.count_if(col(c).isNull())})
    types = constants_per_column(df, {c: {"t": t} for c, t in sql_types(df).items()}, "column string, data_type string")
    order = list(order_by)
    keys = [col(o).alias(f"o{i}") for i, o in enumerate(order)]
    cells = df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("v")) for c in df.columns])).alias("cell"))
    cells = cells.select(*[f"o{i}" for i in range(len(order))], "cell.column", "cell.v").where("v is not null")
    first = Window.partitionBy("column").orderBy(*[f"o{i}" for i in range(len(order))], "v")
    listed = (
        cells.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= samples)  # Spark keeps so many per task and column
        .groupBy("column").agg(F.array_sort(F.collect_list(F.struct("nth", "v")))["v"].alias("listed"))
    )
    sampled = listed.select("column", F.array_join("listed", "|").alias("sample_values"))
    return (
        stats.join(types, "column").join(distinct_counts(df, df.columns), "column").join(sampled, "column", "left")
        .select("column", "data_type", "null_count", "unique_count", F.coalesce("sample_values", F.lit("")).alias("sample_values"))
    )


def _is_key_name(name: str) -> bool:
    return name.lower() == "id" or name.lower().endswith("_id")


def suggest_schema(df: DataFrame) -> DataFrame:
    """SQL type with ENUM and VARCHAR, nullable, primary key and index advice per column."""
    text = text_columns(df)
    types = sql_types(df)
    stats = per_column(df, df.columns, {
        "rows": lambda c: F.count(F.lit(1)),
        "null_count": lambda c: F.count_if(col(c).isNull()),
        "longest": lambda c: F.max(F.length(col(c))) if c in text else F.lit(None).cast("int"),
    }).join(distinct_counts(df, df.columns), "column")
    facts = {r["column"]: r for r in stats.collect()}  # one row per column
    enums = [
        c for c in text
        if facts[c]["unique_count"] <= fixed.ENUM_MAX_VALUES
        and facts[c]["unique_count"] < fixed.ENUM_MAX_RATIO * facts[c]["rows"]
    ]
    # At most ENUM_MAX_VALUES values for each of these columns.
    listed = {
        r["column"]: r["v"] for r in value_frequencies(df, enums).groupBy("column")
        .agg(F.array_join(F.sort_array(F.collect_list("value")), ", ").alias("v")).collect()
    } if enums else {}

    rows = []
    for c in df.columns:
        f = facts[c]
        if c not in text:
            sql_type = types[c]
        elif c in enums:
            sql_type = f"ENUM({listed.get(c, '')})"
        else:
            sql_type = f"VARCHAR({fixed.VARCHAR_LIMIT})" if (f["longest"] or 0) < fixed.VARCHAR_LIMIT else "TEXT"
        primary = _is_key_name(c) and f["null_count"] == 0 and f["unique_count"] == f["rows"]
        index = c.lower().endswith("_id") and c.lower() != "id"
        rows.append((c, sql_type, f["null_count"] > 0, f["unique_count"], primary, index))
    return constant_rows(df.sparkSession, rows, "column string, sql_type string, nullable boolean, unique_values bigint, primary_key boolean, index boolean")


# Types that can hold each other; any other mix becomes TEXT.
_WIDER = {frozenset(["INTEGER", "DECIMAL"]): "DECIMAL"}
_SPARK_TYPE = {"INTEGER": "bigint", "DECIMAL": "double", "TEXT": "string", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz"}


#: Numbers as a text column holds them; codes with leading zeros are none.
_WHOLE = r"^\s*[+-]?(0|[1-9][0-9]*)\s*$"
_NUMBER = r"^\s*[+-]?((0|[1-9][0-9]*)(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def value_types(df: DataFrame) -> dict[str, str | None]:
    """SQL type per column, of text columns by all their values; None for a text column without any.

    A text column is INTEGER if every value is a whole number of 64 bits, DECIMAL if every value is a number, else
    TEXT. Codes with leading zeros and whole numbers beyond 64 bits stay TEXT, so that no digit is lost. One scan for
    all columns of the table.
    """
    types: dict[str, str | None] = dict(sql_types(df))
    text = text_columns(df)
    if not text:
        return types

    def whole(c):
        return col(c).rlike(_WHOLE)

    def fits(c):
        return col(c).try_cast("bigint").isNotNull()

    facts = per_column(df, text, {
        "values": lambda c: F.count(col(c)),
        "integers": lambda c: F.count_if(whole(c) & fits(c)),
        "numbers": lambda c: F.count_if(col(c).rlike(_NUMBER) & (~whole(c) | fits(c))),
    })
    for r in facts.collect():  # one row per column
        if not r["values"]:
            types[r["column"]] = None
        elif r["integers"] == r["values"]:
            types[r["column"]] = "INTEGER"
        elif r["numbers"] == r["values"]:
            types[r["column"]] = "DECIMAL"
    return types


def unify_schema(tables: Mapping[str, DataFrame], confidence: float = 0.9, unknown: float = 0.7, by_values: bool = False) -> DataFrame:
    """Column mapping of every table into one schema, with the widest type per target.

    With ``by_values`` types of text columns come from their values. Then a text column without values is TEXT, with confidence ``unknown``,
    and has no say in the type of its target unless all its sources are such. Otherwise declared types count.
    """
    spark = next(iter(tables.values())).sparkSession
    rows = [
        (source, i, c, normal_name(c), t or "TEXT", confidence if t else unknown, t is not None)
        for source, df in tables.items() for i, (c, t) in enumerate((value_types(df) if by_values else sql_types(df)).items())
    ]
    mapping = constant_rows(spark, rows, "source_file string, position int, source_column string, target_column string, "
              "data_type string, confidence double, known boolean")
    found = F.sort_array(F.collect_set(F.when(F.col("known"), F.col("data_type"))))
    widest = mapping.groupBy("target_column").agg(found.alias("types"))
    unified = F.when(F.size("types") == 1, F.col("types")[0])
    for pair, wider in _WIDER.items():
        unified = unified.when(
            (F.size("types") == 2) & F.array_contains("types", sorted(pair)[0]) & F.array_contains("types", sorted(pair)[1]),
            F.lit(wider))
    widest = widest.select("target_column", unified.otherwise("TEXT").alias("unified_type"))
    return mapping.join(widest, "target_column").select(
        "source_file", "source_column", "target_column", "data_type", "unified_type", "confidence", "position")


def type_conflicts(mapping: DataFrame) -> DataFrame:
    """Targets fed by more than one type, with the types and sources."""
    return (
        mapping.groupBy("target_column").agg(
            F.array_join(F.sort_array(F.collect_set("data_type")), ",").alias("conflicting_types"),
            F.array_join(F.sort_array(F.collect_list(F.concat_ws(".", "source_file", "source_column"))), ",").alias("sources"),
            F.countDistinct("data_type").alias("types"))
        .where("types > 1").drop("types")
    )


def mapping_confidence(mapping: DataFrame, threshold: float = 0.8) -> DataFrame:
    return mapping.agg(
        F.count("*").alias("total_mappings"),
        F.count_if(F.col("confidence") >= threshold).alias("high_confidence"),
        F.count_if(F.col("confidence") < threshold).alias("low_confidence"))


def unified_columns(mapping: DataFrame, tables: Mapping[str, DataFrame]) -> dict[str, str]:
    """Target columns in order of first appearance with their SQL type (metadata only)."""
    rank = {name: i for i, name in enumerate(tables)}
    rows = sorted(mapping.collect(), key=lambda r: (rank[r["source_file"]], r["position"]))
    result: dict[str, str] = {}
    for r in rows:
        result.setdefault(r["target_column"], r["unified_type"])
    return result


def create_table_sql(table: str, columns: Mapping[str, str], primary_keys: Iterable[str] = ()) -> str:
    lines = [f"  {name} {sql_type}" for name, sql_type in columns.items()]
    keys = list(primary_keys)
    if keys:
        lines.append(f"  PRIMARY KEY ({', '.join(keys)})")
    return f"CREATE TABLE {table} (\n" + ",\n".join(lines) + "\n);"


def migrate(tables: Mapping[str, DataFrame], mapping: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(all rows under the unified schema with ``source_file``, report).

    Without a mapping the declared types are unified. The report has one row per source with its row count and one row per
    target column with NULLs. A source that cannot be mapped is listed with
    status ``failed`` and its reason.
    """
    mapping = unify_schema(tables) if mapping is None else mapping
    columns = unified_columns(mapping, tables)
    schema = {c: _SPARK_TYPE[t] for c, t in columns.items()}
    by_source: dict[str, dict[str, str]] = {}
    for r in mapping.collect():
        by_source.setdefault(r["source_file"], {})[r["source_column"]] = r["target_column"]
    mapped, failed = {}, {}
    for source, df in tables.items():
        if source not in by_source:
            failed[source] = "no column mapping"
            continue
        try:
            mapped[source] = map_columns(df, by_source[source], schema)
        except AnalysisException as problem:
            failed[source] = str(problem).splitlines()[0]
    return _migrated_rows(mapped, columns), _migration_report(mapped, failed, mapping.sparkSession)


def _migrated_rows(mapped: Mapping[str, DataFrame], columns: Mapping[str, str]) -> DataFrame:
    parts = [df.withColumn("source_file", F.lit(source)) for source, df in mapped.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _migration_report(mapped, failed, spark) -> DataFrame:
    schema = ("source_file string, status string, column string, rows bigint, percentage double, reason string")
    result = constant_rows(spark, [(s, "failed", None, None, None, why) for s, why in failed.items()], schema)
    for source, df in mapped.items():
        done = df.agg(F.count("*").alias("rows")).withColumns({
            "source_file": F.lit(source), "status": F.lit("migrated")})
        issues = null_issue_rows(df).select(
            F.lit(source).alias("source_file"), F.col("type").alias("status"), "column",
            F.col("count").alias("rows"), "percentage")
        result = result.unionByName(done, allowMissingColumns=True).unionByName(issues, allowMissingColumns=True)
    return result

