"""Keys and references over several tables at once."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import fixed_values as fixed
from tallyloom.functions.scalars import col, constant_rows
from tallyloom.operators.clean import check_rules, metadata_rules

ERRORS = "table string, rule string, key string, rows bigint"


def reference_errors(tables: Mapping[str, DataFrame], references: Mapping[str, tuple[str, str]], id_col: str = "id") -> DataFrame:
    """(table, rule, key, rows): ids that several rows of a table have, and references to ids that their parent lacks.

    ``references`` maps a table to (its column, the parent's name). All ids and references of all tables are grouped by
    (parent, value) in one shuffle, in which equal ones collapse first: an unknown parent that a third of all rows name
    is one error with that many rows. NULL is neither an id nor a reference. A parent that is not given has no ids.
    """
    children = [c for c in references if c in tables]
    rows = [df.select(F.lit(n).alias("space"), col(id_col).cast("string").alias("key"), F.lit(None).cast("string").alias("child")) for n, df in tables.items()]
    rows += [tables[c].select(F.lit(references[c][1]).alias("space"), col(references[c][0]).cast("string").alias("key"), F.lit(c).alias("child")) for c in children]
    if not rows:
        raise ValueError("no tables given")
    every = rows[0]
    for part in rows[1:]:
        every = every.unionByName(part)
    tally = every.where("key is not null").groupBy("space", "key").agg(
        F.count_if(F.col("child").isNull()).alias("ids"), *[F.count_if(F.col("child") == c).alias(f"n{i}") for i, c in enumerate(children)])

    def error(table, rule, number, found):
        return F.when(found, F.struct(table.alias("table"), F.lit(rule).alias("rule"), F.col("key").alias("key"), number.alias("rows")))

    errors = [error(F.col("space"), fixed.UNIQUE_RULE, F.col("ids"), F.col("ids") > 1)]
    for i, c in enumerate(children):
        column, parent = references[c]
        n = F.col(f"n{i}")
        errors.append(error(F.lit(c), f"{column}_exists", n, (F.col("space") == parent) & (F.col("ids") == 0) & (n > 0)))
    return tally.select(F.inline(F.array_compact(F.array(*errors))))


def rule_errors(tables: Mapping[str, DataFrame], id_col: str = "id") -> DataFrame:
    """(table, rule, key, rows): rows that break a NOT NULL or CHECK rule of the metadata tables, by id."""
    result = constant_rows(next(iter(tables.values())).sparkSession, [], ERRORS)
    for name, df in tables.items():
        rules = metadata_rules(name) | {f"{c}_set": col(c).isNotNull() for c in fixed.METADATA_REQUIRED[name]}
        broken = check_rules(df, rules).select(col(id_col).cast("string").alias("key"), F.explode("failed_rules").alias("rule"))
        counted = broken.groupBy("rule", "key").agg(F.count("*").alias("rows"))
        result = result.unionByName(counted.select(F.lit(name).alias("table"), "rule", "key", "rows"))
    return result


def metadata_errors(tables: Mapping[str, DataFrame]) -> DataFrame:
    """All errors of the six metadata tables, or those given: rules of rows, unique ids, references to parents."""
    unknown = set(tables) - set(fixed.METADATA_TABLES)
    if unknown:
        raise ValueError(f"no metadata tables: {sorted(unknown)}")
    return rule_errors(tables).unionByName(reference_errors(tables, fixed.METADATA_REFERENCES))
