"""Keys found from the data: column sets that tell all rows of a table apart, and their columns in another table.

Sets are searched level by level, from one column up. A set of columns can only be a key if its values are as many as
the rows, which a sketch of its digests tells within a few percent; what is left is proven on the digests themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.scalars import col, columns_of, constant_rows, normal_name, row_digest
from tallyloom.operators.reconcile import key_tally

#: Relative deviation of the distinct-count sketches; a set is dropped only when five of these below the rows.
DEVIATION = 0.02
#: Sketches per pass.
SKETCHES = 300
#: So much of a key column's values at least is in its counterpart, by sketches of 4,096 values.
LEAST_SHARED, LOG_VALUES = 0.05, 12


def canonical(name: str) -> Column:
    """The value as trimmed text, so that 17 and ' 17' are one key; blank is NULL."""
    text = F.trim(col(name).cast("string"))
    return F.when(text != "", text)


def key_columns(df: DataFrame) -> list[str]:
    """Columns that may be part of a key: all but amounts, flags and nested values."""
    return columns_of(df, "integer", "text", "timestamp")


def _sketched(df: DataFrame, sets: list[tuple[str, ...]]) -> dict[tuple[str, ...], int]:
    """About how many different values each column set has; one pass per ``SKETCHES`` sets."""
    found: dict[tuple[str, ...], int] = {}
    for start in range(0, len(sets), SKETCHES):
        batch = sets[start:start + SKETCHES]
        row = df.agg(*[F.approx_count_distinct(F.xxhash64(*[canonical(c) for c in s]), DEVIATION).alias(f"n{i}") for i, s in enumerate(batch)]).first()
        found.update(zip(batch, row))
    return found


def _repeated(df: DataFrame, sets: list[tuple[str, ...]]) -> set[int]:
    """Numbers of the column sets with a value that two rows have: one shuffle of digests for all of them."""
    digests = F.array(*[F.struct(F.lit(i).alias("i"), *row_digest([canonical(c) for c in s])) for i, s in enumerate(sets)])
    counts = df.select(F.inline(digests)).groupBy("i", "_h1", "_h2").agg(F.count("*").alias("n"))
    return {r["i"] for r in counts.where("n > 1").select("i").distinct().collect()}  # one number per set at most


def unique_column_sets(df: DataFrame, columns: Iterable[str] | None = None, widest: int = 3) -> list[tuple[str, ...]]:
    """The smallest sets of up to ``widest`` columns without NULL that no two rows agree in, in the order of columns.

    Level by level: a set is looked at only if no part of it is a key and if the numbers of values of its columns,
    multiplied, reach the rows. One pass of sketches per level drops the sets with fewer values than rows, one shuffle
    proves the others.
    """
    columns = list(columns if columns is not None else key_columns(df))
    if not columns:
        return []
    facts = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(canonical(c)).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    rows = facts["rows"]
    filled = [c for i, c in enumerate(columns) if facts[f"c{i}"] == rows]
    if not rows:
        return []
    values = {s[0]: n for s, n in _sketched(df, [(c,) for c in filled]).items()}
    least, most = 1 - 5 * DEVIATION, 1 + 5 * DEVIATION
    keys: list[tuple[str, ...]] = []
    for width in range(1, widest + 1):
        sets = [
            s for s in combinations(filled, width)
            if not any(set(k) <= set(s) for k in keys) and math.prod(max(1, values[c]) * most for c in s) >= rows * least]
        counted = {s: values[s[0]] for s in sets} if width == 1 else _sketched(df, sets)
        near = [s for s in sets if counted[s] >= rows * least]
        if near:
            repeated = _repeated(df, near)
            keys += [s for i, s in enumerate(near) if i not in repeated]
    return keys


def shared_parts(a: DataFrame, columns_a: list[str], b: DataFrame, columns_b: list[str]) -> dict[tuple[str, str], float]:
    """Which part of each column's values of A is in each column of B, by sketches: one pass per table."""
    def sketches(df, columns, side):
        return df.agg(*[F.theta_sketch_agg(canonical(c), LOG_VALUES).alias(f"{side}{i}") for i, c in enumerate(columns)]).withColumn("one", F.lit(1))

    if not columns_a or not columns_b:
        return {}
    both = sketches(a, columns_a, "a").join(sketches(b, columns_b, "b"), "one")
    pairs = [(i, j) for i in range(len(columns_a)) for j in range(len(columns_b))]
    parts = F.array(*[
        F.theta_sketch_estimate(F.theta_intersection(F.col(f"a{i}"), F.col(f"b{j}"))) / F.greatest(F.theta_sketch_estimate(F.col(f"a{i}")), F.lit(1))
        for i, j in pairs])
    return {(columns_a[i], columns_b[j]): p for (i, j), p in zip(pairs, both.select(parts).first()[0])}


def shared_key(a: DataFrame, b: DataFrame, widest: int = 3, least_shared: float = LEAST_SHARED) -> tuple[list[str], list[str]] | None:
    """A key of A and the columns of B that hold it, or None.

    The counterpart of a column is the one of the same name, spelling of blanks and capitals aside, else the free column
    that holds most of its values. The key with the fewest columns counts, then the one of which B holds most.
    """
    keys, columns_b = unique_column_sets(a, widest=widest), key_columns(b)
    used = sorted({c for k in keys for c in k}, key=a.columns.index)
    parts = shared_parts(a, used, b, columns_b)
    named = {normal_name(c): c for c in reversed(columns_b)}
    best: tuple | None = None
    for key in keys:
        match: dict[str, str] = {c: named[normal_name(c)] for c in key if normal_name(c) in named}
        offers = sorted(((-parts[c, d], columns_b.index(d), c, d) for c in key for d in columns_b if c not in match))
        for part, _, c, d in offers:
            if c not in match and d not in match.values() and -part >= least_shared:
                match[c] = d
        if len(match) == len(key) and len(set(match.values())) == len(key):
            rank = (len(key), -min(parts[c, match[c]] for c in key))
            if best is None or rank < best[0]:
                best = (rank, list(key), [match[c] for c in key])
    return None if best is None else (best[1], best[2])


def joint_key(columns: list[str]) -> Column:
    """The columns as one key; NULL if one of them is."""
    values = [canonical(c) for c in columns]
    whole = F.lit(True)
    for v in values:
        whole = whole & v.isNotNull()
    return F.when(whole, F.array(*values))


def missing_by_found_key(a: DataFrame, b: DataFrame, amount_a: str | None, widest: int = 3) -> DataFrame:
    """Rows of A whose key does not occur in B: count, sum, and the columns of the key on both sides.

    No row if the tables share no key. Rows of A with a NULL in the key's columns don't exist, those of B match nothing.
    """
    found = shared_key(a, b, widest)
    if found is None:
        return constant_rows(a.sparkSession, [], "missing_count bigint, missing_amount double, key_a string, key_b string")
    tally = key_tally(a, joint_key(found[0]), b, joint_key(found[1]), col(amount_a) if amount_a else None)
    gone = (F.col("rows_a") > 0) & (F.col("key").isNull() | (F.col("rows_b") == 0))
    return tally.agg(
        F.coalesce(F.sum(F.when(gone, F.col("rows_a"))), F.lit(0)).alias("missing_count"),
        F.round(F.coalesce(F.sum(F.when(gone, F.col("sum_a"))), F.lit(0.0)), 2).alias("missing_amount"),
    ).withColumns({"key_a": F.lit(", ".join(found[0])), "key_b": F.lit(", ".join(found[1]))})
