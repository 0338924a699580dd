"""Correlations of all pairs of many columns as blocked Gram matrices.

A first scan sums up the columns. A second one, with the columns less their means, lets each task add up the products
of its Arrow batches by matrix multiplication; a value's NULL mask takes part in them, so that each pair counts the
rows where both its columns are known. What tasks found is added up per pair in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.scalars import col
from tallyloom.session import compiled_methods, cut_lineage

#: Columns of a block. A task holds the products of two blocks: five matrices of at most four times its square.
BLOCK = 1000
#: Below this part of its squares a variance is taken for rounding, the column for constant.
ROUNDING = 1e-12
#: Pairs of a batch of results.
PAIRS = 100_000

_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy", "bad")


def _packed(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each row's numbers as one array: Arrow then holds a batch as one matrix, row by row."""
    return df.select(F.array(*[col(c).cast("double") for c in columns]).alias("v"))


def _matrices(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(values with 0 for what is unknown or not finite, 1 where known, 1 where known but not finite or None without any), a column each."""
    flat = batch.column(0).flatten()
    known = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, width)
    values = flat.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, width)
    bad = ~np.isfinite(values)
    if not bad.any():
        return values, known.astype("float64"), None
    return np.where(bad, 0.0, values), known.astype("float64"), bad.astype("float64")


def column_means(df: DataFrame, columns: list[str]) -> list[float]:
    """Means of the finite values, 0 without any: one scan, a row per task and column."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(len(columns)), np.zeros(len(columns))
        for batch in batches:
            if batch.num_rows:
                values, known, bad = _matrices(batch, len(columns))
                sums += values.sum(axis=0)
                counts += known.sum(axis=0) if bad is None else (known - bad).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(columns)), pa.int32()), "s": sums, "n": counts})

    found = _packed(df, columns).mapInArrow(run, "i int, s double, n double").groupBy("i").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("mean"))
    means = {r["i"]: r["mean"] for r in found.collect()}  # one number per column
    return [means.get(i) or 0.0 for i in range(len(columns))]


def _products(x: np.ndarray, known: np.ndarray, bad: np.ndarray | None, rows: np.ndarray, others: np.ndarray) -> list[np.ndarray]:
    """The sums of ``_SUMS`` for each pair of one of ``rows`` and one of ``others``."""
    if np.array_equal(rows, others):  # the second column's sums are the first one's, transposed
        sx, sxx = x.T @ known, (x * x).T @ known
        wrong = np.zeros(sx.shape) if bad is None else bad.T @ known
        return [known.T @ known, sx, sx.T, sxx, sxx.T, x.T @ x, wrong + wrong.T]
    xa, xb, ka, kb = x[:, rows], x[:, others], known[:, rows], known[:, others]
    wrong = np.zeros((len(rows), len(others))) if bad is None else bad[:, rows].T @ kb + ka.T @ bad[:, others]
    return [ka.T @ kb, xa.T @ kb, ka.T @ xb, (xa * xa).T @ kb, ka.T @ (xb * xb), xa.T @ xb, wrong]


def _pair_sums(df: DataFrame, columns: list[str], means: list[float], left: range, right: range) -> DataFrame:
    """(a, b, sums) of the pairs a < b of two blocks of columns, one row per task and pair."""
    wanted = sorted({*left, *right})
    place = {c: i for i, c in enumerate(wanted)}
    rows, others = np.array([place[c] for c in left]), np.array([place[c] for c in right])
    shift, numbers = np.array([means[c] for c in wanted]), np.array(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            values, known, bad = _matrices(batch, len(wanted))
            x = (values - shift) * (known if bad is None else known - bad)
            found = _products(x, known, bad, rows, others)
            if total is None:
                total = [m.copy() for m in found]
            else:
                for done, more in zip(total, found, strict=True):
                    done += more
        if total is None:
            return
        step = max(1, PAIRS // len(others))
        for start in range(0, len(rows), step):
            a = np.repeat(numbers[rows[start:start + step]], len(others))
            b = np.tile(numbers[others], len(a) // len(others))
            pick = a < b
            yield pa.RecordBatch.from_pydict({
                "a": pa.array(a[pick], pa.int32()), "b": pa.array(b[pick], pa.int32()),
                **{name: m[start:start + step].ravel()[pick] for name, m in zip(_SUMS, total, strict=True)}})

    values = _packed(df, [columns[c] for c in wanted])
    return values.mapInArrow(run, "a int, b int, " + ", ".join(f"{s} double" for s in _SUMS))


def _all_sums(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, sums) of all pairs, one row each."""
    width = len(columns)
    means = column_means(df, columns)
    blocks = [range(start, min(start + BLOCK, width)) for start in range(0, width, BLOCK)]
    if len(blocks) <= 2:
        parts = [_pair_sums(df, columns, means, range(width), range(width))]
    else:
        parts = [_pair_sums(df, columns, means, x, y) for i, x in enumerate(blocks) for y in blocks[i:]]
    sums = parts[0]
    for part in parts[1:]:
        sums = sums.unionByName(part)
    return sums.groupBy("a", "b").agg(*[F.sum(s).alias(s) for s in _SUMS])


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_a, column_b, r) of all pairs in the order of columns; r is NULL where it is not defined.

    Rows count for a pair if both values are known. NULL for fewer than two such rows, values that are not finite, and
    columns that are constant in them (or vary by less than ``ROUNDING`` of their squared distance from their mean).
    Two scans for up to two blocks of columns, one more for each further pair of blocks, when called; the sums per pair
    are written.
    """
    spark, width = df.sparkSession, len(columns)
    with compiled_methods(spark):
        total = cut_lineage(_all_sums(df, columns))

    def spread(product, x, y):
        return F.col(product) - F.try_divide(F.col(x) * F.col(y), F.col("n"))

    xx, yy = spread("sxx", "sx", "sx"), spread("syy", "sy", "sy")
    varies = (F.col("n") > 1) & (F.col("bad") == 0) & (xx > F.col("sxx") * ROUNDING) & (yy > F.col("syy") * ROUNDING)
    r = F.when(varies, F.try_divide(spread("sxy", "sx", "sy"), F.sqrt(xx) * F.sqrt(yy)))
    pairs = spark.range(width).select(F.col("id").cast("int").alias("a"), F.explode(F.slice(F.lit(list(range(width))), F.col("id").cast("int") + 2, width)).alias("b"))
    names = F.lit(list(columns))
    return pairs.join(total.select("a", "b", r.alias("r")), ["a", "b"], "left").select(
        F.get(names, "a").alias("column_a"), F.get(names, "b").alias("column_b"),
        F.when(F.abs("r") > 1, F.signum("r")).otherwise(F.col("r")).alias("r"))
