"""Exact quantiles in two scans, at any size.

The first scan keeps a mergeable sketch per column, next to whatever else it aggregates; it says between which two
values a wanted rank lies, give or take a known part of the rows. The second scan counts the values below and between
such brackets and passes on the few inside; the one at the wanted rank is read off their counts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tallyloom.functions.scalars import col, constant_rows

#: Size of a sketch (about 24 bytes per unit and column), and in how many cells a bracket is cut.
ACCURACY, CELLS = 2048, 16
COLUMNS_PER_PASS = 20


def _number(name: str) -> Column:
    """The column as a finite-or-NULL double; NaN counts as missing."""
    value = col(name).cast("double")
    return F.when(~F.isnan(value), value)


def _error(accuracy: int) -> float:
    """Twice the part of the rows that 99 of 100 sketched ranks are off by at most."""
    return 2 * 2.296 / accuracy ** 0.9021


def rank_measures(numeric: Iterable[str], accuracy: int = ACCURACY) -> dict[str, Callable[[str], Column]]:
    """Aggregates per column for a first scan; other columns than ``numeric`` get NULL."""
    numeric = set(numeric)

    def only(make: Callable[[Column], Column], kind: str) -> Callable[[str], Column]:
        return lambda c: make(_number(c)) if c in numeric else F.lit(None).cast(kind)

    return {
        "q_count": only(F.count, "bigint"), "q_low": only(F.min, "double"), "q_high": only(F.max, "double"),
        "q_sketch": only(lambda v: F.kll_sketch_agg_double(v, F.lit(accuracy)), "binary"),
    }


def with_points(stats: DataFrame, probabilities: list[float], accuracy: int = ACCURACY) -> DataFrame:
    """Replace the sketches by ``q_points``: the values that cut the bracket of each probability."""
    error = _error(accuracy)
    ranks = [min(1.0, max(0.0, p + error * (2 * j / CELLS - 1))) for p in probabilities for j in range(CELLS + 1)]
    points = F.when(F.col("q_count") > 0, F.kll_sketch_get_quantile_double(F.col("q_sketch"), F.array(*[F.lit(r) for r in ranks])))
    return stats.withColumn("q_points", points).drop("q_sketch")


def _brackets(row: Row, probabilities: list[float], accuracy: int, whole: bool) -> list[list[float]]:
    """Rising cut points per bracket; brackets that touch are one."""
    if not row["q_count"]:
        return []
    found = []
    for i in range(len(probabilities)):
        points = set(row["q_points"][i * (CELLS + 1):(i + 1) * (CELLS + 1)])
        # Among few rows the next rank is further away than the sketch's error.
        few = row["q_count"] * _error(accuracy) < 4
        found.append(sorted(points | ({row["q_low"], row["q_high"]} if whole or few else set())))
    merged: list[list[float]] = []
    for points in sorted(found):
        if merged and points[0] <= merged[-1][-1]:
            merged[-1] = sorted(set(merged[-1]) | set(points))
        else:
            merged.append(points)
    return merged


def _zone(value: Column, brackets: list[list[float]]) -> Column:
    """Rising number of the gap, cut point or cell that a value is in."""
    zone, at = None, 0
    for points in brackets:
        below, inside = value < points[0], value <= points[-1]
        cut = F.array(*[F.lit(p) for p in points])
        cell = 2 * F.size(F.filter(cut, lambda p: p < value)) - 1 + F.array_contains(cut, value).cast("int")
        zone = (F.when(below, at) if zone is None else zone.when(below, at)).when(inside, at + 1 + cell)
        at += 2 * len(points) + 2
    return zone.otherwise(at)


def _gaps(brackets: list[list[float]]) -> list[int]:
    gaps, at = [0], 0
    for points in brackets:
        at += 2 * len(points) + 2
        gaps.append(at)
    return gaps


def _place(df: DataFrame, columns: list[str], brackets: Mapping[str, list[list[float]]], wanted: list[tuple[int, int]]) -> dict[tuple[int, int], float]:
    """The values at the ``wanted`` (column number, rank), as far as they lie in the brackets: one scan."""
    cells = []
    for i, c in enumerate(columns):
        if not brackets[c]:
            continue
        value, zone = _number(c), _zone(_number(c), brackets[c])
        cells.append(F.when(value.isNotNull(), F.struct(
            F.lit(i).alias("i"), zone.cast("int").alias("zone"), F.when(~zone.isin(_gaps(brackets[c])), value).alias("value"))))
    # The counts are used twice; with these filters both uses have the same plan and share one scan.
    cells = df.select(F.inline(F.array_compact(F.array(*cells)))).where("i is not null and zone is not null")
    counts = cells.groupBy("i", "zone", "value").agg(F.count("*").alias("n"))
    zones = counts.groupBy("i", "zone").agg(F.sum("n").alias("rows"))
    zones = zones.withColumn("below", F.sum("rows").over(Window.partitionBy("i").orderBy("zone")) - F.col("rows"))
    ranks = constant_rows(df.sparkSession, wanted, "j int, rank bigint")
    hit = zones.join(ranks, (F.col("i") == F.col("j")) & (F.col("rank") >= F.col("below")) & (F.col("rank") < F.col("below") + F.col("rows"))).select("i", "zone", "rank", "below")
    inside = counts.join(hit, ["i", "zone"])
    upto = F.sum("n").over(Window.partitionBy("i", "zone", "rank").orderBy("value"))
    placed = inside.withColumn("upto", F.col("below") + upto).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
    rows = placed.select("i", "rank", "value").collect()  # one row per wanted rank; a gap has no value
    return {(r["i"], r["rank"]): r["value"] for r in rows if r["value"] is not None}


def placed_quantiles(df: DataFrame, rows: Mapping[str, Row], probabilities: list[float], accuracy: int = ACCURACY) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of columns whose ``rows`` have the measures and points of a first scan: one more scan.

    A rank that lies outside its bracket, because its sketch was off, is looked for among all values in a further scan.
    """
    result: dict[str, list[float | None]] = {}
    columns = list(rows)
    for start in range(0, len(columns), COLUMNS_PER_PASS):
        batch = columns[start:start + COLUMNS_PER_PASS]
        position = {c: [p * (rows[c]["q_count"] - 1) for p in probabilities] for c in batch if rows[c]["q_count"]}
        wanted = sorted({(i, f(x)) for i, c in enumerate(batch) if c in position for x in position[c] for f in (math.floor, math.ceil)})
        found: dict[tuple[int, int], float] = {}
        for whole in (False, True):
            missing = [w for w in wanted if w not in found]
            if missing:
                asked = {i for i, _ in missing}
                found |= _place(df, batch, {c: _brackets(rows[c], probabilities, accuracy, whole) if i in asked else [] for i, c in enumerate(batch)}, missing)
        for i, c in enumerate(batch):
            if c not in position:
                result[c] = [None] * len(probabilities)
                continue
            ends = [(found[i, math.floor(x)], found[i, math.ceil(x)], x - math.floor(x)) for x in position[c]]
            result[c] = [low if low == high else low + (high - low) * part for low, high, part in ends]
    return result


def exact_quantiles(df: DataFrame, columns: list[str], probabilities: list[float], *, accuracy: int = ACCURACY) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of the non-null values, per column."""
    result: dict[str, list[float | None]] = {}
    measures = rank_measures(columns, accuracy)
    for start in range(0, len(columns), COLUMNS_PER_PASS):
        batch = columns[start:start + COLUMNS_PER_PASS]
        wide = df.agg(*[make(c).alias(f"{label}__{i}") for i, c in enumerate(batch) for label, make in measures.items()])
        long = wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{label}__{i}").alias(label) for label in measures]) for i, c in enumerate(batch)])))
        rows = {r["column"]: r for r in with_points(long, probabilities, accuracy).collect()}  # one row per column
        result |= placed_quantiles(df, {c: rows[c] for c in batch}, probabilities, accuracy)
    return result
