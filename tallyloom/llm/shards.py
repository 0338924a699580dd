"""Uniform shuffle into shards of exact sizes, in DataFrame functions only."""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.shared import partitions

_POSITION_BITS = 33  # monotonically_increasing_id: partition above, row below


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Good ones among ``draws`` of ``good + bad`` without replacement, for numbers of any size."""
    if good == 0 or draws == 0:
        return 0
    if bad == 0:
        return draws
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, draws))
    low, high, lg = max(0, draws - bad), min(good, draws), math.lgamma
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))

    def chance(x: int) -> float:
        log = lg(good + 1) - lg(x + 1) - lg(good - x + 1) + lg(bad + 1) - lg(draws - x + 1) - lg(bad - draws + x + 1)
        return math.exp(log - lg(good + bad + 1) + lg(draws + 1) + lg(good + bad - draws + 1))

    left = rng.random() - chance(mode)
    down, up = mode - 1, mode + 1
    while left > 0 and (down >= low or up <= high):  # outwards from the mode
        for x in (down, up):
            if left > 0 and low <= x <= high:
                left -= chance(x)
                at = x
        down, up = down - 1, up + 1
    return mode if up == mode + 1 else at


def communication_matrix(sizes: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """How many rows each partition sends to each shard: rows add up to ``sizes``, columns to ``shards``.

    The counts are drawn as those of a uniform permutation: multivariate hypergeometric, one partition after another.
    """
    rng = np.random.default_rng(seed)
    left = list(shards)
    matrix = []
    for size in sizes:
        row, total, draws = [], sum(left), size
        for room in left:
            x = _hypergeometric(rng, room, total - room, draws)
            row.append(x)
            total, draws = total - room, draws - x
        left = [a - b for a, b in zip(left, row, strict=True)]
        matrix.append(row)
    return matrix


def shuffle_into_shards(df: DataFrame, n_shards: int, by: list[str], seed: int = 7) -> DataFrame:
    """``df`` with ``shard`` and ``slot``: a uniform shuffle, shard sizes one apart at most, slots gapless from 0.

    The counts of the input's partitions give the communication matrix (partitions x shards numbers on the driver).
    Each partition is put in random order without moving a row, and its first rows go to shard 0, the next to shard 1
    and so on, as the matrix says. One exchange brings each shard's rows to several blocks of random ranks, so that
    a shard may be larger than a task; sorting in the blocks is the second permutation.

    ``by``: columns that tell rows apart (an id); equal rows are interchangeable, nulls are values. Both passes must
    see the same partitions, as two scans of one table do; the job fails if the sizes don't come out.
    An empty table gives an empty result. Columns of ``df`` named ``shard`` or ``slot`` are replaced; all others come
    back as they were, whatever their names.
    """
    hidden = {c: f"_in{i}" for i, c in enumerate(df.columns)}
    dealt = _dealt(df.select(*[F.col(f"`{c}`").alias(h) for c, h in hidden.items()]), n_shards, [hidden[c] for c in by], seed)
    return dealt.select(*[F.col(h).alias(c) for c, h in hidden.items() if c not in ("shard", "slot")], "shard", "slot")


def _dealt(df: DataFrame, n_shards: int, by: list[str], seed: int) -> DataFrame:
    spark = df.sparkSession
    position = F.monotonically_increasing_id()
    counted = df.select(F.shiftright(position, _POSITION_BITS).alias("part")).groupBy("part").count().collect()
    counts = {r["part"]: r["count"] for r in counted}
    total = sum(counts.values())
    sizes = [total // n_shards + (j < total % n_shards) for j in range(n_shards)]
    parts = sorted(counts)
    matrix = communication_matrix([counts[p] for p in parts], sizes, seed)
    ends = [{"_part": p, "_ends": np.cumsum(row).tolist()} for p, row in zip(parts, matrix, strict=True)]
    plan = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(ends)), "array<struct<_part:bigint,_ends:array<bigint>>>")).alias("_e")).select("_e.*")

    names = [F.col(f"`{c}`") for c in by]
    mixed = df.withColumn("_order", F.xxhash64(F.lit(seed), *names)).sortWithinPartitions("_order")
    placed = mixed.withColumn("_at", F.monotonically_increasing_id())
    placed = placed.withColumn("_part", F.shiftright("_at", _POSITION_BITS)).withColumn("_row", F.col("_at").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)))
    dealt = placed.join(plan, "_part").withColumn("shard", F.size(F.filter("_ends", lambda e: e <= F.col("_row"))).cast("int"))

    blocks = -(-3 * partitions(spark) // n_shards)
    rank = F.xxhash64(F.lit(seed + 1), *names, "_at")
    block = F.pmod(F.shiftrightunsigned(rank, 20), F.lit(blocks)).cast("int")
    dealt = dealt.withColumn("_rank", rank).withColumn("_block", block)
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    tallies = dealt.groupBy("shard", "_block").count()
    right = F.sum("count").over(Window.partitionBy("shard")) == F.element_at(F.array(*[F.lit(s) for s in sizes]), F.col("shard") + 1)
    start = F.when(right, F.coalesce(F.sum("count").over(before), F.lit(0))).otherwise(F.raise_error(F.lit("the input's partitions changed between two scans")))
    starts = tallies.select("shard", "_block", start.alias("_start"))
    inside = Window.partitionBy("shard", "_block").orderBy("_rank", "_at")
    slots = dealt.withColumn("_i", F.row_number().over(inside)).join(starts, ["shard", "_block"])
    slot = (F.col("_start") + F.col("_i") - 1).cast("long")
    return slots.select(*[F.col(f"`{c}`") for c in df.columns], "shard", slot.alias("slot"))


def utf8_size(text: Column) -> Column:
    """Bytes of the text, and 8 more for its length."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")
