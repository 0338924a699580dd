"""Exact duplicates by a content sort, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.shared import partitions, written

#: Bytes of text that lead the sort key; equal beginnings are ordered by digest, so any range can be cut anywhere.
KEY_BYTES = 32
#: Sampled keys per range.
OVERSAMPLE = 24
#: Splitters per block of the two-step search.
BLOCK = 32


def _split_points(keys: DataFrame, ranges: int) -> list[bytes]:
    """Keys that cut the sampled rows into equal parts: ``ranges - 1`` of them reach the driver."""
    total = keys.count()
    if total == 0 or ranges < 2:
        return []
    sample = keys.sample(min(1.0, ranges * OVERSAMPLE / total), seed=11)
    place = Window.orderBy("_key")
    ranked = sample.select("_key", F.row_number().over(place).alias("_i"), F.ntile(ranges).over(place).alias("_tile"))
    firsts = ranked.groupBy("_tile").agg(F.min("_key").alias("_key")).where("_tile > 1").orderBy("_key")
    return list(dict.fromkeys(bytes(r["_key"]) for r in firsts.collect()))


def _range_of(key: Column, points: list[bytes]) -> Column:
    """How many split points are not above the key: first by blocks of them, then in one block."""
    if not points:
        return F.lit(0)
    array = lambda some: F.array(*[F.lit(bytearray(p)) for p in some])
    below = lambda points_: F.size(F.filter(points_, lambda p: p <= key))
    block = F.greatest(below(array(points[::BLOCK])) - 1, F.lit(0))
    return (block * BLOCK + below(F.slice(array(points), block * BLOCK + 1, F.lit(BLOCK)))).cast("int")


def exact_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", carry: tuple[str, ...] = (),
    normalise=None, ranges: int | None = None,
) -> DataFrame:
    """One row per row of ``df``: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``, and the columns ``carry``.

    Sampled split points deal the rows into ranges of (first bytes, digest, id hash), one shuffle brings each range to
    a task that sorts it externally, and each row's whole text is compared with its neighbour's. Runs that touch an
    end of their range may go on in another one: these, two per range at most, are joined by whole text. A text that
    a third of all rows have is so cut into many ranges, and no group meets in one task.

    ``keep``: "smallest" or "largest" id of equal texts stays. ``normalise`` maps the text column before comparison.
    Null text counts as empty. Null ids stay only where their whole group has none. Of rows equal in text and id one
    stays. An empty table gives an empty result. Other columns of ``df`` don't matter, whatever their names; those
    carried that are named like a result column are dropped.
    """
    spark = df.sparkSession
    results = {id_col, "keep_id", "group_size", "kept", "text_sha256"}
    carried = [c for c in carry if c not in results]
    ranges = ranges or 3 * partitions(spark)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    text = normalise(text) if normalise else text
    rows = df.select(F.col(f"`{id_col}`").alias("_id"), text.alias("_text"), *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carried)])
    content = F.encode("_text", "UTF-8")
    rows = rows.withColumn("_sha", F.sha2(content, 256))
    key = F.concat(F.rpad(F.substring(content, 1, KEY_BYTES), KEY_BYTES, F.lit(bytearray(1))), F.unhex("_sha"), F.unhex(F.lpad(F.hex(F.xxhash64("_id")), 16, "0")))
    points = _split_points(rows.select(key.alias("_key")), ranges)

    ranged = rows.withColumn("_key", key).withColumn("_range", _range_of(F.col("_key"), points))
    order = Window.partitionBy("_range").orderBy("_key", "_text", "_id")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sorted_rows = (
        ranged.withColumn("_new", F.coalesce(F.lag("_text").over(order) != F.col("_text"), F.lit(True)))
        .withColumn("_run", F.sum(F.col("_new").cast("long")).over(so_far))
    )
    run = Window.partitionBy("_range", "_run")
    best, first = (F.min("_id"), F.asc_nulls_last("_id")) if keep == "smallest" else (F.max("_id"), F.desc_nulls_last("_id"))
    whole = Window.partitionBy("_range")
    measured = (
        sorted_rows.withColumn("_last", F.max("_run").over(whole))
        .withColumn("_edge", (F.col("_run") == 1) | (F.col("_run") == F.col("_last")))
        .withColumn("_best", best.over(run)).withColumn("_n", F.count("*").over(run))
        .withColumn("_place", F.row_number().over(run.orderBy(first)))
        .withColumn("_edge_text", F.when(F.col("_edge") & (F.col("_place") == 1), F.col("_text")))
    )
    table = written(measured.select("_id", "_sha", "_range", "_run", "_edge", "_best", "_n", "_place", "_edge_text", *[f"_c{i}" for i in range(len(carried))]), "sorted")

    ends = table.where("_edge_text is not null").select("_range", "_run", "_edge_text", "_best", "_n")
    joint = ends.groupBy("_edge_text").agg((F.min if keep == "smallest" else F.max)("_best").alias("_all_best"), F.sum("_n").alias("_all_n"), F.count("*").alias("_parts"))
    stitched = ends.join(joint.where("_parts > 1"), "_edge_text").select("_range", "_run", "_all_best", "_all_n")
    result = table.drop("_edge_text").join(stitched, ["_range", "_run"], "left")
    keep_id = F.coalesce("_all_best", "_best")
    return result.select(
        F.col("_id").alias(id_col), keep_id.alias("keep_id"), F.coalesce("_all_n", "_n").alias("group_size"),
        ((F.col("_place") == 1) & F.col("_id").eqNullSafe(keep_id)).alias("kept"), F.col("_sha").alias("text_sha256"),
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carried)])


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """Rows of ``df`` that stay, with its columns; a column named like a result of ``exact_duplicates`` comes back as it was."""
    hidden = {c: f"_in{i}" for i, c in enumerate(df.columns)}
    plain = df.select(*[F.col(f"`{c}`").alias(h) for c, h in hidden.items()])
    kept = exact_duplicates(plain, hidden[id_col], hidden[text_col], keep, tuple(hidden.values())).where("kept")
    return kept.select(*[F.col(h).alias(c) for c, h in hidden.items()])
