"""What several operators of this subpackage need: written tables, joins that stand hot keys, components, Arrow texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.session import scratch_dir

#: Bytes of text that a task works on at once; a longer text is worked on alone.
SLICE_BYTES = 2 << 20


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, spread: Column) -> DataFrame:
    """Left join of ``rows`` to ``groups`` (one row per key; ``size``: how many rows have it), whatever a key's share.

    Groups of more than 1/P of all rows (P: shuffle partitions) are fewer than P, which bounds their broadcast. Their
    rows pass the second join spread by ``spread``; the others meet their group in a shuffle join.
    """
    spark = rows.sparkSession
    parts = partitions(spark)
    total = groups.agg(F.sum(size)).first()[0] or 0
    limit = total // parts
    values = [c for c in groups.columns if c not in keys]
    hot = groups.where(F.col(size) > limit).select(*keys, *[F.col(v).alias(f"_hot_{v}") for v in values])
    cold = groups.where(F.col(size) <= limit).withColumn("_at", F.lit(-1).cast("long"))
    at = F.when(F.col(f"_hot_{size}").isNull(), F.lit(-1).cast("long")).otherwise(F.pmod(F.xxhash64(spread), F.lit(4 * parts)))
    joined = rows.join(F.broadcast(hot), keys, "left").withColumn("_at", at).join(cold, [*keys, "_at"], "left")
    picked = {v: F.coalesce(F.col(f"_hot_{v}"), F.col(v)) for v in values}
    return joined.select(*[F.col(c) for c in rows.columns if c not in values], *[picked[v].alias(v) for v in values])


def numbered(rows: DataFrame, group: list[str], order: list[str], at: str, total: str) -> DataFrame:
    """``rows`` with their place in the group, from 0, and the group's number of rows, whatever a group's share.

    Rows are sorted by ranges of (group, order), nulls first, and the ranges fixed in a written table; a group counts
    on from range to range. Columns of ``group`` have no nulls.
    """
    keys = [F.col(c) for c in (*group, *order)]
    placed = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id()), "ranges")
    placed = placed.withColumn("_range", F.shiftright("_place", 33))
    runs = placed.groupBy(*group, "_range").agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy(*group)
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(*group, "_range", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias(total))
    return placed.join(runs, [*group, "_range"]).withColumn(at, F.col("_place") + F.col("_shift")).drop("_place", "_range", "_shift")


# ---- connected components ------------------------------------------------------

def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of one task: each node with the smallest one it reaches."""
    parent: dict = {}

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    for i in range(0, len(nodes), 10_000):
        part = nodes[i:i + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([root(x) for x in part])], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over the links ``a``-``b`` (columns of whole numbers or strings).

    Every task unites its own links first, which leaves a forest; then labels pass along the forest's links and jump
    to their own label's label, until none changes. Each round is a written table.
    """
    kind = edges.schema["a"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    forest = written(edges.select("a", "b").mapInArrow(_forest, schema).where("a <> b").distinct(), "forest")
    both = forest.union(forest.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("component")), "labels")
    while True:
        heard = both.join(label.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("heard"))
        better = label.join(heard, "node").select("node", F.col("component").alias("was"), F.least("component", "heard").alias("via"))
        jump = label.select(F.col("node").alias("via"), F.col("component").alias("far"))
        step = written(better.join(jump, "via", "left").select("node", "was", F.least("via", F.coalesce("far", "via")).alias("component")), "labels")
        label = step.select("node", "component")
        if step.where("component <> was").isEmpty():
            return label


# ---- texts in Arrow batches ----------------------------------------------------

def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of the batches with at most ``limit`` bytes of text (or one row), each with its UTF-8 bytes and row offsets; null is empty."""
    for batch in batches:
        column = pc.fill_null(batch.column(batch.schema.get_field_index(text)), "").cast(pa.large_string())
        if not len(column):
            continue
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
        begin = 0
        while begin < len(column):
            end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + limit, "right")) - 1)
            yield batch.slice(begin, end - begin), data[offsets[begin]:offsets[end]], offsets[begin:end + 1] - offsets[begin]
            begin = end
