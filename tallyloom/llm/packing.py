"""Harmonic packing of documents into sequences of one length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.shared import slices, written
from tallyloom.llm.tokenise import END_ID, encoder

#: Most pieces that the rest of a document, after its full sequences, is cut into.
REST_PIECES = 3
#: A rest whose own class leaves no more than this part of a bin empty is not cut.
SLACK = 1 / 64


def harmonic_cuts(length: int, capacity: int, pieces: int = REST_PIECES) -> list[int]:
    """Piece lengths of a document: full sequences, then reciprocal parts of the capacity, the last piece as it comes.

    A piece of capacity // k tokens fills its place in a bin of k pieces; only the last piece leaves room, less than
    capacity / (k * (k + 1)) for its class k. A rest that fills its place well enough stays whole.
    """
    cuts = [capacity] * (length // capacity)
    rest = length % capacity
    for _ in range(pieces - 1):
        if rest == 0 or capacity // rest * rest >= (1 - SLACK) * capacity:
            break
        part = capacity // -(-capacity // rest)
        cuts.append(part)
        rest -= part
    return cuts + [rest] * (rest > 0)


def _pieces(tokenizer: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for part, data, offsets in slices(batches, "text"):
            rows = []
            raw = data.tobytes()
            for i, (row, key) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)):
                ids = np.append(encode(raw[offsets[i]:offsets[i + 1]].decode()), np.uint32(end_id)).astype("<u4")
                at = 0
                for n in harmonic_cuts(len(ids), capacity):
                    piece = ids[at:at + n].tobytes()
                    rows.append((row, key, at, n, len(ids), capacity // n, zlib.crc32(piece), piece))
                    at += n
            names = ["row", "id", "start", "length", "doc_tokens", "k", "ids_crc32", "ids"]
            kinds = [pa.int64(), part.schema.field(1).type, pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def _fill(capacity: int):
    """Best fit of the last, unfilled bins' pieces: fewer than the sum of the classes' k."""

    def run(pieces):
        pieces = pieces.sort_values(["length", "row", "start"], ascending=[False, True, True])
        room: list[int] = []
        bins, offsets = [], []
        for n in pieces["length"]:
            fits = [i for i, r in enumerate(room) if r >= n]
            best = min(fits, key=room.__getitem__, default=len(room))
            if best == len(room):
                room.append(capacity)
            bins.append(best)
            offsets.append(capacity - room[best])
            room[best] -= n
        return pieces[["row", "start"]].assign(bin=bins, offset=offsets)

    return run


def pack(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048,
    tokenizer: str = "byte_bpe_50k.json", end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``, ``ids``.

    A document's ids, then ``end_id``, are cut by ``harmonic_cuts``. A piece of length n is of class k = capacity // n,
    and each bin of class k takes k pieces, whatever they are: no search. Tasks count their pieces by class; the counts
    before a task say in which bin and place its pieces go, so all tasks fill bins independently and a class has one
    unfilled bin in all. At most 90 classes exist for 2,048 tokens, so the unfilled bins' pieces (under 10,000) are
    put together by best fit. ``ids`` holds the piece's ids as little-endian 32-bit numbers; see ``sequences``.

    Null and empty texts are one piece of ``end_id``. Null and repeated ids are kept as they are; every row is packed.
    An empty table gives an empty result. Other columns of ``df`` don't matter.
    """
    kind = df.schema[id_col].dataType.simpleString()
    docs = df.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = f"row long, id {kind}, start long, length long, doc_tokens long, k int, ids_crc32 long, ids binary"
    pieces = written(docs.mapInArrow(_pieces(tokenizer, capacity, end_id), schema).withColumn("task", F.spark_partition_id()), "pieces")

    narrow = pieces.select("task", "row", "start", "length", "k")
    before = Window.partitionBy("k").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tallies = narrow.groupBy("k", "task").count()
    starts = tallies.select("k", "task", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"), F.sum("count").over(Window.partitionBy("k")).alias("all"))
    placed = (
        narrow.withColumn("nth", F.row_number().over(Window.partitionBy("k", "task").orderBy("row", "start")) - 1)
        .join(starts, ["k", "task"]).withColumn("nth", F.col("nth") + F.col("before"))
        .withColumn("bin", F.floor(F.col("nth") / F.col("k"))).withColumn("full", F.col("bin") < F.floor(F.col("all") / F.col("k")))
    )
    placed = written(placed.select("row", "start", "length", "k", "nth", "bin", "full"), "placed")
    in_bin = Window.partitionBy("k", "bin").orderBy("nth")
    full = placed.where("full").select("row", "start", "k", "bin", (F.sum("length").over(in_bin) - F.col("length")).alias("offset"))
    loose = placed.where("not full").select("row", "start", "length", F.lit("rest").alias("kind")).groupBy("kind").applyInPandas(_fill(capacity), "row long, start long, bin long, offset long")
    seats = full.unionByName(loose.withColumn("k", F.lit(0)))
    # Sequences are numbered class by class: a class's bins follow those of the smaller classes.
    bins = seats.groupBy("k").agg((F.max("bin") + 1).alias("bins"))
    base = bins.select("k", F.coalesce(F.sum("bins").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    seats = seats.join(base, "k").select("row", "start", (F.col("base") + F.col("bin")).cast("long").alias("sequence_id"), F.col("offset").cast("long").alias("offset"))
    return pieces.join(seats, ["row", "start"]).select(
        F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id``, ``length``, ``ids`` (binary): the pieces of each sequence joined in order, at most a capacity's ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    ids = F.aggregate(parts, F.lit(bytearray()), lambda done, p: F.concat(done, p["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), ids.alias("ids"))
