"""Near duplicates on word shingles: SuperMinHash signatures, banding, verification on full sets, union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm import words as W
from tallyloom.llm.shared import attach, components, slices, written

#: Signature length, rows per band. A pair of similarity 0.75 shares no band of 32 with a chance of 5 in a million.
SIGNATURE, BAND_ROWS = 128, 4
#: A pair is verified if at least so many of the 128 one-bit signatures agree: 112 are expected at 0.75, 92 is 5 sd below.
LEAST_BITS = 92
#: Members that one task verifies against one hub, and members per block of a posting list.
HUB_SHARE = 256
_DONE = np.uint32(0xFFFFFFFF)


def super_minhash(sets: list[np.ndarray], m: int = SIGNATURE) -> np.ndarray:
    """SuperMinHash signatures (one row of ``m`` uint32 per set; all ones for an empty set).

    Element d has a random permutation of the m places, drawn by Fisher-Yates from d's own random stream; its j-th
    draw puts the value j + r at the drawn place, r uniform in [0, 1), and each place keeps its minimum. Draws go
    step by step over all elements at once. A set stops as soon as all its places are below the next step.
    """
    signature = np.full((len(sets), m), _DONE, np.uint32)
    flat = signature.reshape(-1)
    sizes = np.array([len(s) for s in sets])
    element = np.concatenate(sets) if len(sets) else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    chunk = 1 << 16
    cuts = [0]
    for end in np.cumsum(sizes).tolist():  # whole sets, about a chunk of elements at a time
        if end - cuts[-1] >= chunk:
            cuts.append(end)
    for a, b in zip(cuts, [*cuts[1:], len(element)], strict=True):
        e, o = element[a:b], owner[a:b]
        places = None
        for j in range(m):
            if not len(e):
                break
            draw = W.mix(e, 2 * j + 11)
            k = j + ((draw >> np.uint64(40)) % np.uint64(m - j)).astype(np.int64)
            value = np.uint32(j << 24) | (draw & np.uint64(0xFFFFFF)).astype(np.uint32)
            if places is None:
                at = k if j == 0 else np.where(k == first, 0, k)  # step 1 of the permutation without its table
            else:
                at = places[np.arange(len(e)), k].astype(np.int64)
            np.minimum.at(flat, o * m + at, value)
            live = (signature[o[0]:o[-1] + 1].max(axis=1) >= np.uint32((j + 1) << 24))[o - o[0]]
            if j == 0:
                first = k
            elif places is None:
                places = np.tile(np.arange(m, dtype=np.uint8), (int(live.sum()), 1))
                row = np.arange(len(places))
                for step, drawn in ((0, first[live]), (1, k[live])):
                    kept = places[row, step].copy()
                    places[row, step] = places[row, drawn]
                    places[row, drawn] = kept
                e, o, first = e[live], o[live], first[live]
                continue
            else:
                row = np.arange(len(e))
                kept = places[:, j].copy()
                places[row, j] = places[row, k]
                places[row, k] = kept
                places = places[live]
            e, o, first = e[live], o[live], first[live]
    return signature


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower = W.spaced()
        for part, data, offsets in slices(batches, "text"):
            _, _, hashes, bounds = W.words(data, offsets, lower)
            sets = W.shingles(hashes, bounds, k)
            signature = super_minhash(sets)
            band = np.zeros((len(sets), SIGNATURE // BAND_ROWS), np.uint64)
            for i in range(BAND_ROWS):
                band = W.mix(band, 3) + W.mix(signature[:, i::BAND_ROWS], i + 5)
            band = W.mix(band + W.mix(np.arange(band.shape[1], dtype=np.uint64), 99)[None, :], 4)
            bits = np.packbits((signature & 1).astype(np.uint8), axis=1).view(np.int64)
            empty = np.array([not len(s) for s in sets])
            key = np.array([[W.mix(s, salt).sum(dtype=np.uint64) for salt in (1, 2)] for s in sets], np.uint64).reshape(-1, 2)
            key = key.view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * band.shape[1], pa.int32()), pa.array(band.view(np.int64).reshape(-1)))
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array([len(s) for s in sets], pa.int64()),
                pa.array(key[:, 0], mask=empty), pa.array(key[:, 1], mask=empty), lists, pa.array(bits[:, 0]), pa.array(bits[:, 1]),
            ], ["id", "n", "key1", "key2", "bands", "bits1", "bits2"])

    return run


def _verify(k: int, percent: int):
    """Rows come sorted by (hub, share, member first or not): a hub's set stays in memory while its members pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower, at, hub = W.spaced(), None, []
        for part, data, offsets in slices(batches, "text"):
            _, _, hashes, bounds = W.words(data, offsets, lower)
            sets = W.shingles(hashes, bounds, k)
            found = []
            rows = zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), sets, strict=True)
            for b, share, a, own in rows:
                if (b, share) != at:
                    at, hub = (b, share), []
                if a is None:
                    hub.append(own)
                    continue
                for other in hub:
                    both = len(np.intersect1d(own, other, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(other) - both):
                        found.append((a, b))
                        break
            kind = part.schema.field(0).type
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], kind), pa.array([x[1] for x in found], kind)], ["a", "b"])

    return run


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int, label: str) -> DataFrame:
    """Those of the ``pairs`` (a, b) whose full shingle sets are similar enough."""
    kind = pairs.schema["a"].dataType.simpleString()
    hubs = pairs.groupBy("b").count().select("b", F.explode(F.sequence(F.lit(0), F.floor((F.col("count") - 1) / HUB_SHARE))).alias("share"), "count")
    hubs = written(hubs, "hubs")
    shares = hubs.select("b", F.col("share").cast("long").alias("share"))
    counts = hubs.where("share = 0").select("b", "count")
    spread = F.pmod(F.xxhash64("a"), F.floor((F.col("count") - 1) / HUB_SHARE) + 1).cast("long")
    members = attach(pairs, counts, ["b"], "count", F.col("a")).select("b", spread.alias("share"), "a")
    member_rows = texts.join(members.withColumnRenamed("a", "id"), "id").select("b", "share", F.col("id").alias("a"), "text")
    hub_rows = texts.join(shares.withColumnRenamed("b", "id"), "id").select(F.col("id").alias("b"), "share", F.lit(None).cast(kind).alias("a"), "text")
    rows = hub_rows.union(member_rows).repartition("b", "share").sortWithinPartitions("b", "share", F.asc_nulls_first("a"))
    return written(rows.mapInArrow(_verify(k, percent), f"a {kind}, b {kind}"), label)


def _likely(a: str, b: str, percent: int):
    """Not ruled out by set sizes or one-bit signatures."""
    bits = lambda i: F.bit_count(F.col(f"{a}bits{i}").bitwiseXOR(F.col(f"{b}bits{i}")))
    sizes = F.least(f"{a}n", f"{b}n") * 100 >= F.greatest(f"{a}n", f"{b}n") * percent
    return sizes & (bits(1) + bits(2) <= SIGNATURE - LEAST_BITS)


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower = W.spaced()
        for part, data, offsets in slices(batches, "text"):
            _, _, hashes, bounds = W.words(data, offsets, lower)
            sets = [s.view(np.int64) for s in W.shingles(hashes, bounds, k)]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets)))
            yield pa.RecordBatch.from_arrays([part.column(0), lists], ["rep", "shingles"])

    return run


def _prefix_pairs(open_: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs across the components of ``open_`` that can be similar enough: none of these is left out.

    Each set is put in order of its shingles' numbers of documents, the rarest first. Two similar sets share a shingle
    that stands so early in both that enough others can follow it. Shingles of one document take their places but
    never meet, so documents that differ from all others in more than the similarity allows form no pair, however many
    share the rest of their text. In a shingle's posting list, its most frequent component is compared with the other
    components' documents only.
    """
    kind = open_.schema["rep"].dataType.simpleString()
    rows = texts.join(open_.select(F.col("rep").alias("id")), "id").mapInArrow(_sets(k), f"rep {kind}, shingles array<long>")
    each = written(rows.select("rep", F.explode("shingles").alias("shingle")).distinct(), "shingles")
    shared = written(each.groupBy("shingle").agg(F.count("*").alias("documents")).where("documents > 1"), "shared")
    known = attach(each, shared, ["shingle"], "documents", F.col("rep")).where("documents is not null")
    own = Window.partitionBy("rep")
    ranked = known.join(open_, "rep").withColumn("place", F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("documents", "shingle")) - 1)
    early = written(ranked.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100)), "prefixes")

    per = early.groupBy("shingle", "component").agg(F.count("*").alias("m"))
    main = per.groupBy("shingle").agg(F.max(F.struct("m", "component")).alias("top"), F.sum("m").alias("size"), F.count("*").alias("kinds")).where("kinds > 1")
    main = written(main.select("shingle", F.col("top.component").alias("main"), "size"), "main")
    listed = attach(early.drop("documents"), main, ["shingle"], "size", F.col("rep")).where("size is not null")
    blocks = F.floor((F.col("size") - 1) / HUB_SHARE)
    right = listed.withColumn("block", F.pmod(F.xxhash64("rep"), blocks + 1).cast("long"))
    minor = listed.where("component <> main").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks)))
    left = minor.select("shingle", "block", *[F.col(c).alias(f"l_{c}") for c in ("rep", "n", "bits1", "bits2", "component", "place")])
    once = (F.col("component") == F.col("main")) | (F.col("l_rep") < F.col("rep"))
    follow = F.least(F.col("l_n") - F.col("l_place"), F.col("n") - F.col("place"))
    enough = follow * (100 + percent) >= (F.col("l_n") + F.col("n")) * percent
    met = left.join(right, ["shingle", "block"]).where((F.col("l_component") != F.col("component")) & once & enough & _likely("l_", "", percent))
    return met.select(F.col("rep").alias("a"), F.col("l_rep").alias("b")).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """One row per row of ``df``: id, ``n_shingles``, ``component_id``, ``kept``.

    Documents are linked if their sets of distinct ``k``-word shingles (of A-Z lower-cased words between ASCII white
    space; with fewer words the whole sequence) have a similarity of ``percent`` or more; ``component_id`` is the
    smallest id reachable.

    1. Signatures; documents of equal sets form a class, and only its smallest id goes on.
    2. Bands of 4 rows. In each band's bucket all members are compared to one hub, not to each other: to the member
       with the largest buckets in all. Pairs ruled out by set sizes or one-bit signatures aside, the full sets decide.
       A hub of many members is verified in shares.
    3. Union-find. Buckets whose members are still in several components are compared to a second hub.
    4. Documents of buckets with several components left are compared across components, wherever ``_prefix_pairs``
       leaves a link possible. So buckets have no cap and no link is lost but by the chances above.

    Null text counts as empty; documents without words have an empty set, no links and their own id. Rows with one id
    count as one document. Rows without id are linked with nothing: null component, kept. An empty table gives an
    empty result. Other columns of ``df`` don't matter.
    """
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    sketch = written(docs.mapInArrow(_sketch(k), f"id {kind}, n long, key1 long, key2 long, bands array<long>, bits1 long, bits2 long"), "sketches")
    own = ["key1", "key2", "n"]
    valid = sketch.where("key1 is not null and id is not null")
    classes = written(valid.groupBy(*own).agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes")
    member = written(attach(valid.select("id", *own), classes, own, "copies", F.col("id")).select("id", "rep"), "members")

    reps = sketch.join(member.where("id = rep").select("id").distinct(), "id").select(F.col("id").alias("rep"), "n", "bits1", "bits2", "bands").distinct()
    keys = reps.select("rep", F.explode("bands").alias("key"))
    buckets = written(keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    met = attach(keys, buckets, ["key"], "size", F.col("rep")).where("size is not null").distinct()
    met = written(met, "met")  # of all keys only those that documents share go on, and only now with what is known of the documents
    weight = met.groupBy("rep").agg(F.sum("size").alias("weight"))
    live = written(met.join(weight, "rep").join(reps.drop("bands"), "rep").select("rep", "n", "bits1", "bits2", "key", "size", "weight"), "live")
    texts = written(docs.join(live.select(F.col("rep").alias("id")).distinct(), "id"), "texts")

    def with_hub(open_: DataFrame, *rank) -> DataFrame:
        """Pairs of each open bucket's members with its hub, the one of the highest rank."""
        hub = open_.groupBy("key").agg(F.max(F.struct(*rank, "rep", "n", "bits1", "bits2")).alias("hub"), F.count("*").alias("size"))
        hub = written(hub.select("key", "size", F.col("hub.rep").alias("h_rep"), *[F.col(f"hub.{c}").alias(f"h_{c}") for c in ("n", "bits1", "bits2")]), "hubs")
        joined = attach(open_.drop("size"), hub, ["key"], "size", F.col("rep"))
        return joined.where((F.col("rep") != F.col("h_rep")) & _likely("", "h_", percent))

    several_sets = member.groupBy("id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high")
    same_id = member.join(several_sets, "id").where("rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b"))
    first = written(with_hub(live, "weight").select(F.col("rep").alias("a"), F.col("h_rep").alias("b")).distinct(), "pairs")
    edges = [_verified(first, texts, k, percent, "links").union(same_id)]

    def still_open(linked: DataFrame) -> DataFrame:
        """Members, with components, of the buckets that hold several of them."""
        joined = live.join(components(linked).withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        several = joined.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).where("low < high")
        several = written(several, "several")
        return written(attach(joined.drop("size"), several, ["key"], "size", F.col("rep")).where("size is not null").drop("low", "high"), "open")

    open_ = still_open(edges[0])
    second = with_hub(open_, F.xxhash64("rep").alias("hash")).select(F.col("rep").alias("a"), F.col("h_rep").alias("b"))
    second = written(second.subtract(first), "pairs")
    edges.append(_verified(second, texts, k, percent, "links"))

    open_ = still_open(edges[0].union(edges[1])).select("rep", "n", "bits1", "bits2", "component").distinct()
    last = written(_prefix_pairs(written(open_, "open"), texts, k, percent).subtract(first).subtract(second), "pairs")
    edges.append(_verified(last, texts, k, percent, "links"))

    component = components(edges[0].union(edges[1]).union(edges[2])).withColumnRenamed("node", "rep")
    reached = member.join(component, "rep", "left").groupBy("id").agg(F.min(F.coalesce("component", "rep")).alias("component"))
    result = sketch.select("id", "n").join(reached, "id", "left")
    component_id = F.coalesce("component", "id")
    return result.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component_id.alias("component_id"),
        F.coalesce(F.col("id") == component_id, F.lit(True)).alias("kept"))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """Rows of ``df`` but those whose component has a smaller id, with its columns, whatever their names.

    Rows with one id stay or go together, rows without id stay. Null and empty texts are near to nothing, so they stay.
    An empty table gives an empty result.
    """
    hidden = {c: f"_in{i}" for i, c in enumerate(df.columns)}
    plain = df.select(*[F.col(f"`{c}`").alias(h) for c, h in hidden.items()])
    key = hidden[id_col]
    gone = near_duplicates(plain, key, hidden[text_col], k, percent).where("not kept").select(key).distinct()
    return plain.join(gone, key, "left_anti").select(*[F.col(h).alias(c) for c, h in hidden.items()])
