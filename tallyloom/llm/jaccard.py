"""Exact join of documents on the Jaccard similarity of their word n-grams, by set-relation skipping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import words as W
from tallyloom.llm.shared import attach, components, slices, written

#: So many of the most repeated n-grams at most come last in the order of n-grams (3 MB for every task).
FREQUENT = 1 << 18
#: N-grams that one count of repeats covers, and repeats in it that make an n-gram a candidate for the end of the order.
COUNTED, REPEATS = 1 << 22, 4
#: Entries of an index block, entries of a list that a task holds against the probes, members of a family that it holds.
SKIP, SHARE, FAMILY = 32, 256, 1024
#: Bucket keys of a set: sets of 80 % similarity share none of them with a chance of 6 in 100,000.
KEYS = 6
#: So many of the keys a set shares with its leader at least; 4.8 are expected at 80 %. Links of other sets are found later.
AGREE = 3
#: Leaders that a bucket's sets are compared with, one after the other, as long as they are in several components.
HUBS = 3
#: Words of the bitmap that tells which n-grams can be shared: 2 MB for every task, and as many rows.
BITMAP = 1 << 18
#: Pairs that a task forms at a time.
PAIRS = 1 << 20
#: Bits of a set's parity map.
PARITY = 256
#: Bits of the second map that sets of more n-grams than ``PARITY`` have.
WIDE = 4096


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """Of ``n`` n-grams so many at least are in any set that is similar enough."""
    return -(-percent * n // 100)


# ---- order of n-grams ----------------------------------------------------------

def _repeats(k: int):
    """(gram, n): n-grams found in several different sets of a run of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower, held, size, seen = W.spaced(), [], 0, set()

        def counted():
            grams, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(grams[n >= REPEATS].view(np.int64)), pa.array(n[n >= REPEATS])], ["gram", "n"])

        for _, data, offsets in slices(batches, "text"):
            _, _, hashes, bounds = W.words(data, offsets, lower)
            for grams in W.shingles(hashes, bounds, k):
                key = grams.tobytes() if len(grams) < 3 else (len(grams), int(grams[0]), int(grams[-1]), int(W.mix(grams, 1).sum(dtype=np.uint64)))
                if len(grams) and key not in seen:
                    seen.add(key)
                    held.append(grams)
                    size += len(grams)
            if size >= COUNTED:
                yield counted()
                held, size, seen = [], 0, set()
        if held:
            yield counted()

    return run


def frequent_grams(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``FREQUENT`` n-grams that repeat most, sorted, and their rank: the most repeated one has the highest.

    They only set the order of n-grams. With any order all links are found; with frequent ones last, fewer sets meet.
    """
    counted = written(docs.mapInArrow(_repeats(k), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "repeats")
    steps = counted.groupBy(F.floor(F.log2("n") * 8).cast("int").alias("step")).agg(F.count("*").alias("grams"), F.min("n").alias("least"))
    least, total = None, 0
    for row in sorted(steps.collect(), reverse=True):  # at most 8 rows per power of two
        total += row["grams"]
        if total > FREQUENT:
            break
        least = row["least"]
    if least is None:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    rows = counted.where(F.col("n") >= least).toArrow()
    grams, n = rows["gram"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    rank = np.empty(len(grams), np.int64)
    rank[np.lexsort((grams, n))] = np.arange(len(grams))
    order = np.argsort(grams)
    return grams[order], rank[order]


# ---- sets ----------------------------------------------------------------------

def _set_key(grams: np.ndarray) -> tuple[int, int]:
    return tuple(int(W.mix(grams, salt).sum(dtype=np.uint64).view(np.int64)) for salt in (1, 2))


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate([*parts, np.empty(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(flat))


def _sketch(k: int, percent: int, frequent: np.ndarray, rank: np.ndarray):
    """Per document: set size, set key, parity map, bucket keys (smallest n-grams by other hashes) and the first n-grams in the common order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower = W.spaced()
        for part, data, offsets in slices(batches, "text"):
            _, _, hashes, bounds = W.words(data, offsets, lower)
            sets = W.shingles(hashes, bounds, k)
            sizes = np.array([len(s) for s in sets])
            every = np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets)), sizes)
            parity = (np.bincount(owner * PARITY + (every & np.uint64(PARITY - 1)).astype(np.int64), minlength=len(sets) * PARITY) & 1).astype(np.uint8)
            parity = np.packbits(parity.reshape(len(sets), PARITY), axis=1).view(np.int64)
            wide = [np.packbits((np.bincount((s & np.uint64(WIDE - 1)).astype(np.int64), minlength=WIDE) & 1).astype(np.uint8)).view(np.uint64) if len(s) > PARITY else s[:0] for s in sets]
            late = np.full(len(every), -1)
            if len(frequent) and len(every):
                at = np.minimum(np.searchsorted(frequent, every), len(frequent) - 1)
                late = np.where(frequent[at] == every, rank[at], -1)
            filled = sizes > 0
            buckets = np.zeros((len(sets), KEYS), np.uint64)
            heads = (np.cumsum(sizes) - sizes)[filled]
            for i in range(KEYS if len(heads) else 0):
                buckets[filled, i] = W.mix(np.minimum.reduceat(W.mix(every, i + 20), heads), i)
            early, keys, begin = [], [], 0
            for n, grams in zip(sizes.tolist(), sets, strict=True):
                mine, begin = late[begin:begin + n], begin + n
                if n and mine.max() >= 0:
                    grams = grams[np.lexsort((grams, mine))]
                early.append(grams[:n - int(least_overlap(n, percent)) + 1] if n else grams)
                keys.append(_set_key(grams) if n else (None, None))
            yield pa.RecordBatch.from_arrays([
                part.column("id"), part.column("hash"), pa.array(sizes, pa.int64()), *[pa.array([x[i] for x in keys], pa.int64()) for i in (0, 1)],
                *[pa.array(np.ascontiguousarray(parity[:, i])) for i in range(4)], _lists([b if n else b[:0] for b, n in zip(buckets, sizes, strict=True)]), _lists(wide), _lists(early),
            ], ["id", "hash", "n", "key1", "key2", "p0", "p1", "p2", "p3", "buckets", "wide", "early"])

    return run


def _whole_sets(k: int):
    """The sets of those documents whose key is that of the row they were asked for by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower = W.spaced()
        for part, data, offsets in slices(batches, "text"):
            _, _, hashes, bounds = W.words(data, offsets, lower)
            asked = zip(part.column("rep").to_pylist(), part.column("key1").to_pylist(), part.column("key2").to_pylist(), W.shingles(hashes, bounds, k), strict=True)
            found = {rep: grams for rep, key1, key2, grams in asked if _set_key(grams) == (key1, key2)}
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), _lists(list(found.values()))], ["rep", "grams"])

    return run


def _near(a: str, b: str, percent: int) -> Column:
    """Not ruled out by the set sizes, nor by the parity maps: where they differ, the sets differ."""
    differ = sum((F.bit_count(F.col(f"{a}p{i}").bitwiseXOR(F.col(f"{b}p{i}"))) for i in range(1, 4)), F.bit_count(F.col(f"{a}p0").bitwiseXOR(F.col(f"{b}p0"))))
    sizes = F.least(f"{a}n", f"{b}n") * 100 >= F.greatest(f"{a}n", f"{b}n") * percent
    return sizes & (differ * (100 + percent) <= (F.col(f"{a}n") + F.col(f"{b}n")) * (100 - percent))


def _still_near(pairs: DataFrame, families: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (a, leader) that the wide maps don't rule out.

    No member differs from the leader in more n-grams than the family's widest one, so the bound is that much wider.
    """
    apart = families.groupBy("leader").agg(F.max(F.size("lack") + F.size("besides")).alias("apart"))
    facts = lambda key, n, wide: reps.select(F.col("rep").alias(key), F.col("n").alias(n), F.col("wide").alias(wide))
    both = pairs.join(facts("a", "n", "wide"), "a").join(facts("leader", "l_n", "l_wide"), "leader").join(apart, "leader", "left")
    differ = F.aggregate(F.zip_with("wide", "l_wide", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda done, n: done + n)
    apart = F.coalesce("apart", F.lit(0))
    room = (F.col("n") + F.col("l_n") + apart) * (100 - percent) + apart * (100 + percent)
    near = (F.size("wide") == 0) | (F.size("l_wide") == 0) | (differ * (100 + percent) <= room)
    return written(both.where(near).select("a", "leader"), "near")


# ---- verification --------------------------------------------------------------

def _array(cell: pa.Scalar) -> np.ndarray:
    return cell.values.to_numpy().view(np.uint64) if cell.is_valid else np.empty(0, np.uint64)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) < len(b):
        a, b = b, a
    if not len(b):
        return 0
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    return int((a[at] == b).sum())


def _against_hub(percent: int):
    """Rows sorted by (hub, share, hub first): members that are linked, with what they lack of the hub and have besides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = hub = None
        for batch in batches:
            links, lack, besides = [], [], []
            grams = batch.column("grams")
            for i, (b, share, a) in enumerate(zip(batch.column("b").to_pylist(), batch.column("share").to_pylist(), batch.column("a").to_pylist(), strict=True)):
                own = _array(grams[i])
                if a is None:
                    at, hub = (b, share), own
                    continue
                assert (b, share) == at
                both = _common(own, hub)
                if 100 * both >= percent * (len(own) + len(hub) - both):
                    links.append((a, b))
                    lack.append(np.setdiff1d(hub, own, assume_unique=True))
                    besides.append(np.setdiff1d(own, hub, assume_unique=True))
            yield pa.RecordBatch.from_arrays([*[pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], _lists(lack), _lists(besides)], ["a", "b", "lack", "besides"])

    return run


def _shared_out(pairs: DataFrame, hub: str, member: str, spread: Column) -> tuple[DataFrame, DataFrame]:
    """The pairs with a ``share`` of their hub, about ``SHARE`` members each, and the hubs' shares."""
    counts = written(pairs.groupBy(hub).agg(F.count("*").alias("members")), "counts")
    shares = F.floor((F.col("members") - 1) / SHARE) + 1
    dealt = attach(pairs, counts, [hub], "members", F.col(member)).withColumn("share", F.pmod(F.xxhash64(spread), shares)).drop("members")
    return dealt, counts.select(hub, F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)).alias("share"))


def _families(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the ``pairs`` (a: member, b: hub) that are links, with the differences of the member's set."""
    dealt, hubs = _shared_out(pairs, "b", "a", F.col("a"))
    member_rows = dealt.join(sets.withColumnRenamed("rep", "a"), "a").select("b", "share", "a", "grams")
    hub_rows = hubs.join(sets.withColumnRenamed("rep", "b"), "b").select("b", "share", F.lit(None).cast("long").alias("a"), "grams")
    rows = hub_rows.union(member_rows).repartition("b", "share").sortWithinPartitions("b", "share", F.asc_nulls_first("a"))
    return written(rows.mapInArrow(_against_hub(percent), "a long, b long, lack array<long>, besides array<long>"), "families")


def _derived(percent: int):
    """Rows sorted by (leader, part, share, kind): the leader's set, the differences of its family, then the probes.

    A member's answer comes from its leader's: the overlap with the leader, less what the member lacks of it and the
    probe has, plus what the member has besides and the probe has too. A probe with one link to the family is linked
    with its leader's component, which is all that is asked.
    """

    def within(parts: list[np.ndarray], probe: np.ndarray) -> np.ndarray:
        """How many n-grams of each part the probe has."""
        flat = np.concatenate([*parts, np.empty(0, np.uint64)])
        at = np.minimum(np.searchsorted(probe, flat), len(probe) - 1)
        return np.diff(np.concatenate([[0], np.cumsum(probe[at] == flat)])[np.cumsum([0, *map(len, parts)])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, lack, besides = np.empty(0, np.uint64), [], []
        for batch in batches:
            found = []
            grams, less, more = batch.column("grams"), batch.column("lack"), batch.column("besides")
            for i, (key, kind, a) in enumerate(zip(batch.column("leader").to_pylist(), batch.column("kind").to_pylist(), batch.column("a").to_pylist(), strict=True)):
                if kind == 0:  # the leader is the member of its family that differs in nothing
                    leader, lack, besides = _array(grams[i]), [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
                elif kind == 1:
                    lack.append(_array(less[i]))
                    besides.append(_array(more[i]))
                else:
                    probe = _array(grams[i])
                    both = _common(probe, leader) - within(lack, probe) + within(besides, probe)
                    sizes = len(leader) - np.array([len(x) for x in lack]) + np.array([len(x) for x in besides])
                    if (100 * both >= percent * (len(probe) + sizes - both)).any():
                        found.append((a, key))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def _answers(pairs: DataFrame, families: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the ``pairs`` (a: probe, leader) where the probe is linked with one of the leader's family, as (a, b: leader)."""
    probes = pairs.groupBy("leader").agg(F.count("*").alias("probes"))
    sizes = families.groupBy("leader").agg(F.count("*").alias("size"))
    facts = probes.join(sizes, "leader", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    steps = lambda n, step: F.floor((F.greatest(n, F.lit(1)) - 1) / step) + 1
    facts = written(facts.withColumns({"shares": steps(F.col("probes"), SHARE), "parts": steps(F.col("size"), FAMILY)}), "facts")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    number, none = F.lit(None).cast("long"), F.lit(None).cast("array<long>")
    asked = attach(pairs, facts.select("leader", "probes", "shares", "parts"), ["leader"], "probes", F.col("a"))
    asked = asked.withColumns({"share": F.pmod(F.xxhash64("a"), F.col("shares")), "part": upto("parts")}).join(sets.withColumnRenamed("rep", "a"), "a")
    family = attach(families, facts.where("size > 0").select("leader", "size", "shares", "parts"), ["leader"], "size", F.col("a")).where("size is not null")
    family = family.withColumns({"part": F.pmod(F.xxhash64("a"), F.col("parts")), "share": upto("shares")})
    heads = facts.withColumn("part", upto("parts")).withColumn("share", upto("shares")).join(sets.withColumnRenamed("rep", "leader"), "leader")
    place = ["leader", "part", "share"]
    rows = (
        heads.select(*place, F.lit(0).alias("kind"), number.alias("a"), "grams", none.alias("lack"), none.alias("besides"))
        .union(family.select(*place, F.lit(1), number, none, "lack", "besides"))
        .union(asked.select(*place, F.lit(2), "a", "grams", none, none)))
    rows = rows.repartition(*place).sortWithinPartitions(*place, "kind")
    return written(rows.mapInArrow(_derived(percent), "a long, b long").distinct(), "links")


# ---- index lists ---------------------------------------------------------------

def _skipping(percent: int):
    """Rows sorted by (gram, block, entries first, place): pairs of a probe and an entry's leader that can be similar enough.

    Entries of a list come by the n-gram's place in their set and stand in blocks of 32. After the place of a match only
    the rest of either set can match. So a whole block is skipped if not even its largest set would match enough from
    the block's first place on, or if all its sets are too small or too large. All lists of a batch pass at once.
    """
    t = percent / 100

    def ranges(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which range, and which number in it, for all numbers of the ranges."""
        n = end - begin
        which = np.repeat(np.arange(len(n)), n)
        return which, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)

    def met(c: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        rows = np.arange(len(c["gram"]))
        key = np.cumsum(np.concatenate([[True], (np.diff(c["gram"]) != 0) | (np.diff(c["block"]) != 0)])) - 1
        entry, probe = rows[c["probe"] == 0], rows[c["probe"] == 1]
        if not len(entry) or not len(probe):
            return
        of = key[entry]
        starts = np.flatnonzero(np.concatenate([[True], np.diff(of) != 0]))
        inner = np.arange(len(entry)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(entry)]])))
        heads = np.flatnonzero(inner % SKIP == 0)
        tails = np.concatenate([heads[1:], [len(entry)]])
        sizes = c["n"][entry]
        low, high, first = np.minimum.reduceat(sizes, heads), np.maximum.reduceat(sizes, heads), c["place"][entry][heads]
        begin, end = (np.searchsorted(of[heads], key[probe], side) for side in ("left", "right"))
        cost = np.cumsum((end - begin) * SKIP)
        for a in range(0, int(cost[-1]) + 1, PAIRS):  # probes of about as many pairs at a time
            some = np.flatnonzero((cost > a) & (cost <= a + PAIRS))
            i, block = ranges(begin[some], end[some])
            i = probe[some][i]
            n = c["n"][i]
            room = (high[block] / (1 + t) - t / (1 + t) * n + 1e-6 >= first[block]) & (high[block] >= t * n - 1e-6) & (low[block] * t <= n + 1e-6)
            i, block = i[room], block[room]
            which, j = ranges(heads[block], tails[block])
            i, j = i[which], entry[j]
            total = c["n"][i] + c["n"][j]
            ok = np.minimum(c["n"][i] - c["place"][i], c["n"][j] - c["place"][j]) * (100 + percent) >= total * percent
            ok &= (c["component"][i] != c["component"][j]) & ((c["component"][j] == c["main"][j]) | (c["rep"][i] < c["rep"][j]))
            i, j, total = i[ok], j[ok], total[ok]
            differ = sum(np.bitwise_count((c[f"p{x}"][i] ^ c[f"p{x}"][j]).view(np.uint64)).astype(np.int64) for x in range(4))
            ok = differ * (100 + percent) <= total * (100 - percent)
            yield c["rep"][i[ok]], c["leader"][j[ok]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            c = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in batch.schema.names}
            if kept:
                c = {name: np.concatenate([kept[name], v]) for name, v in c.items()}
            if not len(c["gram"]):
                continue
            for a, b in met(c):
                pairs = np.unique(np.stack([a, b]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0], pa.int64()), pa.array(pairs[1], pa.int64())], ["a", "leader"])
            # The last list may go on in the next batch: its entries stay.
            last = (c["gram"] == c["gram"][-1]) & (c["block"] == c["block"][-1]) & (c["probe"] == 0)
            kept = {name: v[last] for name, v in c.items()}

    return run


def _candidates(reps: DataFrame, early: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, leader): a set, and the leader of another component's set that shares one of its first n-grams.

    The first n-grams of two similar sets, all but 80 % in the common order, have one in common, so no link is left
    out. Of a list, the most frequent component is met by the others' sets only: its own ones need no further link.
    Lists of one component are the most by far; a bitmap of the n-grams of the others keeps most of them from the join.
    """
    rows = early.join(reps.select("rep", "component"), "rep").select("rep", "component", F.posexplode("early").alias("place", "gram"))
    rows = written(rows, "early")
    shared = rows.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("gram")
    shared = written(shared, "shared")
    word = F.pmod(F.xxhash64("gram"), F.lit(BITMAP))
    one = F.expr("shiftleft(1L, cast(shiftrightunsigned(gram, 58) as int))")
    bitmap = shared.groupBy(word.alias("word")).agg(F.bit_or(one).alias("bits"))
    likely = rows.withColumns({"word": word, "one": one}).join(F.broadcast(bitmap), "word").where(F.col("bits").bitwiseAND(F.col("one")) != 0).select(*rows.columns)
    counted = written(likely.groupBy("gram", "component").agg(F.count("*").alias("m")).join(shared, "gram"), "counted")
    main = counted.groupBy("gram").agg(F.max(F.struct("m", "component")).alias("top"), F.sum("m").alias("size"))
    main = written(main.select("gram", F.col("top.component").alias("main"), "size"), "main")
    listed = attach(likely, main, ["gram"], "size", F.col("rep")).where("size is not null")
    facts = reps.select("rep", "n", "leader", "p0", "p1", "p2", "p3")
    listed = written(listed.join(facts, "rep").withColumn("blocks", F.floor((F.col("size") - 1) / SHARE) + 1), "listed")
    kept = ["gram", "block", "probe", "place", "rep", "leader", "component", "main", "n", "p0", "p1", "p2", "p3"]
    entries = listed.withColumns({"block": F.pmod(F.xxhash64("rep"), F.col("blocks")), "probe": F.lit(0)}).select(*kept)
    probes = listed.where("component <> main").withColumns({"block": F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)), "probe": F.lit(1)}).select(*kept)
    dealt = entries.union(probes).repartition("gram", "block").sortWithinPartitions("gram", "block", "probe", "place")
    return written(dealt.mapInArrow(_skipping(percent), "a long, leader long").distinct(), "candidates")


# ---- the join ------------------------------------------------------------------

def ngram_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``df``: id, ``n_shingles``, ``component_id``.

    Documents are linked if their sets of distinct ``k``-word n-grams (of A-Z lower-cased words between ASCII white
    space; with fewer words the whole sequence) have a similarity of ``percent`` or more. ``component_id`` is the
    smallest id reachable over links. The join is exact but for collisions of 64-bit hashes of n-grams and words.

    1. All n-grams have one order, by hash, the most repeated ones last. Documents of equal sets are one set.
    2. Highly similar sets: those with an equal smallest n-gram by one of six other hashes are compared with one of
       them, the leader. Linked ones are its family, each kept as its difference from the leader.
    3. Index lists of the sets' first n-grams, with the place of the n-gram in the set. Sets meet if they are in
       different components, blocks that no probe can match are skipped (:func:`_skipping`).
    4. A probe is compared in full with a family's leader only; the answers of the others follow from that one
       (:func:`_derived`).

    Links within a component are not listed one by one: once two sets are connected they aren't compared again.

    Null text counts as empty; documents without words have an empty set, no links, and their own id. Every row is a
    document, repeated ids and null ids too; a null id is no smallest id unless there is no other. An empty table
    gives an empty result. Other columns of ``df`` don't matter.
    """
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(f"`{text_col}`").alias("hash"))
    kind = docs.schema["id"].dataType.simpleString()
    frequent, rank = frequent_grams(docs.select("text"), k)
    schema = f"id {kind}, hash long, n long, key1 long, key2 long, p0 long, p1 long, p2 long, p3 long, buckets array<long>, wide array<long>, early array<long>"
    sketch = written(docs.mapInArrow(_sketch(k, percent, frequent, rank), schema).withColumn("row", F.monotonically_increasing_id()), "sketches")

    own, parity = ["key1", "key2", "n"], ["p0", "p1", "p2", "p3"]
    valid = sketch.where("n > 0")
    classes = written(valid.groupBy(*own).agg(F.min("row").alias("rep"), F.min("id").alias("low"), F.count("*").alias("copies")), "classes")
    reps = written(sketch.withColumnRenamed("row", "rep").select("rep", "id", "hash", *own, *parity, "buckets", "wide").join(classes.select("rep"), "rep"), "sets")

    keys = reps.select("rep", F.posexplode("buckets").alias("kind", "key"))
    buckets = written(keys.groupBy("kind", "key").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    inside = attach(keys, buckets, ["kind", "key"], "size", F.col("rep")).where("size is not null")
    weight = inside.groupBy("rep").agg(F.sum("size").alias("weight"))
    inside = written(inside.join(weight, "rep").join(reps.select("rep", "n", "buckets", *parity), "rep"), "inside")
    def whole_sets(needed: DataFrame) -> DataFrame:
        asked = reps.join(needed.distinct(), "rep").select("rep", "id", "hash", "key1", "key2")
        texts = docs.withColumnRenamed("id", "of").join(asked, F.col("of").eqNullSafe(F.col("id")) & (docs["hash"] == asked["hash"])).select("rep", "key1", "key2", "text")
        return written(texts.mapInArrow(_whole_sets(k), "rep long, grams array<long>"), "grams")

    def with_hub(members: DataFrame, *rank: Column) -> DataFrame:
        """Pairs (a, b) of the members of each bucket with its hub, the one of the highest rank, if their components differ."""
        facts = ["rep", "component", "n", "buckets", *parity]
        hub = members.groupBy("kind", "key").agg(F.count("*").alias("size"), F.max(F.struct(*rank, *facts)).alias("hub"))
        hub = written(hub.select("kind", "key", "size", *[F.col(f"hub.{c}").alias(f"h_{c}") for c in facts]), "hubs")
        agree = F.size(F.filter(F.zip_with("buckets", "h_buckets", lambda x, y: x == y), lambda same: same))
        met = attach(members.drop("size"), hub, ["kind", "key"], "size", F.col("rep")).where((F.col("component") != F.col("h_component")) & (agree >= AGREE) & _near("", "h_", percent))
        return written(met.select(F.col("rep").alias("a"), F.col("h_rep").alias("b")).distinct(), "pairs")

    def still_open(members: DataFrame, component: DataFrame) -> DataFrame:
        """The buckets whose members are in several components."""
        placed = members.drop("component", "size").join(component.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        several = placed.groupBy("kind", "key").agg(F.count("*").alias("size"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
        return written(attach(placed, written(several.select("kind", "key", "size"), "several"), ["kind", "key"], "size", F.col("rep")).where("size is not null"), "open")

    members, linked = inside.withColumn("component", F.col("rep")), None
    for i in range(HUBS):
        pairs = with_hub(members, *([F.xxhash64("rep", F.lit(i)).alias("rank")] if i else [F.col("weight")]))
        found = _families(pairs, whole_sets(pairs.select(F.explode(F.array("a", "b")).alias("rep"))), percent)
        linked = linked.union(found) if linked else found
        component = components(linked.select("a", "b"))
        members = still_open(members, component) if i + 1 < HUBS else members
    # A leader of others stays with its own family; every other member goes to the leader of the most members.
    leads = linked.groupBy("b").agg(F.count("*").alias("led"))
    ranked = linked.select("a", "b").join(leads, "b").groupBy("a").agg(F.max(F.struct("led", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
    families = written(linked.join(ranked, ["a", "b"]).select("a", F.col("b").alias("leader"), "lack", "besides"), "families")
    held = reps.select("rep", "n", *parity).join(component.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    held = held.join(families.select(F.col("a").alias("rep"), "leader"), "rep", "left").withColumn("leader", F.coalesce("leader", "rep"))
    pairs = _candidates(written(held, "held"), sketch.select(F.col("row").alias("rep"), "early"), percent)
    pairs = _still_near(pairs, families, reps, percent)
    links = _answers(pairs, families, whole_sets(pairs.select(F.explode(F.array("a", "leader")).alias("rep"))), percent)

    component = components(linked.select("a", "b").union(links)).withColumnRenamed("node", "rep")
    classes = classes.join(component, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    lowest = written(classes.groupBy("component").agg(F.min("low").alias("lowest"), F.count("*").alias("classes")), "lowest")
    reached = attach(classes.select(*own, "copies", "component"), lowest, ["component"], "classes", F.col("key1")).select(*own, "copies", "lowest")
    result = attach(sketch.select("id", "row", *own), written(reached, "reached"), own, "copies", F.col("row"))
    return result.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("lowest", "id").alias("component_id"))
