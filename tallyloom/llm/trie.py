"""Prefix trie of conversations: shards of sorted turn sequences as double-array tries, upper nodes merged across shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.shared import attach, numbered, written

#: Turns of a segment; a longer conversation goes on in the tries that begin at its segment's last node.
SEGMENT = 256
#: Cells (sequences times the longest one's turns) of a shard's trie.
SHARD_CELLS = 1 << 18
#: Free places that are tried for a node's children before they go to the end of the arrays.
TRIES = 32
#: Bytes of joined ids that are hashed at a time.
CHUNK = 1 << 16
HEAD_TURNS = 5


# ---- conversations as turn digests ---------------------------------------------

def turn_digests(df: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, at, total, t1, t2, chars): the turns in order, from 0, each with a 128-bit digest of (role, text)."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = df.where(F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").cast("long").alias("conv"), F.col(f"`{turn_col}`").alias("turn"),
        F.xxhash64(role, text).alias("t1"), F.xxhash64(F.lit(11), text, role).alias("t2"), F.char_length(text).cast("long").alias("chars"))
    return written(numbered(rows, ["conv"], ["turn", "t1", "t2"], "at", "total").drop("turn"), "turns")


def with_shared_heads(turns: DataFrame) -> DataFrame:
    """(conv, depth, t1, t2, chars): the first h turns of conversation c - c % 100, then c's own after its first h; h is crc32(c) % 6.

    A conversation that has no turn left is a row with depth 0.
    """
    head = F.crc32(F.col("conv").cast("string")) % 6
    base = F.col("conv") - F.col("conv") % 100
    convs = turns.groupBy("conv").agg(F.max("total").alias("total"))
    totals = convs.where("conv % 100 = 0").select(F.col("conv").alias("base"), F.col("total").alias("base_total"))
    facts = convs.withColumns({"base": base, "h": head}).join(totals, "base", "left")
    facts = written(facts.withColumn("heads", F.least("h", F.coalesce("base_total", F.lit(0)))).select("conv", "base", "h", "heads", "total"), "facts")

    lent = turns.where((F.col("conv") % 100 == 0) & (F.col("at") < HEAD_TURNS)).select(F.col("conv").alias("base"), "at", "t1", "t2", "chars")
    first = facts.select("conv", "base", "h").join(lent, "base").where("at < h").select("conv", (F.col("at") + 1).alias("depth"), "t1", "t2", "chars")
    own = attach(turns.drop("total"), facts.select("conv", "h", "heads", "total"), ["conv"], "total", F.col("at")).where("at >= h")
    own = own.select("conv", (F.col("heads") + F.col("at") - F.col("h") + 1).alias("depth"), "t1", "t2", "chars")
    zero = F.lit(0).cast("long")
    bare = facts.where("heads = 0 and total <= h").select("conv", zero.alias("depth"), zero.alias("t1"), zero.alias("t2"), zero.alias("chars"))
    return first.union(own).union(bare)


# ---- double arrays -------------------------------------------------------------

def pack(parent: np.ndarray, symbol: np.ndarray, child: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BASE and CHECK of the trie with the edges (parent, symbol, child); node 0 is the root.

    Edges are sorted by parent and symbol, and parents have smaller numbers than their children. The child of state s by symbol a stands in slot
    BASE[s] + a, where CHECK holds s. The children of a node go where all their slots are free: first fit over the free
    slots, after ``TRIES`` of them at the end.
    """
    cuts = np.flatnonzero(np.diff(parent)) + 1
    begins, ends = [0, *cuts.tolist()], [*cuts.tolist(), len(parent)]
    slot_of = np.zeros(len(child) + 1, np.int64)
    used, base, check = bytearray(b"\1"), {}, {}
    free, end = 1, 1
    for a, b in zip(begins, ends, strict=True):
        if a == b:
            continue
        state, symbols = int(slot_of[parent[a]]), symbol[a:b]
        while free < len(used) and used[free]:
            free += 1
        least, span = int(symbols[0]), int(symbols[-1] - symbols[0])
        at, tries = free, 0
        if b - a > 1:
            shifts = symbols - least
            while at < end:
                if at + span >= len(used):
                    used.extend(bytes(at + span + 1 - len(used)))
                if not np.frombuffer(used, np.uint8)[at + shifts].any():
                    break
                tries += 1
                at = end if tries >= TRIES else used.find(b"\0", at + 1)
                at = end if at < 0 else at
        if at + span >= len(used):
            used.extend(bytes(at + span + 1 - len(used)))
        base[state] = at - least
        for i in range(a, b):
            slot = at - least + int(symbol[i])
            used[slot] = 1
            check[slot] = state
            slot_of[child[i]] = slot
        end = max(end, at + span + 1)
    bases, checks = np.zeros(end, np.int64), np.full(end, -1)
    bases[list(base)] = list(base.values())
    checks[list(check)] = list(check.values())
    return bases, checks


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Equal rows of the keys to equal numbers from 0."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), np.int64)
    for key in keys:
        new[1:] |= np.diff(key[order]) != 0
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


class Shard:
    """The trie of some sorted segments: its nodes, with those aggregates that need no other shard."""

    def __init__(self, c: dict[str, np.ndarray], offsets: np.ndarray, cells: dict[str, np.ndarray]):
        rows, lengths = len(offsets) - 1, np.diff(offsets)
        wide = int(lengths.max()) + 1
        roots = _dense(c["s1"], c["s2"])
        n_roots = int(roots.max()) + 1
        row = np.repeat(np.arange(rows), lengths)
        column = np.arange(offsets[-1] - offsets[0]) - np.repeat(offsets[:-1] - offsets[0], lengths) + 1
        symbol = np.full((rows, wide), -1)
        symbol[:, 0] = roots
        if len(row):
            symbol[row, column] = _dense(cells["t1"], cells["t2"]) + n_roots
        there = np.arange(wide)[None, :] <= lengths[:, None]

        # Sorted sequences: a node is new where a sequence leaves the one before.
        new = np.ones((rows, wide), bool)
        new[1:] = np.logical_or.accumulate(symbol[1:] != symbol[:-1], axis=1)
        new &= there
        at_column, at_row = np.nonzero(new.T)
        number = np.zeros((rows, wide), np.int64)
        number[at_row, at_column] = np.arange(1, len(at_row) + 1)
        number = np.maximum.accumulate(number, axis=0)
        parent = np.where(at_column > 0, number[at_row, np.maximum(at_column - 1, 0)], 0)
        edges = np.lexsort((symbol[at_row, at_column], parent))
        base, check = pack(parent[edges], symbol[at_row, at_column][edges], edges + 1)

        # From here on only the double array is asked: every sequence walks through it.
        state = np.full((rows, wide), -1)
        here = np.zeros(rows, np.int64)
        for d in range(wide):
            walking = np.flatnonzero(there[:, d])
            to = base[here[walking]] + symbol[walking, d]
            if not (check[to] == here[walking]).all():
                raise AssertionError("the double array lost a transition")
            here[walking] = to
            state[walking, d] = to
        slots = np.unique(state[there])
        i, d = np.nonzero(there)
        node = np.searchsorted(slots, state[i, d])
        n = len(slots)
        self.members = np.zeros(n, np.int64)
        np.add.at(self.members, node, c["members"][i])
        self.low = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(self.low, node, c["low"][i])
        self.local = np.zeros(n, np.int64)
        self.local[node] = d
        up = check[slots]
        self.parent = np.where(self.local > 0, np.searchsorted(slots, up), -1)

        keys = []
        for start, cell in (("s1", "h1"), ("s2", "h2")):
            key = np.zeros((rows, wide), np.int64)
            key[:, 0] = c[start]
            if len(row):
                key[row, column] = cells[cell]
            key = np.bitwise_xor.accumulate(key, axis=1)
            own = np.zeros(n, np.int64)
            own[node] = key[i, d]
            keys.append(own)
        self.k1, self.k2 = keys
        chars = np.zeros((rows, wide), np.int64)
        if len(row):
            chars[row, column] = cells["chars"]
        self.chars = np.zeros(n, np.int64)
        self.chars[node] = chars[i, d]

        # Nodes of the first and the last sequence may be in other shards too; all others are this shard's alone.
        self.spine = np.zeros(n, bool)
        for edge in (0, rows - 1):
            self.spine[np.searchsorted(slots, state[edge, :lengths[edge] + 1])] = True
        self.children, self.leaves, self.saved = (np.zeros(n, np.int64) for _ in range(3))
        last = np.searchsorted(slots, state[np.arange(rows), lengths])
        for out, name in ((self.children, "b_children"), (self.leaves, "b_leaves"), (self.saved, "b_saved")):
            np.add.at(out, last, c[name])
        alone = ~self.spine & (self.local > 0)
        np.add.at(self.children, self.parent[alone], 1)
        for depth in range(wide - 1, -1, -1):
            these = np.flatnonzero((self.local == depth) & ~self.spine)
            self.leaves[these] += self.children[these] == 0
            self.saved[these] += (self.members[these] - 1) * self.chars[these]
            if depth:
                np.add.at(self.leaves, self.parent[these], self.leaves[these])
                np.add.at(self.saved, self.parent[these], self.saved[these])

    def batch(self, seg: int) -> pa.RecordBatch:
        n = len(self.k1)
        up = np.maximum(self.parent, 0)
        has = self.parent >= 0
        known = has & ~self.spine[up] & ((self.local > 1) | (seg == 0))
        ancestors: list[list[int]] = [[] for _ in range(n)]
        for v in np.flatnonzero(self.spine)[np.argsort(self.local[self.spine], kind="stable")].tolist():
            ancestors[v] = (ancestors[self.parent[v]] if has[v] else []) + [v]
        flat = np.array([x for a in ancestors for x in a], np.int64)
        bounds = pa.array(np.cumsum([0, *map(len, ancestors)]), pa.int32())
        return pa.RecordBatch.from_arrays([
            pa.array(self.spine), pa.array(self.local), pa.array(self.local + seg * SEGMENT), pa.array(self.k1), pa.array(self.k2),
            pa.array(self.k1[up], mask=~has), pa.array(self.k2[up], mask=~has), pa.array(self.members), pa.array(self.low), pa.array(self.chars),
            pa.array(self.children), pa.array(self.leaves), pa.array(self.saved), pa.array(self.low[up], mask=~known),
            *[pa.ListArray.from_arrays(bounds, pa.array(k[flat])) for k in (self.k1, self.k2)],
        ], ["spine", "local", "depth", "k1", "k2", "p1", "p2", "members", "low", "chars", "children", "leaves", "saved", "parent_low", "a1", "a2"])


_NODES = "spine boolean, local long, depth long, k1 long, k2 long, p1 long, p2 long, members long, low long, chars long, children long, leaves long, saved long, parent_low long, a1 array<long>, a2 array<long>"
_FACTS = ("s1", "s2", "members", "low", "b_children", "b_leaves", "b_saved")
_CELLS = ("t1", "t2", "h1", "h2", "chars")


def _shards(seg: int):
    """Sorted segments to the nodes of their tries, a shard of bounded size at a time."""

    def tries(table: pa.Table, begin: int, end: int) -> pa.RecordBatch:
        part = table.slice(begin, end - begin).combine_chunks()
        path = part["path"].chunk(0)
        cells = path.flatten()
        return Shard(
            {f: part[f].to_numpy() for f in _FACTS}, np.concatenate([[0], np.cumsum(part["n"].to_numpy())]),
            {f: cells.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(_CELLS)}).batch(seg)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, widest = 0, 1
        for whole in batches:
            for x in range(0, whole.num_rows, 512):
                batch = whole.slice(x, 512)
                held.append(batch)
                rows, widest = rows + batch.num_rows, max(widest, max(batch["n"].to_pylist()) + 1)
                if rows * widest >= SHARD_CELLS:
                    yield tries(pa.Table.from_batches(held), 0, rows)
                    held, rows, widest = [], 0, 1
        if rows:
            yield tries(pa.Table.from_batches(held), 0, rows)

    return run


# ---- ids that end in a node ----------------------------------------------------

def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (k1, k2, conv) to pieces of each node's comma-joined ids."""
    at, ids, size = None, [], 0
    out: list[tuple] = []
    names = ["k1", "k2", "first", "piece"]

    def flushed(rows):
        return pa.RecordBatch.from_arrays([*[pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], pa.array([r[3] for r in rows], pa.string())], names)

    for batch in batches:
        for k1, k2, conv in zip(*[batch.column(x).to_pylist() for x in ("k1", "k2", "conv")], strict=True):
            if (k1, k2) != at or size > CHUNK:
                if ids:
                    out.append((*at, ids[0], ",".join(map(str, ids))))
                at, ids, size = (k1, k2), [], 0
            ids.append(conv)
            size += len(str(conv)) + 1
        yield flushed(out)
        out = []
    if ids:
        yield flushed([(*at, ids[0], ",".join(map(str, ids)))])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to a digest per node; a piece at a time is in memory."""
    at, running = None, None
    for batch in batches:
        out = []
        for k1, k2, piece in zip(*[batch.column(x).to_pylist() for x in ("k1", "k2", "piece")], strict=True):
            if (k1, k2) == at:
                running.update(b"," + piece.encode())
                continue
            if at is not None:
                out.append((*at, running.hexdigest()))
            at, running = (k1, k2), hashlib.sha256(piece.encode())
        yield _digests(out)
    if at is not None:
        yield _digests([(*at, running.hexdigest())])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], ["k1", "k2", "digest"])


def _ends(ends: DataFrame) -> DataFrame:
    """(k1, k2, digest): SHA-256 of the comma-joined ids, in ascending order, of the conversations that end in a node."""
    order = ["k1", "k2", "conv"]
    pieces = written(ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_chunks, "k1 long, k2 long, first long, piece string"), "pieces")
    return pieces.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(_hashed, "k1 long, k2 long, digest string")


# ---- the trie ------------------------------------------------------------------

def _merged(parts: DataFrame) -> DataFrame:
    """Spine nodes of all shards as one node each, with the totals of their subtrees."""
    sums = ("members", "children", "leaves", "saved")
    shared = parts.where("spine").groupBy("k1", "k2").agg(
        *[F.sum(c).alias(c) for c in sums], F.min("low").alias("low"),
        *[F.first(c).alias(c) for c in ("local", "depth", "p1", "p2", "chars", "a1", "a2")])
    shared = written(shared, "spine")
    kids = shared.where("local > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("kids"))
    whole = shared.join(kids, ["k1", "k2"], "left").withColumn("children", F.col("children") + F.coalesce("kids", F.lit(0))).drop("kids")
    whole = whole.withColumns({"leaves": F.col("leaves") + (F.col("children") == 0).cast("long"), "saved": F.col("saved") + (F.col("members") - 1) * F.col("chars")})
    whole = written(whole, "spine")
    up = whole.select("leaves", "saved", F.explode(F.arrays_zip("a1", "a2")).alias("a"))
    totals = up.groupBy(F.col("a.a1").alias("k1"), F.col("a.a2").alias("k2")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    return whole.drop("leaves", "saved", "a1", "a2").join(totals, ["k1", "k2"]).withColumn("parent_low", F.lit(None).cast("long"))


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The trie of the conversations ``turns`` (conv, depth from 1 without gaps, t1, t2, chars; depth 0 for one without turns).

    One row per node: ``conv_id`` (the smallest member; the node's last turn is that conversation's turn ``depth``),
    ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``.

    Conversations are cut into segments of 256 turns; equal segments after equal beginnings are one sequence with a
    number of members. Sequences are sorted and dealt to shards by ranges, so a shared beginning of any share spreads
    over many. A shard packs its sequences into a double array over dense turn numbers and walks them through it. Only
    nodes of its first and last sequence can be in another shard: these are merged over all shards. Segments are done
    from the last to the first, each node at a segment's end taking over what lies below it.

    An empty table gives an empty result.
    """
    cell = turns.where("depth > 0").withColumns({
        "seg": F.floor((F.col("depth") - 1) / SEGMENT), "h1": F.xxhash64("depth", "t1", "t2"), "h2": F.xxhash64(F.lit(5), "t2", "depth", "t1")})
    path = F.transform(F.array_sort(F.collect_list(F.struct("depth", *_CELLS))), lambda e: F.struct(*[e[c].alias(c) for c in _CELLS]))
    segs = cell.groupBy("conv", "seg").agg(path.alias("path"), F.count("*").alias("n"), F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"))
    order = Window.partitionBy("conv").orderBy("seg")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    segs = segs.withColumns({"s1": F.coalesce(F.bit_xor("x1").over(before), zero), "s2": F.coalesce(F.bit_xor("x2").over(before), zero), "last": F.lead("seg").over(order).isNull()})
    segs = segs.select("conv", "seg", "path", "n", "s1", "s2", F.col("s1").bitwiseXOR(F.col("x1")).alias("e1"), F.col("s2").bitwiseXOR(F.col("x2")).alias("e2"), "last")
    kind = segs.schema["path"].dataType.simpleString()
    bare = turns.where("depth = 0").select("conv", zero.alias("seg"), F.expr(f"cast(array() as {kind})").alias("path"), zero.alias("n"), *[zero.alias(c) for c in ("s1", "s2", "e1", "e2")], F.lit(True).alias("last"))
    segs = written(segs.union(bare), "segments")
    sequences = written(segs.groupBy("seg", "s1", "s2", "e1", "e2", "n").agg(F.first("path").alias("path"), F.count("*").alias("members"), F.min("conv").alias("low")), "sequences")

    top = sequences.agg(F.max("seg")).first()[0]
    below, levels = None, []
    columns = ["local", "depth", "k1", "k2", "p1", "p2", "members", "low", "children", "leaves", "saved", "parent_low"]
    for seg in range(-1 if top is None else top, -1, -1):
        rows = sequences.where(F.col("seg") == seg)
        values = ("b_children", "b_leaves", "b_saved")
        if below is None:
            rows = rows.withColumns({v: zero for v in values})
        else:  # only a full segment's end is the beginning of another
            rows = rows.join(below, (F.col("e1") == F.col("k1")) & (F.col("e2") == F.col("k2")) & (F.col("n") == SEGMENT), "left").withColumns({v: F.coalesce(v, zero) for v in values})
        keys = ["s1", "s2", "path"]
        ranged = rows.select(*_FACTS, "n", "path").repartitionByRange(*keys).sortWithinPartitions(*keys)
        parts = written(ranged.mapInArrow(_shards(seg), _NODES), "nodes")
        level = written(parts.where("not spine").select(*columns).union(_merged(parts).select(*columns)), "level")
        below = level.where("local = 0").select("k1", "k2", F.col("children").alias("b_children"), F.col("leaves").alias("b_leaves"), F.col("saved").alias("b_saved"))
        levels.append(level.where("local > 0 or depth = 0"))
    if not levels:
        return turns.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    nodes = levels[0]
    for level in levels[1:]:
        nodes = nodes.union(level)

    orphans = nodes.where("depth > 0 and parent_low is null")
    wanted = orphans.groupBy("p1", "p2").agg(F.count("*").alias("asking"))
    found = written(nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("low").alias("found")).join(wanted, ["p1", "p2"]), "parents")
    adopted = attach(orphans.drop("parent_low"), found, ["p1", "p2"], "asking", F.struct("k1", "k2")).withColumn("parent_low", F.col("found"))
    nodes = nodes.where("depth = 0 or parent_low is not null").select(*columns).union(adopted.select(*columns))

    digests = _ends(segs.where("last").select(F.col("e1").alias("k1"), F.col("e2").alias("k2"), "conv"))
    result = nodes.join(digests, ["k1", "k2"], "left")
    return result.select(
        F.col("low").alias("conv_id"), "depth", F.col("parent_low").alias("parent_conv_id"), F.col("members").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def conversation_trie(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", shared_heads: bool = False) -> DataFrame:
    """The :func:`prefix_trie` of conversations; with ``shared_heads`` each begins as :func:`with_shared_heads` says.

    Turns are in the order of ``turn_col``, null first, equal ones in the order of their digests; null role or text is
    empty. Rows without id belong to no conversation and are left out. Turns are equal if role and text are (by 128-bit
    digests; texts count whole). Ids are whole numbers. Other columns of ``df`` don't matter.
    """
    turns = turn_digests(df, id_col, turn_col, role_col, text_col)
    if shared_heads:
        return prefix_trie(with_shared_heads(turns))
    return prefix_trie(turns.select("conv", (F.col("at") + 1).alias("depth"), "t1", "t2", "chars"))
