"""Merkle manifest of a table: a tree per value of a column, a tree over these, and a proof for every row.

Digests are SHA-256 in lowercase hex, and hashed as that text.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.shared import numbered, written

#: Children of a node, and levels of a block: 256 leaves, the most that one task holds at a time.
ARITY, LEVELS = 16, 2
BLOCK = ARITY ** LEVELS
ROOTS = ("subroot", "root")
WITNESS = "array<struct<at int, siblings array<string>>>"
_PIECE = pa.struct([("at", pa.int32()), ("siblings", pa.list_(pa.string()))])


def digest(*parts: Column) -> Column:
    """H of the parts, texts or bytes, one after the other."""
    return F.sha2(F.concat(*[p.cast("binary") for p in parts]), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the length of the value as UTF-8, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: list[Column]) -> Column:
    return digest(*[field(v) for v in values])


class Appender:
    """An append-only tree of ``levels`` levels that keeps a witness for each leaf.

    An open subtree holds up to 16 finished children, each with the leaves below it; the witness of these leaves is
    partial. When the last sibling comes, or the input ends, the subtree is finished: every leaf below is told its
    siblings on this level, and the subtree's digest is appended one level up.
    """

    def __init__(self, levels: int):
        self.levels = levels
        self.open: list[list[tuple[str, int, int]]] = [[] for _ in range(levels + 1)]
        self.pieces: list[tuple[int, list[str]]] = []
        self.witness: list[list[int]] = []

    def append(self, leaf: str) -> None:
        at = len(self.witness)
        self.witness.append([])
        self._add(0, (leaf, at, at + 1))

    def _add(self, level: int, node: tuple[str, int, int]) -> None:
        run = self.open[level]
        run.append(node)
        if level < self.levels and len(run) == ARITY:
            self._finish(level)

    def _finish(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        digests = [d for d, _, _ in run]
        for k, (_, begin, end) in enumerate(run):
            piece = len(self.pieces)
            self.pieces.append((k, digests[:k] + digests[k + 1:]))
            for leaf in range(begin, end):
                self.witness[leaf].append(piece)
        self._add(level + 1, (hashlib.sha256("".join(digests).encode()).hexdigest(), run[0][1], run[-1][2]))

    def root(self) -> str:
        for level in range(self.levels):
            if self.open[level]:
                self._finish(level)
        return self.open[self.levels][0][0]


def _levels(total: int) -> int:
    """Levels of a block of a tree with ``total`` nodes."""
    levels = 0
    while levels < LEVELS and total > 1:
        levels, total = levels + 1, -(-total // ARITY)
    return levels


def _grown(rows: pa.Table) -> tuple[pa.Table, Appender]:
    rows = rows.sort_by("at")
    tree = Appender(_levels(rows["total"][0].as_py()))
    for leaf in rows["digest"].to_pylist():
        tree.append(leaf)
    return rows, tree


def _block_root(rows: pa.Table) -> pa.Table:
    first, (_, tree) = rows.slice(0, 1), _grown(rows)
    return pa.table({"tree": first["tree"], "at": first["block"], "total": [-(-first["total"][0].as_py() // BLOCK)], "digest": [tree.root()]})


def _extend(rows: pa.Table, above: pa.Table) -> pa.Table:
    """The block's rows with whole witnesses: within the block, then those that the block's own root has further up."""
    rows, tree = _grown(rows)
    tree.root()
    own = pa.StructArray.from_arrays(
        [pa.array([k for k, _ in tree.pieces], pa.int32()), pa.array([s for _, s in tree.pieces], pa.list_(pa.string()))], fields=list(_PIECE))
    every = pa.concat_arrays([own, above["witness"].combine_chunks().flatten().cast(_PIECE)])
    upper = list(range(len(own), len(every)))
    path, bounds = [], [0]
    for pieces in tree.witness:
        path += pieces + upper
        bounds.append(len(path))
    rows = rows.append_column("witness", pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), every.take(pa.array(path, pa.int64()))))
    for name in ROOTS:
        rows = rows.append_column(name, pa.array([above[name][0].as_py()] * len(rows), pa.string()))
    return rows


def _rounds(nodes: DataFrame, label: str) -> list[DataFrame]:
    """``nodes`` (tree, at, total, digest, ...) and, above them, the tables of block roots up to one node per tree."""
    tables = [nodes]
    while len(tables) == 1 or not tables[-1].where("total > 1").isEmpty():
        below = tables[-1].select("tree", "at", "total", "digest").withColumn("block", F.floor(F.col("at") / BLOCK))
        tables.append(written(below.groupBy("tree", "block").applyInArrow(_block_root, "tree string, at long, total long, digest string"), label))
    return tables


def _with_witness(rounds: list[DataFrame], top: DataFrame) -> DataFrame:
    """The lowest of the ``rounds`` with witnesses: those of the last round, ``top``, handed down from block to block."""
    for nodes in reversed(rounds[:-1]):
        rows = nodes.withColumn("block", F.floor(F.col("at") / BLOCK))
        schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in rows.schema], f"witness {WITNESS}", *[f"{r} string" for r in ROOTS]])
        above = top.select("tree", F.col("at").alias("block"), "witness", *ROOTS)
        top = rows.groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInArrow(_extend, schema)
    return top


def manifest(df: DataFrame, id_col: str, tree_col: str, fields: list[str], carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``df``: id, ``leaf``, ``position``, ``subroot``, ``root``, ``witness``, and the columns ``carry``.

    A row's leaf is the digest of its ``fields``. The rows of one value of ``tree_col`` are a tree, its leaves in the
    order of ids; runs of 16 nodes have a parent until one node is left, the subroot. The subroots, in the order of the
    tree values (null first, then by their bytes), are the leaves of the tree over all, whose last node is the root.
    ``witness`` lists, from the leaf up to the root, the row's place in each run and its siblings there;
    :func:`fold` climbs it again.

    Rows are numbered by ranges, so a tree of any size spreads over all tasks. Blocks of 256 aligned leaves are
    appended in a task each, which gives the block's root; roots are the leaves of the next round. Then witnesses go
    back down: a block's rows get those that its root has further up. No task holds more than a block.

    Null fields are ``-``; a null tree value is a tree of its own; null ids come first. Rows of equal id are ordered by
    leaf, and equal rows are leaves of their own. Empty texts and texts of any length are hashed whole, in the JVM. An
    empty table gives an empty result. Columns of ``df`` that are not named don't matter; a name of ``carry`` that is a
    result's name raises ValueError.
    """
    carry = carry or {}
    taken = {id_col, "leaf", "position", "subroot", "root", "witness"} & set(carry)
    if taken:
        raise ValueError(f"carried columns have names of the result: {sorted(taken)}")
    quoted = lambda c: F.col(f"`{c}`")
    tree = F.coalesce(F.concat(F.lit("="), quoted(tree_col).cast("string")), F.lit(""))
    leaves = df.select(tree.alias("tree"), quoted(id_col).alias("id"), leaf_digest([quoted(f) for f in fields]).alias("digest"), *[v.alias(f"c{i}") for i, v in enumerate(carry.values())])
    leaves = written(numbered(written(leaves, "leaves"), ["tree"], ["id", "digest"], "at", "total"), "numbered")
    rounds = _rounds(leaves, "roots")
    subroots = rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest")
    over = _rounds(written(numbered(subroots, ["tree"], ["of"], "at", "total"), "subroots"), "roots")

    root = over[-1].withColumns({"witness": F.expr(f"cast(array() as {WITNESS})"), "subroot": F.lit(""), "root": F.col("digest")})
    heads = _with_witness(over, root).select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("at"), "witness", F.col("digest").alias("subroot"), "root")
    proven = _with_witness(rounds, written(heads, "heads"))
    return proven.select(
        F.col("id").alias(id_col), F.col("digest").alias("leaf"), F.col("at").alias("position"), "subroot", "root", "witness",
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)])


def siblings_text(witness: Column) -> Column:
    """The siblings of a witness from the leaf up, each run's left to right."""
    return F.array_join(F.flatten(F.transform(witness, lambda w: w["siblings"])), "")


def fold(leaf: Column, witness: Column) -> Column:
    """The root that ``leaf`` leads to by way of ``witness``."""

    def climb(below: Column, w: Column) -> Column:
        before = F.array_join(F.slice(w["siblings"], F.lit(1), w["at"]), "")
        after = F.array_join(F.slice(w["siblings"], w["at"] + 1, F.lit(ARITY)), "")
        return digest(before, below, after)

    return F.aggregate(witness, leaf, climb)
