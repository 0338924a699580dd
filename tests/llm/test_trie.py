"""The conversation trie against a trie of plain dictionaries, and double arrays against the edges they hold."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tallyloom.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, k1 string, depth int"


def rebuilt(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(found)] for c, found in turns.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        out[c] = own.get(base, [])[:h] + own[c][h:]
    return own, out


def plain_trie(conversations):
    members, ends = {}, {}
    for c, seq in conversations.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
        ends.setdefault(tuple(seq), []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = kids.get(node, [])
        leaves[node] = sum(leaves[k] for k in below) if below else 1
        saved[node] = sum(saved[k] for k in below) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
    return sorted(((
        min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(kids.get(node, [])), leaves[node], saved[node],
        hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()) for node, m in members.items()), key=repr)


def nodes(df, **options):
    got = trie.conversation_trie(df, **options)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


@pytest.fixture
def rows():
    """Conversations that share first turns, whole ones repeated, one with very many turns, nulls and a negative id."""
    rng = random.Random(4)
    pool = [(rng.choice(["user", "assistant", None]), rng.choice(["hé", "", None, "a longer turn", f"t{i}"])) for i in range(12)]
    out = []
    ids = list(range(0, 130)) + [500, 501, 590, 733, 1007, -5]
    for c in ids:
        for turn in range(rng.choice([1, 2, 3, 4, 7, 9])):
            out.append((c, turn, *(pool[turn % 3] if rng.random() < 0.7 else rng.choice(pool))))
    out += [(2000, i, "user", f"{i % 40}") for i in range(400)] + [(2001, i, "user", f"{i % 40}") for i in range(400)] + [(2099, i, "user", f"{i % 40}") for i in range(390)]
    out += [(c, t, "user", "hot") for c in range(3000, 3100) for t in range(3)]
    out += [(7, None, "user", "no turn"), (None, 1, "user", "no conversation"), (None, None, None, None)]
    rng.shuffle(out)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 9) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize(("segment", "cells"), [(256, 1 << 18), (192, 40), (64, 16), (50, 700)])
def test_against_plain_trie(spark, rows, monkeypatch, segment, cells):
    monkeypatch.setattr(trie, "SEGMENT", segment)
    monkeypatch.setattr(trie, "SHARD_CELLS", cells)
    monkeypatch.setattr(trie, "CHUNK", 100)
    own, lent = rebuilt(rows)
    df = frame(spark, rows)
    assert nodes(df, shared_heads=True) == plain_trie(lent)
    if segment == 256:
        assert nodes(df) == plain_trie(own)


@pytest.mark.parametrize("segment", [1, 2, 3, 4])
def test_segments_of_few_turns(spark, monkeypatch, segment):
    """Conversations of exactly one, two and more segments, and shards of one sequence each."""
    monkeypatch.setattr(trie, "SEGMENT", segment)
    monkeypatch.setattr(trie, "SHARD_CELLS", 1)
    rng = random.Random(segment)
    rows = [(c, t, "u", rng.choice("ab")) for c in range(40) for t in range(rng.randrange(1, 9))]
    own, _ = rebuilt(rows)
    assert nodes(frame(spark, rows)) == plain_trie(own)


def test_empty_and_bare(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert nodes(empty, shared_heads=True) == []
    assert nodes(spark.createDataFrame([(None, 1, "a", "b", "", 1)], SCHEMA)) == []
    bare = [c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 >= 2][:5]
    rows = [(c, 0, "user", "gone with the head") for c in bare]
    _, lent = rebuilt(rows)
    assert all(not seq for seq in lent.values())
    assert nodes(frame(spark, rows), shared_heads=True) == plain_trie(lent) == [(min(bare), 0, None, 5, 0, 1, 0, hashlib.sha256(",".join(map(str, bare)).encode()).hexdigest())]


@pytest.mark.parametrize("seed", range(6))
def test_double_array_holds_its_edges(seed):
    rng = random.Random(seed)
    n, alphabet = rng.choice([1, 10, 400, 3000]), rng.choice([3, 50, 5000])
    children = [{} for _ in range(n + 1)]
    for node in range(1, n + 1):
        up = rng.randrange(max(0, node - 5), node) if seed % 2 else rng.randrange(node)
        free = rng.randrange(alphabet)
        while free in children[up]:
            free += 1
        children[up][free] = node
    edges = [(p, a, c) for p in range(n + 1) for a, c in sorted(children[p].items())]
    base, check = trie.pack(*(np.array(x) for x in zip(*edges, strict=True)))
    slot = {0: 0}
    for p, a, c in edges:
        at = int(base[slot[p]]) + a
        assert at not in slot.values() or n > 400
        assert check[at] == slot[p]
        slot[c] = at
    assert len(set(slot.values())) == n + 1 and (check >= 0).sum() == n
    present = {(slot[p], int(base[slot[p]]) + a) for p, a, _ in edges}
    for p in rng.sample(range(n + 1), min(n + 1, 50)):  # symbols that are no child lead nowhere
        for a in range(0, alphabet, max(1, alphabet // 40)):
            at = int(base[slot[p]]) + a
            if children[p] and a not in children[p] and 0 <= at < len(check):
                assert check[at] != slot[p] or (slot[p], at) in present
