"""The n-gram join against all pairs, and its parts against plain counts."""

import random

import numpy as np
import pytest

from tallyloom.llm import jaccard
from test_dedup import shingle_set


def brute(rows, percent=80):
    """(id, set size, smallest id reachable) by row, ids may repeat."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[root(b)] = root(a)
    lowest = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            lowest[root(i)] = min(lowest.get(root(i), doc_id), doc_id)
    return sorted(((i, len(s), lowest.get(root(k))) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def joined(df, **options):
    return sorted((tuple(r) for r in jaccard.ngram_join(df, **options).collect()), key=repr)


def test_against_all_pairs(docs):
    got = jaccard.ngram_join(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


@pytest.fixture
def family():
    """Variants of a few texts at similarities around the threshold, in chains, with shared passages."""
    rng = random.Random(11)
    word = lambda: rng.choice(["ba", "do", "ki", "mu", "ser", "tol"]) + rng.choice(["", "n", "ra", "lim"]) + str(rng.randrange(40))
    passage = [word() for _ in range(70)]
    out = []
    for i in range(6):
        base = [word() for _ in range(rng.choice([40, 90, 200]))]
        if i % 2:
            base = base[:20] + passage + base[20:]
        for _ in range(45):
            words = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 5, 8])):
                words[rng.randrange(len(words))] = word()
            out.append(" ".join(words[:len(words) - rng.randrange(3)]))
            if rng.random() < 0.3:
                base = words
    out += [" ".join([word() for _ in range(30)] + passage) for _ in range(40)]
    out += ["a b c d", "A B c d", "a b c d e", "", None, " ", "a b c d e f g h i", "a b c d e f g h i j"]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("frequent", [0, 40, 1 << 18])
def test_families_and_any_order(spark, family, monkeypatch, frequent):
    """Small blocks, shares and counts, and an order of frequent n-grams that is cut short."""
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "SHARE", 5)
    monkeypatch.setattr(jaccard, "SKIP", 3)
    monkeypatch.setattr(jaccard, "FAMILY", 4)
    monkeypatch.setattr(jaccard, "BITMAP", 64)
    monkeypatch.setattr(jaccard, "HUBS", 1 + (frequent == 40))
    monkeypatch.setattr(jaccard, "COUNTED", 5000)
    df = spark.createDataFrame(family, "doc_id long, text string").repartition(4)
    assert joined(df) == brute(family)


def test_other_similarity(spark, family):
    df = spark.createDataFrame(family, "doc_id long, text string")
    assert joined(df, percent=60) == brute(family, 60)


def test_repeats_nulls_and_empty(spark, empty):
    text = "one two three four five six seven"
    rows = [(1, text), (1, text), (1, "other words that are not the same at all"), (None, text), (None, None), (None, "x y"), (3, ""), (4, text.upper())]
    assert joined(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    assert jaccard.ngram_join(empty).count() == 0
    named = spark.createDataFrame([("b", "same text", 1), ("a", "Same  text", 2)], "rep string, grams string, n int")
    assert joined(named, id_col="rep", text_col="grams") == [("a", 1, "a"), ("b", 1, "a")]


def test_skipped_blocks_hold_no_partner(monkeypatch):
    """The pairs of the index lists are those within the bounds, over many lists, blocks and batches."""
    import pyarrow as pa

    monkeypatch.setattr(jaccard, "PAIRS", 5000)
    rng = np.random.default_rng(5)
    rows = 3000
    sizes = rng.integers(1, 400, rows)
    place = (rng.random(rows) * sizes * 0.21).astype(np.int64)
    cells = {
        "gram": np.sort(rng.choice([3, 5, 6, 9, 1 << 40], rows, p=[0.1, 0.6, 0.1, 0.1, 0.1])), "block": np.zeros(rows, np.int64), "probe": rng.integers(0, 2, rows), "place": place,
        "rep": np.arange(rows), "component": np.arange(rows) % 900, "main": np.full(rows, 7), "n": sizes}
    order = np.lexsort((place, cells["probe"], cells["gram"]))
    cells = {k: v[order] for k, v in cells.items()} | {f"p{i}": np.zeros(rows, np.int64) for i in range(4)}
    cells["leader"] = cells["rep"] // 3
    table = pa.RecordBatch.from_arrays([pa.array(v) for v in cells.values()], list(cells))
    want = set()
    for g in np.unique(cells["gram"]):
        e, q = (np.flatnonzero((cells["gram"] == g) & (cells["probe"] == x)) for x in (0, 1))
        for i in q:
            rest = np.minimum(cells["n"][i] - cells["place"][i], cells["n"][e] - cells["place"][e])
            ok = (180 * rest >= 80 * (cells["n"][i] + cells["n"][e])) & (cells["component"][e] != cells["component"][i])
            ok &= (cells["component"][e] == 7) | (cells["rep"][i] < cells["rep"][e])
            want |= {(int(cells["rep"][i]), int(x)) for x in cells["leader"][e[ok]]}
    for step in (rows, 700, 37):
        parts = iter([table.slice(x, step) for x in range(0, rows, step)])
        got = {(a, b) for batch in jaccard._skipping(80)(parts) for a, b in zip(batch["a"].to_pylist(), batch["leader"].to_pylist(), strict=True)}
        assert got == want and len(want) > 1000


def test_derived_answers():
    """A probe is linked with a family if one of its whole sets is similar enough, the leader's too."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    universe = np.unique(rng.integers(0, 1 << 62, 400).astype(np.uint64))
    leader = np.unique(rng.choice(universe, 300, replace=False))
    members = [np.unique(np.concatenate([rng.choice(leader, len(leader) - 10, replace=False), rng.choice(universe, 12)])) for _ in range(9)]
    probes = [np.unique(rng.choice(universe, n, replace=False)) for n in range(150, 400, 5)] + [leader, members[3], universe[:1]]
    rows = [(7, 0, None, leader, None, None)] + [(7, 1, None, None, np.setdiff1d(leader, m), np.setdiff1d(m, leader)) for m in members]
    rows += [(7, 2, i, p, None, None) for i, p in enumerate(probes)] + [(8, 0, None, probes[0], None, None), (8, 2, 0, probes[0], None, None), (8, 2, 1, universe, None, None)]
    lists = lambda at: pa.array([None if r[at] is None else r[at].view(np.int64) for r in rows], pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)] + [lists(i) for i in (3, 4, 5)], ["leader", "kind", "a", "grams", "lack", "besides"])
    for percent in (50, 60, 70, 80):
        got = [(a, b) for out in jaccard._derived(percent)(iter([batch.slice(0, 7), batch.slice(7)])) for a, b in zip(out["a"].to_pylist(), out["b"].to_pylist(), strict=True)]
        near = lambda x, y: 100 * len(np.intersect1d(x, y)) >= percent * len(np.union1d(x, y))  # noqa: B023, E731
        want = [(i, 7) for i, p in enumerate(probes) if any(near(p, m) for m in [leader, *members])] + [(0, 8)]
        assert got == want and 0 < len(want) < len(probes)
