"""Exact and near duplicates against brute force."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

from tallyloom.llm import exact, neardup, words


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("ranges", [1, 7, 200])
def test_exact_against_grouping(docs, keep, ranges):
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    best = min if keep == "smallest" else max
    want = {(i, best(groups[t]), len(groups[t]), i == best(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows}
    got = exact.exact_duplicates(docs, keep=keep, ranges=ranges)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(rows)


def test_hot_text_over_many_ranges(spark):
    rows = [(i, "the same long beginning of every text " * 3) for i in range(500)] + [(1000 + i, f"the same long beginning of every text {i % 50}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = exact.exact_duplicates(df, ranges=40).collect()
    sizes = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in got}
    assert all(sizes[i] == (0, 500) for i in range(500)) and all(sizes[1000 + i] == (1000 + i % 50, 4) for i in range(200))
    assert sum(r["kept"] for r in got) == 51


def test_exact_repeated_rows_null_ids_and_empty(spark, docs, empty):
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b"), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact.exact_duplicates(df).where("kept").collect()
    assert sorted((r["doc_id"] or -1, r["keep_id"] or -1, r["group_size"]) for r in got) == [(-1, -1, 2), (1, 1, 3), (2, 2, 2)]
    assert exact.exact_duplicates(empty).count() == 0
    left = exact.drop_exact_duplicates(docs)
    assert left.columns == docs.columns and left.count() == len({r["text"] or "" for r in docs.collect()})
    assert exact.drop_exact_duplicates(empty).columns == docs.columns


def test_native_plan(docs):
    plan = exact.exact_duplicates(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def shingle_set(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(found[i:i + 5]) for i in range(max(1, len(found) - 4))} if found else set()


def brute(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), root(i), root(i) == i) for i in ids}


def test_near_against_all_pairs(docs):
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = neardup.near_duplicates(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert {tuple(r) for r in got.collect()} == want
    left = neardup.drop_near_duplicates(docs)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {x[0] for x in want if x[3]}


def test_near_on_driver_rows(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in df.collect()])
    assert {tuple(r) for r in neardup.near_duplicates(df).collect()} == want


def test_near_chain_is_followed_beyond_the_hub(spark):
    """Neighbours in the chain are linked, ends are not; the hubs alone don't show all links."""
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(base[:3 * i] and [f"v{j}" for j in range(3 * i)] + base[3 * i:] or base)) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in neardup.near_duplicates(df).collect()} == brute(rows)


def test_near_nulls_repeats_and_empty(spark, empty):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(None, long), (5, long), (5, long), (9, long + " x"), (7, None), (8, "")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in got) == [(-1, -1, True), (5, 5, True), (5, 5, True), (7, 7, True), (8, 8, True), (9, 5, False)]
    assert neardup.near_duplicates(empty).count() == 0


def test_near_with_nul_bytes(spark):
    """NUL is no white space: it stands in words, and a word of NULs is one."""
    plain = [f"w{i}" for i in range(60)]
    joined = " ".join(f"w{i}\0w{i + 1}" for i in range(0, 60, 2))
    rows = list(enumerate([" ".join(plain), joined, joined + " x", "a\0b c", "\0", "\0 \0", "a\0 b c d e f", "a b c d e f", " ".join(plain) + " \0"]))
    want = brute(rows)
    assert {i: n for i, n, *_ in want}[1] == 26
    assert {tuple(r) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_near_copies_go_whatever_the_columns_are_named(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, 5, "a"), (2, text + " eleven", 6, "b"), (3, None, 7, "c"), (None, text, 8, "d"), (4, "other words", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `_gone` long, n string").withColumnRenamed("n", "key1")
    left = neardup.drop_near_duplicates(df)
    assert left.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["_gone"], r["key1"]) for r in left.collect()) == [(0, 8, "d"), (1, 5, "a"), (3, 7, "c"), (4, None, None)]
    odd = spark.createDataFrame(rows, "rep long, component string, kept long, id string")
    assert neardup.drop_near_duplicates(odd, "rep", "component").count() == 4
    assert neardup.drop_near_duplicates(df.where("1 = 0")).count() == 0


def test_super_minhash_is_unbiased_and_a_permutation():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 4000).astype(np.uint64)
    errors = []
    for i in range(40):
        x, y = np.unique(a[i * 50:i * 50 + 80]), np.unique(a[i * 50 + 20:i * 50 + 100])
        s = neardup.super_minhash([x, y, np.empty(0, np.uint64)])
        errors.append((s[0] == s[1]).mean() - 60 / 100)
        assert (s[2] == 0xFFFFFFFF).all() and (s[:2] >> 24 < 128).all()
    assert abs(np.mean(errors)) < 0.03
    one = neardup.super_minhash([a[:1]])[0]
    assert sorted((one >> 24).tolist()) == list(range(128))  # one element gives every place its own step
    assert (neardup.super_minhash([a[:3], a[5:9]])[1] == neardup.super_minhash([a[5:9]])[0]).all()


def test_words_of_segments_and_rows(monkeypatch):
    text = ["Ab c", "", "c", " ab  zz", "q" * 300]
    data = np.frombuffer("".join(text).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t) for t in text])
    starts, ends, hashes, bounds = words.words(data, offsets, words.spaced())
    assert np.diff(bounds).tolist() == [2, 0, 1, 2, 1]
    assert hashes[0] == hashes[3] and hashes[1] == hashes[2] and len(set(hashes.tolist())) == 4
    monkeypatch.setattr(words, "_SEGMENT", 5)
    assert (words.words(data, offsets, words.spaced())[2] == hashes).all()
