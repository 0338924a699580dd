"""The Merkle manifest against trees built in plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def H(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return H("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[f] for f in FIELDS))


def plain_tree(leaves):
    """(root, siblings of each leaf from its run upwards)."""
    nodes, paths = [(d, [i]) for i, d in enumerate(leaves)], [[] for _ in leaves]
    while len(nodes) > 1:
        up = []
        for a in range(0, len(nodes), 16):
            run = nodes[a:a + 16]
            for k, (_, below) in enumerate(run):
                for i in below:
                    paths[i].append((k, [d for j, (d, _) in enumerate(run) if j != k]))
            up.append((H(d for d, _ in run), [i for _, below in run for i in below]))
        nodes = up
    return nodes[0][0], paths


def plain_manifest(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r["source"], []).append(r)
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in names:
        trees[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        built[s] = plain_tree([leaf_of(r) for r in trees[s]])
    root, above = plain_tree([built[s][0] for s in names])
    out = []
    for t, s in enumerate(names):
        for i, r in enumerate(trees[s]):
            out.append((r["doc_id"], leaf_of(r), i, built[s][0], root, built[s][1][i] + above[t]))
    return out


def as_tuples(df):
    return sorted(((r["doc_id"], r["leaf"], r["position"], r["subroot"], r["root"], [(w["at"], w["siblings"]) for w in r["witness"]]) for r in df.collect()), key=repr)


@pytest.fixture
def rows():
    rng = random.Random(3)
    sources = [None, "", "a", "b", "Ü", "hot"] + [f"s{i:03}" for i in range(30)]
    out = []
    for i in range(900):
        source = "hot" if i < 520 else sources[i % len(sources)]
        out.append({"doc_id": i, "source": source, "lang": rng.choice([None, "en"]), "n_chars": rng.choice([None, i]), "text": rng.choice([None, "", f"Text {i} É", "x" * 3000])})
    out += [dict(out[5]), dict(out[5]), {**out[6], "text": "other"}, {**out[7], "doc_id": None}]
    rng.shuffle(out)
    return out


def test_against_plain_trees(spark, rows):
    df = spark.createDataFrame([tuple(r[f] for f in FIELDS) + (1, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, at int, root string").repartition(5)
    got = merkle.manifest(df, "doc_id", "source", FIELDS)
    assert got.columns == ["doc_id", "leaf", "position", "subroot", "root", "witness"]
    assert as_tuples(got) == sorted(plain_manifest(rows), key=repr)


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257, 300])
def test_sizes(spark, n):
    rows = [{"doc_id": i, "source": "one", "lang": None, "n_chars": i, "text": None} for i in range(n)]
    df = spark.createDataFrame([tuple(r[f] for f in FIELDS) for r in rows], "doc_id long, source string, lang string, n_chars long, text string")
    assert as_tuples(merkle.manifest(df, "doc_id", "source", FIELDS)) == sorted(plain_manifest(rows), key=repr)


def test_four_levels(spark):
    """More leaves than one block of blocks holds, by the subroots alone."""
    df = spark.range(66_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("string").alias("source"))
    got = merkle.manifest(df, "doc_id", "source", ["doc_id"]).where("doc_id in (0, 1, 65999)")
    ok = got.where((merkle.fold(F.col("leaf"), F.col("witness")) == F.col("root")) & (F.size("witness") == 5)).select("subroot", "root").distinct().collect()
    def leaf(i):
        return H([f"{len(str(i))}:{i}"])

    subroots = [plain_tree([leaf(i) for i in range(s, 66_000, 2)])[0] for s in (0, 1)]
    assert {r["subroot"] for r in ok} == set(subroots) and {r["root"] for r in ok} == {H(subroots)}


def test_tampered_rows_do_not_fold(spark, rows):
    df = spark.createDataFrame([tuple(r[f] for f in FIELDS) for r in rows], "doc_id long, source string, lang string, n_chars long, text string")
    altered = merkle.leaf_digest([F.lower(f) if f == "text" else F.col(f) for f in FIELDS])
    got = merkle.manifest(df, "doc_id", "source", FIELDS, {"altered": altered})
    folded = got.withColumn("same", merkle.fold(F.col("altered"), F.col("witness")) == F.col("root")).withColumn("kept", merkle.fold(F.col("leaf"), F.col("witness")) == F.col("root"))
    changed = {leaf_of(r) for r in rows if r["text"] and r["text"].lower() != r["text"]}
    for r in folded.collect():
        assert r["kept"] and r["same"] == (r["leaf"] not in changed)


def test_empty_and_clashing_names(spark):
    none = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert merkle.manifest(none, "doc_id", "source", FIELDS).count() == 0
    with pytest.raises(ValueError, match="leaf"):
        merkle.manifest(none, "doc_id", "source", FIELDS, {"leaf": F.lit(1)})
    tree = spark.createDataFrame([(1, 2), (2, 2)], "tree long, at long")
    assert merkle.manifest(tree, "at", "tree", ["tree", "at"]).count() == 2


def test_crc_of_the_sql():
    import duckdb

    from tallyloom.llm import sql

    for i in (0, 7, -3, 1234567890123):
        assert duckdb.sql(f"SELECT {sql.crc32(repr(str(i)))}").fetchall()[0][0] == zlib.crc32(str(i).encode())
