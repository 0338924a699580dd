"""Sharding, packing and token counts: laws and round trips."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tallyloom.llm import counts, packing, shards, tokenise
from tallyloom.llm.queries import op3_sharding


@pytest.fixture(scope="module")
def model():
    return Tokenizer.from_file(tokenise.tokenizer_path())


def test_matrix_margins_and_spread():
    sizes, columns = [100, 0, 7, 893], [334, 333, 333]
    m = np.array(shards.communication_matrix(sizes, columns, 3))
    assert m.sum(axis=1).tolist() == sizes and m.sum(axis=0).tolist() == columns
    draws = np.array([shards.communication_matrix(sizes, columns, s)[0] for s in range(600)])
    assert abs(draws.mean(axis=0) - np.array([33.4, 33.3, 33.3])).max() < 1
    assert abs(draws[:, 0].var() - 100 * 0.334 * 0.666 * 900 / 999) < 4


def test_hypergeometric_of_many_rows():
    rng = np.random.default_rng(1)
    got = [shards._hypergeometric(rng, 3 * 10**9, 10**9, 1000) for _ in range(300)]
    assert abs(np.mean(got) - 750) < 4 and 8 < np.std(got) < 20


def test_shards_are_exact_and_uniform(docs, empty, spark):
    got = shards.shuffle_into_shards(docs, 5, ["doc_id"])
    assert got.columns == [*docs.columns, "shard", "slot"]
    rows = got.collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in docs.collect())
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert shards.shuffle_into_shards(empty, 5, ["doc_id"]).count() == 0
    assert not re.search("Python|Arrow|Pandas", got._jdf.queryExecution().toString())
    plain = spark.range(1, 5000, 1, 6)
    place = {r["id"]: r["shard"] for r in shards.shuffle_into_shards(plain, 4, ["id"]).collect()}
    low = Counter(s for i, s in place.items() if i < 800)  # one partition's rows go everywhere
    assert min(low.values()) > 150
    odd = spark.createDataFrame([(None, 1), (None, 1), (3, None)], "doc_id long, shard int")
    assert sorted(r["shard"] for r in shards.shuffle_into_shards(odd, 2, ["doc_id"]).collect()) == [0, 0, 1]


def test_shards_leave_columns_of_any_name_alone(spark):
    names = ["doc_id", "_at", "_rank", "_i", "_block", "_part", "_order", "_row", "_start", "_ends", "_in0", "count", "a.b"]
    df = spark.createDataFrame([(i, *[1000 * k + i for k in range(1, len(names))]) for i in range(60)], ", ".join(f"`{n}` long" for n in names)).repartition(3)
    got = shards.shuffle_into_shards(df, 4, ["doc_id"])
    assert got.columns == [*names, "shard", "slot"]
    assert sorted(tuple(r)[:-2] for r in got.collect()) == sorted(tuple(r) for r in df.collect())


def test_encoder_gives_the_tokenizers_ids(model, docs):
    encode = tokenise.encoder("byte_bpe_50k.json")
    texts = ["", " " * 999 + "x", " \n" * 700, "a" * 5000, " " * 50_000 + "b", "x<|endoftext|>y", "\u3000\u4e2d\u6587 na\u00efve \U0001f600\r\n\t!"]
    texts += [r["text"] for r in docs.where("text is not null").select("text").collect()]
    assert all(encode(t).tolist() == model.encode(t, add_special_tokens=False).ids for t in texts)


def test_sharding_query(spark):
    rows = op3_sharding(spark, "/root/testdata/sf0.001").collect()
    text = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(text)
    assert all((r["size"], r["text_crc32"], r["law"]) == (len(text[r["doc_id"]]) + 8, zlib.crc32(text[r["doc_id"]]), "rows") for r in rows)


def test_chunked_encoding_equals_whole(texts, model):
    encode = tokenise.encoder("byte_bpe_50k.json")
    odd = ["a \n b", " lead", "trail ", "trail\n\n", "x\ty z", "don't  can't ", " x y", "a  b", "<|endoftext|> b <|endoftext|>", "1 2  3\n\n\n4", "\x1c a\x1f b", "é è", " ", "\n", ""]
    for t in [*odd, *(t or "" for t in texts)]:
        assert encode(t).tolist() == model.encode(t, add_special_tokens=False).ids, repr(t[:50])


def test_cuts():
    for n in [1, 2, 3, 1000, 1024, 1025, 2047, 2048, 2049, 99_999]:
        cuts = packing.harmonic_cuts(n, 2048)
        assert sum(cuts) == n and all(0 < c <= 2048 for c in cuts) and len(cuts) <= n // 2048 + packing.REST_PIECES


def test_packing_round_trip(docs, empty, model):
    packed = packing.pack(docs)
    rows = packed.collect()
    ids = {r["doc_id"]: model.encode(r["text"] or "", add_special_tokens=False).ids + [1] for r in docs.collect()}
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        own = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert np.frombuffer(r["ids"], "<u4").tolist() == own and r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for some, ends in [*((p, len(ids[i])) for i, p in pieces.items()), *((b, None) for b in bins.values())]:
        at = 0
        for start, length in sorted(some):
            assert start == at
            at += length
        assert at == ends if ends is not None else at <= 2048
    assert set(pieces) == set(ids) and sorted(bins) == list(range(len(bins)))
    assert len(bins) * 2048 < 1.1 * sum(map(len, ids.values())) + 2048
    joined = {r["sequence_id"]: r for r in packing.sequences(packed).collect()}
    assert all(len(r["ids"]) == 4 * r["length"] == 4 * sum(n for _, n in bins[s]) for s, r in joined.items())
    assert packing.pack(empty).count() == 0


def test_packing_keeps_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or -1, r["length"]) for r in packing.pack(df).collect()) == [(-1, 1), (1, 3), (1, 3)]


@pytest.mark.parametrize("file_ids", [50, 997, 1 << 21])
def test_token_counts_over_file_bounds(spark, docs, empty, model, tmp_path, file_ids):
    table = docs.where("not (text <=> '<|endoftext|>')")
    path = str(tmp_path / "tokens")
    counts.write_token_files(table, path, file_ids=file_ids)
    got = counts.count_tokens(spark, path)
    want = sorted(len(model.encode(r["text"] or "", add_special_tokens=False).ids) for r in table.collect())
    assert sorted(r["n_tokens"] for r in got.collect()) == want


def test_document_tokens(spark, docs, empty, model):
    got = {r["doc_id"]: r["n_tokens"] for r in counts.document_tokens(docs).collect()}
    assert got == {r["doc_id"]: len(model.encode(r["text"] or "", add_special_tokens=False).ids) for r in docs.collect()}
    assert counts.document_tokens(empty).count() == 0
    odd = spark.createDataFrame([(None, None), (1, "x"), (1, "x"), (2, "<|endoftext|>")], "doc_id long, text string")
    assert len(counts.document_tokens(odd).collect()) == 4


def test_separator_strings_count_as_the_text_they_are(spark, tmp_path):
    texts = ["<|endoftext|>", "x<|endoftext|>y", "a <|endoftext|> b<|endoftext|>", "<|endoftext|>" + " " * 50_000 + "b"]
    plain = Tokenizer.from_file(tokenise.tokenizer_path())
    plain.encode_special_tokens = True
    want = {i: plain.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert all(tokenise.EOD_ID not in ids and plain.decode(ids) == t for (_, ids), t in zip(want.items(), texts, strict=True))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["n_tokens"] for r in counts.document_tokens(df).collect()} == {i: len(ids) for i, ids in want.items()}
    path = tmp_path / "tokens"
    counts.write_token_files(df.coalesce(1), str(path))
    ids = np.concatenate([np.frombuffer(f.read_bytes(), "<u2")[:-1] for f in sorted(path.rglob("part-*"))])
    parts = np.split(ids, np.flatnonzero(ids == tokenise.EOD_ID) + 1)
    assert sorted(plain.decode(p[:-1].tolist()) for p in parts if len(p)) == sorted(texts)
