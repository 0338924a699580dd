"""WARC round trips with magic inside payloads, and the pipeline against its stages in plain Python."""

import base64
import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F
from test_dedup import brute

import __spark_entry__ as contract
import corpus_pipeline
from tallyloom.llm import packing, quality, warc


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def expected(pages, least=0):
    first = {}
    for i, html in pages:
        if i is not None:
            first[html] = min(i, first.get(html, i))
    out = Counter()
    for i, html in pages:
        payload = (html or "").encode()
        again = i is not None and first[html] != i and len(payload) >= least
        out[i, len(payload), digest(payload), "revisit" if again else "response", first[html] if again else None] += 1
    return out


def trap(next_length):
    """A record inside a payload, made to end where the payload ends."""
    return f"{warc.MAGIC}WARC-Type: response\r\nWARC-Record-ID: <urn:page-id:666>\r\nContent-Length: {next_length}\r\n\r\nHTTP/1.1 200 OK\r\n\r\n"


PAGES = [
    (1, "<p>plain</p>"), (2, ""), (3, warc.MAGIC), (4, f"x{warc.MAGIC}{warc.MAGIC}y"), (5, "before " + trap(10**6)), (6, "before " + trap(3) + "tail" * 10),
    (7, trap(19)), (8, trap(19) + "\r\n\r\n" + trap(19)), (9, "é" * 2000), (10, "<p>plain</p>"), (11, "\r\n\r\n"), (12, warc.MAGIC), (13, "z" * 200_000),
    (14, "Content-Length: 5\r\n\r\nWARC/1.1"), (15, trap(0)[:40]), (16, ""),
]


@pytest.mark.parametrize("split", ["128m", "1k", "257b"])
def test_round_trip(spark, split):
    pages = [*PAGES, *((100 + i, f"<p>{i % 90} {'word ' * (i % 37)}</p>") for i in range(150))]
    df = spark.createDataFrame([(i, f"http://x/{i}", h) for i, h in pages], "page_id long, url string, html string").repartition(2)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = warc.archive(df).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == expected(pages)
    assert all(r["url"] == f"http://x/{r['page_id']}" for r in got)


def test_payloads_come_back(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", h) for i, h in PAGES], "page_id long, url string, html string").repartition(3)
    warc.write_warc(df, str(tmp_path / "w"), revisit_bytes=10)
    got = {r["page"]: (r["record_type"], bytes(r["payload"])) for r in warc.read_warc(spark, str(tmp_path / "w"), payload=True).collect()}
    assert got.keys() == {str(i) for i, _ in PAGES}
    for i, html in PAGES:
        kind, payload = got[str(i)]
        assert payload == (b"" if kind == "revisit" else html.encode()) and kind == ("revisit" if i in (10, 12) else "response")


def test_broken_files_end_their_chain(spark, tmp_path):
    folder = tmp_path / "w"
    folder.mkdir()
    record = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page-id:{}>\r\nContent-Length: 24\r\n\r\nHTTP/1.1 200 OK\r\n\r\nhello\r\n\r\n"
    (folder / "good.warc").write_bytes(b"".join(record.format(i).encode() for i in range(5)))
    (folder / "cut.warc").write_bytes(b"".join(record.format(i).encode() for i in range(10, 13))[:-8])
    (folder / "noise.warc").write_bytes(b"\xff\xfenoise" + record.format(77).encode())
    (folder / "none.warc").write_bytes(b"")
    got = warc.read_warc(spark, str(folder), payload=True).collect()
    assert sorted(int(r["page"]) for r in got) == [0, 1, 2, 3, 4, 10, 11] and {bytes(r["payload"]) for r in got} == {b"hello"}


def test_nulls_repeats_and_empty(spark):
    rows = [(1, None, None), (2, "u\r\nWARC-Type: x", None), (None, "u", "a"), (None, "u", "a"), (5, "u", "a"), (5, "u", "a"), (6, "u", "a")]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "page_id long, url string, html string, sha1 int, payload string")
    got = warc.archive(df)
    want = expected([(i, h) for i, _, h in rows])
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got.collect()) == want
    assert warc.archive(df.where("1 = 0")).count() == 0


# ---- the pipeline --------------------------------------------------------------

def test_text_ids_come_back(spark):
    ids = ["a>1", "a>2", "50%", "50%25", "two\nlines", "tab\there", "x y+z", "é", "a/b?c=d&e"]
    rows = [(i, f"http://h/{k}", "same" if k < 4 else f"page {k}") for k, i in enumerate(ids)]
    got = warc.archive(spark.createDataFrame(rows, "page_id string, url string, html string"), revisit_bytes=0).collect()
    assert sorted(r["page_id"] for r in got) == sorted(ids)
    first = min(ids[:4])
    assert {r["page_id"]: r["refers_to"] for r in got} == {i: first if i in ids[:4] and i != first else None for i in ids}
    assert {r["payload_bytes"] for r in got if r["page_id"] in ids[:4]} == {4}


def test_queries_match_their_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    queries = contract.queries()
    for name, sql in contract.oracle_sql().items():
        if name.startswith("op"):
            df = queries[name](spark, folder)
            cursor = con.execute(sql)
            columns = [d[0] for d in cursor.description]
            assert sorted(df.columns) == sorted(columns)
            assert Counter(map(tuple, df.select(*columns).collect())) == Counter(cursor.fetchall())


def test_pipeline_against_plain_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    model = quality.fit_quality(docs, labels)
    rows = {r["doc_id"]: r["text"] for r in quality.score_quality(docs, model).where("score >= 0.7").collect()}
    first = {}
    for i, t in rows.items():
        first[t] = min(i, first.get(t, i))
    rows = {i: t for i, t in rows.items() if first[t] == i}
    kept = {i for i, _, _, stays in brute(rows.items()) if stays}
    items = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    rows = {i: t for i, t in rows.items() if i in kept and not any(x in t for x in items)}
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in got} == set(rows)
    whole = defaultdict(int)
    for r in got:
        whole[r["doc_id"]] += r["length"]
    assert all(whole[r["doc_id"]] == r["doc_tokens"] for r in got)


def test_stages_keep_columns_and_stand_odd_rows(spark, tmp_path):
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    rows = [(1, None, None, None, None), (None, "some text here", "en", "s", 3), (2, "", "en", "s", 0), (3, "same words again and again", "en", "s", 5), (4, "same words again and again", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.where("1 = 0"), docs.withColumn("kept", F.lit(1)).withColumn("quality_score", F.lit("x"))):
        for name, stage in corpus_pipeline.STAGES:
            result = stage(spark, table, str(tmp_path))
            assert name == "packing" or result.columns == table.columns
            result.count()
    assert packing.pack(docs).where("doc_id is null").count() > 0


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontamination", "packing"]
    assert not re.search("localCheckpoint", open(corpus_pipeline.__file__).read())
