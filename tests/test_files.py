import json

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import chunks, clean, messages, pick, reconcile, sampling
from tallyloom.sinks import writers
from tallyloom.sources import catalog, conversations, probe, readers
from tallyloom.streaming import incremental

HEADER = "No,Settlement Date,Merchant Reference,Transaction Type,Transaction Amount (RM),Commission (RM),Details,Mode"


def report(n=6):
    lines = ["," * 7, HEADER]
    lines += [f"{i},{i}/12/2024,REF{i},{'QR' if i % 2 else 'Card'},{10 * i + 0.25},0,,{'x' if i == 1 else ''}" for i in range(1, n + 1)]
    total = sum(10 * i + 0.25 for i in range(1, n + 1))
    return "\n".join(lines + [f",,,Total:,{total},0,,"]) + "\n"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "settled.csv").write_text(report())
    (tmp_path / "orders.csv").write_text(
        'Day,Transaction ID,Order name,Gateway,Gross payments\n'
        + "".join(f'2024-12-0{i},77{i:011d},#{i},"Bank, {i}",{10 * i + 0.25 if i < 4 else 1.5 * i}\n' for i in range(1, 8)))
    return tmp_path


def load(spark, path):
    good, _ = readers.quarantine_rows(readers.scan_csv(spark, str(path)))
    return clean.retype_whole_columns(clean.filter_summary_rows(good.drop("source_file")))


def test_question_end_to_end(spark, folder):
    a, b = load(spark, folder / "settled.csv"), load(spark, folder / "orders.csv")
    amount_a, amount_b = pick.find_amount_column(a), pick.find_amount_column(b)
    assert (amount_a, amount_b) == ("Transaction Amount (RM)", "Gross payments")
    got = reconcile.compare_tables(a, b, amount_a, amount_b).first()
    assert (got["count_a"], got["total_a"], got["count_b"]) == (6, 211.5, 7)
    assert (got["common_count"], got["common_amount"], got["missing_count"], got["missing_amount"]) == (3, 60.75, 3, 150.75)


def test_without_the_filter_the_total_counts_twice(spark, folder):
    good, _ = readers.quarantine_rows(readers.scan_csv(spark, str(folder / "settled.csv")))
    got = good.agg(F.count("*"), F.sum(F.col("`Transaction Amount (RM)`").cast("double"))).first()
    assert tuple(got) == (7, 423.0)


def test_head_rows_drop_once_per_file(spark, tmp_path):
    text = report(3)
    body = text.splitlines()
    (tmp_path / "a.csv").write_text(text)
    (tmp_path / "b.csv").write_text("\n".join(body[:4] + [body[1]] + body[4:]) + "\n")  # a repeated header is data
    df = readers.scan_csv(spark, str(tmp_path))
    assert {r[0]: r[1] for r in df.groupBy("source_file").count().collect()} == {"a.csv": 4, "b.csv": 5}


def test_many_different_head_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "MAX_HEAD_LINES", 2)
    for i in range(4):
        (tmp_path / f"{i}.csv").write_text(f"{i},2024-01-0{i + 1}\nname,amount\nx{i},1\nname,amount\n")
    df = readers.scan_csv(spark, str(tmp_path))
    assert df.columns[:2] == ["name", "amount"]
    assert sorted(tuple(r)[:2] for r in df.collect()) == sorted([(f"x{i}", "1") for i in range(4)] + [("name", "amount")] * 4)


def test_bad_rows(spark, tmp_path, rows):
    (tmp_path / "x.csv").write_text('k,name,amount\n1,"a, b",2\n2,b,3,extra\n3,c\n')
    good, bad = readers.quarantine_rows(readers.scan_csv(spark, str(tmp_path)))
    assert rows(good, "k", "name", "amount") == [("1", "a, b", "2"), ("3", "c", None)]
    assert rows(good.select("k")) == [("1",), ("3",)] and good.count() == 2
    assert rows(bad) == [("x.csv", "2,b,3,extra", "too many cells")]


@pytest.mark.parametrize("text, expected", [
    ("a;b;c\n1;2;3\n4;5;6\n", (";", '"')), ("a\tb\n1\t2\n3\t4\n", ("\t", '"')), ("just words\nmore words here\n", (",", '"')),
    ("a;b;c\n1,5;2,5;3,5\n4,5;5,5;6,5\n7,5;8,5;9,5\n", (";", '"')),  # decimal commas
    ("Report; of May\n\nk,name,v\n1,a;b,2\n2,c;d,3\n3,\"e;f, g\",4\n", (",", '"')),
    ("k|'a, b, c'|1\nl|'d, e'|2\n'm'|f|3\n", ("|", "'")), ("it's;1\nthat's;2\n", (";", '"')),
    ("k,v\n1,\"two\nlines; and more\"\n2,x\n", (",", '"')), ("", (",", '"')), ("some words; here\n" + "and none\n" * 9, (",", '"')),
])
def test_dialects(text, expected):
    assert probe.sniff_dialect(text) == expected


@pytest.mark.parametrize("rows, expected", [
    ([["", ""], ["1", "2/3/2024"], ["name", "5"], ["name", "amount"]], 3), ([["1", "2"]], 0), ([["a", "b"], ["1", "2"]], 0),
])
def test_header_search(rows, expected):
    assert probe.find_header_row(rows) == expected


def test_promote_header(spark):
    df = spark.createDataFrame(
        [(0, "No", "Payment type", None, "Amount", "No"), (1, "1", "QR", "x", "5.5", "7"), (2, "2", "Card", None, "6", "8")],
        "pos int, a string, b string, c string, d string, e string")
    got = readers.promote_header(df, order=["pos"])
    assert got.columns == ["No", "Payment type", "Column_2", "Amount", "No_1"]
    assert dict(got.dtypes)["Amount"] == "double" and dict(got.dtypes)["No"] == "bigint" and got.count() == 2
    plain = spark.createDataFrame([("x", "y", "z", "w")], "a string, b string, c string, d string")
    assert readers.promote_header(plain).columns == ["a", "b", "c", "d"]
    head = spark.createDataFrame([("No", "Date", "Type", "Ref"), ("1", "2", "3", "4")], "a string, b string, c string, d string").coalesce(1)
    assert [tuple(r) for r in readers.promote_header(head).collect()] == [(1.0, 2.0, 3.0, 4.0)]


def test_scan_any_reports_problems(spark, folder):
    (folder / "doc.json").write_text(json.dumps([{"k": 1}, {"k": 2}], indent=1))
    (folder / "lines.json").write_text('{"k": 1}\n{"k": 2}\n{"k": 3}\n')
    (folder / "book.xlsx").write_bytes(b"PK")
    scan = readers.scan_any(spark, [str(folder / n) for n in ("settled.csv", "doc.json", "lines.json", "book.xlsx", "absent.csv")])
    assert sorted(p.rsplit("/", 1)[-1] for p in scan.tables) == ["doc.json", "lines.json", "settled.csv"]
    assert scan.tables[str(folder / "doc.json")].count() == 2 and scan.tables[str(folder / "lines.json")].count() == 3
    assert {r["path"].rsplit("/", 1)[-1] for r in scan.errors.collect()} == {"book.xlsx", "absent.csv"}


def test_catalog(spark, folder):
    (folder / "book.xlsx").write_bytes(b"PK")
    listed, errors = catalog.file_catalog(spark, str(folder), order_by="size")
    got = listed.collect()
    assert [r["bytes"] for r in got] == sorted((r["bytes"] for r in got), reverse=True)
    assert {r["file"]: (r["rows"], r["columns"]) for r in got} == {"settled.csv": (7, 8), "orders.csv": (7, 5), "book.xlsx": (None, None)}
    types = {r["file"]: r["types"] for r in got}
    assert types["orders.csv"] == "Day:object,Transaction ID:int64,Order name:object,Gateway:object,Gross payments:float64"
    assert errors.count() == 1


def test_catalog_by_full_path(spark, tmp_path):
    for place, text in {
        "one/data.csv": "k,name\n1,a\n2,b\n3,c\n", "two/data.csv": "k,name\n" + "1,a\n" * 5, "two/empty.csv": "k,name\n",
        "two/data.json": '{"k": 1}\n{"k": 2}\n', "two/other.json": '[{"z": 1}]', "two/broken.parquet": "no such format",
        "two/surplus.csv": "k,name\n1,a,b\n",
    }.items():
        (tmp_path / place).parent.mkdir(exist_ok=True)
        (tmp_path / place).write_text(text)
    listed, errors = catalog.file_catalog(spark, str(tmp_path))
    got = {"/".join(r["file_path"].split("/")[-2:]): (r["rows"], r["types"]) for r in listed.collect()}
    assert got == {
        "one/data.csv": (3, "k:int64,name:object"), "two/data.csv": (5, "k:int64,name:object"), "two/empty.csv": (0, None),
        "two/data.json": (2, "k:int64"), "two/other.json": (1, "z:int64"), "two/broken.parquet": (None, None), "two/surplus.csv": (1, "k:int64,name:object")}
    assert [r["path"].rsplit("/", 1)[-1] for r in errors.collect()] == ["broken.parquet"]


def test_mixed_folder(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,name\n1,a\n2,b,c\n")
    (tmp_path / "b.json").write_text('{"k": 1}\n{"k": 2}\n')
    (tmp_path / "c.json").write_text('[{"k": 3},\n{"k": 4}]')
    scan = readers.scan_any(spark, [str(tmp_path)])
    assert {p.rsplit(".", 1)[-1]: t.count() for p, t in scan.tables.items()} == {"csv": 1, "json": 4}
    assert [(r["source_file"], r["raw"]) for r in scan.bad_rows.collect()] == [("a.csv", "2,b,c")] and scan.errors.isEmpty()


def test_header_of_any_length(spark, tmp_path):
    names = [f"a_rather_long_column_name_{i}" for i in range(1200)]
    (tmp_path / "wide.csv").write_text("\n".join([",".join(names), ",".join(map(str, range(1200)))]) + "\n")
    good, bad = readers.quarantine_rows(readers.scan_csv(spark, str(tmp_path)))
    assert good.columns[:-1] == names and bad.isEmpty() and good.first()[names[-1]] == "1199"


def test_unreadable_files_do_not_vanish(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,name\n1,a\n")
    probe_bad = spark.createDataFrame([(f"file:{tmp_path}/gone.csv",)], "path string").mapInPandas(probe._local_heads, "path string, head binary, error string")
    assert probe_bad.first()["error"].startswith("FileNotFoundError")
    with pytest.raises(OSError, match="1 unreadable"):
        readers.scan_csv(spark, str(tmp_path), encoding="no-such-encoding")
    assert readers.scan_csv(spark, str(tmp_path), encoding="no-such-encoding", on_error="skip").isEmpty()
    assert readers.unreadable_files(spark, str(tmp_path)).isEmpty()


def test_heads_by_spark_equal_local_ones(spark, tmp_path):
    """A path that only Spark's file systems know."""
    (tmp_path / "a.csv").write_text(report(300))
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.shop.link./in", f"file://{tmp_path}")
    got = readers.scan_csv(spark, "viewfs://shop/in/a.csv").drop("source_file")
    assert got.count() == 301 and got.exceptAll(readers.scan_csv(spark, str(tmp_path)).drop("source_file")).isEmpty()


def test_conversations(spark, tmp_path):
    talk = {"conversation_id": "c1", "title": "T", "messages": [{"role": "user", "content": "hi", "timestamp": 1.0}, {"role": "assistant", "content": "yo"}], "data_files": ["a.csv"]}
    (tmp_path / "good.json").write_text(json.dumps(talk, indent=2))
    (tmp_path / "broken.json").write_text('{"conversation_id": "c2", "messages": [')
    good, bad = conversations.scan_conversations(spark, str(tmp_path))
    assert [(r["turn"], r["role"], r["content"]) for r in good.orderBy("turn").collect()] == [(0, "user", "hi"), (1, "assistant", "yo")]
    assert [r["source_file"] for r in bad.collect()] == ["broken.json"]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", you', None), (2, None, 1.5)], "k int, t string, x double")
    history = str(tmp_path / "history")
    writers.write_csv(df, str(tmp_path / "csv"), history=history)
    writers.write_json(df, str(tmp_path / "json"), history=history)
    assert sorted(r["format"] for r in spark.read.parquet(history).collect()) == ["csv", "json"]
    for fmt in ("csv", "json"):
        assert all(r["is_same"] for r in writers.validate_export(df, str(tmp_path / fmt), fmt).collect())
    changed = df.withColumn("x", F.coalesce("x", F.lit(0.0)))
    assert {r["column"] for r in writers.validate_export(changed, str(tmp_path / "csv")).where("not is_same").collect()} == {"x"}


def test_split_output(spark, tmp_path):
    writers.split_output(spark.range(95).coalesce(1), str(tmp_path / "parts"), 30)
    files = sorted((tmp_path / "parts").glob("part-*.csv"))
    assert [len(f.read_text().splitlines()) for f in files] == [31, 31, 31, 6]


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(10).selectExpr("id", "id * 1.5D as amount").repartition(4).write.parquet(source)
    drain = lambda: incremental.drain(incremental.incremental_scan(spark, source, files_per_trigger=1), str(tmp_path / "out"), str(tmp_path / "state"))
    assert drain().count() == 10
    spark.range(5).selectExpr("id", "1.0D as amount").write.mode("append").parquet(source)
    assert drain().count() == 15
    totals = incremental.stream_totals({"in": (incremental.incremental_scan(spark, source, files_per_trigger=1), "amount")}, str(tmp_path / "totals"))
    assert [tuple(r) for r in totals.collect()] == [("in", 72.5, 15)]


def test_process_fn(spark):
    df = spark.range(10).selectExpr("id", "cast(id as double) as x").coalesce(1)

    def fails(batch):
        raise ValueError("no")

    assert chunks.apply_process_fn(df, fails, on_error="passthrough").count() == 10
    with pytest.raises(Exception):
        chunks.apply_process_fn(df, fails).count()
    with pytest.raises(ValueError):
        chunks.apply_process_fn(df, fails, "id long", on_error="passthrough")


def test_random_sample_is_stable(spark, rows):
    df = spark.range(1000)
    assert rows(sampling.random_sample(df, ["id"], 20)) == rows(sampling.random_sample(df.repartition(7), ["id"], 20))
    assert sampling.random_sample(df, ["id"], 20, seed=1).exceptAll(sampling.random_sample(df, ["id"], 20)).count() > 0
    assert sampling.random_sample(df, ["id"], 5000).count() == 1000


def test_time_series_finds_the_date(spark):
    df = spark.createDataFrame([("2024-01-02", 1.0, "x"), ("2024-01-01", 2.0, "y")], "sale_date string, v double, update_time string")
    assert [r["value"] for r in sampling.time_series(df, "v").collect()] == [2.0, 1.0]
    with pytest.raises(ValueError):
        sampling.time_series(df.select("v"), "v")


@pytest.mark.parametrize("question, tables, expected", [
    ("Compare the two files", 1, ("comparison", 0.1)), ("What is the total?", 1, ("aggregation", 0.333333)),
    ("What total is missing?", 1, ("analysis", 0.0)), ("missing total", 1, ("aggregation", 0.333333)),
    ("How many transactions are missing and how much?", 2, ("comparison", 0.5)), ("", 2, ("comparison", 0.5)), ("hello", 1, ("analysis", 0.0)),
    ("match transactions", 2, ("transaction_matching", 0.333333)), ("missing how much RM", 1, ("comparison", 0.1)),
])
def test_intents(spark, question, tables, expected):
    df = spark.createDataFrame([(question,)], "q string")
    got = messages.classify_intent(df, "q", tables).first()
    assert (got["intent"], got["confidence"]) == expected


def test_scores(spark):
    df = spark.createDataFrame([("You should use the id column.\n\n- next step: create an index", "which id column?"), ("", "")], "r string, q string")
    full, blank = messages.score_responses(df, "r", "q").collect()
    assert (full["length_score"], full["structure_score"], full["relevance_score"]) == (1.0, 0.8, 0.666667)
    assert full["action_score"] == 1.0 and blank["relevance_score"] == 0.0
