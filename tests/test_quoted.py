"""Files with line breaks in quoted cells, read in many splits."""

import csv
import io
import random

import pytest

from tallyloom.sources import quoted, readers


@pytest.fixture
def small_splits(spark):
    """Splits of a few dozen bytes."""
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")}
    yield lambda size: [spark.conf.set(k, v) for k, v in zip(old, (str(size), "0", "1"))]
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cells(rng):
    return rng.choice(["plain", "", 'say ""hi""', "two\nlines", "a, b", "\n", "é\n\n\nü", '"', 'x"y\n"z"', "w" * 40, "1"])


def as_rows(df, names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


@pytest.mark.parametrize("size", [7, 31, 64, 200, 1000, 1 << 20])
def test_equals_the_unsplit_reader(spark, tmp_path, small_splits, size):
    rng = random.Random(size)
    names = ["id", "name", "note", "last"]
    for k in range(3):
        table = [[str(i), cells(rng), cells(rng), rng.choice(["x", "end\nof row"])] for i in range(60)]
        with open(tmp_path / f"f{k}.csv", "w", encoding="utf-8", newline="") as f:
            csv.writer(f, lineterminator="\n").writerows([names, *table])
    want = spark.read.csv(str(tmp_path), header=True, multiLine=True, escape='"', schema=", ".join(f"{n} string" for n in names))
    small_splits(size)
    got = readers.scan_csv(spark, str(tmp_path), sep=",", quote='"', multi_line=True)
    if size < 100:
        assert quoted._lines(spark, [str(tmp_path)], '"').select("file", "block").distinct().count() > 30
    assert as_rows(got, names) == as_rows(want, names) and got.where("_bad_record is not null").isEmpty()


@pytest.mark.parametrize("size", [9, 40, 1 << 20])
def test_records_are_numbered_as_they_stand(spark, tmp_path, small_splits, size):
    text = 'a,b\r\n1,"x\r\ny"\r\n\r\n2,""\r\n"3\n\n4","q""\n"\n\n5,6'
    (tmp_path / "t.csv").write_bytes(b"\xef\xbb\xbf" + text.encode())
    small_splits(size)
    got = {r["record_no"]: r["text"] for r in quoted.records(spark, [str(tmp_path / "t.csv")], '"').collect()}
    assert got == {0: "a,b", 1: '1,"x\r\ny"', 2: '2,""', 3: '"3\n\n4","q""\n"', 4: "5,6"}
    assert [r for r in csv.reader(io.StringIO(text, newline="")) if r] == [next(csv.reader(io.StringIO(got[i], newline=""))) for i in range(5)]


@pytest.mark.parametrize("size", [11, 30, 1 << 20])
def test_a_quote_that_never_closes(spark, tmp_path, small_splits, size):
    (tmp_path / "t.csv").write_text('id,note\n1,"two\nlines"\n2,"open\n3,three\n4,four\n5,"x""y"\n')
    small_splits(size)
    good, bad = readers.quarantine_rows(readers.scan_csv(spark, str(tmp_path / "t.csv"), sep=",", quote='"', multi_line=True))
    assert as_rows(good, ["id", "note"]) == [("1", "two\nlines")]
    assert sorted(r["raw"] for r in bad.collect()) == ['2,"open', "3,three", "4,four", '5,"x""y"']
    assert sorted(r["record_no"] for r in quoted.records(spark, [str(tmp_path / "t.csv")], '"').collect()) == list(range(6))


def test_lead_rows_wide_rows_and_empty_files(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text('"1\n2",3,4\n\nno,kind,amount\n1,"a\nb",2\n2,c,3,4\n3\n')
    (tmp_path / "b.csv").write_text("")
    small_splits(16)
    good, bad = readers.quarantine_rows(readers.scan_csv(spark, str(tmp_path), sep=",", quote='"', multi_line=True))
    assert bad.count() == 1 and bad.first()["raw"] == "2,c,3,4"
    assert as_rows(good, ["no", "kind", "amount"]) == [("1", "a\nb", "2"), ("3", None, None)]
