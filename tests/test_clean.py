import pytest
from pyspark.sql import functions as F

from tallyloom.functions.scalars import name_similarity, unique_names
from tallyloom.operators import clean, pick


def test_summary_rows(spark, rows):
    df = spark.createDataFrame([
        ("a", "Sale", 1.0), ("b", "Total:", 9.0), ("c", "consumer", 2.0), ("d", "Subtotal", 1.0), ("e", None, None), (None, "AMOUNT DUE", 1.0),
    ], "ref string, kind string, amount double")
    assert rows(clean.filter_summary_rows(df), "ref") == [("a",)]
    assert rows(clean.filter_summary_rows(df, word_boundary=True), "ref") == [("a",), ("c",)]


def test_blank_rows(spark, rows):
    df = spark.createDataFrame([(" ", None), (None, 1), ("x", None), ("", None)], "a string, b int")
    assert rows(clean.drop_blank_rows(df)) == [("x", None), (None, 1)]


def test_retype_needs_every_value(spark):
    df = spark.createDataFrame([("1", " 2 ", "x"), (None, "3.5", "1")], "a string, b string, c string")
    assert dict(clean.retype_whole_columns(df).dtypes) == {"a": "bigint", "b": "double", "c": "string"}


def test_cast_keeps_what_fails(spark, rows):
    df = spark.createDataFrame([("7",), ("x",), (None,)], "v string")
    assert rows(clean.cast_by_schema(df, {"v": "int"})) == [(7, None, False), (None, "x", True), (None, None, False)]


def test_dates_in_two_formats(spark, rows):
    df = spark.createDataFrame([("31/1/2024", "2024-01-31"), ("2024-02-01", "2024-02-01")], "pay_date string, day string")
    coerced = clean.parse_dates(df, ["pay_date"], "d/M/yyyy")
    assert [r[0] for r in rows(coerced.where("pay_date is null").select("day"))] == ["2024-02-01"]
    assert dict(clean.parse_dates(df, ["pay_date"], "d/M/yyyy", on_error="keep").dtypes)["pay_date"] == "string"
    assert rows(clean.date_string_columns(df), "column", "is_date_string") == [("pay_date", False)]


def test_narrow_types(spark):
    df = spark.createDataFrame([(1, 300, 70000, 7_700_000_000_000, 1.5), (-5, -300, 1, 1, 2.5)], "a long, b long, c long, d long, e double")
    assert dict(clean.narrow_types(df).dtypes) == {"a": "tinyint", "b": "smallint", "c": "int", "d": "bigint", "e": "double"}


def test_map_columns(spark):
    df = spark.createDataFrame([(1, "x")], "`Old Name` int, kept string")
    got = clean.map_columns(df, {"Old Name": "new"}, {"kept": "string", "new": "bigint", "absent": "double"})
    assert [tuple(r) for r in got.collect()] == [("x", 1, None)]


def test_confidence_limit_is_exclusive(spark, rows):
    df = spark.createDataFrame([("a", 70.0), ("b", 70.1), (" ", 99.0), (None, 99.0)], "text string, conf double")
    assert rows(clean.confidence_filter(df), "text") == [("b",)]


def test_rules_pass_on_null(spark):
    df = spark.createDataFrame([(1, 120.0), (2, None), (None, 50.0)], "id int, progress_percentage double")
    valid, broken = clean.validate_constraints(df, clean.metadata_rules("processing_states"))
    assert [r["id"] for r in valid.collect()] == [2]
    assert sorted((r["id"], r["failed_rules"]) for r in broken.collect() if r["id"]) == [(1, ["progress_in_range"])]


@pytest.mark.parametrize("columns, expected", [
    ("`No` long, `Settlement Amount (RM)` double, `Transaction Amount (RM)` double", "Transaction Amount (RM)"),
    ("k long, `Gross total` string", "Gross total"),
    ("big long, small double", "small"),
    ("only_text boolean", None),
])
def test_amount_column(spark, columns, expected):
    values = {"No": 1, "k": 1, "big": 10 ** 9, "small": 12.5, "Gross total": "3.5", "only_text": True}
    names = spark.createDataFrame([], columns).columns
    df = spark.createDataFrame([tuple(values.get(n, 5.0) for n in names)], columns)
    assert pick.find_amount_column(df) == expected


def test_id_column(spark):
    assert pick.find_id_column(spark.createDataFrame([], "paid string, `Order` string")) == "paid"
    assert pick.find_id_column(spark.createDataFrame([], "paid string, Reference string")) == "Reference"
    assert pick.find_id_column(spark.createDataFrame([], "a string")) is None


def test_names():
    assert unique_names(["a", None, "A", "a", ""]) == ["a", "Column_1", "A_1", "a_2", "Column_4"]
    assert name_similarity("Customer_ID", "customer id") == 1.0
    assert name_similarity("id", "order_id") == 0.8
    assert name_similarity("ab", "bc") == pytest.approx(1 / 3)


def test_stringify(spark):
    df = spark.range(1).select(F.array(F.lit(1)).alias("a"), F.create_map(F.lit("k"), F.lit(2)).alias("m"), "id")
    assert [tuple(r) for r in clean.stringify_complex(df).collect()] == [("[1]", '{"k":2}', 0)]
