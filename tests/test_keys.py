"""Keys found from the data."""

import random
from itertools import combinations

import pytest

from tallyloom import ask
from tallyloom.operators import keys


def brute(rows, names, widest):
    found = []
    for width in range(1, widest + 1):
        for s in combinations(range(len(names)), width):
            if any(set(k) <= set(s) for k in found) or any(r[i] in (None, "", " ") for r in rows for i in s):
                continue
            if len({tuple(str(r[i]).strip() for i in s) for r in rows}) == len(rows):
                found.append(s)
    return [tuple(names[i] for i in s) for s in found]


@pytest.mark.parametrize("seed", range(4))
def test_against_all_sets(spark, seed):
    rng = random.Random(seed)
    names = ["a", "b", "c", "d", "e"]
    rows = [(rng.randrange(30), rng.randrange(12), str(rng.randrange(8)), rng.choice(["x", "y", None if seed == 1 else "z"]), i if seed == 2 else i // 2) for i in range(120)]
    df = spark.createDataFrame(rows, "a long, b int, c string, d string, e long").repartition(3)
    assert keys.unique_column_sets(df) == brute(rows, names, 3)
    assert keys.unique_column_sets(df, ["b", "c"], 2) == brute([(r[1], r[2]) for r in rows], ["b", "c"], 2)


def test_many_rows_and_sketches(spark, monkeypatch):
    monkeypatch.setattr(keys, "SKETCHES", 2)
    df = spark.range(40_000).selectExpr("id div 200 AS a", "id % 200 AS b", "id % 7 AS c", "id % 1000 AS d", "cast(id AS double) AS amount", "id > 5 AS flag")
    assert keys.unique_column_sets(df) == [("a", "b"), ("a", "d")]
    assert keys.unique_column_sets(df.selectExpr("a", "d")) == [("a", "d")]


def test_empty_single_and_no_columns(spark):
    df = spark.createDataFrame([], "a long, b string")
    assert keys.unique_column_sets(df) == [] and keys.unique_column_sets(df.select()) == []
    assert keys.unique_column_sets(spark.createDataFrame([(1, "x")], "a long, b string")) == [("a",), ("b",)]
    assert keys.missing_by_found_key(df, df, "a").count() == 0


@pytest.fixture
def booked(spark):
    sold = [(f"S{i % 20}", i // 20, float(i)) for i in range(200)]
    a = spark.createDataFrame(sold, "shop string, `Receipt No` long, Amount double")
    b = spark.createDataFrame([(str(r), 100 + i % 9, s, v) for i, (s, r, v) in enumerate(sold) if v % 10], "number string, clerk long, branch string, amount double")
    return a, b


def test_two_column_key_by_values(booked):
    a, b = booked
    assert keys.shared_key(a, b) == (["shop", "Receipt No"], ["branch", "number"])
    got = keys.missing_by_found_key(a, b, "Amount").first()
    assert tuple(got) == (20, float(sum(range(0, 200, 10))), "shop, Receipt No", "branch, number")


def test_names_come_before_values(spark):
    a = spark.createDataFrame([(i, i % 3) for i in range(30)], "`Order ID` long, kind long")
    b = spark.createDataFrame([(i + 25, i) for i in range(30)], "order_id long, other long")
    assert keys.shared_key(a, b) == (["Order ID"], ["order_id"])
    assert keys.missing_by_found_key(a, b, None).first()["missing_count"] == 25


def test_nulls_in_b_match_nothing(spark):
    a = spark.createDataFrame([(str(i),) for i in range(10)], "k string")
    b = spark.createDataFrame([(None,), ("",), (" 3 ",), ("4",)], "k string")
    assert keys.missing_by_found_key(a, b, None).first()["missing_count"] == 8


def test_ask_by_key(spark, booked):
    a, b = booked
    got = ask("Which transactions are missing by key, and how much?", {"sales": a, "books": b})
    assert got.method == "missing_by_key"
    assert got.text() == "Missing from books: 20 transactions, RM 1,900.00 (matched by shop, Receipt No)"
    assert ask("How many transactions are missing and how much?", {"sales": a, "books": b}).method == "comparison"
    other = spark.createDataFrame([("zz", 1.0)], "word string, Amount double")
    assert ask("compare the files by transaction id, what is missing", {"sales": a, "other": other}).method == "column_detection_error"
