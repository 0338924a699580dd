import random

import pytest

from tallyloom.operators import history, reconcile, totals


@pytest.fixture(scope="module")
def pair(spark):
    rng = random.Random(3)
    a = [10.0] * 300 + [round(rng.uniform(0, 30), 2) for _ in range(600)] + [None] * 5
    b = [10.0] * 50 + [round(rng.uniform(0, 30), 2) for _ in range(400)] + [None]
    frame = lambda v: spark.createDataFrame([(x,) for x in v], "amount double").repartition(3)
    return a, b, frame(a), frame(b)


def first(df):
    return df.first().asDict()


def test_match_and_missing(pair):
    a, b, fa, fb = pair
    known = {round(x, 2) for x in b if x is not None}
    hit = [x for x in a if x is not None and round(x, 2) in known]
    miss = [x for x in a if x is None or round(x, 2) not in known]
    assert first(reconcile.match_by_amount(fa, fb, "amount", "amount")) == {"common_count": len(hit), "common_amount": round(sum(hit), 2)}
    got = first(reconcile.missing_by_amount(fa, fb, "amount", "amount"))
    assert got == {"missing_count": len(miss), "missing_amount": round(sum(x or 0 for x in miss), 2)}
    key = reconcile.amount_key
    assert reconcile.missing_rows(fa, fb, key(fa.amount), key(fb.amount)).count() == len(miss)
    assert reconcile.matching_rows(fa, fb, key(fa.amount), key(fb.amount)).count() == len(hit)


@pytest.mark.parametrize("tolerance", [0, 1, 3, 100])
def test_tolerance(pair, tolerance):
    a, b, fa, fb = pair
    cents = {round(x * 100) for x in b if x is not None}
    hit = [x for x in a if x is not None and any(round(x * 100) + d in cents for d in range(-tolerance, tolerance + 1))]
    got = first(reconcile.match_with_tolerance(fa, fb, "amount", "amount", tolerance_units=tolerance))
    assert got == {"common_count": len(hit), "common_amount": pytest.approx(sum(hit), abs=0.01)}


def test_compare_text(spark):
    a = spark.createDataFrame([(1000.5,), (2.0,), (None,)], "x double")
    b = spark.createDataFrame([("1000.50",), ("7",)], "y string")
    got = first(reconcile.compare_tables(a, b, "x", "y", "a.csv", "b.csv"))
    assert (got["common_count"], got["missing_count"], got["missing_amount"]) == (1, 2, 2.0)
    assert got["answer"] == "\n".join([
        "Direct comparison results:", "• a.csv: 3 transactions, RM 1,002.50", "• b.csv: 2 transactions, RM 1,007.50",
        "• Difference: 1 transactions, RM 5.00", "• Common transactions: 1 found", "• Missing from b.csv: 2 transactions, RM 2.00"])


def test_empty_sides(spark):
    a, none = spark.createDataFrame([(1.0,)], "x double"), spark.createDataFrame([], "x double")
    assert first(reconcile.match_by_amount(a, none, "x", "x")) == {"common_count": 0, "common_amount": 0.0}
    assert first(reconcile.missing_by_amount(a, none, "x", "x")) == {"missing_count": 1, "missing_amount": 1.0}
    assert first(reconcile.compare_tables(none, none, "x", "x"))["count_a"] == 0


def test_subset_ignores_null(spark):
    a = spark.createDataFrame([(1,), (2,)], "x int")
    b = spark.createDataFrame([(1,), (None,)], "y int")
    assert first(reconcile.subset_check(a, b, "x", "y")) == {"values_b": 1, "not_in_a": 0, "is_subset": True}
    assert first(reconcile.inclusion_ratio(b, a, "y", "x"))["ratio"] == 0.5


def test_mean_without_positive_table(spark, rows):
    df = spark.createDataFrame([(-1.0,)], "x double")
    empty = spark.createDataFrame([], "x double")
    got = {r["source"]: r["mean"] for r in totals.mean_across({"a": (df, "x"), "b": (empty, "x"), "c": (df, None)}).collect()}
    assert got == {"a": -1.0, "b": None, "c": None, "(all)": None}


def test_totals_keep_empty_tables(spark):
    df = spark.createDataFrame([(1.5,), (2.5,)], "x double")
    empty = spark.createDataFrame([], "x double")
    got = {r["source"]: (r["total"], r["rows"]) for r in totals.total_across({"a": (df, "x"), "b": (empty, "x"), "c": (df, None)}).collect()}
    assert got == {"a": (4.0, 2), "b": (0.0, 0), "c": (0.0, 2), "(all)": (4.0, 4)}


def test_cascade(spark):
    gone = spark.createDataFrame([(1,)], "id int")
    files = spark.createDataFrame([(10, 1), (11, 2)], "id int, session int")
    states = spark.createDataFrame([(100, 10), (101, 11)], "id int, file int")
    doomed = history.cascade_delete(gone, "id", {"files": (files, "id", "session"), "states": (states, "id", "file")}, parents={"states": "files"})
    assert {t: [r[0] for r in df.collect()] for t, df in doomed.items()} == {"files": [10], "states": [100]}


def test_upsert_prefers_the_update_on_ties(spark, rows):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 5), (3, "c", 9)], "id int, v string, at int")
    new = spark.createDataFrame([(1, "x", 5), (3, "y", 8), (4, "z", 1)], "id int, v string, at int")
    assert rows(history.upsert_latest(old, new, "id", "at"), "id", "v") == [(1, "x"), (2, "b"), (3, "c"), (4, "z")]


def test_keep_recent(spark, rows):
    df = spark.createDataFrame([(1, 5), (2, 9), (3, 9), (4, 1)], "id int, at int")
    newest, removed = history.keep_recent_items(df, 2, "at", "id")
    assert rows(newest, "id") == [(2,), (3,)] and rows(removed, "id") == [(1,), (4,)]
    assert history.keep_recent_items(df, 10, "at", "id")[1].count() == 0


def test_histories(spark, rows):
    df = spark.createDataFrame([(i, i % 2, i * 10) for i in range(6)], "id int, session_id int, timestamp int")
    assert rows(history.conversation_history(df, 2, session=1, before=50), "id") == [(1,), (3,)]
    assert rows(history.conversation_history(df, 1), "id") == [(4,), (5,)]
    assert rows(history.usage_history(df, 10, 30, session=1), "id") == [(1,), (3,)]
    assert rows(history.usage_history(df, 10, 30), "id") == [(1,), (2,), (3,)]
    states = df.withColumnsRenamed({"session_id": "file_id", "timestamp": "started_at"})
    assert [r["id"] for r in history.file_history(states, file=0).collect()] == [4, 2, 0]
    assert [r["id"] for r in history.file_history(states).collect()] == [4, 2, 0, 5, 3, 1]


def test_retention(spark, rows):
    df = spark.createDataFrame([(1, 5), (2, 20), (3, None)], "id int, at int")
    kept, figures = history.retention_cleanup(df, "at", 10)
    assert rows(kept, "id") == [(2,), (3,)] and first(figures) == {"removed": 1, "kept": 2}
