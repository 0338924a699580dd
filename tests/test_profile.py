import pytest
from pyspark.sql import functions as F

from tallyloom.operators import profile, quality, relate, schema


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "n double, t string, d timestamp_ntz, b boolean")


def test_empty_table(empty):
    assert {r["column"]: r["unique_count"] for r in profile.column_statistics(empty).collect()} == {"n": 0, "t": 0, "d": 0, "b": 0}
    assert profile.profile_numeric(empty).first()["outlier_count"] == 0
    assert profile.profile_datetime(empty).first()["range_days"] is None
    assert profile.duplicate_rows(empty).first()["duplicate_percent"] == 0.0
    assert profile.histogram(empty, "n").count() == 0
    assert profile.outlier_rows(empty, "n").count() == 0
    assert profile.table_profile(empty).count() == 5
    assert quality.quality_score_simple(empty).first()["score"] == 1.0
    assert quality.quality_scorecard(empty).where("item = 'issue'").count() == 0


def test_duplicates_are_null_safe(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), (None, "a"), ("a", "a")], "x string, y string")
    assert profile.duplicate_rows(df).first()["duplicates"] == 1


def test_mode_ties_take_the_smaller(spark, rows):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",)], "v string")
    assert rows(profile.top_values(df, ["v"], 2), "value", "rank") == [("a", 1), ("b", 2)]
    assert rows(profile.value_counts(df, "v", 1), "value", "share") == [("a", 0.4)]


def test_histogram_of_a_constant(spark):
    got = profile.histogram(spark.createDataFrame([(5.0,), (5.0,), (None,)], "v double"), "v", 4).orderBy("bin").collect()
    assert [r["rows"] for r in got] == [2, 0, 0, 0]


def test_title_case(spark):
    df = spark.createDataFrame([("Red Ring",), ("red",), ("RED",), ("éCole",), ("12",)], "v string")
    got = quality.inconsistent_case(df).first()
    assert (got["any_lower"], got["any_upper"], got["any_title"], got["is_inconsistent"]) == (True, True, True, True)
    odd = spark.createDataFrame([("rED",), ("Red ring",), ("12",)], "v string")
    assert not quality.inconsistent_case(odd).first()["any_title"]


def test_wide_table_takes_several_passes(spark, monkeypatch):
    monkeypatch.setattr(profile, "WIDE_LIMIT", 4)
    df = spark.range(10).selectExpr(*[f"id + {i} as c{i}" for i in range(7)])
    assert profile.null_report(df).count() == 8


def test_moderate_missing(spark):
    # Over half of the columns mostly empty, yet 70% of the cells filled is impossible to miss: 2 of 3 columns at 60%.
    df = spark.createDataFrame([(i, None if i < 6 else i, None if i < 6 else i) for i in range(10)], "a int, b int, c int")
    got = quality.quality_score_simple(df).first()
    assert (got["issue"], got["completeness"], got["score"]) == ("high_missing_data", 0.6, 0.55)


def test_relationship_kinds(spark):
    customers = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id int, name string")
    orders = spark.createDataFrame([(10, 1.0), (11, 1.0), (12, 2.0), (13, None)], "order_id int, customer_id double")
    got = relate.column_relationship(customers, orders, "id", "customer_id").first()
    assert (got["relationship_type"], got["source_overlap"], got["target_overlap"]) == ("one-to-many", 0.666667, 1.0)
    assert got["confidence"] == pytest.approx(0.7 * 2 / 3 + 0.3 * 0.5, abs=1e-6)
    text = spark.createDataFrame([("1",), ("2",)], "id string")
    assert relate.column_relationship(customers, text, "id", "id").count() == 0


def test_foreign_key_within(spark, rows):
    df = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (3, 1, "c")], "id int, parent int, name string")
    assert rows(relate.foreign_keys_within(df)) == [("id", "parent", 0.333333)]


def test_suggest_schema(spark):
    df = spark.createDataFrame([(i, "on" if i % 2 else "off", "x" * 60, i, None) for i in range(100)],
                               "id int, state string, note string, owner_id int, gone double")
    got = {r["column"]: r for r in schema.suggest_schema(df).collect()}
    assert got["id"]["primary_key"] and not got["id"]["index"] and got["owner_id"]["index"]
    assert (got["state"]["sql_type"], got["note"]["sql_type"]) == ("ENUM(off, on)", "ENUM(" + "x" * 60 + ")")
    assert got["gone"]["nullable"]


def test_migrate_lists_failures(spark):
    tables = {"a": spark.createDataFrame([(1, "x")], "Id int, `Full Name` string"), "b": spark.createDataFrame([("2",)], "id string")}
    mapping = schema.unify_schema(tables)
    everything = {**tables, "c": spark.createDataFrame([(1,)], "z int")}
    data, report = schema.migrate(everything, mapping)
    assert sorted(map(tuple, data.collect())) == [("1", "x", "a"), ("2", None, "b")]
    assert [(r["source_file"], r["reason"]) for r in report.where("status = 'failed'").collect()] == [("c", "no column mapping")]
    assert schema.create_table_sql("t", {"id": "TEXT", "n": "DECIMAL"}, ["id"]) == "CREATE TABLE t (\n  id TEXT,\n  n DECIMAL,\n  PRIMARY KEY (id)\n);"
    assert schema.mapping_confidence(mapping).first().asDict() == {"total_mappings": 3, "high_confidence": 3, "low_confidence": 0}


def test_distinct_counts(spark):
    df = spark.createDataFrame(
        [(1, 1.5, "a", True), (1, -0.5, "b", None), (None, None, None, True), (3, 1.5, "a", False)], "i int, d double, t string, b boolean")
    exact = {r[0]: r[1] for r in profile.distinct_counts(df, df.columns).collect()}
    assert exact == {"i": 2, "d": 2, "t": 2, "b": 2}
    assert {r[0]: r[1] for r in profile.distinct_counts(df, df.columns, approx=True).collect()} == exact
    big = spark.range(20000).selectExpr("id", "id * 1.25D d", "cast(id as string) t")
    assert {r[1] for r in profile.distinct_counts(big, big.columns).collect()} == {20000}


def test_most_frequent(spark):
    df = spark.createDataFrame(
        [("b", "x1", None), ("a", "x3", None), ("b", "x2", None), ("a", "x0", None), (None, "x9", None)], "t string, u string, e string")
    for short in (-1, 1, 100):
        got = {r["column"]: (r["top_value"], r["top_count"]) for r in profile.most_frequent(df, ["t", "u", "e"], short).collect()}
        assert got == {"t": ("a", 2), "u": ("x0", 1), "e": (None, None)}


def test_nested_columns_count_too(spark):
    df = spark.createDataFrame([({"a": 1}, [1]), ({"a": 1}, [1]), ({"a": 2}, None)], "m map<string, int>, l array<int>")
    assert {r[0]: r[1] for r in profile.distinct_counts(df, df.columns).collect()} == {"m": 2, "l": 1}
    assert profile.duplicate_rows(df).first()["duplicates"] == 1


def test_candidates_of_all_tables(spark, rows):
    tables = {
        "a": spark.range(20).selectExpr("id", "id % 5 as x_id", "id % 3 as y_id"),
        "b": spark.range(10).selectExpr("id as x_id", "id % 3 as y_id", "id as z_key"),
    }
    assert len(rows(relate.detect_relationships(tables))) == 9
    df = tables["a"].selectExpr("id", "id div 2 as parent", "x_id", "1 as one")
    assert rows(relate.foreign_keys_within(df)) == [("id", "one", 0.05), ("id", "parent", 0.5), ("id", "x_id", 0.25)]
    assert relate.foreign_keys_within(df.drop("id")).count() == 0


def test_counts_of_candidates(spark, rows):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,)], "x int")
    b = spark.createDataFrame([(1,), (3,), (None,), (None,)], "y long")
    pairs = [("a", "b", "x", "y"), ("b", "a", "y", "x"), ("a", "a", "x", "x"), ("a", "e", "x", "z")]
    got = relate.measure_candidates({"a": a, "b": b, "e": spark.createDataFrame([], "z int")}, pairs)
    assert sorted(tuple(r)[:2] + tuple(r)[4:] for r in got.collect()) == sorted([
        ("a", "b", 4, 2, 1, 4, 2, 2, 1, 2), ("b", "a", 4, 2, 2, 4, 2, 1, 1, 1), ("a", "a", 4, 2, 1, 4, 2, 1, 2, 3), ("a", "e", 4, 2, 1, 0, 0, 0, 0, 0)])


def test_candidates_of_a_wide_table(spark):
    wide = spark.range(40).select(*[(F.col("id") + 1000 * i).alias(f"c{i}") for i in range(299)], (F.col("id") % 4).alias("d"))
    assert [tuple(r) for r in relate.foreign_keys_within(wide).collect()] == [("c0", "d", 0.1)]


def test_equal_columns_of_a_wide_table(spark, rows):
    wide = spark.range(30).select(*[F.when(F.col("id") != i, F.col("id")).alias(f"c{i}") for i in range(60)])
    assert rows(profile.duplicate_columns(wide)) == sorted((f"c{i}", f"c{j}") for i in range(30, 60) for j in range(i + 1, 60))
    odd = spark.createDataFrame([(None, None, 0.0, -0.0, [1], [1], 0)] * 2 + [(1, 1, 1.0, 1.0, None, None, 0)], "a int, b int, x double, y double, l array<int>, m array<int>, z int")
    assert rows(profile.duplicate_columns(odd)) == [("a", "b"), ("l", "m"), ("x", "y")]
    assert profile.duplicate_columns(odd.where("false").select("a", "b")).count() == 1
