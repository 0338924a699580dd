"""Ties, bounds and types that the driver's tables don't reach."""

from pyspark.sql import functions as F

from tallyloom.operators import clean, history, reconcile


def test_upsert_of_equally_late_updates_is_fixed(spark, rows):
    old = spark.createDataFrame([("a", 1, "old")], "id string, at int, v string")
    updates = [("a", 5, "x"), ("a", 5, "y")]
    for order in (updates, updates[::-1]):
        new = spark.createDataFrame(order, "id string, at int, v string")
        assert rows(history.upsert_latest(old, new, "id", "at")) == [("a", 5, "y")]


def test_keep_none(spark):
    df = spark.createDataFrame([(1, 1), (2, 2)], "t int, k int")
    kept, gone = history.keep_recent_items(df, 0, "t", "k")
    assert kept.count() == 0 and gone.count() == 2


def test_session_data_is_a_map(spark):
    df = spark.createDataFrame([("a", {"k": "v"}), (None, None)], "id string, session_data map<string,string>")
    valid, broken = clean.validate_constraints(df, clean.metadata_rules("user_sessions"))
    assert valid.count() == 1 and broken.first()["failed_rules"] == ["id_set"]


def test_null_keys_are_missing(spark, rows):
    a, b = spark.createDataFrame([(1,), (None,), (2,)], "k int"), spark.createDataFrame([(2,), (None,)], "k int")
    assert rows(reconcile.missing_rows(a, b, F.col("k"), F.col("k"))) == [(1,), (None,)]


def test_paragraphs_are_whole(spark):
    from tallyloom.operators import documents

    html = '<!-- <p>no</p> --><h2 class="t">A <i>b</i></h2><p>foo <b>bar</b> baz</p><p class="c">kept</p><pre>x</pre><P>open<p>next</p>'
    got = documents.html_elements(spark.createDataFrame([(1, html)], "id int, html string"), "id", "html").orderBy("position")
    assert [(r["level"], r["text"]) for r in got.collect()] == [(2, "A b"), (None, "foo bar baz"), (None, "kept"), (None, "open"), (None, "next")]


def test_all_tables_and_rows_count(spark):
    from tallyloom.operators import relate, schema

    tables = {f"t{i}": spark.range(50).withColumnRenamed("id", "user_id") for i in range(5)}
    assert relate.key_relationships(tables).count() == 10 and relate.key_relationships(tables, max_pairs=3).count() == 3
    late = spark.range(3000).selectExpr("id", "if(id >= 2000, 'v' || id, null) as late", "cast(null as string) as never")
    got = {r["column"]: r["sample_values"] for r in schema.extract_schema(late, ["id"]).collect()}
    assert got == {"id": "0|1|2|3|4", "late": "v2000|v2001|v2002|v2003|v2004", "never": ""}


def test_whole_numbers_stay_whole(spark):
    from tallyloom.operators import clean

    df = spark.createDataFrame([("9007199254740993", "1", "99999999999999999999"), (None, "2.5", "1")], "a string, b string, c string")
    got = clean.retype_whole_columns(df)
    assert dict(got.dtypes) == {"a": "bigint", "b": "double", "c": "double"} and got.first()["a"] == 9007199254740993


def test_exported_texts_are_valid(spark):
    import json

    from tallyloom.operators import messages

    talk = spark.createDataFrame([('a"1', 0, "user", 'x < y & "z"'), (None, 0, "user", "n")], "conv_id string, turn int, role string, text string")
    got = {r["conv_id"]: json.loads(r["document"]) for r in messages.export_conversation(talk, "json").collect()}
    assert got['a"1']["conversation_id"] == 'a"1' and got[None]["conversation_id"] is None
    page = messages.export_conversation(talk, "html").where("conv_id is not null").first()["document"]
    assert "x &lt; y &amp; &quot;z&quot;" in page and 'Conversation a&quot;1' in page


def test_times_of_conversations(spark):
    from tallyloom.operators import messages

    talk = spark.createDataFrame(
        [(1, 0, "user", "which?", 5), (1, 1, "assistant", "I recommend an index", 9), (2, 0, "user", "hi", 3), (3, 0, "user", "yo", 7)],
        "conv_id int, turn int, role string, text string, at int")
    assert [r["at"] for r in messages.extract_decisions(talk, timestamp="at").collect()] == [9]
    assert [r["conv_id"] for r in messages.conversation_summary(talk, updated_at="at").collect()] == [1, 3, 2]
    assert [r["conv_id"] for r in messages.conversation_summary(talk).collect()] == [3, 2, 1]


def test_totals_of_an_empty_stream(spark, tmp_path):
    from tallyloom.streaming import incremental

    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("id int, amount double").parquet(str(tmp_path / "in"))
    assert incremental.stream_totals({"in": (stream, "amount")}, str(tmp_path / "totals")).collect() == []


def test_chunk_totals_keep_null_keys(spark):
    import pandas as pd

    from tallyloom.plans.totals import _chunk_totals

    got = _chunk_totals(pd.DataFrame({"l_returnflag": ["A", None], "l_extendedprice": [1.0, 2.0]}))
    assert got["total"].sum() == 3.0
