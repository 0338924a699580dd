"""Column types from all values, for unified schemas."""

from tallyloom.operators import schema


def test_types_of_text_columns(spark):
    df = spark.createDataFrame(
        [("1", "1.5", "007", "2", None, "9223372036854775808", "1e3", "x", 1, ""), (" -20 ", ".5", "12", "b", None, "3", "-2.", "y", 2, "4"),
         (None, "3", None, None, None, None, None, None, None, None)],
        "whole string, number string, code string, mixed string, none string, big string, power string, word string, n int, blank string")
    assert schema.value_types(df) == {
        "whole": "INTEGER", "number": "DECIMAL", "code": "TEXT", "mixed": "TEXT", "none": None, "big": "TEXT", "power": "DECIMAL", "word": "TEXT",
        "n": "INTEGER", "blank": "TEXT"}
    assert set(schema.value_types(df.limit(0)).values()) == {None, "INTEGER"}


def test_one_late_value_decides(spark):
    df = spark.range(5000).selectExpr("if(id = 4999, 'x', cast(id AS string)) AS a", "if(id = 4999, '0.5', cast(id AS string)) AS b")
    assert schema.value_types(df) == {"a": "TEXT", "b": "DECIMAL"}


def test_texts_are_migrated_as_what_they_hold(spark, rows):
    a = spark.createDataFrame([("1", "2.5", None), ("2", None, None)], "id string, Amount string, note string")
    b = spark.createDataFrame([(3, 4, 7)], "id int, amount int, note int")
    mapping = {(r["source_file"], r["target_column"]): r for r in schema.unify_schema({"a": a, "b": b}, by_values=True).collect()}
    assert {k: r["unified_type"] for k, r in mapping.items() if k[0] == "a"} == {("a", "id"): "INTEGER", ("a", "amount"): "DECIMAL", ("a", "note"): "INTEGER"}
    assert mapping["a", "note"]["confidence"] == 0.7 and mapping["b", "note"]["confidence"] == 0.9
    moved, _ = schema.migrate({"a": a, "b": b}, schema.unify_schema({"a": a, "b": b}, by_values=True))
    assert rows(moved, "id", "amount", "note", "source_file") == [(1, 2.5, None, "a"), (2, None, None, "a"), (3, 4.0, 7, "b")]
    assert schema.mapping_confidence(schema.unify_schema({"a": a, "b": b}, by_values=True)).first() == (6, 5, 1)
