"""Ids and references over several tables."""

import pytest

from tallyloom.functions import fixed_values as fixed
from tallyloom.operators import references


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_orphans_and_repeated_ids(spark, rows):
    parent = frame(spark, [(1,), (2,), (2,), (None,), (None,)], "id long")
    child = frame(spark, [("a", 1), ("b", 9), ("c", 9), ("d", None), ("a", 2)], "id string, up long")
    grandchild = frame(spark, [(1, "a"), (2, "z")], "id long, owner string")
    refs = {"child": ("up", "parent"), "grandchild": ("owner", "child"), "absent": ("x", "parent")}
    got = references.reference_errors({"parent": parent, "child": child, "grandchild": grandchild}, refs)
    assert rows(got) == [("child", "id_unique", "a", 2), ("child", "up_exists", "9", 2), ("grandchild", "owner_exists", "z", 1), ("parent", "id_unique", "2", 2)]


def test_hot_orphan_and_missing_parent(spark, rows):
    child = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 77, id) AS up")
    got = references.reference_errors({"child": child}, {"child": ("up", "parent")})
    assert got.where("key = '77'").first()["rows"] == 1001 and got.count() == 2000
    assert references.reference_errors({"child": child, "parent": spark.range(3000)}, {"child": ("up", "parent")}).count() == 0


def test_same_space_for_siblings(spark, rows):
    """Two children of one parent, one of which knows the key."""
    tables = {"p": frame(spark, [(1,)], "id long"), "c": frame(spark, [(5, 2)], "id long, p long"), "d": frame(spark, [(6, 1), (7, 2)], "id long, p long")}
    got = references.reference_errors(tables, {"c": ("p", "p"), "d": ("p", "p")})
    assert rows(got) == [("c", "p_exists", "2", 1), ("d", "p_exists", "2", 1)]


def test_metadata_tables(spark, rows):
    sessions = frame(spark, [("s1", "u", {"a": "b"}), ("s2", None, {}), (None, "u", {})], "id string, user_id string, session_data map<string,string>")
    files = frame(spark, [("f1", "s1", "n", "csv", 5, "pending"), ("f2", "s9", None, "csv", 5, "odd")], "id string, session_id string, filename string, file_type string, size long, processing_status string")
    got = references.metadata_errors({"user_sessions": sessions, "file_metadata": files})
    assert rows(got, "table", "rule", "key", "rows") == sorted([
        ("user_sessions", "user_id_set", "s2", 1), ("user_sessions", "id_set", None, 1), ("file_metadata", "filename_set", "f2", 1),
        ("file_metadata", "status_known", "f2", 1), ("file_metadata", "session_id_exists", "s9", 1)], key=repr)
    empty = {"user_sessions": sessions.where("1 = 0"), "file_metadata": files.where("1 = 0")}
    assert references.metadata_errors(empty).count() == 0
    with pytest.raises(ValueError, match="other"):
        references.metadata_errors({"other": sessions})
    assert set(fixed.METADATA_REQUIRED) == set(fixed.METADATA_TABLES) == set(fixed.METADATA_REFERENCES) | {"user_sessions"}
