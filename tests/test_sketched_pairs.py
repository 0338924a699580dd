"""Sketches leave out only column pairs that cannot qualify."""

from itertools import combinations

import pytest

from tallyloom.operators import relate


@pytest.fixture(scope="module")
def wide(spark):
    """Two tables of 30,000 rows: keys, parts of keys, other ranges, texts, NULLs, a third of all rows in one value."""
    a = spark.range(30000).selectExpr(
        "id", "id % 3000 AS few", "id + 50000 AS far_id", "id * 7 % 30000 AS mixed_id", "cast(id AS string) AS text_id",
        "if(id % 3 = 0, -1, id) AS hot_id", "cast(id % 40 AS double) AS x_id", "cast(NULL AS bigint) AS none_id", "concat('k', id) AS name_key")
    b = spark.range(30000).selectExpr(
        "id + 29500 AS id", "id % 20 AS few", "id * 2 AS far_id", "id AS mixed_id", "id + 29999 AS text_id", "-1L AS hot_id",
        "id % 40 + 0.5D AS x_id", "if(id = 5, 5, NULL) AS none_id", "concat('k', id + 25000) AS name_key")
    return {"a": a, "b": b, "empty": a.limit(0)}


def every_pair(tables):
    return [(s, t, x, y) for s, t in combinations(tables, 2) for x in tables[s].columns for y in tables[t].columns]


def figures(frame):
    return {(r["source_table"], r["target_table"], r["source_column"], r["target_column"]): r for r in frame.collect()}


def test_any_common_value_and_shares(wide):
    pairs = every_pair(wide)
    measured = figures(relate.measure_candidates(wide, pairs))
    kept = set(relate.possible_candidates(wide, pairs))
    assert {p for p, r in measured.items() if r["common"]} <= kept and len(kept) < len(pairs) / 2
    tenth = set(relate.possible_candidates(wide, pairs, 0.1))
    qualified = {p for p, r in measured.items() if r["common"] and r["common"] >= 0.1 * min(r["source_values"], r["target_values"])}
    assert qualified <= tenth < kept
    assert ("a", "b", "id", "id") not in tenth  # 500 of 30,000 values, by a sample
    assert ("a", "b", "id", "far_id") in tenth and ("a", "b", "name_key", "name_key") in tenth
    assert ("a", "b", "id", "far_id") in kept and ("a", "b", "far_id", "few") not in kept and ("a", "b", "text_id", "text_id") not in kept


def test_relationships_are_those_of_all_pairs(wide, rows, monkeypatch):
    operators = [relate.detect_relationships, relate.key_relationships, relate.shared_column_relationships, relate.id_column_relationships]
    pruned = [rows(f(wide)) for f in operators]
    monkeypatch.setattr(relate, "possible_candidates", lambda tables, candidates, *_, **__: list(candidates))
    assert pruned == [rows(f(wide)) for f in operators] and all(pruned[:1] + pruned[2:])


def test_foreign_keys_within_counts_only_what_can_lie_inside(spark, rows, monkeypatch):
    df = spark.range(30000).selectExpr(
        "id", "id * 3 % 30000 AS parent", "id * 2 AS twice", "id % 7 AS seven", "cast(id % 7 AS string) AS text", "cast(NULL AS bigint) AS none",
        "if(id = 9, 30001, id) AS almost", "if(id < 400, NULL, id) AS holes")
    asked = []
    measure = relate.measure_candidates
    monkeypatch.setattr(relate, "measure_candidates", lambda tables, pairs: asked.extend(pairs) or measure(tables, pairs))
    got = {(k, f) for k, f, _ in rows(relate.foreign_keys_within(df))}
    keys = {"id": set(range(30000)), "twice": set(range(0, 60000, 2)), "almost": set(range(30000)) - {9} | {30001},
            "parent": set(range(0, 30000, 3))}
    others = keys | {"holes": set(range(400, 30000)), "seven": set(range(7)), "none": set()}
    assert got == {(k, f) for k in ("id", "twice", "almost") for f in others if f != k and others[f] <= keys[k]}
    assert ("t", "t", "id", "twice") not in asked and ("t", "t", "id", "almost") not in asked


def test_no_rows_and_no_pairs(wide, rows):
    empty = {"e": wide["empty"], "f": wide["empty"].select("id", "few")}
    assert relate.possible_candidates(empty, every_pair(empty)) == []
    assert rows(relate.detect_relationships(empty)) == [] and rows(relate.foreign_keys_within(empty["e"])) == []
    assert relate.possible_candidates(wide, []) == []
