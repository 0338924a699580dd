"""Every registered query against its SQL on the smallest driver tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract

FOLDER = Path("/root/testdata/sf0.001")
QUERIES, SQL = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def normal(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return float(value)
    return value if value is None or isinstance(value, bool) else str(value)


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def test_every_query_has_sql():
    """But for those of the training-data operators that SQL cannot express."""
    assert set(SQL) <= set(QUERIES)
    assert all(name == "pipeline" or name.startswith("op") for name in set(QUERIES) - set(SQL))


def test_entry(spark):
    assert contract.entry(spark).count() == 1


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, db, name):
    df = QUERIES[name](spark, str(FOLDER))
    cursor = db.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert sorted_rows(df.columns, df.collect()) == sorted_rows(columns, cursor.fetchall())
