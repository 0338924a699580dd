"""Correlations by blocks against the aggregate of one pair each."""

import pytest

from tallyloom.operators import gram, profile
from tallyloom.session import compiled_methods


@pytest.fixture(scope="module")
def wide(spark):
    """12 columns far from 0, with NULLs, constants, values that are not finite, a single known value, and a name with a dot."""
    return spark.range(2000).selectExpr(
        "cast(id AS double) + 1e9 AS far", "id % 17 AS a", "if(id % 3 = 0, NULL, id % 23) AS b", "if(id % 3 = 0, id % 19, NULL) AS apart",
        "7 AS constant", "0.1D AS tenth", "if(id = 5, double('NaN'), id) AS nan", "if(id = 6, double('Infinity'), id) AS inf",
        "if(id = 7, 1, NULL) AS single", "cast(NULL AS int) AS none", "-2 * id AS `down.by`", "cast(id * 0.3 AS decimal(12,2)) AS dec",
        "if(id < 900, 1e6, id) AS half").repartition(5)


def by_pair(df):
    return {(r["column_a"], r["column_b"]): r["correlation"] for r in df.collect()}


@pytest.mark.parametrize("block", [1000, 4])
def test_blocks_agree_with_single_pairs(wide, monkeypatch, block):
    expected = by_pair(profile.correlation_matrix(wide))
    monkeypatch.setattr(profile, "WIDE_LIMIT", 10)
    monkeypatch.setattr(gram, "BLOCK", block)
    got = by_pair(profile.correlation_matrix(wide))
    assert got.keys() == expected.keys() and len(got) == 78
    for pair, r in expected.items():
        assert (got[pair] is None) == (r is None) and (r is None or abs(got[pair] - r) <= 2e-6), pair
    assert got["far", "down.by"] == -1.0 and got["b", "apart"] is None and got["far", "tenth"] is None


def test_no_rows(wide):
    assert set(by_pair(gram.correlations(wide.limit(0), wide.columns).withColumnRenamed("r", "correlation")).values()) == {None}


def test_two_scans_at_any_width(spark):
    scans = spark.sparkContext.accumulator(0)
    df = spark.range(600).selectExpr(*[f"id % {i + 2} AS c{i}" for i in range(120)]).repartition(3)

    def run(batches):
        for b in batches:
            scans.add(len(b))
            yield b

    got = by_pair(profile.correlation_matrix(df.mapInPandas(run, df.schema)))
    assert len(got) == 120 * 119 // 2 and scans.value == 2 * 600


def test_wide_expressions_run_as_compiled_methods(spark, monkeypatch):
    """The expressions of 40 columns make one method of over 8,000 bytes, which the JVM interprets, unless a limit splits it."""
    limit, seen = "spark.sql.codegen.hugeMethodLimit", []
    df = spark.range(2000).selectExpr(*[
        f"CASE WHEN id % 7 <> {i % 7} THEN (id * {2 * i + 1} + id % 91 * {i % 5} + id % 13) % {11 + i} END AS x{i}" for i in range(40)])
    expected = by_pair(profile.correlation_matrix(df, columns=df.columns[:12]))

    def spied(name):
        plain = getattr(type(df), name)

        def action(self, *args, **kwargs):
            seen.append((name, int(spark.conf.get(limit))))
            return plain(self, *args, **kwargs)
        monkeypatch.setattr(type(df), name, action)

    spied("collect")
    spied("checkpoint")
    before = spark.conf.get(limit)
    wide = profile.correlation_matrix(df)
    assert seen == [("collect", 8000), ("checkpoint", 8000)] and spark.conf.get(limit) == before
    got = by_pair(wide)
    assert len(got) == 780 and all(abs(got[pair] - r) <= 2e-6 for pair, r in expected.items())


def test_method_limit_is_put_back(spark):
    limit = "spark.sql.codegen.hugeMethodLimit"
    for own, inside in (("4000", "4000"), ("20000", "8000")):
        spark.conf.set(limit, own)
        try:
            with pytest.raises(ValueError), compiled_methods(spark):
                assert spark.conf.get(limit) == inside
                raise ValueError
            assert spark.conf.get(limit) == own
        finally:
            spark.conf.unset(limit)
