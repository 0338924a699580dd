import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tallyloom.operators.quantiles import exact_quantiles

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.9, 1.0]


def check(spark, values, **options):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double").repartition(3)
    got = exact_quantiles(df, ["x"], PROBS, **options)["x"]
    kept = [v for v in values if v is not None and not np.isnan(v)]
    expected = [float(np.quantile(kept, p)) for p in PROBS] if kept else [None] * len(PROBS)
    assert got == pytest.approx(expected) if kept else got == expected


def test_spread_values(spark):
    check(spark, np.random.default_rng(1).normal(size=5000).tolist(), accuracy=100)


def test_one_value_holds_a_third(spark):
    rng = np.random.default_rng(2)
    values = [7.0] * 2000 + rng.uniform(0, 20, 4000).tolist()
    check(spark, values, accuracy=50)


def test_hot_values_at_the_ends(spark):
    check(spark, [0.0] * 3000 + [1.0] * 10 + [2.0] * 3000, accuracy=8)


def test_nulls_and_nan(spark):
    check(spark, [None, float("nan"), 1.0, 2.0, None, 10.0])


def test_empty_and_single(spark):
    check(spark, [None, None])
    check(spark, [3.5])


def test_sketches_of_any_size_agree(spark):
    df = spark.range(1000).selectExpr("cast(id as int) x", "id * 0.5 y", "case when id < 0 then 1.0D end z")
    small = exact_quantiles(df, ["x", "y", "z"], PROBS)
    large = exact_quantiles(df, ["x", "y", "z"], PROBS, accuracy=8)
    assert small["z"] == large["z"] == [None] * len(PROBS)
    for c in ("x", "y"):
        assert large[c] == pytest.approx(small[c])


def test_many_columns_take_several_passes(spark, monkeypatch):
    from tallyloom.operators import quantiles

    monkeypatch.setattr(quantiles, "COLUMNS_PER_PASS", 2)
    df = spark.range(101).selectExpr(*[f"id * {i} as c{i}" for i in range(1, 6)])
    assert exact_quantiles(df, df.columns, [0.5]) == {f"c{i}": [50.0 * i] for i in range(1, 6)}


def test_many_rows(spark):
    df = spark.range(300_000).selectExpr("cast(id * 7919 % 300000 as double) x", "id % 3 y", "pow(id, 3) z")
    got = exact_quantiles(df, ["x", "y", "z"], [0.1, 0.5, 0.999])
    assert got["x"] == pytest.approx([29999.9, 149999.5, 299699.001]) and got["y"] == [0.0, 1.0, 2.0]
    assert got["z"] == pytest.approx(np.quantile(np.arange(300_000.0) ** 3, [0.1, 0.5, 0.999]).tolist())


def test_a_sketch_that_is_off(spark, monkeypatch):
    """A bracket without the rank costs a scan more, not the answer."""
    from tallyloom.operators import quantiles

    monkeypatch.setattr(quantiles, "_error", lambda accuracy: 1e-9)
    check(spark, np.random.default_rng(3).normal(size=4000).tolist(), accuracy=8)


def test_two_scans(spark, tmp_path):
    spark.range(20_000).selectExpr("id * 1.5D x", "id % 17 y").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    scans = spark.sparkContext.accumulator(0)
    counted = df.mapInPandas(lambda batches: (scans.add(len(b)) or b for b in batches), df.schema)
    assert exact_quantiles(counted, ["x", "y"], [0.25, 0.5]) == {"x": [7499.625, 14999.25], "y": [4.0, 8.0]}
    assert scans.value == 40_000

@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5), st.floats(-1e6, 1e6)), min_size=1, max_size=60))
def test_any_values(spark, values):
    check(spark, values, accuracy=8)
