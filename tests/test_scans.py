"""How often the statistics read their table."""

import pytest

from tallyloom.operators import profile, quality


@pytest.fixture
def counted(spark):
    """A table that counts how many of its rows are read."""
    scans = spark.sparkContext.accumulator(0)
    df = spark.range(3000).selectExpr("id", "id % 7 AS k", "cast(id % 50 AS double) / 4 AS x", "concat('t', id % 5) AS t", "concat('u', id) AS u").repartition(4)

    def run(batches):
        for b in batches:
            scans.add(len(b))
            yield b

    return df.mapInPandas(run, df.schema), scans


@pytest.mark.parametrize(("operator", "most"), [
    (profile.column_statistics, 3), (profile.table_profile, 3), (quality.quality_scorecard, 3), (profile.profile_numeric, 3), (profile.describe, 2)])
def test_scans(counted, operator, most):
    df, scans = counted
    assert operator(df).collect()
    assert scans.value <= most * 3000


def test_no_text_and_no_numbers(spark):
    df = spark.range(500).selectExpr("id % 5 AS n")
    assert profile.column_statistics(df).first()["median"] == 2.0 and profile.table_profile(df).count() == 2
    words = df.selectExpr("cast(n AS string) AS w")
    got = profile.column_statistics(words).first()
    assert (got["unique_count"], got["median"], got["appears_categorical"], got["top_categories"]) == (5, None, True, "|".join(f"{i}=0.2000" for i in range(5)))
    assert profile.column_statistics(words, approx_distinct=True).first() == got
    assert quality.quality_scorecard(words).count() >= 5 and quality.quality_scorecard(df, approx_distinct=True).count() >= 5
