import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidemark.operators import hot_keys
from tidemark.operators.hot_keys import heavy_keys, key_totals


@pytest.mark.parametrize("splits", [None, 5000])
@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_equals_group_by(spark, kind, splits):
    rng = random.Random(3)
    keys = [None if (x := rng.random()) < 0.1 else 7 if x < 0.45 else rng.randrange(300) for _ in range(3000)]
    data = [(None if k is None else k if kind == "bigint" else str(k), rng.choice([None, rng.randrange(-(1 << 40), 1 << 40)]), 1, 2) for k in keys]
    df = spark.createDataFrame(data, f"k {kind}, x bigint, n int, block int").repartition(40)
    got = key_totals(df, F.col("k"), {"total": F.col("x")}, splits)
    want = df.groupBy("k").agg(F.count(F.lit(1)), F.coalesce(F.sum("x"), F.lit(0)))
    assert rows(got) == rows(want)


def test_heavy(spark):
    keys = [1] * 40 + [2] * 2 + [3] * 1 + [None] * 50 + list(range(10, 17))
    df = spark.createDataFrame([(k,) for k in keys], "k bigint")
    got = heavy_keys(key_totals(df, F.col("k")), df)
    assert {r["key"] for r in got.collect()} == {k for k, n in Counter(keys).items() if k is not None and n * 100 >= 2 * len(keys)} == {1, 2}


def test_empty(spark):
    df = spark.createDataFrame([], "k bigint, x int")
    totals = key_totals(df, F.col("k"), {"x": F.col("x")})
    assert rows(totals) == [] and rows(heavy_keys(totals, df)) == []


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_split_of_more_rows_than_are_encoded_at_once(spark, kind):
    """Sums of the rows before are added to those of new rows, whose columns are declared not NULL."""
    df = spark.range(0, hot_keys.ROWS + 50_000, 1, 1).select(F.when(F.col("id") % 5 > 0, F.col("id") % 700).cast(kind).alias("k"), "id")
    got = key_totals(df, F.col("k"), {"total": F.col("id")})
    assert rows(got) == rows(df.groupBy("k").agg(F.count(F.lit(1)), F.sum("id")))
    assert key_totals(df, F.col("id")).where("n = 1").agg(F.count_distinct("key")).first()[0] == hot_keys.ROWS + 50_000


def test_split_that_sends_its_sums_on_several_times(spark, monkeypatch):
    monkeypatch.setattr(hot_keys, "ROWS", 1000)
    monkeypatch.setattr(hot_keys, "MOST_ENTRIES", 15_000)
    df = spark.range(0, 100_000, 1, 2).select((F.col("id") * 7919 % 30_011).alias("k"), "id")
    for splits in (None, 40):
        got = key_totals(df, F.col("k"), {"total": F.col("id")}, splits)
        assert rows(got) == rows(df.groupBy("k").agg(F.count(F.lit(1)), F.sum("id")))
