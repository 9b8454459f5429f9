import random

import pytest
from pyspark.sql import functions as F

from qualitylens.operators import selection
from qualitylens.operators.selection import order_statistics, quantiles, quantiles_by


def test_ranks_and_quantiles(spark, monkeypatch):
    monkeypatch.setattr(selection, "FEW", 8)
    monkeypatch.setattr(selection, "BINS", 16)
    r = random.Random(4)
    values = [r.choice([r.gauss(0, 1), 5.0, -1e300, 1e300, 1e-9 * r.random(), 0.0]) for _ in range(3000)]
    df = spark.createDataFrame([(x, "a") for x in values] + [(None, "a"), (float("nan"), "a")], "x double, v string")
    want = sorted(values)
    ranks = [0, 1, 17, 1500, 2998, 2999, 2700]
    assert order_statistics(df, "x", ranks) == [want[k] for k in ranks]
    got = quantiles(df, "x", [0.0, 0.25, 0.9, 1.0])
    exact = df.where("x is not null and not isnan(x)").agg(*[F.percentile("x", q) for q in (0.0, 0.25, 0.9, 1.0)]).first()
    assert all(a == pytest.approx(b) for a, b in zip(got, exact, strict=True))


def test_ties_and_none(spark):
    df = spark.range(20_000).select(F.lit(7.0).alias("x"))
    assert order_statistics(df, "x", [0, 19_999]) == [7.0, 7.0]
    assert quantiles(df.where("false"), "x", [0.5]) == [None]
    with pytest.raises(ValueError):
        order_statistics(df, "x", [20_000])


def test_by_key_with_a_hot_one(spark, monkeypatch):
    monkeypatch.setattr(selection, "FEW", 8)
    monkeypatch.setattr(selection, "BINS", 16)
    r = random.Random(7)
    rows = [(r.choice([1, 1, 1, None, 2, 3]), r.choice([r.gauss(0, 1), 2.0, 2.0, 1e6])) for _ in range(2000)] + [(9, 4.0), (8, None), (1, float("nan"))]
    df = spark.createDataFrame(rows, "v int, k double")
    got = {x.v: x.q for x in quantiles_by(df, "v", "k", [0.5, 0.9, 0.0]).collect()}
    want = df.where("not isnan(k)").groupBy("v").agg(*[F.percentile("k", q) for q in (0.5, 0.9, 0.0)]).collect()
    assert {x.v for x in want if x.v != 8} == set(got)
    assert all(got[x.v] == pytest.approx(list(x)[1:]) for x in want if x.v != 8)
    assert quantiles_by(df.where("false"), "v", "k", [0.5]).count() == 0
