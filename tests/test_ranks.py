"""Ranks, quantiles, rank tests over many distinct values, against NumPy."""

import numpy as np
import pandas as pd
import pytest

from lexforum.functions import stats


@pytest.fixture
def parts(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)


def ranks(x):
    _, at, n = np.unique(x, return_inverse=True, return_counts=True)
    upto = np.cumsum(n)
    return (upto - (n - 1) / 2)[at]


@pytest.mark.parametrize("parts", [16, 200], indirect=True)
def test_mann_whitney_over_many_distinct_values(spark, parts):
    n = 600_000 if parts == 16 else 100_000
    df = spark.range(n).selectExpr("id % 3 = 0 as g", "pmod(xxhash64(id), 1000000007) / 7.0 as v", "'x' as k").repartition(7)
    got = stats.mann_whitney(df, df.g, "v", ["k"]).first()
    told = df.toPandas()
    r = ranks(told.v.to_numpy())
    n1 = int(told.g.sum())
    assert got.u == pytest.approx(r[told.g].sum() - n1 * (n1 + 1) / 2, rel=1e-12) and got.n1 == n1


def test_spearman_and_ranks_with_ties_and_groups(spark):
    rng = np.random.default_rng(2)
    rows = pd.DataFrame({"g": rng.integers(0, 3, 30_000), "x": np.round(rng.normal(size=30_000), 2)})
    rows["y"] = np.where(rng.random(30_000) < 0.3, 1.5, rows.x + np.round(rng.normal(size=30_000), 1))
    got = {r.g: r for r in stats.spearman(spark.createDataFrame(rows), "x", "y", "g").collect()}
    for g, own in rows.groupby("g"):
        assert got[g].n == len(own) and got[g].rho == pytest.approx(np.corrcoef(ranks(own.x), ranks(own.y))[0, 1], abs=1e-12)
    out = stats.average_ranks(spark.createDataFrame(rows), "x").toPandas()
    assert np.allclose(np.sort(out["rank"]), np.sort(ranks(rows.x))) and set(out.columns) == {"g", "x", "y", "rank", "ties"}


def test_quantiles_by_selection(spark):
    df = spark.range(1_000_000).selectExpr("id % 2 as g", "double(pmod(xxhash64(id), 1000000007)) / 13 as v")
    told = df.toPandas()
    shares = (0.0, 0.05, 0.25, 0.5, 0.95, 1.0)
    whole = stats.quantiles(df, "v", shares).first()
    assert whole.n == 1_000_000 and np.allclose(whole.q, np.quantile(told.v, shares), rtol=1e-12)
    for r in stats.quantiles(df, "v", shares, "g").collect():
        assert np.allclose(r.q, np.quantile(told.v[told.g == r.g], shares), rtol=1e-12)
    few = spark.createDataFrame([(None, 1.0), (None, 4.0), ("a", None), ("b", 2.0), ("b", 2.0), ("b", 2.0)], "g string, v double")
    assert {r.g: (r.n, r.q) for r in stats.quantiles(few, "v", [0.5, 0.75], "g").collect()} == {None: (2, [2.5, 3.25]), "b": (3, [2.0, 2.0])}
    assert stats.quantiles(few.where("g = 'a'"), "v", [0.5]).collect() == []
