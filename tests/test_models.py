"""Structural models by specification, bootstrap of a path, invariance, Kendall's tau, against NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexforum.operators import ranking, structural

PARTIAL = structural.Model.of(structural.SPECS["parcial"])
NAMES = ["y2", "y3", "y4", "y5", "y6", "y10"]


def implied():
    """Covariances of the partial model at known values: loadings .8, 1.2, .7, paths -.5 and .3, covariance .2, variances 1, .8, .6, noise .3."""
    load = np.array([[1, 0, 0], [0.8, 0, 0], [1.2, 0, 0], [0, 1, 0], [0, 0.7, 0], [0, 0, 1.0]])
    psi = np.array([[1.0, 0.2, 0], [0.2, 0.8, 0], [0, 0, 0.6]])
    beta = np.zeros((3, 3))
    beta[2, :2] = -0.5, 0.3
    way = np.linalg.inv(np.eye(3) - beta)
    return load @ way @ psi @ way.T @ load.T + np.diag([0.3] * 5 + [0.0])


def test_specifications_are_read():
    two = structural.Model.of(structural.SPECS["dos_factores"])
    assert two.factors == {"xi1": ["y2", "y3", "y4"], "eta2": ["y10"]} and two.paths == [("eta2", "xi1")]
    # 10 moments; 2 loadings, a path, 2 variances of factors, 3 of noise: the only indicator of a factor has none of its own.
    assert len(two.free()) == 8 and ("y10", "~~", "y10") not in two.free()
    assert len(PARTIAL.free()) == 14 and PARTIAL.free().count(("xi2", "~~", "xi1")) + PARTIAL.free().count(("xi1", "~~", "xi2")) == 1
    whole = structural.Model.of(structural.SPECS["completo"])
    assert whole.indicators == ["y2", "y3", "y4", "y1", "y5", "y6", "y7", "y8", "y9", "y10", "y11"] and whole.paths == [("eta1", "xi1"), ("eta1", "xi2"), ("eta2", "eta1")]
    noisy = structural.Model.of("f =~ a + b + c  # one factor\n a ~~ b\n f ~ z")
    assert ("a", "~~", "b") in noisy.free() and noisy.factors["z"] == ["z"]
    for bad in ("f = a + b", "f =~ a + 2b", "f =~ a\nq ~~ a"):
        with pytest.raises(ValueError):
            structural.Model.of(bad)


def test_known_covariances_are_found():
    f = structural.fit(implied(), 5000, PARTIAL)
    found = {(a, op, b): est for a, op, b, est, _ in f.estimates}
    for key, true in {("xi1", "=~", "y3"): 0.8, ("xi1", "=~", "y4"): 1.2, ("xi2", "=~", "y6"): 0.7, ("eta2", "~", "xi1"): -0.5, ("eta2", "~", "xi2"): 0.3, ("xi2", "~~", "xi1"): 0.2, ("eta2", "~~", "eta2"): 0.6, ("y2", "~~", "y2"): 0.3}.items():
        assert found[key] == pytest.approx(true, abs=2e-3)
    assert f.df == 7 and f.chi2 < 1e-3 and f.p > 0.99 and f.path()[:2] == ("eta2", "xi1") and f.path()[4] < 0.01
    two = structural.fit(np.cov(np.random.default_rng(1).multivariate_normal(np.zeros(6), implied(), 4000).T)[np.ix_([0, 1, 2, 5], [0, 1, 2, 5])], 4000, structural.Model.of(structural.SPECS["dos_factores"]))
    assert two.df == 2 and two.chi2 < 12 and all(se > 0 for *_, se in two.estimates)


def test_chi2_tail():
    assert structural.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-9)
    assert structural.chi2_tail(18.307038053275146, 10) == pytest.approx(0.05, rel=1e-9)
    assert structural.chi2_tail(2.0, 2) == pytest.approx(math.exp(-1)) and structural.chi2_tail(0, 3) == 1 and structural.chi2_tail(500, 2) == pytest.approx(math.exp(-250))


def rows_of(spark, n, seed, group=None):
    x = np.random.default_rng(seed).multivariate_normal(np.zeros(6), implied(), n)
    named = ["y2_sa", "y3_civil", "y4_nv", "y5_corpus_type", "y6_period", "y10_rep"]
    return x, spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, " + ", ".join(f"{c} double" for c in named))


def test_feature_rows_are_fitted(spark):
    x, df = rows_of(spark, 1500, 2)
    own = structural.prepared(df.unionByName(df.limit(1).withColumn("y4_nv", F.lit(None).cast("double"))), PARTIAL)
    assert own.columns == NAMES and own.count() == 1500
    out = {(r.left, r.op, r.right): r for r in structural.fit_table(own, PARTIAL).collect()}
    key = out["key path", "~", "eta2 ~ xi1"]
    assert key.estimate == pytest.approx(-0.5, abs=4 * key.std_error) and key.passes and key.p < 0.01
    assert out["fit", "", "df"].estimate == 7 and out["fit", "", "n"].passes
    assert structural.prepared(df, structural.Model.of(structural.SPECS["completo"])).where("y7 is null").count() == 1500


def test_bootstrap_equals_numpy_with_the_same_weights(spark):
    x, df = rows_of(spark, 400, 5)
    own = structural.prepared(df, PARTIAL).columns
    named = df.withColumnsRenamed(structural.FEATURES)
    got = {r.draw: r for r in structural.replicate_moments(named.repartition(5), own, ["id"], 40, seed=9).collect()}
    keys = np.array([r.k for r in df.orderBy("id").select(F.xxhash64("id").alias("k")).collect()], np.int64).view(np.uint64)
    w = structural.poisson_weights(keys, 40, 9)
    assert w.mean() == pytest.approx(1, abs=0.02) and w.var() == pytest.approx(1, abs=0.05)
    for d in range(40):
        again = np.repeat(x, w[:, d].astype(int), 0)
        assert got[d].n == len(again) and np.allclose(got[d].c, np.cov(again.T)[np.triu_indices(6)])
    told = structural.path_replicates(named, PARTIAL, ["id"], draws=40, seed=9)
    estimates = {r.draw: r.estimate for r in told.collect()}
    for d in (0, 7, 39):
        plain = structural.fit(np.cov(np.repeat(x, w[:, d].astype(int), 0).T), 400, PARTIAL).path()[2]
        assert estimates[d] == pytest.approx(plain, abs=1e-3)
    out = structural.path_interval(told).first()
    values = np.array(list(estimates.values()))
    assert (out.valid, out.below) == (40, True) and (out.mean, out.low, out.high) == (pytest.approx(values.mean()), pytest.approx(np.percentile(values, 2.5)), pytest.approx(np.percentile(values, 97.5)))
    assert structural.path_replicates(named.limit(5), PARTIAL, ["id"], draws=4).count() == 0


def test_equal_and_unequal_loadings(spark):
    def group(g, second, seed):
        r = np.random.default_rng(seed)
        f = r.normal(size=1200)
        return [(g, *map(float, x)) for x in np.stack([f + r.normal(size=1200) * 0.5, second * f + r.normal(size=1200) * 0.5, 1.2 * f + r.normal(size=1200) * 0.5, 0.9 * f + r.normal(size=1200) * 0.5], 1)]

    model, ddl = structural.Model.of("f =~ a + b + c + d"), "g string, a double, b double, c double, d double"
    same = structural.invariance(spark.createDataFrame(group("p", 0.8, 1) + group("q", 0.8, 2), ddl), "g", model).first()
    other = structural.invariance(spark.createDataFrame(group("p", 0.8, 1) + group("q", 1.3, 2), ddl), "g", model).first()
    assert (same.df_free, same.df_equal, same.df) == (4, 7, 3) and same.equal and same.difference < 12
    assert not other.equal and other.difference > 50
    assert structural.invariance(spark.createDataFrame(group("p", 0.8, 1), ddl), "g", model).count() == 0


def tau_b(a, b):
    x, y = np.sign(a[:, None] - a), np.sign(b[:, None] - b)
    upper = np.triu_indices(len(a), 1)
    x, y = x[upper], y[upper]
    return (x * y).sum() / np.sqrt((x != 0).sum() * (y != 0).sum())


def test_kendall_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(ranking, "LEAST", 50)
    rng = np.random.default_rng(6)
    a = np.round(rng.normal(size=2500), 1)
    b = np.where(rng.random(2500) < 0.35, 7.0, np.round(a + rng.normal(size=2500), 1))  # a third are equal
    g = rng.integers(0, 2, 2500)
    df = spark.createDataFrame([(float(x), float(y), int(k)) for x, y, k in zip(a, b, g, strict=True)] + [(None, 1.0, 0)], "a double, b double, g int")
    whole = ranking.kendall(df, "a", "b").first()
    assert (whole.n, whole.tau) == (2500, pytest.approx(tau_b(a, b), abs=1e-12))
    for r in ranking.kendall(df, "a", "b", "g").collect():
        assert r.tau == pytest.approx(tau_b(a[g == r.g], b[g == r.g]), abs=1e-12)
    assert ranking.kendall(df.withColumn("b", F.lit(1.0)), "a", "b").first().tau is None
    assert ranking.inversions(a, np.ones(2500)) == (np.triu(a[:, None] > a[None], 1)).sum()


def test_rankings_under_other_weights(spark):
    rng = np.random.default_rng(8)
    x = rng.random((40, 3))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "sa double, nv double, rep double").repartition(3)
    weights = {"sa": 0.35, "nv": 0.35, "-rep": 0.30}
    got = {r.draw: r.tau for r in ranking.weight_sensitivity(df, weights, draws=60).collect()}
    y = np.concatenate((x[:, :2], 1 - x[:, 2:]), 1)
    for d, w in enumerate(ranking.drawn_weights(weights, 60, 42, 10.0)):
        assert got[d] == pytest.approx(tau_b(y @ np.array([0.35, 0.35, 0.30]), y @ w), abs=1e-9)
    out = ranking.sensitivity_summary(ranking.weight_sensitivity(df, weights, draws=60)).first()
    assert out["mean"] == pytest.approx(np.mean(list(got.values()))) and out.p5 == pytest.approx(np.percentile(list(got.values()), 5))
    # A closed case: two rows under weights (w, 1 - w) keep their order where w > 1/2.
    two = ranking.weight_sensitivity(spark.createDataFrame([(1.0, 0.0), (0.0, 1.0)], "a double, b double"), {"a": 0.7, "b": 0.3}, draws=200)
    want = np.sign(ranking.drawn_weights({"a": 0.7, "b": 0.3}, 200, 42, 10.0)[:, 0] - 0.5)
    assert [r.tau for r in two.orderBy("draw").collect()] == want.tolist()
    assert ranking.scaled(df, ["sa"]).agg(F.max("sa")).first()[0] == pytest.approx(1, abs=1e-8)
