"""Temporal control of gaps, redundant indicators, explainability."""

import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexforum.functions import stats
from lexforum.operators import controls, indices


def test_gaps_of_time_and_of_kind(spark):
    r = random.Random(11)
    rows = []
    for i in range(400):
        a, year = i % 2 == 0, r.choice([2001, 2005, 2019, 2021, None])
        old = a and (year is None or year < 2018)
        rows.append((a, year, r.gauss(1.0 if old else 0.0, 0.5), r.gauss(0.8 if a else 0.0, 0.5), r.choice([1.0, 2.0, float("nan"), None])))
    rows += [(None, 2020, 9.0, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "a boolean, year int, old double, kind double, none double")
    got = {x.code: x for x in controls.temporal_control(df, F.col("a"), F.col("year"), 2018, 2023, ["old", "kind", "none"]).collect()}
    assert {c: x.gap for c, x in got.items()} == {"old": "temporal", "kind": "structural", "none": "none"} and got["kind"].stars == "***"
    t = pd.DataFrame(rows[:-1], columns=["a", "year", "old", "kind", "none"])
    for c, x in got.items():
        own = t.dropna(subset=[c])
        parts = own[own.a], own[own.a & own.year.between(2018, 2023)], own[~own.a]
        assert (x.n_a, x.n_a_recent, x.n_b) == tuple(map(len, parts)) and (x.mean_a, x.mean_a_recent, x.mean_b) == pytest.approx(tuple(p[c].mean() for p in parts))
        for u, own_a in ((x.u, parts[0]), (x.u_recent, parts[1])):
            assert u == sum((p > q) + 0.5 * (p == q) for p in own_a[c] for q in parts[2][c])
        alone = stats.mann_whitney(df.where("a is not null and not isnan(%s) and (not a or year between 2018 and 2023)" % c), F.col("a"), c, []).first()
        assert x.p_recent == pytest.approx(alone.p)
    few = controls.temporal_control(df.limit(6), F.col("a"), F.col("year"), 2018, 2023, ["old"]).first()
    assert few.p is None and few.gap is None
    assert controls.temporal_control(df.limit(0), F.col("a"), F.col("year"), 2018, 2023, ["old"]).count() == 0


def test_redundant_pairs(spark):
    r = random.Random(2)
    rows = []
    for _ in range(300):
        x = r.choice([None, *range(30)])
        rows.append((x, None if x is None else x * x + r.choice([0, 1]), r.random() if r.random() < 0.9 else float("nan"), 1.0))
    df = spark.createDataFrame([(None if a is None else float(a), None if b is None else float(b), c, d) for a, b, c, d in rows], "x double, y double, z double, same double")
    got = {(p.a, p.b): p for p in controls.correlated_pairs(df, ["x", "y", "z", "same"]).collect()}
    want = pd.DataFrame(rows, columns=["x", "y", "z", "same"]).astype(float)
    for a, b in itertools.combinations(want.columns, 2):
        both = want[[a, b]].dropna()
        assert got[a, b].n == len(both)
        if "same" in (a, b):
            assert got[a, b].rho is None and not got[a, b].redundant
        else:
            ranks = both.rank()
            assert got[a, b].rho == pytest.approx(ranks[a].corr(ranks[b])) and got[a, b].redundant == ((a, b) == ("x", "y"))
    report = {x.test: x for x in controls.explainability(df, ["x", "y", "z"], {"dis": indices.DIS, "iei": indices.IEI}, {"code": True, "seeds": True, "data": False}).collect()}
    assert (report["correlations"].score, report["weights"].score, report["checklist"].score) == (0.5, 0.85, 0.667)
    assert report["correlations"].detail == f"x y {got['x', 'y'].rho:.3f}" and report["checklist"].detail == "data" and not report["checklist"].passed
    assert {x.test: x.score for x in controls.explainability(df, ["x", "z"], {"dis": {"a": 0.5}}, {"code": True}).collect()} == {"correlations": 0.8, "weights": 0.4, "checklist": 1.0}
