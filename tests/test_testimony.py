"""Testimony, star schema, structural models, resampling against brute force and known answers."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexforum.functions import lexicons as L
from lexforum.operators import resampling, star, structural
from lexforum.operators import testimony as E


def test_layer_one_by_brute_force(spark):
    r = random.Random(2)
    terms = [*L.FIRST_PERSON, *L.IMPERSONAL, *L.HEDGES, *(t for ts in L.EMOTIONS.values() for t in ts), "palabra", "Texto"]
    rows = [(i, " ".join(r.choice(terms) for _ in range(r.randint(20, 60)))) for i in range(40)] + [(90, "corto"), (91, None)]
    out = {x.doc_id: x for x in E.layer_one(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert sorted(out) == [i for i, t in rows if t and len(t.strip()) >= 100]
    for i, text in rows:
        if i not in out:
            continue
        low, n, x = text.lower(), len(text.split()), out[i]
        p, s = (sum(low.count(t) for t in ts) / n for ts in (L.FIRST_PERSON, L.IMPERSONAL))
        assert (x.primera_persona_ratio, x.sa_ratio, x.accountability_score) == pytest.approx((round(p, 4), round(s, 4), round(p / (p + s + 0.001), 4)), abs=1.1e-4)
        counts = {k: low.count(k) for k in L.HEDGES if low.count(k)}
        assert x.hedging_count == sum(counts.values()) and x.hedging_weight == pytest.approx(sum(c * L.HEDGES[k] for k, c in counts.items()), abs=1e-4)
        assert x.marcadores == ", ".join([f"{k}({c})" for k, c in counts.items()][:10])
        for k, ts in L.EMOTIONS.items():
            assert x[k] == pytest.approx(sum(low.count(t) for t in ts) / n * 100, abs=1e-3)


def test_facial_scores(spark):
    at = lambda *x: spark.range(1).select(E.facial_score(*(F.lit(v).cast("double") for v in x))).first()[0]
    assert at(*[None] * 7) == 0.5 and at(0, 0, 0, 0, 0, 0, 0) == 0.0
    assert at(2, 2, 0, 0, 0, 0, 0) == pytest.approx(0.5) and at(4, 4, 4, 4, 0, 2, -0.5) == pytest.approx((2 - 0.3 + 0.2) / 3) and at(0, 0, 0, 0, 0, 2, 0) == 0.0


def test_hearings_by_brute_force(spark):
    r = random.Random(3)
    rows = [(h, r.choice("ab"), 10.0 * i, 10.0 * i + r.choice([2, 5, 9]), r.choice(["verdad y perdón", "nada de eso aquí"]), r.random(), r.random()) for h in "xy" for i in range(12)]
    out = {x.hearing: x for x in E.hearing_summary(spark.createDataFrame(rows, "hearing string, speaker string, start double, end double, text string, prosody double, facial double")).collect()}
    for h in "xy":
        talk = {s: sum(x[3] - x[2] for x in rows if x[0] == h and x[1] == s) for s in "ab"}
        main = max(talk, key=lambda s: (talk[s], s))
        icm = []
        for x in rows:
            if x[0] == h and x[1] == main and x[3] - x[2] >= 5:
                verbal = min(sum(x[4].count(t) for t in L.VERBAL) / len(x[4].split()) * 10, 1)
                own = [verbal, x[5], x[6]]
                icm.append((0.4 * own[0] + 0.35 * own[1] + 0.25 * own[2]) * (1 - min(2 * np.std(own), 1)))
        assert (out[h].speaker, out[h].n) == (main, len(icm)) and out[h].icm == pytest.approx(np.mean(icm), abs=1e-4) and len(out[h].best) == min(5, len(icm))


def test_file_rules(spark):
    df = spark.createDataFrame([("a/B_JEP/x.JSON",), ("aus_huila_v2_SPEAKER_01.csv",), ("x.tar.unknown",), ("consejo_de_estado/y.IPYNB",)], "p string")
    out = [tuple(r) for r in df.select(E.file_kind(F.col("p")), E.path_corpus(F.col("p")), E.hearing_of_file(F.col("p"))).collect()]
    # Letters, digits and _ are one word, so "a/B_JEP" has an edge before B.
    assert out == [("datos_json", "B-JEP", None), ("datos_tabular", "C-JEP-oral", "huila"), ("otro", None, None), ("notebook", "A-CE", None)]
    assert len(L.FILE_KINDS) == 53


def test_loader_orders_isolates_and_commits(spark, tmp_path):
    load = star.Loader()

    @load.module("blocks", after=("documents",))
    def _(t):
        return t["documents"].select(F.concat("document_id", F.lit("__1")).alias("block_id"), "document_id")

    @load.module("documents", after=("corpora",))
    def _(t):
        return t["corpora"].select(F.lit("d1").alias("document_id"), "corpus_id")

    @load.module("corpora")
    def _(t):
        return spark.createDataFrame([("A", "a", "written")], "corpus_id string, name string, kind string")

    @load.module("models")
    def _(t):
        raise OSError("no such file")

    @load.module("runs", after=("models",))
    def _(t):
        return t["models"].select(F.lit("r").alias("run_id"), "model_id")

    tables, errors = load.run(star.empty(spark))
    assert load.order() == ["corpora", "documents", "blocks", "models", "runs"] and load.order({"documents"}) == ["corpora", "documents"]
    assert set(errors) == {"models", "runs"} and "no such file" in errors["models"]
    assert tables["blocks"].first().block_id == "d1__1" and star.orphans(tables).agg(F.sum("orphans")).first()[0] == 0
    only, _ = load.run(star.empty(spark), {"documents"})
    assert only["blocks"].count() == 0 and only["documents"].count() == 1
    dry = {r.table: r.rows for r in star.commit(tables, str(tmp_path / "db"), dry_run=True).collect()}
    assert dry["blocks"] == 1 and not (tmp_path / "db").exists()
    assert {r.table: r.rows for r in star.commit(tables, str(tmp_path / "db")).collect()} == dry
    lost = dict(tables, blocks=tables["blocks"].withColumn("parent_id", F.lit("nobody")))
    assert {(r["table"], r["column"]): r.orphans for r in star.orphans(lost).collect()}[("blocks", "parent_id")] == 1
    loop = star.Loader()
    loop.module("a", after=("b",))(lambda t: t)
    loop.module("b", after=("a",))(lambda t: t)
    with pytest.raises(ValueError):
        loop.order()


def test_parents_are_made_once(spark):
    blocks = spark.createDataFrame([(1, "H", 1), (1, "H", 2), (2, "H", 1)], "doc int, section string, n int").withColumn("ext", star.external_id(F.concat(F.lit("D"), F.col("doc").cast("string")), F.col("section"), F.col("n")))
    out = star.with_parents(blocks, spark.createDataFrame([("D2__H__padre",)], "ext string"))
    assert sorted(r.ext for r in out.where("is_parent").collect()) == ["D1__H__padre"]
    assert {r.parent for r in out.where("not is_parent").collect()} == {"D1__H__padre", "D2__H__padre"}


def test_alpha_by_brute_force(spark):
    r = random.Random(5)
    rows = [(a, a if r.random() < 0.8 else 1 - a) for a in (r.randint(0, 1) for _ in range(200))]
    values = [v for pair in rows for v in pair]
    n = len(values)
    expected = sum(values.count(a) * values.count(b) for a in (0, 1) for b in (0, 1) if a != b) / (n * (n - 1))
    observed = sum(a != b for a, b in rows) / len(rows)
    got = star.krippendorff(spark.createDataFrame([*rows, (1, None)], "a int, b int"), "a", "b").first().alpha
    assert got == pytest.approx(1 - observed / expected)


def made(n, path=0.6, seed=1, second=0.8):
    r = np.random.default_rng(seed)
    f = r.normal(size=n)
    g = path * f + r.normal(size=n) * 0.8
    return np.stack([f + r.normal(size=n) * 0.5, second * f + r.normal(size=n) * 0.5, 1.2 * f + r.normal(size=n) * 0.5, g + r.normal(size=n) * 0.5, 0.7 * g + r.normal(size=n) * 0.5, 1.5 * g + r.normal(size=n) * 0.5], 1)


NAMES = ["x1", "x2", "x3", "y1", "y2", "y3"]


def test_structural_model_finds_known_values(spark):
    model = structural.Model({"f": NAMES[:3], "g": NAMES[3:]}, [("g", "f")])
    df = spark.createDataFrame([tuple(map(float, x)) for x in made(4000)], ", ".join(f"{c} double" for c in NAMES))
    out = {(r.left, r.op, r.right): r for r in structural.fit_table(df, model).collect()}
    for (key, true) in ((("f", "=~", "x2"), 0.8), (("f", "=~", "x3"), 1.2), (("g", "=~", "y2"), 0.7), (("g", "=~", "y3"), 1.5), (("g", "~", "f"), 0.6), (("f", "~~", "f"), 1.0), (("x1", "~~", "x1"), 0.25)):
        assert out[key].estimate == pytest.approx(true, abs=4 * out[key].std_error + 1e-3) and out[key].std_error < 0.1
    assert out[("g", "~", "f")].stars == "***" and out[("fit", "", "df")].estimate == 8
    f = structural.fit(np.cov(made(4000).T), 4000, model)
    assert structural.passes(f) == {"cfi": True, "rmsea": True, "srmr": True}
    # Indicators on the wrong factor fit badly.
    bad = structural.fit(np.cov(made(4000)[:, [0, 4, 2, 3, 1, 5]].T), 4000, structural.Model({"f": ["x1", "y2", "x3"], "g": ["y1", "x2", "y3"]}, []))
    assert bad.cfi < 0.9 and bad.chi2 > f.chi2
    assert structural.fit_table(df.limit(3), model).count() == 0


def test_likelihood_is_at_its_top():
    model = structural.Model({"f": ["x1", "x2", "x3"]}, [])
    sample = np.cov(made(500)[:, :3].T)
    f = structural.fit(sample, 500, model)
    # Three indicators of one factor fit any covariances exactly.
    assert f.df == 0 and f.chi2 == pytest.approx(0, abs=1e-4) and f.srmr < 1e-4
    load = {b: est for _, op, b, est, _ in f.estimates if op == "=~"}
    assert load["x2"] == pytest.approx(sample[1, 2] / sample[0, 2], rel=1e-3) and load["x3"] == pytest.approx(sample[1, 2] / sample[0, 1], rel=1e-3)


def test_groups_differ_where_they_do(spark):
    rows = [("a", *map(float, x[:3])) for x in made(2000)] + [("b", *map(float, x[:3])) for x in made(2000, seed=2, second=1.6)] + [("c", 1.0, 2.0, 3.0)]
    out = structural.multigroup(spark.createDataFrame(rows, "g string, x1 double, x2 double, x3 double"), "g", structural.Model({"f": ["x1", "x2", "x3"]}, [])).collect()
    assert {r.g for r in out} == {"a", "b"}
    assert {r.right: round(r.spread, 1) for r in out if r.op == "=~"}["x2"] == pytest.approx(0.8, abs=0.1)


def test_plane_by_brute_force(spark):
    v = np.random.default_rng(4).normal(size=(80, 5)) * [5, 3, 1, 1, 1]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(100, None), (101, [1.0])]
    out = {r.k: (r.x, r.y) for r in structural.main_plane(spark.createDataFrame(rows, "k int, v array<double>"), "k", "v").collect()}
    centred = v - v.mean(0)
    axes = np.linalg.svd(centred)[2][:2]
    axes = axes * np.sign(axes[np.arange(2), np.abs(axes).argmax(1)])[:, None]
    assert sorted(out) == list(range(80)) and np.allclose([out[i] for i in range(80)], centred @ axes.T)


def test_parametric_bootstrap_is_the_closed_form(spark):
    r = np.random.default_rng(7)
    rows = [(True, float(x)) for x in r.normal(5, 2, 400)] + [(False, float(x)) for x in r.normal(4, 1, 900)]
    out = resampling.parametric_gap(spark.createDataFrame(rows, "g boolean, v double"), F.col("g"), "v").first()
    a, b = (np.array([v for g, v in rows if g is k]) for k in (True, False))
    gap, se = a.mean() - b.mean(), np.sqrt(a.var(ddof=1) / len(a) + b.var(ddof=1) / len(b))
    assert out.middle == pytest.approx(gap, abs=0.01) and (out.low, out.high) == (pytest.approx(gap - 1.96 * se, abs=0.02), pytest.approx(gap + 1.96 * se, abs=0.02)) and out.apart
    assert resampling.parametric_gap(spark.createDataFrame([(True, 1.0)], "g boolean, v double"), F.col("g"), "v").count() == 0
