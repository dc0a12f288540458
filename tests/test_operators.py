"""Operators on small made cases: expected values worked out by hand."""

import os

import pytest
from pyspark.sql import functions as F

from lexforum.functions import stats, text as T
from lexforum.operators import indices, ingest, records, relational as R, spans
from lexforum.sources import readers, sinks
from lexforum.streaming import jobs


def one(spark, column, **values):
    names = list(values)
    kind = ", ".join(f"{n} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'int'}" for n, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], kind).select(column.alias("out")).first().out


def test_clean_report(spark):
    row = ingest.clean(spark.createDataFrame([("a  b​“c”…\r\n\r\n\r\n\r\nd \x00",), (None,)], "text string")).collect()
    assert row[0].clean_text == 'a b "c"...\n\nd'
    assert row[0].cleaning_report.encoding_fixes == 2
    assert row[1].clean_text is None


@pytest.mark.parametrize(
    ("text", "iso"),
    [("quince (15) de marzo de dos mil ocho (2008)", "2008-03-15"), ("a 15 de marzo de 2008", "2008-03-15"), ("(3) de Enero de mil novecientos noventa y nueve (1999)", "1999-01-03"), ("20/07/2007", "2007-07-20"), ("30/02/2010", None), ("x 2021-01-15", "2021-01-15"), ("1 de mayo de 1980", None), ("nada", None)],
)
def test_issue_date(spark, text, iso):
    assert one(spark, records.issue_date(F.col("t"))[0], t=text) == iso


def test_span_positions_and_greedy(spark):
    found = one(spark, spans.positions(F.col("t"), "ab+"), t="xabb ab")
    assert [(s.start, s.end) for s in found] == [(1, 4), (5, 7)]
    df = spans.find(spark.createDataFrame([("el hecho fue reconocido",)], "text string"), [spans.Rule("a", "hecho fue", 1.0), spans.Rule("b", "fue", 0.9), spans.Rule("c", "reconocido", 0.5)])
    kept = df.select(spans.greedy(F.col("spans")).alias("s")).first().s
    assert [s.mechanism for s in kept] == ["a", "c"]


def test_context_lowers_weight_and_short_text_scores_nothing(spark):
    df = spark.createDataFrame([(1, "Dicen que presuntamente es un bandido. El bandido huyo del lugar."), (2, "bandido"), (3, None)], "id int, text string")
    found = spans.find(df, [spans.Rule("nv", "bandido", 1.0)])
    out = {r.id: r for r in spans.score(spans.in_context(found, "presuntamente", 20), 0.0, 0.6).collect()}
    assert out[1].raw == pytest.approx((0.25 + 1.0) / 2)
    assert out[2].score == 0.0 and out[2].has_warning and out[3].score == 0.0


def test_merge_short_and_pack_words(spark):
    long, short = " ".join(["w"] * 25), "a b"
    df = spark.createDataFrame([([("x", short), ("a", long), ("b", short), ("c", long), ("d", short)],)], "s array<struct<label:string,body:string>>")
    out = df.select(ingest.merge_short(F.col("s")).alias("s")).first().s
    assert [x.label for x in out] == ["a", "c", "d"]
    assert out[0].body.endswith("a b")
    blocks = one(spark, ingest.pack_words(F.col("t"), 50, 3), t=" ".join(["palabra"] * 10))
    assert [len(b.split()) for b in blocks] == [7]


def test_positions_kept_apart(spark):
    df = spark.createDataFrame([([0, 100, 250, 260, 500],)], "p array<int>")
    assert df.select(R.keep_apart(F.col("p"), 200).alias("k")).first().k == [0, 250, 500]
    assert df.select(R.replace_near(F.col("p"), 120).alias("k")).first().k == [100, 260, 500]


def test_mann_whitney_tail(spark):
    rows = [("a", float(i)) for i in range(20)] + [("b", float(i + 10)) for i in range(20)]
    out = stats.mann_whitney(spark.createDataFrame(rows, "g string, v double").withColumn("k", F.lit(1)), F.col("g") == "a", "v", ["k"]).first()
    assert out.u == 50.0 and out.p == pytest.approx(5.0e-05, rel=0.2)
    assert one(spark, stats.normal_tail(F.col("z")), z=1.959964) == pytest.approx(0.025, abs=1e-6)


def test_golden_composite_shape(spark):
    rows = [("a", 1.0, 0.2, 0.1, 0.3, 0.2), ("b", 0.5, 0.4, 0.3, 0.1, 0.6), ("c", 0.0, 0.3, 0.2, 0.2, 0.4)]
    out = {r.k: r for r in indices.composite(spark.createDataFrame(rows, "k string, sa double, nv double, rep double, y8 double, y9 double"), "k").collect()}
    assert out["a"].dis == pytest.approx(0.35 + 0.30, abs=1e-6)
    assert out["b"].iei == pytest.approx(0.20 + 0.25, abs=1e-6)


def test_prefix_join_counts(spark):
    full = spark.createDataFrame([("abcdefghijklmnop-1",), ("abcdefghijklmnop-2",), ("zzzzzzzzzzzzzzzz-9",)], "name string")
    short = spark.createDataFrame([("abcdefghijklmnop...",), ("zzzzzzzzzzzzzzzz",), ("abc",), (None,)], "p string")
    out = {r.p: (r.match_count, r.matched) for r in R.prefix_join(short, full, "p", "name").collect()}
    assert out == {"abcdefghijklmnop...": (2, None), "zzzzzzzzzzzzzzzz": (1, "zzzzzzzzzzzzzzzz-9"), "abc": (0, None), None: (0, None)}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a_HECHOS_1_003.txt").write_bytes("﻿niño".encode())
    (tmp_path / "in" / "b_DECISION_010.txt").write_bytes("niño".encode("latin-1"))
    texts = {os.path.basename(r.path): r.text for r in readers.text_files(spark, str(tmp_path / "in")).collect()}
    assert set(texts.values()) == {"niño"}
    named = {r.doc: (r.section, r.ordinal) for r in readers.named_blocks(spark, str(tmp_path / "in")).collect()}
    assert named == {"a": ("HECHOS_1", 3), "b": ("DECISION", 10)}
    assert readers.inventory(spark, str(tmp_path / "in"), 1000).where("sha256 is not null").count() == 2
    (tmp_path / "d.json").write_text('{"text": "abcdef", "label": [{"start": 1, "end": 3, "labels": ["SA", "NV"]}]}')
    assert [(r.start, r.end, r.label) for r in readers.annotations(spark, str(tmp_path / "d.json")).collect()] == [(1, 3, "SA"), (1, 3, "NV")]
    (tmp_path / "c.csv").write_text('﻿id,note\n1,"two\nlines"\n')
    assert readers.csv(spark, str(tmp_path / "c.csv")).collect()[0].note == "two\nlines"
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id int, v string")
    sinks.append_new(df, str(tmp_path / "t"), ["id"])
    sinks.append_new(spark.createDataFrame([(2, "z"), (3, "y")], "id int, v string"), str(tmp_path / "t"), ["id"])
    assert {r.id: r.v for r in spark.read.parquet(str(tmp_path / "t")).collect()}[2] == "c"
    report, code = sinks.markdown(spark.createDataFrame([("x", "OK", 0), ("y", "ERROR", 3)], "check string, severity string, n long"), "Audit")
    assert code == 2 and "| y | ERROR | 3 |" in report


def test_streaming_windows(spark, tmp_path):
    events = spark.createDataFrame([(i, f"2024-01-01 00:{i:02d}:00", i % 3, "click", float(i)) for i in range(40)], "event_id int, ts string, user_id int, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    stream = jobs.stream(spark, str(tmp_path), "events")
    q = jobs.once(jobs.windows(stream, late="1 minute"), str(tmp_path / "out"), str(tmp_path / "check"))
    assert q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(out) >= 7 and all(r.n == 5 for r in out)


def test_text_measures(spark):
    assert one(spark, T.occurrences(F.col("t"), "aa"), t="aaaa") == 2
    assert one(spark, T.visible_text(F.col("t")), t="<p>a &amp; b</p><script>x</script>\n<p>c</p>") == "a & b\nc"
    assert one(spark, T.nfc(F.col("t")), t="é") == "é"


def test_least_squares_and_resampling(spark):
    import numpy as np

    from lexforum.operators import regression, resampling

    r = np.random.default_rng(1)
    x = r.normal(size=(400, 2))
    y = 1.5 + 2.0 * x[:, 0] - 0.5 * x[:, 1] + r.normal(scale=0.1, size=400)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    out = {q.term: q for q in regression.least_squares(df, "y", ["a", "b"]).collect()}
    want = np.linalg.lstsq(np.column_stack((np.ones(400), x)), y, rcond=None)[0]
    assert [out[t].estimate for t in ("(intercept)", "a", "b")] == pytest.approx(want.tolist(), rel=1e-6)
    assert out["a"].stars == "***" and regression.least_squares(df.limit(2), "y", ["a", "b"]).count() == 0
    groups = spark.createDataFrame([(i, "a" if i % 2 else "b", float(i % 7) + (i % 2)) for i in range(700)], "i int, g string, v double")
    ci = resampling.bootstrap_gap(groups, "g", "v", "a", "b", 300).first()
    assert ci.low < 1.0 < ci.high and ci.high - ci.low < 1.2


def made_documents(spark, tmp_path, *texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_all_tokens_are_labelled(spark, tmp_path):
    from lexforum.plans import registry

    texts = [" ".join("x" * (i % 3) for i in range(3000)), "ñandú " * 50, "", "one"]
    got = sorted(tuple(r) for r in registry.QUERIES["t36_token_labels"](spark, made_documents(spark, tmp_path, *texts)).select("doc_id", "token_index", "label").collect())
    want = []
    for d, text in enumerate(texts):
        at = 0
        for i, w in enumerate(text.split(" ")):
            want.append((d, i, "NV" if 40 <= at < 90 else "SA" if 10 <= at < 60 else "O"))
            at += len(w) + 1
    assert got == sorted(want) and len(got) == 3000 + 51 + 2
    df = spark.createDataFrame([(" ".join(["ab"] * 500),)], "text string").withColumn("doc_id", F.lit(1))
    assert spans.token_labels(df, [(1200, 1206, "X")]).where("label = 'X'").count() == 2


def test_all_matches_have_a_position(spark, tmp_path):
    import re

    from lexforum.plans import registry

    texts = ["ñ the other " * 450, "none", "the"]
    got = sorted(tuple(r) for r in registry.QUERIES["t_span_positions"](spark, made_documents(spark, tmp_path, *texts)).select("doc_id", "i", "start").collect())
    assert got == [(d, i, m.start()) for d, text in enumerate(texts) for i, m in enumerate(re.finditer("the", text))] and len(got) == 901


def test_windows_reach_the_end_of_a_text(spark, tmp_path):
    from lexforum.plans import registry

    texts = [" ".join("the" if i >= 16_000 else "x" for i in range(16_500)), "the x", ""]
    got = {r.doc_id: (r.covered, r.tokens, r["mean"]) for r in registry.QUERIES["w7_token_windows"](spark, made_documents(spark, tmp_path, *texts)).collect()}
    for d, text in enumerate(texts):
        words = text.split(" ")
        seen = [w for a in range(0, len(words), 300) for w in words[a : a + 400]]
        assert got[d] == (len(seen), len(words), pytest.approx(sum(w == "the" for w in seen) / len(seen)))


def test_patterns_are_tried_wherever_they_may_match(spark):
    """The letters that stand for a pattern are found in every case that the pattern takes for equal."""
    heads = ["CORTE CONſTİTUCİONAL", "conseKo", "Corte Suprema de Justicia\n sala de casación penal", "TRIBUNAL ADMINISTRATIVO DE Sucre", "jep", "Juzgado 3° Municipal de Soacha", "", "nada", None]
    df = spark.createDataFrame([(h,) for h in heads], "h string")
    plain = [F.when(F.col("h").rlike("(?iuU)" + p), F.regexp_extract("h", "(?iuU)" + p, 0)) for p, _ in records.C.COURTS]
    got = df.select(records.court_found(F.col("h"))["raw"].alias("a"), F.coalesce(*plain).alias("b"), records.court(F.col("h")).alias("name")).collect()
    assert all(r.a == r.b for r in got)
    assert [r.name for r in got] == ["Corte Constitucional", None, "Corte Suprema · Sala Penal", "Tribunal Administrativo · Sucre", "JEP", "Juzgado 3° · Soacha", None, None, None]
