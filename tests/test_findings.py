"""Findings of the third round: each case failed before its change."""

import os

import duckdb
import pytest

from lexforum.plans import registry


def against_sql(spark, folder, name, **tables):
    """The query's rows and its SQL's over made tables (rows and a schema each)."""
    con = duckdb.connect()
    for t, (rows, schema) in tables.items():
        path = os.path.join(folder, f"{t}.parquet")
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
        con.execute(f"create view {t} as select * from read_parquet('{path}/*.parquet')")
    df = registry.QUERIES[name](spark, str(folder))
    rel = con.execute(registry.ORACLES[name])
    columns = [c[0] for c in rel.description]
    told = lambda v: "null" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(told(r[c]) for c in columns) for r in df.collect()), sorted(tuple(map(told, r)) for r in rel.fetchall())


@pytest.mark.parametrize("name", ["a24_variation", "v1_disparity"])
def test_f2_zero_values(spark, tmp_path, name):
    rows = [("a", 0.0), ("a", 2.5), ("b", 0.0), ("b", 0.0), ("c", -1.0), ("c", 0.0), ("d", 3.0), ("e", None)]
    got, want = against_sql(spark, tmp_path, name, events=(rows, "event_type string, value double"))
    assert got == want and (name != "a24_variation" or {"inf", "nan"} <= {x for r in got for x in r})


def test_f3_even_tenths(spark, tmp_path):
    rows = [(i, "x" * n) for i, n in enumerate((3157, 3140, 3072 * 2 + 85, 256 * 3 + 85, 4181, 349525 + 17476, 349525 + 52428, 1, 0))]
    rows += [(100 + k, "y" * k) for k in range(1000, 4000, 17)]
    got, want = against_sql(spark, tmp_path, "p15_readable_bytes", documents=(rows, "doc_id long, text string"))
    assert got == want


@pytest.mark.parametrize("name", ["y3_civil_similarity", "t10_civil_dimensions"])
def test_f4_f5_few_words(spark, tmp_path, name):
    """A text of fewer than five words with its sentence has a similarity, too."""
    rows = [(8, ""), (17, "a b"), (26, "hijo"), (35, "Él_3 niño ñandú, casa-hogar HIJO hijo casa"), (2, "x"), (3, "..."), (5, None)]
    got, want = against_sql(spark, tmp_path, name, documents=(rows, "doc_id long, text string"))
    assert got == want


def test_f6_batches_are_bounded(spark):
    """A task's Python is given few bytes at a time, however large the partition; a smaller bound stays."""
    import pandas as pd
    from pyspark.sql import functions as F

    from lexforum.functions.materialise import ARROW_BYTES, small_batches
    from lexforum.operators import records

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.unset(key)
    records.sections("A")

    @F.pandas_udf("long")
    def held(text: pd.Series) -> pd.Series:
        return pd.Series([int(text.str.len().sum())] * len(text))

    rows = spark.range(0, 1200, 1, 1).select(F.repeat(F.lit("abcd"), 10_000).alias("text"))
    most = rows.select(held("text").alias("n")).agg(F.max("n")).first()[0]
    assert most <= 2 * ARROW_BYTES
    spark.conf.set(key, "1000")
    small_batches()
    assert spark.conf.get(key) in ("1000", "1000b")
    spark.conf.set(key, before)


def planned(spark, df):
    spark.conf.set("spark.sql.maxPlanStringLength", str(1 << 28))
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_f11_words_are_split_once(spark):
    from lexforum.operators import indicators

    df = indicators.civil_distance(spark.createDataFrame([(1, "mi hijo era carpintero en la casa del barrio")], "doc_id long, text string"))
    assert planned(spark, df).count("split(") == 1


def test_f15_blocks_keep_numbers(spark):
    """The fold over words carries no words; blocks are those of a plain loop."""
    from pyspark.sql import functions as F

    from lexforum.operators import ingest

    text = " ".join("w" * (1 + i * 7 % 11) for i in range(3000))
    want, own, size = [], [], 0
    for w in text.split():
        own, size = [*own, w], size + len(w) + 1
        if size >= 200:
            want, own, size = [*want, " ".join(own)], [], 0
    want += [" ".join(own)] if len(own) > 20 else []
    df = spark.createDataFrame([(text,), (None,), ("a b",)], "text string").select(ingest.pack_words(F.col("text"), 200).alias("b"))
    assert [r.b for r in df.collect()] == [want, None, []]
    assert ".open" not in planned(spark, df)


def test_f16_lower_case_once(spark):
    from pyspark.sql import functions as F

    from lexforum.operators import testimony

    df = spark.createDataFrame([("Yo ordené; víctima y dolor.",), (None,)], "text string").select(testimony.emotions(F.col("text")).alias("e"), testimony.grammatical_person(F.col("text")).alias("p"))
    assert planned(spark, df).count("lower(") == 2
    assert df.collect()[1].p.sa_ratio is None


def test_f18_each_rule_is_counted_and_applied_once(spark):
    from pyspark.sql import functions as F

    from lexforum.functions import text as T

    df = spark.createDataFrame([("aAb",), (None,), ("",)], "text string").select(T.substituted(F.col("text"), [("a", "b"), ("b", "cc"), ("c", "")]).alias("f")).select("f.text", "f.n")
    assert [tuple(r) for r in df.collect()] == [("", 2 + 3 + 6), (None, None), ("", 0)]
    assert planned(spark, df).count("regexp_replace(") <= 3


def test_f21_windows_are_shuffled_not_tokens(spark):
    from pyspark.sql import functions as F

    from lexforum.operators import spans

    for size, step in ((4, 3), (4, 2), (2, 3)):
        docs = spark.createDataFrame([(1, list("abacadaeafa")), (2, ["a"]), (3, [])], "doc_id long, tokens array<string>")
        wins = spans.token_windows(docs, F.when(F.col("token") == "a", 1.0).otherwise(0.0), size, step)
        plain = wins.groupBy("doc_id").agg(F.count(F.lit(1)).alias("covered"), F.count_distinct("token_index").alias("tokens"), F.avg("token_score").alias("mean"))
        assert sorted(spans.window_summary(wins).collect()) == sorted(plain.collect())


def test_op10_packed_ranges_stay_small():
    """What a range costs beside its elements follows these, not the number of texts: with many ranges a count a text outweighed them."""
    import numpy as np

    from lexforum.llm import jaccard

    rng = np.random.default_rng(3)
    for m, texts in ((0, 4096), (1, 4096), (300, 4096), (90_000, 4096), (5000, 3), (70_000, 1)):
        element, text = rng.integers(0, 1 << 40, m, dtype=np.uint64), np.sort(rng.integers(0, texts, m))
        blob = jaccard.pack(element, text, texts)
        got = jaccard.unpack(blob)
        assert (got[0] == element).all() and (got[1] == text).all() and got[2] == texts and not len(got[3])
        assert len(blob) <= 12 + 7 * m + 8


def test_op10_pairs_of_hot_keys(spark):
    """A hot key's rows go to few parts, and all pairs meet once, whatever the number of parts."""
    from lexforum.llm import jaccard

    rows = [(1, True, i, 100, 2, 100, i % 7) for i in range(40)]
    named = spark.createDataFrame([(*r, 40) for r in rows], "key long, subset boolean, name long, n int, kind int, left int, component long, sets long")
    want = {(a[2], b[2]) for a in rows for b in rows if a[2] < b[2] and a[6] != b[6]}
    for hot in (1, 7, 39, 40, 1000):
        pairs = jaccard._cross_pairs(named, hot)
        got = [(r.a, r.b) for r in pairs.collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_f12_f13_sentences_cross_once(spark):
    """All detectors look at a sentence that was gathered once: no join, one exchange, no words in it. Heads are found with and without gaps, or not at all."""
    from lexforum.operators import indicators as I

    schema = "doc_id long, sent int, i int, start int, end int, token string, lemma string, pos string, dep string, head int, ent string"
    word = lambda d, s, i, dep, head, lemma="x": (d, s, i, i * 10, i * 10 + 9, "x", lemma, "VERB", dep, head, "")
    rows = [word(1, 0, 0, "nsubjpass", 2), word(1, 0, 1, "x", 0), word(1, 0, 2, "x", 2, "reportar"), word(1, 1, 5, "nsubjpass", 9), word(1, 1, 9, "x", 9, "reportar")]
    rows += [word(2, 0, 3, "nsubjpass", 77), word(None, 0, 4, "nsubjpass", 5), word(None, 0, 5, "agent", 5), word(3, 0, 1, "nsubjpass", 2), word(3, 0, 3, "agent", 2), word(3, 0, 2, "x", 2)]
    out = I.token_instances(spark.createDataFrame(rows, schema), I.SA_TOKENS)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    got = {(r.doc_id, r.sent, r.start, r.end, round(r.weight, 4)) for r in out.collect()}
    assert got == {(1, 0, 0, 29, 1.3), (1, 1, 50, 99, 1.3), (2, 0, 30, 39, 1.0), (None, 0, 40, 49, 1.0)}


def test_f14_frequent_words_stay(spark, tmp_path):
    """Tokens of frequent words are not shuffled to their counts; with and without such words the result is the SQL's."""
    from pyspark.sql import functions as F

    from lexforum.operators import measurement

    rows = [(1, "a b  a\tc"), (2, "b"), (3, None), (4, ""), (5, "a d\ne é"), (1, "a z")]
    got, want = against_sql(spark, tmp_path, "t35_surprisal", documents=(rows, "doc_id long, text string"))
    assert got == want and len(got) == 4 - 1
    tokens = spark.createDataFrame([(i, w) for i, t in rows for w in (t or "").split()] + [(9, None)], "doc_id long, w string")
    told = [sorted((r.doc_id, r.w, round(r.log_prob, 12)) for r in measurement.own_log_probs(tokens, "w", k).collect()) for k in (1, 4, 1000)]
    assert told[0] == told[1] == told[2] and len(told[0]) == 11
    assert measurement.own_log_probs(tokens, "w").agg(F.sum(F.exp("log_prob"))).first()[0] > 0


def test_f23_lines_meet_orders_once(spark, monkeypatch):
    """What each index reads, many times over, is the written means of classes, not the join of lines and orders."""
    from lexforum.operators import ranking
    from lexforum.plans import studies

    plans, own = [], ranking.weight_sensitivity
    monkeypatch.setattr(ranking, "weight_sensitivity", lambda df, w: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or own(df, w, draws=3))
    studies.v4_weight_sensitivity(spark, "/root/testdata/sf0.001")
    assert len(plans) == 3 and not any("Join" in p for p in plans)


def test_language_id_holds_pieces_of_texts():
    """Peak memory of a prediction over 2 MB of text, as one text or many; pieces of a text hold the n-grams of the whole."""
    import random
    import tracemalloc
    from itertools import pairwise

    import numpy as np
    import pyarrow as pa

    from lexforum.llm import kernel, langid

    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnop\u00e9\u00df\u4e2dQ'") for _ in range(r.randint(1, 9)))
    words = [word() for _ in range(5000)]
    long = "".join(r.choice(words) + r.choice([" ", "  ", "\n", ", ", " 17 ", "\u3000"]) for _ in range(300_000))
    data = np.frombuffer(long.encode()[: 2 << 20].decode(errors="ignore").encode(), np.uint8)
    whole = np.array([0, len(data)])
    h, _ = langid.grams(data, whole)
    filters = langid.Filters.of({"x": np.unique(h)[::3], "y": np.unique(h)[1::4]})
    parts = list(langid.pieces(data, whole, 1 << 10))
    assert len(parts) > 1000 and np.array_equal(np.concatenate([p for p, _ in parts]), data)
    assert np.array_equal(np.sort(np.concatenate([langid.grams(p, o)[0] for p, o in parts])), np.sort(h))
    spaceless = np.frombuffer(("\u4e2d" * 2000 + "a" * 3000).encode(), np.uint8)
    assert len(list(langid.pieces(spaceless, np.array([0, len(spaceless)]), 100))) == 1
    many = np.array([0, *np.flatnonzero(data == 32)[::300], len(data)])
    langs, scores = filters.predict(data, whole)
    bits = filters.lookup(h)
    shares = [(((bits[:, 0] >> i) & 1).mean() - filters.false[i]) / (1 - filters.false[i]) for i in range(2)]
    assert langs == ["xy"[int(np.argmax(shares))]] and scores[0] == pytest.approx(max(shares), rel=1e-12)
    table = pa.RecordBatch.from_arrays([pa.array([data[a:b].tobytes().decode() for a, b in pairwise(many.tolist())])], ["text"])
    for batch in (table, pa.RecordBatch.from_arrays([pa.array([data.tobytes().decode()])], ["text"])):
        tracemalloc.start()
        n = sum(len(filters.predict(d, o)[0]) for _, d, o in kernel.blocks([batch], size=langid.PIECE_BYTES))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert n == batch.num_rows and peak < 64 << 20


def test_f19_values_are_ranked_once(spark, monkeypatch):
    """A column's values are counted once and not for each pair; nulls, many values, null groups and two types have the ranks of pandas."""
    import random

    import pandas as pd

    from lexforum.functions import stats
    from lexforum.operators import controls

    r = random.Random(5)
    rows = [(r.choice(["a", "b", None]), r.random() if r.random() < 0.9 else None, r.choice([None, 1, 2, 2, 3]), r.random() * 9 // 1, float(r.choice([1, 2, float("nan")]))) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, many double, few int, some double, odd double")
    seen, own = [], stats.running_totals
    monkeypatch.setattr(stats, "running_totals", lambda counts, *a: seen.append(counts.count()) or own(counts, *a))
    told = pd.DataFrame(rows, columns=df.columns)
    for few in (10_000, 0):  # ranks broadcast, rows shuffled to them
        monkeypatch.setattr(stats, "FEW_VALUES", few)
        for x in controls.correlated_pairs(df, ["few", "many", "some", "odd"]).collect():
            both = told[[x.a, x.b]].dropna().rank()
            assert x.n == len(both) and x.rho == pytest.approx(both[x.a].corr(both[x.b]), abs=1e-12)
        assert seen.pop() == told.many.nunique() + 3 + 9 + 2 and not seen
        got = {x.g: x for x in stats.spearman(df, "few", "many", "g").collect()}
        assert set(got) == {"a", "b", None} and len(seen) == 1 and seen.pop()
        for g, x in got.items():
            both = told[told.g.isna() if g is None else told.g == g][["few", "many"]].dropna().rank()
            assert x.n == len(both) and x.rho == pytest.approx(both.few.corr(both.many), abs=1e-12)
    assert controls.correlated_pairs(df.limit(0), ["few", "many"]).collect() == []


def test_pipeline_shortest_runs_sort_lines_thrice(spark):
    """Shortest runs equal brute force, with gaps and lines without words; the lines are scanned once and no task holds sorts of several branches."""
    import random

    from lexforum.llm import line_dedup

    r, rows = random.Random(5), []
    for d in range(120):
        p = 0
        for _ in range(r.choice([1, 3, 20, 60])):
            p += r.choice([1, 1, 1, 1, 1, 2, 3])
            rows.append((True, str(d), d % 7, p, r.choice([0, 0, 1, 2, 5, 9, 30, 60])))
    words = {(d, p): w for _, d, _, p, w in rows}
    lines = spark.createDataFrame(rows, "_some boolean, _id string, _h long, pos int, words int")
    for least in (1, 7, 50):
        want = set()
        for d, p in words:
            for step in (1, -1):
                q, total = p, words[d, p]
                while total < least and (d, q + step) in words:
                    q += step
                    total += words[d, q]
                if total >= least:
                    want.add((d, min(p, q), abs(p - q) + 1))
        out = line_dedup._shortest_runs(lines, least)
        got = [(x["_id"], x.start, x.m) for x in out.collect()]
        assert len(got) == len(want) and set(got) == want
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Sort [") == 3 and "Union" not in plan


def test_pipeline_workers_stay_small(spark, monkeypatch):
    """Packing holds little beside its encoder over 4 MB of text, tables of powers follow the texts, and language ID starts no second kind of Python workers."""
    import random
    import tracemalloc

    import public_tokenizers
    import pyarrow as pa
    from pyspark import SparkContext

    from lexforum.llm import bpe, kernel, langid, packing

    class Docs:
        """Takes the function that tasks run."""

        schema = spark.createDataFrame([], "doc_id long, text string").schema

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            self.run = run
            return self

        def withColumnRenamed(self, *_):
            return self

    path = public_tokenizers.path("byte_bpe_50k.json")
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(1, 9))) for _ in range(5000)]
    texts = [" ".join(r.choice(words) for _ in range(400)) for _ in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(texts)], ["id", "text"])
    assert sum(map(len, texts)) > 4 << 20
    docs = Docs()
    packing.pieces(docs, path)
    bpe.encoder(path).encode(*kernel.utf8(pa.array(["warm up"])))
    kernel._powers.cache_clear()
    tracemalloc.start()
    out = pa.Table.from_batches(docs.run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    ids, before = bpe.encoder(path).encode(*kernel.utf8(batch.column(1)))
    assert sum(out["length"].to_pylist()) == len(ids) + 2000 and len(before) == 2001
    assert peak < 80 << 20, peak
    assert len(kernel._Powers(3).to(1000)[0]) == kernel.POWERS_STEP

    learn = spark.createDataFrame([(i, f"{w} some words here", "en" if i % 2 else "de") for i, w in enumerate(words[:50])], "doc_id long, text string, lang string").localCheckpoint()
    monkeypatch.setattr(SparkContext, "parallelize", None)
    assert langid.train(learn).languages == ["de", "en"]


def test_f1_parsed_rows_read_tokens_once(spark):
    """Tokens are read and dealt once for both indicators and their sentences, and meet their text once; texts and tokens without a partner, without a document or a sentence are as before."""
    from lexforum.operators import indicators as I

    schema = "doc_id long, sent int, i int, start int, end int, token string, lemma string, pos string, dep string, head int, ent string"
    text = "El sujeto con fusil portaba un fusil, presentado falsamente como baja."
    words = [("El", 0, "DET", "det", 1), ("sujeto", 3, "NOUN", "nsubj", 4), ("con", 10, "ADP", "case", 3), ("fusil", 14, "NOUN", "obl", 3), ("portaba", 20, "VERB", "x", 4), ("un", 28, "DET", "det", 6), ("fusil", 31, "NOUN", "obj", 4)]
    row = lambda d, s, i, w: (d, s, i, w[1], w[1] + len(w[0]), w[0], w[0], w[2], w[3], w[4], "")
    tokens = spark.createDataFrame([row(d, s, i, w) for d, s in ((1, 0), (None, 0), (3, None)) for i, w in enumerate(words)], schema)
    sections = spark.createDataFrame([(1, text), (2, text), (3, text), (None, text), (4, "corto")], "doc_id long, text string")
    out = I.parsed_feature_rows(sections, tokens, most_chars=None)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Join") == 1
    got = {r.doc_id: (r.n_nv_instances, r.n_nv_questioned, r.y4_nv) for r in out.collect()}
    # Tokens: "sujeto", and the first "fusil" beside "con"; the phrase "portaba un fusil" stands in a sentence; a trigger is near to all.
    assert {k: v[:2] for k, v in got.items()} == {1: (3, 3), 2: (0, 0), 3: (1, 1)}
    assert got[1][2] == pytest.approx((0.7 + 0.63 + 0.9) / 4 / 0.6) and got[3][2] == pytest.approx(0.9 / 4 / 0.6)


def test_f1_stems_of_alternatives():
    """A pattern is tried only where one of its alternatives stands, and finds what the plain pattern finds."""
    import re

    from lexforum.functions import lexicons as L
    from lexforum.functions import patterns as P

    assert P.stems(r"\bse\s+(?:presentó|reportó)\b") == ("presentó", "reportó") and P.stems(r"\b(?:a|)b?") == ("",) and P.stems("a(?:bcd|x)?ef") == ("ef",)
    texts = ["Se  LLEVÓ a cabo", "la Verificación del", "TROPAS del ejército y habitantes de la calle", "ſe ejecutó", "que realmente no eran", "próximo a grupos criminaleſ", ""]
    for p in (*L.SA_LEXICAL, *L.NV_MORAL, *L.NV_QUESTIONED, *L.REP_IDENTITY, *L.REP_REPAIR):
        for x in texts:
            assert [m.span() for m in P.Finder(p).finditer(x, P.folded(x))] == [m.span() for m in re.finditer(p, x, re.IGNORECASE)]


def test_f2_all_windows_are_learned_from(spark):
    """More windows than a part holds are dealt to parts: each one changes the network, and how rows lie does not; no long run is left out."""
    import numpy as np

    from lexforum.llm import secrets

    def rows(n):
        r = np.random.default_rng(5)
        draw = lambda: "".join(r.choice(list("0123456789abcdef"), 24))
        return [(i, f"ten mora dor plain_vel_{chr(97 + i % 26)}{chr(97 + i // 26)}_lomir_ras password={draw()} gut ka sha lo niber") for i in range(n)]

    plain = [(chr(97 + i % 26) + chr(97 + i // 26) + "lomirtenshadorvel",) for i in range(200)]
    out = spark.createDataFrame([(" ".join(x[0] for x in plain),)], "text string").mapInArrow(secrets._labelled(), secrets._LABELLED).collect()
    assert {bytes(x.window[secrets.CONTEXT : secrets.CONTEXT + secrets.INSIDE]).rstrip(b"\0").decode() for x in out} == {x[0] for x in plain}

    train = lambda some, n: secrets.train(spark.createDataFrame(some, "doc_id int, text string").repartition(n), sample=40)
    all_of, again, most = train(rows(160), 2), train(rows(160), 3), train(rows(160)[:-1], 2)
    assert all((all_of.weights[k] == again.weights[k]).all() for k in all_of.weights) and all_of.threshold == again.threshold < 1
    assert any((all_of.weights[k] != most.weights[k]).any() for k in all_of.weights)
    assert all_of.recall >= 0.95
    # Windows of each held-out output are counted: the same threshold as that of the windows one by one.
    z, label = np.array([-1.0, -1.0, 0.5, 2.0, 2.0, 3.0]), np.array([0, 0, 1, 1, 1, 0])
    one, two = secrets.Network({}), secrets.Network({})
    one.calibrated(z, label, 0.6, np.zeros(6, int), np.ones(6, int))
    two.calibrated(np.array([-1.0, 0.5, 2.0, 3.0]), np.array([0, 1, 1, 0]), 0.6, np.zeros(4, int), np.array([2, 1, 2, 1]))
    assert (one.recall, one.false_rate) == (two.recall, two.false_rate) == (pytest.approx(2 / 3), pytest.approx(1 / 3)) and one.threshold == pytest.approx(two.threshold)
