"""The pipeline's stages on a small made corpus, and its run over the smallest tables."""

import os

import pytest

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"
EN, FR = "the and of that was with for this have from they which".split(), "les des une que dans pour avec sur est pas plus par".split()


@pytest.fixture(scope="module")
def docs(spark):
    import random

    r = random.Random(1)
    text = lambda ws, n: " ".join(r.choice(ws) + r.choice(["", "s", "er", "al", "on"]) for _ in range(n))
    rows = [(i, text(EN if i % 2 else FR, 80), "en" if i % 2 else "fr", "s", 0) for i in range(60)]
    shared = text(EN, 70)
    rows += [(100, shared + "\n" + text(EN, 30), "en", "s", 0), (101, text(EN, 30) + "\n" + shared, "en", "s", 0)]
    near = rows[1][1].split()
    rows += [(102, " ".join([*near[:-1], "changed"]), "en", "s", 0), (103, rows[1][1], "en", "s", 0)]
    rows += [(104, text(EN, 40) + " password=abc123def456 " + text(EN, 20), "en", "s", 0), (105, "0000 1111 !!", "en", "s", 0), (106, None, None, None, None), (107, "", "en", "s", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def test_stages(spark, docs):
    after = {}
    kept = docs
    for name, stage in P.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, SF).collect(), docs.schema)
        assert kept.columns == docs.columns
        after[name] = {r.doc_id: r for r in kept.collect()}
    clean = set(range(60)) | {100, 101, 104}
    assert clean | {102, 103} == set(after["language_id"])
    assert 103 not in after["line_dedup"]  # a whole copy
    assert after["line_dedup"][101].text.count("\n") == 0 and after["line_dedup"][100].text.count("\n") == 1
    assert after["line_dedup"][101].n_chars == len(after["line_dedup"][101].text)
    assert clean == set(after["jaccard_join"])
    assert "abc123def456" not in after["secret_scan"][104].text and "[SECRET]" in after["secret_scan"][104].text
    pieces = P.STAGES[-1][1](spark, kept, SF).collect()
    assert {r.doc_id for r in pieces} == clean


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_run(spark):
    out = P.run(spark, SF)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns)
    fill = {}
    for r in out.collect():
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 1024


def brute_pipeline(filters, network, rows):
    """The first four stages over (id, text) by plain loops; the trained parts are given."""
    import re

    import numpy as np

    from lexforum.llm import kernel, langid, secrets
    from test_llm_joins import brute_lines

    def utf8(text):
        data = np.frombuffer(text.encode(), np.uint8)
        return data, np.array([0, len(data)])

    kept = []
    for i, t in rows:
        lang, score = filters.predict(*utf8(t or ""))
        if t and lang[0] != langid.UND and score[0] >= P.LEAST_LANGUAGE_SCORE:
            kept.append((i, t))
    clean = brute_lines([((i is not None, i or 0), t) for i, t in kept], 50)
    kept = [(i, clean[((i is not None, i or 0), t)], t) for i, t in kept]
    kept = [(i, t) for i, t, was in kept if t == was or re.search(r"\S", t)]

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        return frozenset([tuple(w)] if len(w) < 5 else (tuple(w[k : k + 5]) for k in range(len(w) - 4)))

    docs = sorted(set(kept), key=lambda x: (x[0] is None, x[0] or 0))
    sets, group = [shingles(t) for _, t in docs], list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = group[a], group[b]
                group = [min(x, y) if g in (x, y) else g for g in group]
    groups = {}
    for g, d in zip(group, docs):
        groups.setdefault(g, []).append(d)
    out = []
    for own in groups.values():
        ids = [i for i, _ in own]
        assert len(own) == 1 or ids[0] != ids[1] or own[0][1].split() == own[1][1].split(), "the test's groups have one least id"
        i, t = own[0]
        for s, e, _ in reversed(secrets.find([t], *utf8(t), network)[0]):
            t = t[:s] + "[SECRET]" + t[e:]
        out.append((i, t))
    return out


def test_against_brute_force(spark, tmp_path):
    """Repeated and null ids, columns with the stages' own names, empty texts, one of 1 MB, ties."""
    import random

    from pyspark.sql import functions as F

    from lexforum.llm import langid, secrets

    r = random.Random(11)
    text = lambda ws, n: " ".join(r.choice(ws) + r.choice(["", "s", "er", "al", "on", "x"]) + r.choice("abcdefgh") for _ in range(n))
    rows = [(i, "\n".join(text(EN if i % 2 else FR, r.randint(15, 40)) for _ in range(r.randint(1, 4)))) for i in range(70)]
    passage = text(EN, 55)
    rows += [(80 + i, f"{text(EN, 12 + i)}\n{passage}\n{text(EN, 9)}") for i in range(4)]
    rows += [(3, rows[3][1]), (5, rows[3][1]), (5, text(EN, 60)), (None, text(EN, 61)), (None, text(FR, 62)), (None, rows[7][1])]
    rows += [(90, None), (91, ""), (92, "12 34 !!"), (93, " \n "), (94, text(EN, 30) + " password=abc123def456 token: zzz999yyy " + text(EN, 9))]
    rows += [(95, "\n".join(text(EN, 14_000) for _ in range(12)))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), i, 0.5, "h", 7, "k", "t") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _id long, score double, _h string, lines_total int, key string, _text string")
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "fr").otherwise("en")).repartition(4)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = kept = spark.read.parquet(str(tmp_path / "documents.parquet"))
    after = {}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, kept, str(tmp_path))
        assert out.schema.names == docs.columns
        out.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        after[name] = kept
    network = secrets.train(after["jaccard_join"])
    want = brute_pipeline(langid.train(docs), network, rows)
    got = [(x.doc_id, x.text) for x in kept.collect()]
    order = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(got, key=order) == sorted(want, key=order)
    assert all((x._h, x.key, x.score, x.lines_total, x._text) == ("h", "k", 0.5, 7, "t") for x in kept.collect())
    pieces = P.run(spark, str(tmp_path)).collect()
    assert sorted(str(x.doc_id) for x in pieces if x.piece == 0) == sorted(str(i) for i, _ in want)
    for name, stage in P.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
