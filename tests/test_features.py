"""Feature jobs: documents of JSON, targets, contexts, rows, summaries; measurement formulae; runners with flags."""

import json
import math
import statistics

import pytest
from pyspark.sql import functions as F

from lexforum.__main__ import main
from lexforum.operators import features, indicators, jobs, measurement

NV = "El presunto guerrillero portaba un fusil y fue reportado como baja en combate. "
REP = "Reconozco ante las víctimas mi responsabilidad y pido perdón a la familia. "


def document(section, text, kind="A", tribunal="Corte Suprema · Sala Penal", date="2010-05-01", target=False, **more):
    own = {"section_id": section, "is_target": target, "text": text} | more.pop("extra", {})
    return {"metadata": {"doc_id": more.pop("id", "d"), "tribunal": tribunal, "date_issued": date}, "segmentation": {"corpus_type": kind, "sections": [own]}, **more}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    place = tmp_path_factory.mktemp("corpora")
    files = {
        "a/one.json": document("hechos", NV * 3, id="one"),
        "a/two.json": document("CARGO UNICO", REP, kind="B", tribunal="x CE y", id="two"),
        "a/three.json": document("ANTECEDENTES", NV, id="three"),
        "a/four.json": document("OTRA", "inline, that the source replaces", target=True, id="four", source_file="texts\\four.txt", extra={"char_range": [2, 2 + len(NV)]}),
        "a/five.json": document("HECHOS", "  short  ", id="five"),
        "a/six.json": {"metadata": None, "segmentation": {"sections": None}},
        "b/one.json": document("RESUELVE", REP * 2, kind="B", tribunal="JEP", id="b1"),
    }
    for name, data in files.items():
        path = place / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(json.dumps(data, ensure_ascii=False))
    (place / "a" / "bad.json").write_text("{not json")
    (place / "texts").mkdir()
    (place / "texts" / "four.txt").write_text("..\n"[:2] + NV + "tail")
    (place / "none").mkdir()
    return place


def sources(spark, folder):
    return spark.createDataFrame([(f"file:{folder}/texts/four.txt", ".." + NV + "tail"), ("other", "x")], "path string, text string")


def test_documents_and_targets(spark, folder):
    docs = features.documents(spark, f"{folder}/a", None, sources(spark, folder), str(folder))
    assert {r.file: r.error for r in docs.collect() if r.error} == {"bad.json": "json_read_error"} and docs.count() == 7
    rows = {r.file: r for r in features.targets(docs, "A").collect()}
    assert set(rows) == {"one.json", "two.json", "four.json"} and rows["four.json"].text == NV.strip()
    # What calls itself B in A is put right, with the code of the first court.
    assert {k: (r.corpus_type, r.y5_corpus_type, r.year) for k, r in rows.items()} == {"one.json": ("A-CSJ", 1, 2010), "two.json": ("A-CE", 0, 2010), "four.json": ("A-CSJ", 1, 2010)}
    assert rows["one.json"].y6_period == pytest.approx(16 / 29)
    bare = {r.file: r for r in features.targets(features.documents(spark, f"{folder}/a"), "A").collect()}
    assert bare["four.json"].text == "inline, that the source replaces"
    assert features.documents(spark, f"{folder}/a", first=2).count() == 2
    assert features.documents(spark, f"{folder}/none").count() == features.documents(spark, f"{folder}/nowhere").count() == 0


def test_rows_equal_those_of_single_sections(spark, folder):
    docs = features.documents(spark, f"{folder}/a")
    rows = {r.file: r for r in features.section_features(docs, "A").collect()}
    alone = {r.file: r for r in indicators.feature_rows(features.targets(docs, "A")).collect()}
    assert set(rows) == set(alone)
    for k, r in rows.items():
        assert all(r[c] == alone[k][c] for c in ("y2_sa", "y3_civil", "y4_nv", "y10_rep", "text_length_chars", "n_nv_instances", "has_warning")) and r.y1_ebi == 0
    assert rows["one.json"].y4_nv > 0 and rows["two.json"].y10_rep > 0
    y1 = spark.createDataFrame([("one.json", 0, 0.7), ("one.json", 0, 0.6)], "file string, place int, y1_ebi double")
    assert {r.file: r.y1_ebi for r in features.section_features(docs, "A", y1=y1).collect()} == {"one.json": 0.7, "two.json": 0.0, "four.json": 0.0}
    cut = {r.file: r.text_length_chars for r in features.section_features(docs, "A", most_chars=40).collect()}
    assert cut == {"one.json": 40, "two.json": 40, "four.json": 32}


def test_parsed_rows(spark, folder):
    docs = features.documents(spark, f"{folder}/a")
    words = [("one.json", 0, 0, i, w, w, p, dep, h, i * 10, i * 10 + 5) for i, (w, p, dep, h) in enumerate([("presunto", "ADJ", "amod", 1), ("guerrillero", "NOUN", "nsubj", 2), ("portar", "VERB", "ROOT", 2), ("fusil", "NOUN", "obj", 2), ("baja", "NOUN", "obl", 2)])]
    tokens = spark.createDataFrame(words, "file string, place int, sent int, i int, token string, lemma string, pos string, dep string, head int, start int, end int").withColumns({"morph": F.lit(""), "ent": F.lit("")})
    got = {r.file: r for r in features.section_features(docs, "A", tokens).collect()}
    keyed = features.targets(docs, "A").withColumn("doc_id", F.col("file"))
    want = {r.doc_id: r for r in indicators.parsed_feature_rows(keyed, tokens.withColumn("doc_id", F.col("file"))).collect()}
    assert set(got) == set(want) and all(got[k][c] == want[k][c] for k in want for c in ("y2_sa", "y4_nv", "n_nv_instances", "n_nv_questioned"))
    assert got["one.json"].doc_id == "one" and got["one.json"].n_nv_instances > 0


def test_run_summary_and_tally(spark, folder, tmp_path):
    rows = features.run(spark, {"A": f"{folder}/a", "B": f"{folder}/b"}, str(tmp_path))
    assert sorted((r.corpus, r.file) for r in rows.collect()) == [("A", "four.json"), ("A", "one.json"), ("A", "two.json"), ("B", "one.json")]
    back = spark.read.option("header", True).csv(f"{tmp_path}/indicators_all")
    assert back.count() == 4 and [c.lstrip("﻿") for c in back.columns] == list(features.COLUMNS)
    told = {(r.corpus, r.indicator): r for r in features.summary(rows).collect()}
    y4 = [r.y4_nv for r in rows.collect() if r.corpus == "A"]
    one = told["A", "y4_nv"]
    assert (one.n, one.min, one.max) == (3, min(y4), max(y4)) and one.mean == pytest.approx(statistics.mean(y4)) and one.std == pytest.approx(statistics.stdev(y4))
    assert told["B", "y4_nv"].std is None
    a = rows.where("corpus = 'A'")
    assert features.tally(features.documents(spark, f"{folder}/a"), a).first().asDict() == {"files": 7, "errors": 1, "sections": 3, "without_warning": a.where("not has_warning").count(), "documents": 3}
    assert features.tally(features.documents(spark, f"{folder}/none"), a.limit(0)).first().asDict() == {"files": 0, "errors": 0, "sections": 0, "without_warning": 0, "documents": 0}
    assert [tuple(r.features) for r in features.feature_matrix(rows.where("corpus = 'B'")).collect()] == [(2.0, pytest.approx(16 / 29))]
    assert {r.corpus_type: r.n for r in features.distribution(rows).collect()} == {"A-CSJ": 2, "A-CE": 1, "B": 1}


def test_rows_of_document_jobs(spark):
    body = "HECHOS PROBADOS:\n" + NV * 4 + "\nRESUELVE:\n" + REP * 3
    files = spark.createDataFrame([("x.txt", bytearray(body.encode())), ("y.txt", None)], "path string, content binary")
    docs = features.from_jobs(jobs.document_job(files, "A"))
    rows = features.section_features(docs, "A").collect()
    assert {r.file for r in rows} == {"x.txt"} and any(r.y4_nv > 0 for r in rows)
    assert docs.where("error is not null").count() == 1


def test_measures(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-2.0, 0.0]), (3, [0.0, 5.0]), (4, [0.0, 0.0]), (5, None)], "id int, v array<double>")
    poles = spark.createDataFrame([("p", [3.0, 0.0])], "name string, vector array<double>")
    out = {r.id: (r.d, r.c, r.m) for r in measurement.poles(df, poles, "v", {"d": ("p", False), "c": ("p", True), "m": ("missing", False)}).collect()}
    assert out == {1: (0.0, 1.0, None), 2: (1.0, 0.0, None), 3: (0.5, 0.5, None), 4: (None, None, None), 5: (None, None, None)}
    tokens = spark.createDataFrame([(1, -2.0, 1), (1, -4.0, 3), (1, None, 9), (2, None, 1)], "doc_id int, log_prob double, k int")
    got = {r.doc_id: r.surprisal for r in measurement.mean_surprisal(tokens).collect()}
    assert got == {1: 3.0, 2: 0.0} and measurement.mean_surprisal(tokens, weight="k").where("doc_id = 1").first().y7_surprisal == pytest.approx((3.5 - 3.82) / 1.14)
    row = spark.createDataFrame([(4.0, 2.0, 0.5), (0.0, 2.0, 0.5), (None, 2.0, 0.5)], "r double, v double, l double").select(measurement.acoustic(F.col("r"), F.col("v"), F.col("l"))).collect()
    assert row[0][0] == pytest.approx((0.4 / 4 + 0.8 * 0.4 + 0.1 - 0.52) / 0.18) and row[1][0] == pytest.approx((4 + 0.8 * 0.4 + 0.1 - 0.52) / 0.18) and row[2][0] is None
    assert not math.isnan(row[0][0])


def test_runners(spark, folder, tmp_path, capsys):
    assert main(["features", "--corpus", "A", "--corpus-a-dir", f"{folder}/a", "--output-dir", f"{tmp_path}/f"], spark) == 0
    assert "y4_nv" in capsys.readouterr().out and spark.read.option("header", True).csv(f"{tmp_path}/f/indicators_corpus_a").count() == 3
    assert main(["inventory", "--root", str(folder / "texts"), "--output", f"{tmp_path}/i", "--skip-hash"], spark) == 0
    assert "txt" in capsys.readouterr().out
    assert main(["sem", "--csv-a", f"{tmp_path}/none", "--csv-b", f"{tmp_path}/none"], spark) == 1
    assert main(["load", "--list"], spark) == 0 and "documents" in capsys.readouterr().out.splitlines()
    assert main(["load"], spark) == 1 and main(["load", "--only", "nothing"], spark) == 4 and main(["load", "--only", "corpora", "--store", f"{tmp_path}/s"], spark) == 3
    assert main(["load", "--only", "corpora", "--store", f"{tmp_path}/s", "--reset"], spark) == 0 and main(["load", "--only", "corpora", "--store", f"{tmp_path}/s", "--dry-run"], spark) == 0
    with pytest.raises(SystemExit):
        main(["features", "--corpus", "C"], spark)


def test_sem_runner(spark, tmp_path, capsys):
    rows = [(str(i), "A-CE" if i % 2 else "B", math.sin(i), math.sin(i) + 0.3 * math.cos(7 * i), math.sin(i) + 0.3 * math.sin(5 * i + 1), -0.5 * math.sin(i) + 0.4 * math.cos(3 * i)) for i in range(200)]
    spark.createDataFrame(rows, "doc_id string, corpus_type string, y2_sa double, y3_civil double, y4_nv double, y10_rep double").write.option("header", True).csv(f"{tmp_path}/a")
    assert main(["sem", "--csv-a", f"{tmp_path}/a", "--csv-b", f"{tmp_path}/b", "--spec", "dos_factores", "--bootstrap", "20"], spark) == 0
    assert "key path" in capsys.readouterr().out
    assert main(["sem", "--csv-a", f"{tmp_path}/a", "--csv-b", f"{tmp_path}/b", "--spec", "dos_factores", "--multigroup"], spark) == 0
    assert "A-CE" in capsys.readouterr().out
