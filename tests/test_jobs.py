"""Document jobs: failures as rows, good files whole, delivery once, counters, runners."""

import pytest
from pyspark.sql import functions as F

from lexforum.operators import ingest, jobs, records

HEAD = "República de Colombia\nCorte Suprema de Justicia\nSALA DE CASACIÓN PENAL\nRadicación núm. 35099 SP1234-2015\nBogotá, quince (15) de marzo de dos mil ocho (2008)\n"
BODY = "HECHOS PROBADOS:\n" + "palabra " * 30 + "\nRESUELVE:\n" + "otra " * 25


def files(spark):
    rows = [("d/a.txt", (HEAD + BODY).encode()), ("d/b.txt", BODY.encode("latin-1")), ("d/c.txt", None), ("d/e.txt", b""), ("d/f.txt", " \n\t ".encode()), ("d/g.txt", (HEAD + BODY).encode())]
    return spark.createDataFrame([(p, None if c is None else bytearray(c)) for p, c in rows], "path string, content binary")


def test_each_file_is_a_row(spark):
    out = {r.path[2]: r for r in jobs.document_job(files(spark).withColumn("text", F.lit("clash")), "A").collect()}
    assert {k: (r.success, r.step, r.error_message) for k, r in out.items()} == {"a": (True, None, None), "b": (True, None, None), "c": (False, "read", "no content"), "e": (False, "clean", "no text is left"), "f": (False, "clean", "no text is left"), "g": (True, None, None)}
    # The good ones equal the single steps.
    clean = ingest.clean(files(spark).withColumn("text", F.col("content").cast("string")).where("path in ('d/a.txt', 'd/b.txt')"), "text", tuple(jobs.C.SCAN_CORRECTIONS))
    alone = {r.path[2]: r for r in records.metadata(clean.withColumn("n", F.regexp_extract("path", "([^/]*)$", 1)), "clean_text", "n").withColumn("s", records.sections("A")(F.col("clean_text"))).collect()}
    for k, r in alone.items():
        assert (out[k].clean_text, out[k].sha256_clean, out[k].cleaning_report, out[k].sections, out[k].coverage, out[k].warnings) == (r.clean_text, r.doc_sha, r.cleaning_report, r.s.sections, r.s.coverage, r.s.warnings)
        assert out[k].metadata.extraction_confidence == r.extraction_confidence and out[k].metadata.tribunal == r.tribunal
        assert out[k].low_confidence == (r.extraction_confidence < 0.5) and len(out[k].sections) >= 2
    assert (out["a"].low_confidence, out["b"].low_confidence, out["c"].low_confidence) == (False, True, None) and out["f"].sections is None and out["c"].metadata is None


def test_what_raises_is_told_in_its_row(spark, monkeypatch):
    def first(data):
        raise ValueError("not this kind") if data[:1] == b"R" else KeyError("x")

    second = lambda data: data.decode() if data.startswith(b"R") else None
    out = {r.path[2]: r for r in jobs.read_text(files(spark), [first, second]).collect()}
    assert out["a"].text == HEAD + BODY and out["a"].read_error is None
    assert (out["b"].read_error, out["c"].read_error) == ("KeyError: 'x'", "no content") and out["b"].text is None
    whole = {r.path[2]: (r.step, r.success) for r in jobs.document_job(files(spark), "A", [first, second]).collect()}
    assert whole["b"] == ("read", False) and whole["a"] == (None, True)

    def broken(corpus, *more):
        def cut(text):
            if "35099" in text:
                raise RuntimeError("no end")
            return records_cut(text)

        records_cut = real(corpus, *more)
        return cut

    real = records.cutter
    monkeypatch.setattr(records, "cutter", broken)
    out = {r.path[2]: r for r in jobs.document_job(files(spark), "A").collect()}
    assert (out["a"].step, out["a"].error_message, out["b"].success) == ("segment", "RuntimeError: no end", True)
    assert out["a"].metadata.tribunal == "Corte Suprema · Sala Penal" and out["a"].low_confidence is None


def test_delivery_is_once(spark, tmp_path):
    folder = str(tmp_path / "out")
    want = (6, 3, 3, 1)
    for _ in range(2):
        assert tuple(jobs.deliver(jobs.document_job(files(spark), "A"), folder).first()) == want
    assert spark.read.parquet(f"{folder}/documents").count() == 3
    assert sorted((r.path, r.step) for r in spark.read.parquet(f"{folder}/quarantine").collect()) == [("d/c.txt", "read"), ("d/e.txt", "clean"), ("d/f.txt", "clean")]
    mended = spark.createDataFrame([("d/c.txt", bytearray(BODY.encode()))], "path string, content binary")
    assert tuple(jobs.deliver(jobs.document_job(mended, "A"), folder).first()) == (6, 4, 2, 2)
    with pytest.raises(RuntimeError, match="d/c.txt: read: no content"):
        jobs.deliver(jobs.document_job(files(spark), "A"), str(tmp_path / "none"), stop_on_error=True)
    assert not (tmp_path / "none").exists()


def test_run_over_folders(spark, tmp_path):
    for c in "AB":
        (tmp_path / c).mkdir()
    (tmp_path / "A" / "SP1234-2015.txt").write_text(HEAD + BODY, encoding="utf-8")
    (tmp_path / "A" / "x.text").write_bytes(b"\n")
    (tmp_path / "A" / "y.pdf").write_bytes(b"1")
    out = {r.corpus_type: tuple(r)[1:] for r in jobs.run(spark, str(tmp_path), str(tmp_path / "out")).collect()}
    assert out == {"A": (2, 1, 1, 0), "B": (0, 0, 0, 0)}


def test_looser_headings(spark):
    text = "LOS HECHOS: " + "uno " * 60 + "\nV. ORDENA:\n" + "dos " * 60 + "\nMODUS OPERANDI\n" + "tres " * 60
    df = spark.createDataFrame([(text,), (None,), ("",)], "text string")
    named = lambda schemes: [(r.section_id, r.is_target) for r in records.section_rows(df.where("text <> ''"), "B", schemes=schemes).orderBy("section_index").collect()]
    assert named(jobs.C.SECTIONS_LOOSE) == [("HECHOS_Y_CONDUCTAS", True), ("RESUELVE", True), ("PATRONES_MACROCRIMINALES", True)]
    assert [s for s, _ in named(jobs.C.SECTIONS)] == ["ENCABEZADO", "PATRONES_MACROCRIMINALES"]
    whole = jobs.document_job(spark.createDataFrame([("x", bytearray(text.encode()))], "path string, content binary"), "B", schemes=jobs.C.SECTIONS_LOOSE).first()
    assert whole.success and [s.section_id for s in whole.sections] == ["HECHOS_Y_CONDUCTAS", "RESUELVE", "PATRONES_MACROCRIMINALES"]
    # A null text has no section, an empty one a body.
    assert sorted(r.section_id for r in records.section_rows(df, "A", schemes=jobs.C.SECTIONS_LOOSE).collect()) == ["CUERPO", "HECHOS"]


def test_section_text_or_inline(spark):
    rows = [("abc  def", 3, 8, "in"), ("abc", 1, 99, "in"), ("abc", 1, 1, "in"), (None, 0, 2, " in "), ("", 0, 2, "in"), ("abc", None, 2, "in"), ("abc", 2, 1, "in"), (None, None, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s string, a int, b int, t string")
    got = {r.i: r.x for r in df.select("i", records.section_text_or(F.col("s"), F.col("a"), F.col("b"), F.col("t")).alias("x")).collect()}
    assert [got[i] for i in range(len(rows))] == ["def", "bc", "", "in", "in", "in", "in", ""]
