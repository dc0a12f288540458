"""Sources and sinks over made files; streaming jobs against batch results."""

import hashlib
import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from lexforum.sources import readers, sinks
from lexforum.streaming import jobs


def docx(*paragraphs):
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<?xml version="1.0"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_text_files_by_suffix_in_order(spark, tmp_path):
    (tmp_path / "b.txt").write_text("zwei")
    (tmp_path / "a.md").write_bytes("uño".encode("latin-1"))
    (tmp_path / "c.pdf").write_text("no")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.txt").write_bytes(b"\xef\xbb\xbfmark")
    rows = readers.text_files(spark, str(tmp_path), (".txt", ".md")).collect()
    assert [r.path.rsplit("/", 1)[1] for r in rows] == ["a.md", "b.txt", "d.txt"] and [r.text for r in rows] == ["uño", "zwei", "mark"]


def test_json_documents_with_fallback_rows(spark, tmp_path):
    (tmp_path / "1.json").write_text(json.dumps({"id": "x", "y": 3}))
    (tmp_path / "2.json").write_text('{"id": "broken", ')
    (tmp_path / "3.json").write_text(json.dumps({"id": "z"}))
    out = readers.json_documents(spark, str(tmp_path), "id string, y int, p double", {"y": 0, "p": 0.5}).collect()
    assert [(r.file, r.id, r.y, r.p, r.warning) for r in out] == [("1.json", "x", 3, None, None), ("2.json", out[1].id, 0, 0.5, "json_read_error"), ("3.json", "z", None, None, None)]
    assert [r.file for r in readers.json_documents(spark, str(tmp_path), "id string", first=2).collect()] == ["1.json", "2.json"]


def test_documents_with_a_second_extractor(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx("Uno", " ", "dos &amp; tres"))
    (tmp_path / "b.docx").write_bytes(b"no archive: plain words")
    (tmp_path / "c.docx").write_bytes(docx())
    out = {r.path.rsplit("/", 1)[1]: (r.text, r.extractor) for r in readers.extracted(spark, str(tmp_path), [".docx"], [readers.docx_text, lambda b: b.decode()], least=3).collect()}
    assert out["a.docx"] == ("Uno\ndos & tres", 0) and out["b.docx"] == ("no archive: plain words", 1) and out["c.docx"] == (None, None)
    assert readers.docx_text(None) is None


def test_inventory_prunes_and_sums(spark, tmp_path):
    for name, n in (("a.txt", 3), (".git/x", 9), ("sub/b.TXT", 5), ("sub/c.csv", 70)):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(b"x" * n)
    files = readers.inventory(spark, str(tmp_path / "in"), 10, [".git"])
    assert {r.path.rsplit("/", 1)[1]: r.sha256 is not None for r in files.collect()} == {"a.txt": True, "b.TXT": True, "c.csv": False}
    assert [(r.extension, r.files, r.bytes) for r in sinks.inventory_summary(files).collect()] == [("csv", 1, 70), ("txt", 2, 8)]
    report = sinks.inventory_report(files, str(tmp_path / "out"))
    assert report.splitlines()[-1].split() == ["total", "3", "78"]
    assert spark.read.json(str(tmp_path / "out/json")).count() == readers.csv(spark, str(tmp_path / "out/csv")).count() == 3
    bare = readers.inventory(spark, str(tmp_path / "in"))
    assert "content#" not in bare._jdf.queryExecution().executedPlan().toString()


def test_pairs_are_written_once(spark, tmp_path):
    df = spark.createDataFrame([("a" * 64, "uno", 1, True), ("b" * 64, "dos", 2, False)], "doc_sha string, text string, n int, ok boolean")
    out = sinks.document_pairs(df, str(tmp_path), failed=~F.col("ok"))
    assert {(r.name, json.loads(r.record)["n"]) for r in out.collect()} == {("a" * 16, 1), ("error", 2)}
    again = sinks.document_pairs(df.withColumn("n", F.lit(9)), str(tmp_path))
    assert again.count() == 2 and {json.loads(r.record)["n"] for r in again.collect()} == {1, 2}
    assert {r.text for r in spark.read.parquet(str(tmp_path / "texts")).collect()} == {"uno", "dos"}


def test_small_reports(spark, tmp_path):
    df = spark.createDataFrame([("x", True, False), ("z", False, True), ("y", False, False)], "name string, ok boolean, low boolean")
    r = sinks.batch_summary(df, F.col("ok"), F.col("low"), "name").first()
    assert (r.total, r.success, r.failed, r.low_confidence, r.failed_files) == (3, 1, 2, 1, ["y", "z"])
    sinks.delimited(df, str(tmp_path / "csv"), mark=True)
    assert next((tmp_path / "csv").glob("part*")).read_bytes().startswith(b"\xef\xbb\xbf") and readers.csv(spark, str(tmp_path / "csv")).columns == df.columns
    assert sinks.descriptives(spark.createDataFrame([("a", 1.0, None)], "k string, v double, w int"), "T").splitlines() == ["T", "=", "k  v       w", "a  1.0000  -"]
    report = json.loads(sinks.governance(spark.createDataFrame([("m1", "t1", 1.0), ("m1", "t2", 0.5), ("m2", "t1", 0.5)], "module string, test string, score double")).first().report)
    assert report["overall"] == pytest.approx(0.6667) and report["level"] == "MEDIUM" and report["modules"]["m1"] == {"tests": {"t1": 1.0, "t2": 0.5}, "mean": 0.75, "level": "HIGH"}


def test_centroids_are_complete(spark, tmp_path):
    spark.createDataFrame([("a", [1.0, 2.0]), ("b", [None, 1.0]), ("c", None)], "name string, vector array<float>").write.parquet(str(tmp_path / "c"))
    assert [tuple(r) for r in readers.centroids(spark, str(tmp_path / "c")).collect()] == [("a", [1.0, 2.0])]


def test_streams_give_what_batches_give(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i % 60:02d}:00", f"u{i % 3}", "click" if i % 2 else "view", float(i), i % 40) for i in range(120)]
    events = spark.createDataFrame(rows, "event_id int, t string, user_id string, event_type string, value double, doc_id int").withColumn("ts", F.col("t").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    read = lambda: jobs.stream(spark, str(tmp_path), "events")
    jobs.once(jobs.new_documents(read(), "ts"), str(tmp_path / "new"), str(tmp_path / "cp1")).awaitTermination()
    assert sorted(r.doc_id for r in spark.read.parquet(str(tmp_path / "new")).collect()) == list(range(40))
    jobs.once(jobs.sessions(read(), "5 minutes"), str(tmp_path / "sessions"), str(tmp_path / "cp2")).awaitTermination()
    batch = {(r.user_id, r.start, r.n) for r in events.groupBy("user_id", F.session_window("ts", "5 minutes").alias("w")).count().select("user_id", F.col("w.start").alias("start"), F.col("count").alias("n")).collect()}
    # Sessions are told when the watermark has passed them; no later event closes the last ones.
    assert {(r.user_id, r.start, r.n) for r in spark.read.parquet(str(tmp_path / "sessions")).collect()} <= batch


def test_listing_never_enters_pruned_folders(spark, tmp_path):
    root = tmp_path / "tree"
    kept = {"a.txt": 1, "x/b.TXT": 2, "x/y/z/c": 3, "x/ñ é/d.csv": 4, "x/.hidden/e": 5}
    for name, n in kept.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"q" * n)
    for name in (".git/deep/f", "x/.git/g", "x/y/venv/h"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"no")
    (root / "loop").symlink_to(root, target_is_directory=True)
    (root / "empty").mkdir()
    closed = [root / ".git", root / "x" / ".git", root / "x" / "y" / "venv"]
    for c in closed:
        os.utime(c, (1, 2))  # reading a folder's entries moves its access time (where the mount keeps one)
    # Links to files are files; folders that are links are not entered.
    found = {r.path[len(str(root)) + 1 :]: r for r in readers.listing(spark, str(root), [".git", "venv"]).collect()}
    assert {k: r.length for k, r in found.items()} == kept and all(c.stat().st_atime == 1 for c in closed)
    assert found["a.txt"].modificationTime is not None
    uri = readers.inventory(spark, f"file://{root}", 3, [".git", "venv"])
    rows = {r.path.split("/tree/")[1]: (r.extension, r.sha256) for r in uri.collect() if r.extension != "csv"}
    digest = lambda n: hashlib.sha256(b"q" * n).hexdigest()
    assert rows == {"a.txt": ("txt", digest(1)), "x/b.TXT": ("txt", digest(2)), "x/y/z/c": ("", digest(3)), "x/.hidden/e": ("", None)}
    assert readers.listing(spark, str(root / "empty")).count() == 0 and readers.listing(spark, str(root / "nowhere")).count() == 0
    whole = readers.inventory(spark, str(root), by_tasks=False, pruned=[".git", "venv"])
    assert {r.path.split("/tree/")[1] for r in whole.collect()} >= {"a.txt", "x/b.TXT", "x/y/z/c"}
