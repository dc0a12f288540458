"""Commits of all tables or none, keys that stay, lookups."""

import pytest
from pyspark.sql import functions as F

from lexforum.operators import star


def rows(tables):
    return {n: sorted(tuple(r) for r in t.collect()) for n, t in tables.items()}


def test_a_failed_commit_leaves_the_last_one(spark, tmp_path):
    folder = str(tmp_path / "db")
    assert star.committed(spark, folder) == {}
    names = ["corpora", "documents", "blocks", "scores", "runs"]
    first = {n: spark.range(i + 1).withColumn("name", F.lit(n)) for i, n in enumerate(names)}
    assert {r.table: r.rows for r in star.commit(first, folder).collect()} == {n: i + 1 for i, n in enumerate(names)}
    before = rows(star.committed(spark, folder))
    # The third of five tables fails: no table changes, not even those that were written before it.
    second = {n: spark.range(10, 12).withColumn("name", F.raise_error(F.lit("lost")).cast("string") if i == 2 else F.lit("new")) for i, n in enumerate(names)}
    with pytest.raises(Exception, match="lost"):
        star.commit(second, folder)
    assert rows(star.committed(spark, folder)) == before
    # A later commit of one table, made from itself, keeps the others.
    own = star.committed(spark, folder)["documents"]
    star.commit({"documents": own.unionByName(own.selectExpr("id + 100 as id", "name"))}, folder, rows_per_file=1)
    after = rows(star.committed(spark, folder))
    assert after["documents"] == sorted(before["documents"] + [(i + 100, n) for i, n in before["documents"]]) and {n: after[n] for n in names if n != "documents"} == {n: before[n] for n in names if n != "documents"}
    assert len(list((tmp_path / "db" / "versions").glob("0000000002*/documents/part-*.parquet"))) >= 4


def test_of_two_commits_one_wins(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "db")
    star.commit({"a": spark.range(1)}, folder)
    seen = star._manifests
    monkeypatch.setattr(star, "_manifests", lambda s, f: seen(s, f)[:-1])  # as one that started before the other ended
    with pytest.raises(star.Conflict):
        star.commit({"a": spark.range(5)}, folder)
    monkeypatch.undo()
    assert star.committed(spark, folder)["a"].count() == 1


def test_keys_stay_when_rows_come_again(spark):
    names = [("b", 1), ("a", 2), ("a", 2), ("c", None), (None, None)]
    first = star.with_keys(spark.createDataFrame(names, "name string, year int"), ["name", "year"], "document_id")
    keys = {(r.name, r.year): r.document_id for r in first.collect()}
    assert first.count() == 5 and sorted(keys.values()) == [1, 2, 3, 4]
    more = spark.createDataFrame([*names, ("aa", 1), ("z", 9)], "name string, year int")
    again = star.with_keys(more, ["name", "year"], "document_id", first.select("name", "year", "document_id"))
    now = {(r.name, r.year): r.document_id for r in again.collect()}
    assert {k: now[k] for k in keys} == keys and (now["aa", 1], now["z", 9]) == (5, 6) and again.count() == 7
    twice = star.with_keys(more, ["name", "year"], "document_id", again.select("name", "year", "document_id"))
    assert {(r.name, r.year): r.document_id for r in twice.collect()} == now
    many = star.with_keys(spark.range(5000).selectExpr("md5(string(id)) as name"), ["name"], "k")
    assert [r.k for r in many.orderBy("name").collect()] == list(range(1, 5001))


def test_lookups_name_parents(spark):
    parents = star.with_keys(spark.createDataFrame([("a",), ("b",)], "corpus string"), ["corpus"], "corpus_id")
    out = star.with_lookup(spark.createDataFrame([(1, "b"), (2, "x"), (3, None)], "i int, of string"), parents, {"of": "corpus"}, "corpus_id")
    assert {r.i: r.corpus_id for r in out.collect()} == {1: 2, 2: None, 3: None}
    assert star.with_keys(parents.limit(0).drop("corpus_id"), ["corpus"], "corpus_id").count() == 0
