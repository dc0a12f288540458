"""Load modules over the star schema: twice the same, no orphans, keys that stay, enrichment, errors of one module."""

import pytest
from pyspark.sql import functions as F

from lexforum.operators import modules, star

ROWS = "order long, doc string, corpus string, year int, section string, n_chars long, y2_sa double, y4_nv double"
LONG = "0123456789abcdef"


def sources(spark):
    make = spark.createDataFrame
    a = [(0, f"{LONG}A", "A-CSJ", None, "H", 10, 0.1, None), (1, f"{LONG}A", "A", 2008, "R", 20, 0.2, 0.5), (2, f"{LONG}A", "A", 2010, "H", 30, float("nan"), 0.6), (3, None, "A", 1, "H", 1, 0.3, 0.3), (4, "z", "?", 2001, None, 1, 0.3, 0.3), (5, "z", "B", 1999, "H", 7, 0.9, None)]
    b = [(0, f"{LONG}A", "B", 1980, "H", 10, 0.7, 0.7), (1, "b1", "b-jep", 2020, "ASUNTO", 5, 0.4, None)]
    return {
        "rows_a": make(a, ROWS),
        "rows_b": make(b, ROWS),
        "inventory": make([(0, f"{LONG}…", "Auto de casación", None, "", "CSJ", None, "Meta", None, None, 99), (1, f"{LONG}A...", "Sentencia", "SP-1", "2008-01-01", "X", None, "Huila", None, None, None), (2, "b1", "auto", "no", None, None, None, None, None, None, None)], "order long, doc string, action string, number string, date string, origin string, judge string, department string, town string, unit string, n_chars long"),
        "hearings": make([("Huila", "huila", ["huila_neiva", "Neiva"], "2024-04-22", 10.5, None, None), ("Dabeiba", "dabeiba", None, "2022-09-26", 2.3, "J", None)], "name string, audio string, aliases array<string>, started string, hours double, judge string, notes string"),
        "participants": make([("Huila", "S1", "one", "r"), ("Nowhere", "S1", "two", "r"), ("Huila", "S1", "again", "r")], "hearing string, speaker string, name string, rank string"),
        "named": make([("X1_HECHOS_001", "X1", "HECHOS", 1, "uno"), ("X1_HECHOS_002", "X1", "HECHOS", 2, "dós"), ("b1_ASUNTO_x", "b1", "ASUNTO", None, "")], "stem string, doc string, section string, ordinal int, text string"),
        "rows_c": make([(0, " NEIVA", "huila_b007", 50, 0.2, 0.3), (1, "nobody", "n_b001", 1, 0.5, 0.5), (2, "dabeiba", "d_x", None, None, 0.4), (3, "huila", "huila_b007", 51, 0.9, 0.9)], "order long, audio string, block string, n_chars long, y8_a double, y9_b double"),
        "stance": make([(0, LONG, "s_b000", 3, 0.5), (1, "b", "s_b001", 3, 0.5)], "order long, doc string, block string, n_chars long, y11_quotes double"),
        "lexical": make([(0, LONG, "H", 0.25), (1, LONG, "H", 0.5), (2, LONG, "H", 0.75), (3, LONG, "none", 0.1)], "order long, doc string, section string, sa_ratio double"),
        "facial": make([("aus_huila_v2.csv", 0, "S1", 0.0, 5.0, {"AU1": 0.5}), ("aus_huila_v2.csv", 1, "S9", 5.0, 6.0, None), ("other.csv", 0, "S1", 0.0, 1.0, None)], "file string, place long, speaker string, start double, end double, features map<string,double>"),
        "vocal": make([("egemap_dabeiba_compareciente.csv", 0, None, 0.0, 3.0, {"hnr": 4.0})], "file string, place long, speaker string, start double, end double, features map<string,double>"),
        "ratings": make([(1, None, "m", "REP", "REP", 2), (2, 5, "m", None, None, None)], "id long, inner long, rater string, label string, labels string, n_spans int"),
    }


def content(tables):
    return {n: sorted((tuple(r) for r in t.collect()), key=repr) for n, t in tables.items()}


@pytest.fixture(scope="module")
def loaded(spark):
    tables, errors = modules.loader(sources(spark)).run(modules.empty(spark))
    assert errors == {}
    return tables


def test_rows_of_all_modules(spark, loaded):
    docs = {r.external: r for r in loaded["documents"].collect()}
    assert set(docs) == {f"{LONG}A", "z", "b1", "audiencia_huila", "audiencia_dabeiba", "X1"} and sorted(r.id for r in docs.values()) == list(range(1, 7))
    corpora = {r.id: r.code for r in loaded["corpora"].collect()}
    # The first row tells the corpus, the first year in the first file the year; values of the inventory fill what is empty.
    assert {e: (corpora[r.corpus_id], r.year) for e, r in docs.items()} == {f"{LONG}A": ("A-CSJ", 2008), "z": ("A-CE", 2001), "b1": ("B-JEP", 2020), "audiencia_huila": ("C-JEP-oral", 2024), "audiencia_dabeiba": ("C-JEP-oral", 2022), "X1": ("B-JEP", None)}
    first = docs[f"{LONG}A"]
    assert (first.kind, first.number, first.date, first.origin, first.department, first.n_chars, first.title) == ("sentencia", "SP-1", "2008-01-01", "CSJ", "Meta", 99, f"{LONG}A")
    assert docs["b1"].number is None  # its name is too short for the inventory
    blocks = {r.external: r for r in loaded["blocks"].collect()}
    assert set(blocks) == {f"{LONG}A__H__1", f"{LONG}A__R__1", f"{LONG}A__H__2", "z__H__1", "b1__ASUNTO__1", "X1__HECHOS__padre", "b1__ASUNTO__padre", "X1_HECHOS_001", "X1_HECHOS_002", "b1_ASUNTO_x", "huila_b007", "d_x", "s_b000"}
    assert (blocks[f"{LONG}A__H__2"].position, blocks[f"{LONG}A__H__1"].grain, blocks["b1__ASUNTO__1"].grain) == (3, "bloque_granular", "seccion")
    assert blocks["X1_HECHOS_002"].parent_id == blocks["X1__HECHOS__padre"].id and blocks["X1_HECHOS_002"].n_chars == 3
    assert (blocks["huila_b007"].position, blocks["huila_b007"].n_chars, blocks["d_x"].position) == (7, 50, 0) and blocks["huila_b007"].document_id == docs["audiencia_huila"].id
    names = {r.id: r.external for r in loaded["blocks"].collect()}
    runs = {r.id: r.description for r in loaded["runs"].collect()}
    scores = {(runs[r.run_id], names[r.block_id], r.code): r.value for r in loaded["scores"].collect()}
    assert scores == {
        ("rows_a", f"{LONG}A__H__1", "y2_sa"): 0.1, ("rows_a", f"{LONG}A__R__1", "y2_sa"): 0.2, ("rows_a", f"{LONG}A__R__1", "y4_nv"): 0.5, ("rows_a", f"{LONG}A__H__2", "y4_nv"): 0.6, ("rows_a", "z__H__1", "y2_sa"): 0.9,
        ("rows_b", f"{LONG}A__H__1", "y2_sa"): 0.7, ("rows_b", f"{LONG}A__H__1", "y4_nv"): 0.7, ("rows_b", "b1__ASUNTO__1", "y2_sa"): 0.4, ("rows_c", "huila_b007", "y8_a"): 0.2, ("rows_c", "huila_b007", "y9_b"): 0.3, ("rows_c", "d_x", "y9_b"): 0.4,
        ("stance", "s_b000", "y11_quotes"): 0.5, ("lexical", f"{LONG}A__H__1", "sa_ratio"): 0.25, ("lexical", f"{LONG}A__H__2", "sa_ratio"): 0.5,
    }
    people = loaded["participants"].collect()
    assert [(r.speaker, r.name) for r in people] == [("S1", "again")]  # of equal keys the least row
    segments = {(r.source, r.place): r for r in loaded["segments"].collect()}
    assert {k: r.participant_id for k, r in segments.items()} == {("aus_huila_v2.csv", 0): people[0].id, ("aus_huila_v2.csv", 1): None, ("egemap_dabeiba_compareciente.csv", 0): None}
    assert segments["aus_huila_v2.csv", 0].features == {"AU1": 0.5} and loaded["ratings"].count() == 2
    assert star.orphans(loaded, modules.REFERENCES).agg(F.sum("orphans")).first()[0] == 0


def test_a_second_load_adds_nothing_and_keys_stay(spark, loaded):
    again, errors = modules.loader(sources(spark)).run(loaded)
    assert errors == {} and content(again) == content(loaded)
    more = {"rows_a": spark.createDataFrame([(0, "aaa", "A", 2000, "H", 1, 0.5, 0.5)], ROWS)}
    now, errors = modules.loader(more).run(loaded)
    assert errors == {} and {r.external: r.id for r in now["documents"].collect()} == {r.external: r.id for r in loaded["documents"].collect()} | {"aaa": 7}
    assert now["blocks"].agg(F.max("id")).first()[0] == loaded["blocks"].count() + 1


def test_a_failure_of_tasks_stays_with_its_module(spark):
    given = sources(spark)
    tables = {**modules.empty(spark)}
    own = {"rows_a": given["rows_a"], "ratings": given["ratings"], "hearings": given["hearings"], "facial": given["facial"].withColumn("file", F.when(F.col("place") >= 0, F.raise_error(F.lit("unreadable"))).cast("string"))}
    kept, errors = modules.loader(own).run(tables)
    assert set(errors) == {"segments_facial"} and kept["ratings"].count() == 2 and kept["segments"].count() == 0


def test_nothing_from_nothing(spark):
    tables, errors = modules.loader({"rows_a": spark.createDataFrame([], ROWS)}).run(modules.empty(spark))
    assert errors == {} and tables["blocks"].count() == 0 and tables["corpora"].count() == 4
    only, _ = modules.loader(sources(spark)).run(modules.empty(spark), {"hearings"})
    assert only["hearings"].count() == 2 and only["blocks"].count() == 0
