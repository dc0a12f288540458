"""Nested JSON of hearings, transcripts, windows over segments, channels side by side."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lexforum.operators import hearings
from lexforum.sources import readers

#: Published figures of four hearings: facial, vocal, y8, y11_prop; verbal v1 and v2, index v1 and v2, delta.
PUBLISHED = {
    "casanare": ((0.190, 0.415, 0.1929, 0.416), (0.667, 0.567, 0.375, 0.355, -0.020)),
    "catatumbo": ((0.272, 0.317, 0.2068, 0.736), (0.000, 0.295, 0.236, 0.295, 0.059)),
    "dabeiba": ((0.353, 0.452, 0.1894, 0.821), (0.857, 0.842, 0.493, 0.490, -0.003)),
    "huila": ((0.299, 0.334, 0.1862, 0.602), (1.000, 0.841, 0.453, 0.421, -0.032)),
}


def test_json_of_hearings(spark, tmp_path):
    d, t = tmp_path / "diarization", tmp_path / "transcript"
    d.mkdir(), t.mkdir()
    (d / "casanare.json").write_text(json.dumps([{"speaker": "S1", "start": 0.25, "end": 9.0, "duracion": 8.75}, {"speaker": "S2", "start": 9.0, "end": 12.5}], indent=1))
    (d / "v1.2.json").write_text("[]"), (d / "bad.json").write_text("{oh")
    (t / "casanare.json").write_text(json.dumps({"0.2": "él ordenó\n\"esto\"", "9.0": "sí", "77.0": "nadie"}, ensure_ascii=False, indent=1))
    (t / "bad.json").write_text("[1")
    segments = readers.diarizations(spark, str(d))
    rows = {(r.hearing, r.segment): r for r in segments.collect()}
    assert set(rows) == {("casanare", 0), ("casanare", 1), ("v1.2", None), ("bad", None)} and rows["casanare", 1].duration == 3.5
    out = hearings.with_transcript(segments, readers.transcripts(spark, str(t)))
    assert {(r.hearing, r.segment): r.text for r in out.collect()} == {("casanare", 0): "él ordenó\n\"esto\"", ("casanare", 1): "sí", ("v1.2", None): "", ("bad", None): ""}


def test_starts_have_the_exact_tenth(spark):
    rng = random.Random(5)
    xs = [0.05, 0.15, 0.25, 0.35, 0.45, 0.75, 1.05, 2.675, 0.95, 9.95, 99.95, 1000.05, 0.0, 3.0, -0.25, -1.15, 12345.65] + [round(rng.uniform(0, 40000), rng.choice([1, 2, 3, 6])) for _ in range(3000)] + [k / 20 for k in range(1, 2001, 2)]
    got = spark.createDataFrame([(i, x) for i, x in enumerate([*xs, None])], "i int, x double").select("i", hearings.tenths(F.col("x")).alias("k")).collect()
    told = {r.i: r.k for r in got}
    assert told.pop(len(xs)) is None and all(told[i] == f"{x:.1f}" for i, x in enumerate(xs))


def test_overlaps_are_those_of_all_pairs(spark):
    rng = random.Random(3)
    make = lambda n, most: [(rng.choice(["a", "a", "b", None]), i, s := rng.choice([0.0, 30.0, 60.0, round(rng.uniform(-40, 200), 2), None]), None if s is None else s + rng.choice([0.0, 30.0, -1.0, round(rng.uniform(0, most), 2)])) for i in range(n)]
    left, right = make(120, 90), make(150, 300)
    l = spark.createDataFrame(left, "h string, i int, start double, end double")
    r = spark.createDataFrame(right, "h string, j int, start double, end double")
    live = lambda x: x[0] is not None and x[2] is not None and x[2] < x[3]
    want = {(a[1], b[1]): min(a[3], b[3]) - max(a[2], b[2]) for a in left for b in right if live(a) and live(b) and a[0] == b[0] and a[2] < b[3] and b[2] < a[3]}
    got = [(x.i, x.j, x.overlap) for x in hearings.overlapping(l, r, ["h"]).collect()]
    assert len(got) == len(want) > 500 and all(want[i, j] == pytest.approx(o) for i, j, o in got)
    assert hearings.overlapping(l.limit(0), r, ["h"]).count() == 0


def test_windows_weigh_by_common_time(spark):
    segments = spark.createDataFrame([("h", 0, 0.0, 10.0, 9), ("h", 1, 50.0, 51.0, 9), ("g", 0, 0.0, 1.0, 9)], "hearing string, segment int, start double, end double, loud int")
    windows = spark.createDataFrame([("h", -5.0, 2.0, 1.0, 4), ("h", 2.0, 8.0, 3.0, 4), ("h", 8.0, 40.0, None, 4), ("g", 5.0, 6.0, 1.0, 4)], "hearing string, start double, end double, loud double, speaker int")
    out = {(r.hearing, r.segment): r.loud for r in hearings.with_windows(segments, windows, ["loud"]).collect()}
    assert out == {("h", 0): pytest.approx(2.5), ("h", 1): None, ("g", 0): None}


def test_channels_side_by_side(spark):
    rows = [(h, x[0], 1 - x[0], *x[1:]) for h, (x, _) in PUBLISHED.items()]
    e = spark.createDataFrame(rows, "hearing string, distress double, smile double, vocal double, y8 double, y11_prop double")
    got = {r.hearing: r for r in hearings.channels(e, e, e).collect()}
    for h, (given, told) in PUBLISHED.items():
        r = got[h]
        assert (r.verbal_v1, r.verbal_v2, r.icm_v1, r.icm_v2, r.delta) == pytest.approx(told, abs=0.0011)
        assert (r.facial, r.convergence) == pytest.approx((given[0], abs(given[0] - given[1])), abs=0.0011)
    part = hearings.channels(e.where("hearing = 'huila'"), e.where("hearing <> 'huila'"), e.limit(0))
    assert {r.hearing: (r.facial, r.vocal, r.verbal_v1, r.icm_v1, r.convergence) for r in part.where("hearing in ('huila', 'casanare')").collect()} == {"huila": (0.299, None, None, None, None), "casanare": (None, 0.415, None, None, None)}
    assert hearings.channels(e.limit(1), e.limit(1), e.limit(1)).first().verbal_v1 == 0.0


def test_main_speaker_and_scores(spark):
    rows = [("h", "A", 0.0, 6.0, "perdón"), ("h", "B", 6.0, 9.0, "no"), ("h", "B", 9.0, 14.0, ""), ("g", "A", 0.0, 5.0, "verdad"), ("g", "B", 5.0, 10.0, "x")]
    s = spark.createDataFrame(rows, "hearing string, speaker string, start double, end double, text string")
    assert sorted((r.hearing, r.speaker) for r in hearings.main_speaker(s).collect()) == [("g", "B"), ("h", "B"), ("h", "B")]
    known = spark.createDataFrame([("h", "A")], "hearing string, speaker string")
    assert sorted((r.hearing, r.speaker) for r in hearings.main_speaker(s, known).collect()) == [("g", "B"), ("h", "A")]
    out = hearings.segment_scores(s, F.lit(0.5), F.lit(0.5)).collect()
    assert len(out) == 4 and all(r["class"] in ("GENUINE", "AMBIGUOUS", "PERFORMATIVE") for r in out)


def test_named_blocks_are_whole_files(spark, tmp_path):
    (tmp_path / "SP1_HECHOS_PROBADOS_017.txt").write_text("uno\ndos\n")
    r = readers.named_blocks(spark, str(tmp_path)).collect()
    assert [(x.doc, x.section, x.ordinal, x.text) for x in r] == [("SP1", "HECHOS_PROBADOS", 17, "uno\ndos\n")]
