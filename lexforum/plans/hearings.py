"""Queries of hearings and of the star schema: transcripts, windows of channels over segments, channels side by side, load modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforum.operators import hearings, modules, star
from lexforum.sources.readers import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_SEGMENTS = """s AS (SELECT conv_id AS hearing, turn AS segment, max(role) AS speaker, CAST(turn AS DOUBLE) * 7.25::DOUBLE AS "start", CAST(turn AS DOUBLE) * 7.25::DOUBLE + 4 + max(length(text)) % 10 AS "end", max(text) AS told FROM conversations WHERE turn IS NOT NULL AND conv_id IS NOT NULL AND text IS NOT NULL GROUP BY conv_id, turn)"""
_WINDOWS = """w AS (SELECT user_id AS hearing, CAST(event_id % 97 AS DOUBLE) * 1.5::DOUBLE AS a, CAST(event_id % 97 AS DOUBLE) * 1.5::DOUBLE + 3 AS b, value FROM events)"""


def _segments(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").where("turn is not null and conv_id is not null and text is not null")
    start = F.col("segment") * 7.25
    own = turns.groupBy(F.col("conv_id").alias("hearing"), F.col("turn").alias("segment")).agg(F.max("role").alias("speaker"), F.max("text").alias("told"), F.max(F.length("text")).alias("_n"))
    return own.select("hearing", "segment", "speaker", start.alias("start"), (start + 4 + F.col("_n") % 10).alias("end"), "told")


def _windows(spark: SparkSession, d: str) -> DataFrame:
    start = F.col("event_id") % 97 * 1.5
    return table(spark, d, "events").select(F.col("user_id").alias("hearing"), start.alias("start"), (start + 3).alias("end"), "value")


@query(f"WITH {_SEGMENTS} SELECT s.hearing, s.segment, coalesce(length(t.told), 0) AS chars FROM s LEFT JOIN (SELECT hearing, printf('%.1f', \"start\") AS key, max(told) AS told FROM s WHERE speaker <> 'system' GROUP BY 1, 2) t ON s.hearing = t.hearing AND printf('%.1f', s.\"start\") = t.key")
def s14_transcript_join(spark: SparkSession, d: str) -> DataFrame:
    """Turns as segments, each with the entry of its start; the transcript lacks what the system says."""
    own = _segments(spark, d)
    entries = own.where("speaker <> 'system'").select("hearing", hearings.tenths(F.col("start")).alias("key"), F.col("told").alias("text"))
    return hearings.with_transcript(own.drop("told"), entries).select("hearing", "segment", F.length("text").cast("long").alias("chars"))


@query(f"""WITH {_SEGMENTS}, {_WINDOWS}, p AS (SELECT s.hearing, s.segment, least(s."end", w.b) - greatest(s."start", w.a) AS o, w.value FROM s JOIN w ON s.hearing = w.hearing AND s."start" < w.b AND w.a < s."end"),
m AS (SELECT hearing, segment, sum(value * o) / sum(CASE WHEN value IS NOT NULL THEN o END) AS value FROM p GROUP BY ALL)
SELECT s.hearing, s.segment, m.value FROM s LEFT JOIN m ON s.hearing = m.hearing AND s.segment = m.segment""")
def s14_channel_windows(spark: SparkSession, d: str) -> DataFrame:
    """Turns as segments, events as windows of 3 seconds: the mean by common time."""
    return hearings.with_windows(_segments(spark, d), _windows(spark, d), ["value"]).select("hearing", "segment", "value")


@query(f"""WITH {_SEGMENTS}, talk AS (SELECT hearing, speaker, sum("end" - "start") AS t FROM s GROUP BY ALL), most AS (SELECT hearing, arg_max(speaker, (t, speaker)) AS speaker FROM talk GROUP BY hearing)
SELECT hearing, speaker, count(*) AS n, round(sum("end" - "start"), 4) AS seconds FROM s JOIN most USING (hearing, speaker) WHERE "end" - "start" >= 5 GROUP BY ALL""")
def s14_main_speaker(spark: SparkSession, d: str) -> DataFrame:
    """Segments of 5 seconds or more of each hearing's main speaker."""
    own = hearings.main_speaker(_segments(spark, d))
    return own.where(F.col("end") - F.col("start") >= 5).groupBy("hearing", "speaker").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("end") - F.col("start")), 4).alias("seconds"))


@query("""WITH e AS (SELECT user_id AS hearing, avg(value) FILTER (event_type = 'error') AS distress, avg(value) FILTER (event_type = 'purchase') AS smile, (avg(value) - min(value)) / (max(value) - min(value) + 1e-9) AS vocal, avg(value) FILTER (event_type = 'view') / 1000 AS y8, avg(CASE WHEN event_type = 'signup' THEN 1.0 ELSE 0.0 END) AS y11 FROM events GROUP BY user_id),
x AS (SELECT round(min(y8), 3) AS a, round(max(y8), 3) AS b FROM e), v AS (SELECT hearing, distress / (distress + smile) AS f, vocal AS o, CASE WHEN b > a THEN round((b - round(y8, 3)) / (b - a), 3) WHEN b IS NOT NULL THEN 0.0 END AS v1, y11 FROM e, x),
w AS (SELECT *, 0.6 * v1 + 0.4 * y11 AS v2 FROM v), i AS (SELECT *, 0.4 * f + 0.4 * o + 0.2 * v1 AS i1, 0.4 * f + 0.4 * o + 0.2 * v2 AS i2 FROM w)
SELECT hearing, round(f, 3) AS facial, round(o, 3) AS vocal, round(v1, 3) AS verbal_v1, round(v2, 3) AS verbal_v2, round(i1, 3) AS icm_v1, round(i2, 3) AS icm_v2, round(abs(f - o), 3) AS convergence, round(i2 - i1, 3) AS delta FROM i""")
def j15_channels(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of events as rates of channels, users as hearings."""
    v, kind = F.col("value"), F.col("event_type")
    of = lambda k: F.avg(F.when(kind == k, v))
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("hearing")).agg(
        of("error").alias("distress"), of("purchase").alias("smile"), ((F.avg(v) - F.min(v)) / (F.max(v) - F.min(v) + 1e-9)).alias("vocal"),
        (of("view") / 1000).alias("y8"), F.avg((kind == "signup").cast("double")).alias("y11_prop"),
    )
    return hearings.channels(e, e, e)


@query("""WITH r AS (SELECT doc_id, 'document_' || lpad(CAST(doc_id // 4 AS VARCHAR), 12, '0') AS doc, coalesce(lang, 'none') AS section, length(text) AS n FROM documents WHERE text IS NOT NULL),
b AS (SELECT *, row_number() OVER (PARTITION BY doc, section ORDER BY doc_id) AS k, row_number() OVER (PARTITION BY doc ORDER BY doc_id) AS p FROM r)
SELECT doc || '__' || section || '__' || k AS external, CAST(p AS INTEGER) AS position, n AS n_chars, 'A-CSJ' AS corpus, round((n % 100) / 100.0, 2) AS y2_sa, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE round((n % 7) / 8.0, 3) END AS y4_nv, 0 AS orphans, 0 AS again FROM b""")
def d5_load_modules(spark: SparkSession, d: str) -> DataFrame:
    """Texts as blocks of documents, loaded twice: blocks with their document's corpus and scores, rows without a parent, rows that the second load added."""
    n = F.length("text").cast("long")
    rows = table(spark, d, "documents").where("text is not null").select(
        F.col("doc_id").alias("order"), F.concat(F.lit("document_"), F.lpad(F.floor(F.col("doc_id") / 4).cast("string"), 12, "0")).alias("doc"), F.lit("csj").alias("corpus"), F.lit(None).cast("int").alias("year"),
        F.coalesce("lang", F.lit("none")).alias("section"), n.alias("n_chars"), F.round(n % 100 / 100.0, 2).alias("y2_sa"), F.when(F.col("doc_id") % 3 != 0, F.round(n % 7 / 8.0, 3)).alias("y4_nv"),
    )
    load = modules.loader({"rows_a": rows})
    once, errors = load.run(modules.empty(spark))
    twice, more = load.run(once)
    if errors or more:
        raise RuntimeError(str(errors | more))
    size = lambda t: t.agg(F.count(F.lit(1)).alias("n"))
    again = sum((size(twice[t]).scalar() - size(once[t]).scalar() for t in ("documents", "blocks", "scores")), F.lit(0))
    lost = star.orphans(twice, modules.REFERENCES).agg(F.sum("orphans").alias("n")).scalar()
    wide = twice["scores"].groupBy(F.col("block_id").alias("id")).agg(*(F.max(F.when(F.col("code") == c, F.col("value"))).alias(c) for c in ("y2_sa", "y4_nv")))
    docs = twice["documents"].select(F.col("id").alias("document_id"), "corpus_id").join(twice["corpora"].select(F.col("id").alias("corpus_id"), F.col("code").alias("corpus")), "corpus_id")
    return twice["blocks"].join(docs, "document_id").join(wide, "id", "left").select("external", "position", "n_chars", "corpus", "y2_sa", "y4_nv", lost.alias("orphans"), again.alias("again"))
