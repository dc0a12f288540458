"""Queries over texts: sources, cleaning, metadata, segmentation, spans, lexicons, distances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexforum.functions import stats, text as T
from lexforum.operators import indicators, indices, ingest, relational as R, spans
from lexforum.sources.readers import decoded, rttm, table

QUERIES, ORACLES = {}, {}

#: Lexicons and patterns that occur in the synthetic tables; every operator takes its own as a parameter.
TERMS = {"tion": 1.0, "ment": 0.5, "ung": 0.75}
RULES = [spans.Rule("ack", r"\b(the|les|der)\b", 1.0), spans.Rule("dih", r"\b(of|la|die) \w+", 0.8), spans.Rule("rep", r"(and|et|und) (the|le|der)", 0.75)]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("SELECT doc_id, text FROM documents")
def s1_decode_fallback(spark: SparkSession, d: str) -> DataFrame:
    # UTF-8 bytes of the texts, those of Spanish ones as Latin-1 where that loses nothing.
    docs = table(spark, d, "documents")
    latin = F.encode("text", "ISO-8859-1")
    safe = (F.col("lang") == "es") & (F.decode(latin, "ISO-8859-1") == F.col("text")) & ~F.is_valid_utf8(latin.cast("string"))
    return docs.withColumn("content", F.when(safe, latin).otherwise(F.encode("text", "UTF-8"))).select("doc_id", decoded(F.col("content")).alias("text"))


_VISIBLE = r"""regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '(?s)<[^>]+>', chr(10), 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t]*\n\s*', chr(10), 'g'), '^\s+|\s+$', '', 'g')"""


@query(f"SELECT page_id, {_VISIBLE} AS visible FROM pages")
def s7_html_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.visible_text(F.col("html")).alias("visible"))


@query("SELECT event_type AS speaker, value AS start, 1.5 AS duration, value + 1.5 AS end FROM events")
def s13_rttm(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    lines = ev.select(F.concat_ws(" ", F.lit("SPEAKER"), F.col("user_id").cast("string"), F.lit("1"), F.col("value").cast("string"), F.lit("1.5"), F.lit("<NA>"), F.lit("<NA>"), "event_type").alias("value"))
    return rttm(lines.unionByName(spark.createDataFrame([("too short",)], "value string")))


_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\r\n?', chr(10), 'g'), '[ \t]+(\n|$)', '\1', 'g'), '[ \t]{{2,}}', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"
_NOISY = "chr(160) || replace(text, '. ', '  .' || chr(8203) || chr(13) || chr(10) || chr(10) || chr(10)) || chr(8217) || '  '"


@query(f"""WITH n AS (SELECT doc_id, {_NOISY} AS raw FROM documents), t AS (SELECT doc_id, raw, regexp_replace(replace(replace(raw, chr(160), ' '), chr(8203), ' '), '[^\\pL\\pN\\pP\\pS\\pZ\\n\\t\\r]', '', 'g') AS kept FROM n),
c AS (SELECT doc_id, raw, {_CLEAN.format("replace(replace(replace(replace(replace(replace(replace(replace(kept, chr(8216), ''''), chr(8217), ''''), chr(8220), chr(34)), chr(8221), chr(34)), chr(8211), '-'), chr(8212), '-'), chr(8230), '...'), chr(65279), ' ')")} AS clean_text FROM t)
SELECT doc_id, clean_text, CAST(length(raw) AS INTEGER) AS original_length, CAST(length(clean_text) AS INTEGER) AS final_length, sha256(clean_text) AS sha FROM c""")
def i8_clean(spark: SparkSession, d: str) -> DataFrame:
    noise = F.concat(F.lit(" "), F.replace("text", F.lit(". "), F.lit("  .​\r\n\n\n")), F.lit("’  "))
    out = ingest.clean(table(spark, d, "documents").withColumn("text", noise))
    return out.select("doc_id", "clean_text", F.col("cleaning_report.original_length").alias("original_length"), F.col("cleaning_report.final_length").alias("final_length"), F.sha2("clean_text", 256).alias("sha"))


@query("SELECT doc_id, nfc_normalize(text || 'e' || chr(769)) AS composed FROM documents")
def i2_nfc(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.nfc(F.concat("text", F.lit("é"))).alias("composed"))


@query("SELECT doc_id, regexp_replace(regexp_replace(text, '(?i)erer', 'er', 'g'), '(?i)on(t|s)h', 'ond\\1', 'g') AS fixed, CAST(len(regexp_extract_all(text, '(?i)erer')) + len(regexp_extract_all(regexp_replace(text, '(?i)erer', 'er', 'g'), '(?i)on(t|s)h')) AS INTEGER) AS corrections FROM documents")
def i6_substitutions(spark: SparkSession, d: str) -> DataFrame:
    fixed, count = T.substitutions(F.col("text"), [("erer", "er"), ("on(t|s)h", "ond$1")])
    return table(spark, d, "documents").select("doc_id", fixed.alias("fixed"), count.cast("int").alias("corrections"))


@query("""WITH c AS (SELECT doc_id, regexp_extract_all(lower(text), '(the|and|der|les|la|und)') AS m FROM documents), e AS (SELECT doc_id, m[i] AS x, i FROM c, range(1, len(m) + 1) t(i)),
r AS (SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(i)) AS k FROM e GROUP BY doc_id, x)
SELECT d.doc_id, x AS place FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id AND k = 1""")
def m5_region(spark: SparkSession, d: str) -> DataFrame:
    found = F.regexp_extract_all(F.lower("text"), F.lit("(the|and|der|les|la|und)"), F.lit(1))
    return table(spark, d, "documents").select("doc_id", ingest.most_frequent(found).alias("place"))


@query()
def g2_merge_short(spark: SparkSession, d: str) -> DataFrame:
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(F.concat(F.lit("S"), i.cast("string")).alias("label"), x.alias("body")))
    return table(spark, d, "documents").select("doc_id", F.posexplode(ingest.merge_short(lines)).alias("n", "s")).select("doc_id", "n", "s.label", "s.body")


@query("""WITH l AS (SELECT doc_id, i AS line_no, s[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents), range(1, len(s) + 1) t(i)),
h AS (SELECT *, CASE WHEN regexp_matches(upper(trim(line)), '^(IN|LES) ') THEN 'OPEN' WHEN regexp_matches(upper(trim(line)), '^(THE|DER|LA) ') THEN 'BODY' END AS label FROM l),
r AS (SELECT *, coalesce(last_value(label IGNORE NULLS) OVER w, 'CUERPO') AS section, CAST(count(label) OVER w AS INTEGER) AS fragment FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING))
SELECT doc_id, section, fragment, string_agg(line, chr(10) ORDER BY line_no) AS body FROM r WHERE label IS NULL GROUP BY doc_id, section, fragment HAVING length(trim(string_agg(line, chr(10) ORDER BY line_no), ' ')) > 0""")
def g5_line_segments(spark: SparkSession, d: str) -> DataFrame:
    return ingest.segment_lines(table(spark, d, "documents"), [("^(IN|LES) ", "OPEN"), ("^(THE|DER|LA) ", "BODY")])


@query()
def g1_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """Heading positions with near ones dropped (200) and chains replaced (50)."""
    starts = F.transform(spans.positions(F.col("text"), r"(?iu)\bthe\b"), lambda s: s["start"])
    kept = R.keep_apart(starts, 200)
    return table(spark, d, "documents").select("doc_id", F.size(starts).alias("found"), kept.alias("kept"), R.replace_near(starts, 50).alias("chained"))


@query("""WITH p AS (SELECT doc_id, unnest(range(0, len(string_split(text, 'the')))) AS i, unnest(string_split(text, 'the')) AS part FROM documents),
q AS (SELECT doc_id, i, sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i) + 3 * i AS start, count(*) OVER (PARTITION BY doc_id) AS n FROM p)
SELECT doc_id, CAST(i AS INTEGER) AS i, CAST(start AS INTEGER) AS start FROM q WHERE i < n - 1""")
def t_span_positions(spark: SparkSession, d: str) -> DataFrame:
    """All matches of every whole text."""
    found = table(spark, d, "documents").select("doc_id", F.posexplode(spans.positions(F.col("text"), "the")).alias("i", "s"))
    return found.select("doc_id", "i", F.col("s.start").alias("start"))


@query()
def t24_span_score(spark: SparkSession, d: str) -> DataFrame:
    """Spans of three mechanisms, lowered near a trigger, overlaps removed, scored by sentences; each text is read once for all rules."""
    found = indicators.pattern_spans([indicators.Mechanism(r.mechanism, r.weight, [r.pattern]) for r in RULES], [r"\bwas\b"], apart=True)
    docs = table(spark, d, "documents").select("doc_id", "text", found(F.col("text")).alias("spans"))
    return spans.score(docs, 0.0, 0.4).select("doc_id", "n_spans", "raw", "score", "has_warning")


@query("SELECT doc_id, CAST((length(text) - length(replace(text, 'tion', ''))) / 4 AS INTEGER) AS first, CAST((length(text) - length(replace(text, 'ment', ''))) / 4 AS INTEGER) AS second, (length(text) - length(replace(text, 'tion', ''))) / 4 / ((length(text) - length(replace(text, 'tion', ''))) / 4 + (length(text) - length(replace(text, 'ment', ''))) / 4 + 0.001) AS accountability FROM documents")
def t30_person(spark: SparkSession, d: str) -> DataFrame:
    a, b = T.occurrences(F.col("text"), "tion"), T.occurrences(F.col("text"), "ment")
    return table(spark, d, "documents").select("doc_id", a.alias("first"), b.alias("second"), (a / (a + b + 0.001)).alias("accountability"))


@query("SELECT doc_id, w AS weight, w * 100 / greatest(n, 1) AS density, least(w / greatest(n, 1) * 10, 1.0) AS verbal FROM (SELECT doc_id, (length(text) - length(replace(text, 'tion', ''))) / 4 * 1.0 + (length(text) - length(replace(text, 'ment', ''))) / 4 * 0.5 + (length(text) - length(replace(text, 'ung', ''))) / 3 * 0.75 AS w, len(regexp_extract_all(text, '\\S+')) AS n FROM documents)")
def t31_hedging(spark: SparkSession, d: str) -> DataFrame:
    w, n = T.weighted_terms(F.col("text"), TERMS), F.greatest(T.word_count(F.col("text")), F.lit(1))
    return table(spark, d, "documents").select("doc_id", w.alias("weight"), (w * 100 / n).alias("density"), F.least(w / n * 10, F.lit(1.0)).alias("verbal"))


_TOKENS = "list_filter(string_split(regexp_replace(lower({0}), '[^\\pL\\pN_]+', ' ', 'g'), ' '), lambda w: length(w) > 2)"


@query(f"WITH t AS (SELECT doc_id, list_distinct({_TOKENS.format('text')}) AS a, list_distinct({_TOKENS.format(chr(39) + 'the and for with that les des une der die und los que' + chr(39))}) AS b FROM documents) SELECT doc_id, CASE WHEN len(list_distinct(list_concat(a, b))) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) ELSE 0.0 END AS j, CAST(len(a) AS INTEGER) AS n_distinct FROM t")
def t10_jaccard(spark: SparkSession, d: str) -> DataFrame:
    lexicon = F.array(*map(F.lit, "the and for with that les des une der die und los que".split()))
    own = F.array_distinct(T.tokens(F.col("text"), 2))
    return table(spark, d, "documents").select("doc_id", T.jaccard(own, lexicon).alias("j"), F.size(own).alias("n_distinct"))


@query("WITH c AS (SELECT list(m ORDER BY i) AS pole FROM (SELECT i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, len(embedding) + 1) t(i) WHERE label = 0 GROUP BY i)) SELECT vec_id, round(1 - list_cosine_similarity(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), pole), 8) AS distance FROM embeddings, c")
def t34_pole_distance(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    pole = indices.centroids(vectors.where("label = 0"), None, "embedding")  # one row
    return vectors.withColumn("pole", pole.scalar()).select("vec_id", F.round(1 - T.cosine(F.col("embedding"), F.col("pole")), 8).alias("distance"))


@query("WITH p AS (SELECT quantile_cont(n_chars, 0.05) AS lo, quantile_cont(n_chars, 0.95) AS hi FROM documents) SELECT doc_id, CASE WHEN abs(hi - lo) < 1e-9 THEN 0.5 ELSE least(greatest((n_chars - lo) / (hi - lo), 0.0), 1.0) END AS score FROM documents, p")
def t2_normalise(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("x"))
    fit = stats.quantiles(docs, "x", (0.05, 0.95)).select("q")  # one row
    return docs.withColumn("q", fit.scalar()).select("doc_id", stats.scaled(F.col("x"), F.col("q")[0], F.col("q")[1]).alias("score"))


@query("""WITH w AS (SELECT doc_id, string_split(text, ' ') AS t FROM documents), s AS (SELECT doc_id, t, unnest(range(0, (len(t) - 1) // 300 + 1)) AS g FROM w),
x AS (SELECT doc_id, g, t[g * 300 + 1:g * 300 + 400] AS own FROM s), y AS (SELECT doc_id, g * 300 + unnest(range(0, len(own))) AS i, unnest(own) AS token FROM x)
SELECT doc_id, count(*) AS covered, count(DISTINCT i) AS tokens, avg(CASE WHEN token = 'the' THEN 1.0 ELSE 0.0 END) AS mean FROM y GROUP BY doc_id""")
def w7_token_windows(spark: SparkSession, d: str) -> DataFrame:
    """The reference's window and step, over every whole text."""
    return _window_means(table(spark, d, "documents"), 400, 300, None)


def _window_means(docs: DataFrame, size: int, step: int, most: int | None) -> DataFrame:
    docs = docs.select("doc_id", F.split("text", " ").alias("tokens"))
    wins = spans.token_windows(docs, F.when(F.col("token") == "the", 1.0).otherwise(0.0), size, step, most)
    return spans.window_summary(wins)


@query()
def w6_word_blocks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(ingest.pack_words(F.col("text"), 2000)).alias("block", "body"))


@query("SELECT doc_id, strpos(text, 'thing') AS at, CASE WHEN strpos(text, 'thing') > 0 THEN substring(text, greatest(strpos(text, 'thing') - 30, 1), 135) END AS context FROM documents")
def h3_keyword_in_context(spark: SparkSession, d: str) -> DataFrame:
    at = F.instr("text", "thing")
    return table(spark, d, "documents").select("doc_id", at.cast("long").alias("at"), F.when(at > 0, F.substring(F.col("text"), F.greatest(at - 30, F.lit(1)), F.lit(135))).alias("context"))


@query("SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, trim(s[i]) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents), range(1, 100000) t(i) WHERE i <= len(s) AND length(trim(s[i])) > 3 AND length(trim(s[i])) < 80 AND trim(s[i]) = upper(trim(s[i]))".replace("range(1, 100000) t(i) WHERE i <= len(s) AND", "range(1, len(s) + 1) t(i) WHERE"))
def h4_heading_candidates(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).withColumn("line", F.trim("line"))
    return lines.where((F.length("line") > 3) & (F.length("line") < 80) & (F.col("line") == F.upper("line")))


@query("SELECT doc_id, CAST(i AS INTEGER) AS n, fragment FROM (SELECT doc_id, CASE WHEN length(f) > 2400 THEN [substring(f, 1, 800), substring(f, greatest(CAST(floor(length(f) / 2) AS INTEGER) - 400, 0) + 1, 800), substring(f, greatest(length(f) - 800, 0) + 1, 800)] ELSE [substring(f, 1, 800)] END AS fs FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '\\n+', ' ', 'g'), ' +', ' ', 'g') AS f FROM documents)), LATERAL (SELECT unnest(range(1, len(fs) + 1)) - 1 AS i, unnest(fs) AS fragment)")
def r1_fragments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(R.fragments(F.col("text"))).alias("n", "fragment"))


@query("SELECT conv_id, count(*) AS turns, string_agg(text, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id")
def s14_transcripts(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return turns.select("conv_id", "turns", F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("transcript"))


@query("""WITH s AS (SELECT doc_id, [0, 100, 300, 900] AS starts, [90, 300, 800, length(text)] AS ends, strpos(text, 'tion') - 1 AS pt FROM documents) SELECT doc_id, coalesce((SELECT min(i) - 1 FROM range(1, 5) t(i) WHERE starts[i] <= pt AND pt < ends[i]), -1) AS sentence FROM s""")
def j11_point_in_interval(spark: SparkSession, d: str) -> DataFrame:
    intervals = F.array(*(F.struct(F.lit(a).alias("start"), b.alias("end")) for a, b in ((0, F.lit(90)), (100, F.lit(300)), (300, F.lit(800)), (900, F.length("text")))))
    return table(spark, d, "documents").select("doc_id", R.interval_of(F.instr("text", "tion") - 1, intervals).cast("long").alias("sentence"))


@query("SELECT doc_id, CASE lang WHEN 'es' THEN 2 WHEN 'fr' THEN 3 ELSE CASE WHEN source LIKE 'src1%' THEN 1 ELSE 0 END END AS y5, coalesce(least(greatest((1994 + CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) - 1994) / 29.0, 0.0), 1.0), 0.5) AS y6 FROM documents")
def t25_context(spark: SparkSession, d: str) -> DataFrame:
    year = 1994 + F.regexp_extract("source", r"(\d+)$", 1).try_cast("int")
    y5 = F.when(F.col("lang") == "es", 2).when(F.col("lang") == "fr", 3).when(F.col("source").startswith("src1"), 1).otherwise(0)
    return table(spark, d, "documents").select("doc_id", y5.alias("y5"), F.coalesce(stats.clamp((year - 1994) / 29.0), F.lit(0.5)).alias("y6"))


@query("SELECT source, count(*) AS n, avg(length(text)) AS mean_chars, count(*) FILTER (length(text) < 30) AS low FROM documents GROUP BY source")
def t29_batch_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg(F.length("text")).alias("mean_chars"), F.count_if(F.length("text") < 30).alias("low"))


@query("SELECT doc_id, CASE WHEN toxic = 1 THEN 'B' ELSE 'A' END AS kind, (SELECT count(*) FROM labels) AS total FROM labels")
def labels_with_total(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels")
    total = labels.agg(F.count(F.lit(1)).alias("total"))  # one row
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "B").otherwise("A").alias("kind"), total.scalar().alias("total"))


@query("SELECT doc_id, lang, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END, ''), 'filled') AS source FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'new', 'filled' FROM documents WHERE doc_id % 2 = 1")
def k4_upsert(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", F.when(F.expr("doc_id % 3 = 0"), "").otherwise(F.col("source")).alias("source"))
    new = docs.select("doc_id", F.lit("new").alias("lang"), F.lit("filled").alias("source"))
    return ingest.upsert(docs.where("doc_id % 2 = 0"), new, ["doc_id"], ["source"])


@query("SELECT doc_id, CAST('0x' || substring(md5('42:' || doc_id), 1, 8) AS BIGINT) % 100 < 80 AS train FROM documents")
def r3_split(spark: SparkSession, d: str) -> DataFrame:
    """80/20 split by a seeded hash: the same for a row wherever it is read."""
    return table(spark, d, "documents").select("doc_id", R.in_training("doc_id").alias("train"))


@query("""WITH p AS (SELECT doc_id, source, coalesce(contains(text, 'the'), false) AS is_priority FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY source, is_priority ORDER BY md5('42:' || doc_id), doc_id) AS k FROM p)
SELECT doc_id, source, is_priority FROM r WHERE k <= CASE WHEN is_priority THEN 35 ELSE 15 END""")
def r1_priority_sample(spark: SparkSession, d: str) -> DataFrame:
    """Stratified sample for annotation: 35 priority texts and 15 others of each source."""
    docs = table(spark, d, "documents")
    return R.priority_sample(docs, "source", F.col("text").contains("the")).select("doc_id", "source", "is_priority")


@query("SELECT a.conv_id, a.turn, a.turn - b.turn AS gap FROM conversations a JOIN (SELECT conv_id, min(turn) AS turn FROM conversations WHERE role = 'assistant' GROUP BY 1) b USING (conv_id) WHERE a.turn > b.turn")
def turns_since_first(spark: SparkSession, d: str) -> DataFrame:
    first = F.min(F.when(F.col("role") == "assistant", F.col("turn"))).over(W.partitionBy("conv_id"))
    return table(spark, d, "conversations").select("conv_id", "turn", (F.col("turn") - first).alias("gap")).where("gap > 0")
