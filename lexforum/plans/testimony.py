"""Queries of testimony, keys and blocks, audit remainder, structural models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforum.functions import lexicons as L
from lexforum.functions import stats
from lexforum.operators import records, resampling, star, structural
from lexforum.operators import testimony as E
from lexforum.sources import sinks
from lexforum.sources.readers import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Sentences that are added to texts, by doc_id.
SENTENCES = [
    "Yo ordené y reconozco; fue presentado como baja en combate. Tal vez habría sido el operativo.",
    "Mi hijo, víctima inocente; dolor y duelo de la madre. Verdad, justicia y reparación.",
    "Posiblemente se estima que en principio, al parecer, quizás podrían; no se descarta. Supuestamente en teoría pareciera, aparentemente, hubiera, habrían.",
    "Nosotros asumimos la responsabilidad por el asesinato del campesino. Perdón.",
    "Operación y misión táctica: neutralizado, abatido. Indignación, rabia y miedo.",
    "Nada.",
]
_ADDED = "text || ' ' || [{0}][doc_id % {1} + 1]".format(", ".join("'" + s + "'" for s in SENTENCES), len(SENTENCES))
_T = f"SELECT doc_id, lower({_ADDED}) AS low, greatest(len(regexp_extract_all({_ADDED}, '\\S+')), 1) AS n FROM documents"


def _count(terms) -> str:
    return " + ".join(f"(length(low) - length(replace(low, '{t}', ''))) // {len(t)}" for t in terms)


def _texts(spark: SparkSession, d: str) -> DataFrame:
    added = F.element_at(F.array(*map(F.lit, SENTENCES)), (F.col("doc_id") % len(SENTENCES) + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", F.concat("text", F.lit(" "), added).alias("text"))


@query(f"WITH t AS ({_T}), c AS (SELECT doc_id, ({_count(L.FIRST_PERSON)}) / n AS p, ({_count(L.IMPERSONAL)}) / n AS s FROM t) SELECT doc_id, round(p, 4) AS primera_persona_ratio, round(s, 4) AS sa_ratio, round(p / (p + s + 0.001), 4) AS accountability_score FROM c")
def t30_grammatical_person(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("doc_id", E.grammatical_person(F.col("text")).alias("p")).select("doc_id", "p.*")


_MARKERS = ", ".join(f"{{'k': '{k}', 'n': {_count([k])}, 'w': {w}}}" for k, w in L.HEDGES.items())


@query(f"""WITH t AS ({_T}), m AS (SELECT doc_id, n, list_filter([{_MARKERS}], lambda x: x.n > 0) AS f FROM t)
SELECT doc_id, CAST(coalesce(list_sum(list_transform(f, lambda x: x.n)), 0) AS INTEGER) AS hedging_count, round(coalesce(list_sum(list_transform(f, lambda x: x.n)), 0) / n * 100, 4) AS hedging_density, round(coalesce(list_sum(list_transform(f, lambda x: CAST(x.n * x.w AS DOUBLE))), 0.0), 4) AS hedging_weight, coalesce(array_to_string(list_transform(f[1:10], lambda x: x.k || '(' || x.n || ')'), ', '), '') AS marcadores FROM m""")
def t31_hedging_markers(spark: SparkSession, d: str) -> DataFrame:
    """All 29 weighted markers."""
    return _texts(spark, d).select("doc_id", E.hedging(F.col("text")).alias("h")).select("doc_id", "h.*")


_EMOTIONS = ", ".join(f"round(({_count(terms)}) / n * 100, 4) AS {k}" for k, terms in L.EMOTIONS.items())


@query(f"WITH t AS ({_T}), e AS (SELECT doc_id, {_EMOTIONS} FROM t) SELECT *, round(reconocimiento_victimas / (reconocimiento_victimas + violencia_institucional + 0.001), 4) AS balance_victimas FROM e")
def t32_emotions(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("doc_id", E.emotions(F.col("text")).alias("e")).select("doc_id", "e.*")


@query()
def t33_layer_one(spark: SparkSession, d: str) -> DataFrame:
    """The three features of every text of 100 characters or more, beside each other."""
    return E.layer_one(_texts(spark, d))


@query(f"WITH t AS ({_T}) SELECT doc_id, round(least(({_count(L.VERBAL)}) / n * 10, 1.0), 9) AS verbal FROM t")
def n4_verbal(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("doc_id", F.round(E.verbal_score(F.col("text")), 9).alias("verbal"))


@query("""WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 8) AS e FROM embeddings), c AS (SELECT vec_id, abs(e[1]) AS a, abs(e[2]) AS b, abs(e[3]) AS c, abs(e[4]) AS d, abs(e[5]) AS f, abs(e[6]) AS g, e[7] AS rx FROM u)
SELECT vec_id, round(greatest(0.0, least((least((a + b) / 4, 1.0) + least((c + d) / 4, 1.0) - CASE WHEN g > 1.0 AND f < 0.5 THEN 0.3 ELSE 0 END + CASE WHEN rx < -0.1 THEN 0.2 ELSE 0 END) / CASE WHEN rx < -0.1 THEN 3 ELSE 2 END, 1.0)), 9) AS facial FROM c""")
def n6_facial(spark: SparkSession, d: str) -> DataFrame:
    unit = lambda i: F.col("embedding")[i].cast("double") * 8
    score = E.facial_score(*(F.abs(unit(i)) for i in range(6)), unit(6))
    return table(spark, d, "embeddings").select("vec_id", F.round(score, 9).alias("facial"))


@query()
def n8_hearings(spark: SparkSession, d: str) -> DataFrame:
    """Main speakers of conversations as hearings (tested by brute force)."""
    turns = table(spark, d, "conversations")
    start = F.col("turn") * 10.0
    segments = turns.select(F.col("conv_id").alias("hearing"), F.col("role").alias("speaker"), start.alias("start"), (start + F.length("text") % 10).alias("end"), "text", ((F.length("text") % 7) / 7.0).alias("prosody"), ((F.length("text") % 5) / 5.0).alias("facial"))
    return E.hearing_summary(segments)


_KEYS = ", ".join(f"'{k}'" for k in L.KEYWORDS)


@query(f"""WITH t AS (SELECT doc_id, text || ' hechos y conductas; resuelve; caso 03 y antecedentes' AS text FROM documents), k AS (SELECT unnest([{_KEYS}]) AS keyword), h AS (SELECT *, strpos(lower(text), lower(keyword)) AS p FROM t, k)
SELECT doc_id, keyword, CAST(p - 1 AS INTEGER) AS at, substring(text, greatest(p - 30, 1), CAST(p + 100 - greatest(p - 30, 1) AS INTEGER)) AS context FROM h WHERE p > 0""")
def h3_keywords_in_context(spark: SparkSession, d: str) -> DataFrame:
    """First hit of each of the eleven keywords, with 30 characters before and 100 from it on."""
    docs = table(spark, d, "documents").select("doc_id", F.concat("text", F.lit(" hechos y conductas; resuelve; caso 03 y antecedentes")).alias("text")).withColumn("low", F.lower("text"))
    rows = docs.withColumn("keyword", F.explode(F.array(*map(F.lit, L.KEYWORDS)))).withColumn("p", F.expr("instr(low, lower(keyword))")).where("p > 0")
    start = F.greatest(F.col("p") - 30, F.lit(1))
    return rows.select("doc_id", "keyword", (F.col("p") - 1).alias("at"), F.substring(F.col("text"), start, F.col("p") + 100 - start).alias("context"))


_PATHS = "['data/B_JEP/auto.JSON', 'x/consejo-de-estado/a.docx', 'corte_suprema/v.wav', 'audiencia casanare/1.tar.gz', 'soacha/mafapo.TXT', 'cidh.pdf', 'plain', 'a/b.ipynb'][doc_id % 8 + 1] || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '.csv' END"
_KINDS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.FILE_KINDS.items())
_RULES = " ".join(f"WHEN regexp_matches(path, '(?i){p}') THEN '{c}'" for p, c in L.PATH_CORPORA)


@query(f"SELECT doc_id, CASE lower(regexp_extract(path, '\\.([A-Za-z0-9_]+)$', 1)) {_KINDS} ELSE 'otro' END AS kind, CASE {_RULES} END AS corpus FROM (SELECT doc_id, {_PATHS} AS path FROM documents)")
def p16_file_rules(spark: SparkSession, d: str) -> DataFrame:
    """Kinds by all 53 extensions, corpora by all 6 path rules."""
    paths = ["data/B_JEP/auto.JSON", "x/consejo-de-estado/a.docx", "corte_suprema/v.wav", "audiencia casanare/1.tar.gz", "soacha/mafapo.TXT", "cidh.pdf", "plain", "a/b.ipynb"]
    path = F.concat(F.element_at(F.array(*map(F.lit, paths)), (F.col("doc_id") % 8 + 1).cast("int")), F.when(F.col("doc_id") % 3 == 0, "").otherwise(".csv"))
    return table(spark, d, "documents").select("doc_id", E.file_kind(path).alias("kind"), E.path_corpus(path).alias("corpus"))


@query("""SELECT doc_id, CASE WHEN starts_with(f, 'aus_') THEN replace(regexp_replace(regexp_replace(replace(substring(f, 5), '.csv', ''), '_SPEAKER_\\d+$', ''), '_v\\d+$', ''), '_comparecientes', '') END AS hearing
FROM (SELECT doc_id, ['aus_' || lang || '_v2_SPEAKER_0' || (doc_id % 5) || '.csv', 'aus_' || source || '_comparecientes_v1.csv', 'notes_' || lang || '.csv'][doc_id % 3 + 1] AS f FROM documents)""")
def p17_hearing_of_file(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    name = F.when(k % 3 == 0, F.concat(F.lit("aus_"), "lang", F.lit("_v2_SPEAKER_0"), (k % 5).cast("string"), F.lit(".csv"))).when(k % 3 == 1, F.concat(F.lit("aus_"), "source", F.lit("_comparecientes_v1.csv"))).otherwise(F.concat(F.lit("notes_"), "lang", F.lit(".csv")))
    return table(spark, d, "documents").select("doc_id", E.hearing_of_file(name).alias("hearing"))


@query("SELECT doc_id, CASE WHEN 10 + doc_id % 50 >= 5 + doc_id % 7 THEN trim(substring(text, 6 + doc_id % 7, 5 + doc_id % 50 - doc_id % 7), ' ') END AS section FROM documents")
def s18_section_text(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id").cast("int")
    return table(spark, d, "documents").select("doc_id", records.section_text(F.col("text"), 5 + k % 7, 10 + k % 50).alias("section"))


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 5 <> 0 AND length(text) > 0 AND doc_id % 7 <> 0 THEN trim(substring(text, 4, 9 + doc_id % 40), ' ') END, CASE WHEN doc_id % 3 <> 0 THEN trim(source, ' ') END, '') AS section FROM documents")
def s18_inline_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Each fifth text lacks its source, each seventh its range, each third an inline text."""
    k = F.col("doc_id")
    source, start, inline = F.when(k % 5 != 0, F.col("text")), F.when(k % 7 != 0, 3), F.when(k % 3 != 0, F.col("source"))
    return table(spark, d, "documents").select("doc_id", records.section_text_or(source, start, (12 + k % 40).cast("int"), inline).alias("section"))


@query("""WITH p AS (SELECT toxic AS t, 1 - quality AS g FROM labels), l AS (SELECT DISTINCT t AS label FROM p UNION SELECT DISTINCT g FROM p),
c AS (SELECT label, (SELECT count(*) FROM p WHERE t = label AND g = label) AS tp, (SELECT count(*) FROM p WHERE t = label) AS support, (SELECT count(*) FROM p WHERE g = label) AS guessed FROM l)
SELECT avg(CASE WHEN guessed > 0 THEN tp / guessed ELSE 0.0 END) AS precision, avg(CASE WHEN support > 0 THEN tp / support ELSE 0.0 END) AS recall, avg(CASE WHEN guessed + support > 0 THEN 2 * tp / (guessed + support) ELSE 0.0 END) AS macro_f1 FROM c""")
def a20_macro_f1(spark: SparkSession, d: str) -> DataFrame:
    scores = stats.f_scores(table(spark, d, "labels").select("toxic", (1 - F.col("quality")).alias("guess")), "toxic", "guess")
    return scores.agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("macro_f1"))


@query("""WITH r AS (SELECT quality AS v FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL UNION ALL SELECT toxic FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), n AS (SELECT count(*) AS n, sum(v) AS ones FROM r),
o AS (SELECT count(*) FILTER (quality <> toxic) AS off FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL) SELECT 1 - (n - 1) * (2.0 * off) / (2.0 * ones * (n - ones)) AS alpha FROM n, o""")
def t40_krippendorff(spark: SparkSession, d: str) -> DataFrame:
    """Krippendorff's alpha of two raters over nominal labels."""
    return star.krippendorff(table(spark, d, "labels"), "quality", "toxic")


@query("""WITH k AS (SELECT o_orderkey AS doc, o_orderpriority AS section, l_linenumber AS n, 'D' || o_orderkey || '__' || o_orderpriority || '__' || l_linenumber AS ext FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT doc, section, count(*) AS blocks, 'D' || doc || '__' || section || '__padre' AS parent FROM k GROUP BY doc, section""")
def j10_parents(spark: SparkSession, d: str) -> DataFrame:
    """Parents of blocks, made where there are none."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("n"))
    blocks = table(spark, d, "orders").join(lines, "o_orderkey").select(F.col("o_orderkey").alias("doc"), F.col("o_orderpriority").alias("section"), "n").withColumn("ext", star.external_id(F.concat(F.lit("D"), F.col("doc").cast("string")), F.col("section"), F.col("n")))
    both = star.with_parents(blocks, existing=blocks.limit(0).select("ext"))
    return both.where("not is_parent").groupBy("doc", "section").agg(F.count(F.lit(1)).alias("blocks"), F.first("parent").alias("parent"))


@query("SELECT l_orderkey, l_linenumber, o_orderdate FROM lineitem JOIN orders ON 'D' || l_orderkey || '__x__' || (l_linenumber % 3) = 'D' || o_orderkey || '__x__' || (o_orderkey % 3)")
def j6_composite_key(spark: SparkSession, d: str) -> DataFrame:
    """Lines with the order whose composite key is the same."""
    key = lambda doc, n: star.external_id(F.concat(F.lit("D"), F.col(doc).cast("string")), F.lit("x"), F.col(n) % 3)
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", key("l_orderkey", "l_linenumber").alias("ext"))
    orders = table(spark, d, "orders").select(key("o_orderkey", "o_orderkey").alias("ext"), "o_orderdate")
    return lines.join(orders, "ext").drop("ext")


@query("""SELECT o.o_orderkey, c.c_custkey AS customer, n.n_nationkey AS nation, r.r_regionkey AS region FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON r.r_name = CASE WHEN o.o_orderkey % 2 = 0 THEN 'ASIA' ELSE 'NOWHERE' END""")
def j7_lookups(spark: SparkSession, d: str) -> DataFrame:
    """Ids of several dimensions, null where there is no such row."""
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_nationkey").alias("nation"))
    region = table(spark, d, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("region"))
    customer = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_custkey").alias("customer"), "c_nationkey")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 2 == 0, "ASIA").otherwise("NOWHERE").alias("name"))
    return orders.join(customer, "o_custkey", "left").join(nation, "c_nationkey", "left").join(region, "name", "left").select("o_orderkey", "customer", "nation", "region")


@query("""WITH t AS (SELECT doc_id, list_filter(string_split(lower(text), ' '), lambda w: length(w) > 2) AS w FROM documents), u AS (SELECT doc_id, unnest(w) AS token, unnest(range(0, len(w))) AS i FROM t),
d AS (SELECT doc_id, token, min(i) AS i FROM u GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(token) DESC, i) AS k FROM d) SELECT doc_id, string_agg(token, ' ' ORDER BY k) AS longest FROM r WHERE k <= 5 GROUP BY doc_id""")
def o2_top_in_document(spark: SparkSession, d: str) -> DataFrame:
    """The five longest distinct tokens of each text, first ones first among equals."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), " ", -1), lambda w: F.length(w) > 2))
    ranked = F.array_sort(F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("m"), i.alias("i"), w.alias("w"))))
    out = table(spark, d, "documents").select("doc_id", F.array_join(F.transform(F.slice(ranked, 1, 5), lambda x: x["w"]), " ").alias("longest"))
    return out.where("longest <> ''")


@query("SELECT event_type, user_id, arg_min(value, event_id) FILTER (event_id % 3 <> 0) AS first_value FROM events GROUP BY event_type, user_id")
def w13_first_value(spark: SparkSession, d: str) -> DataFrame:
    """First non-null value of each group, in order of events."""
    value = F.when(F.col("event_id") % 3 != 0, F.col("value"))
    return table(spark, d, "events").groupBy("event_type", "user_id").agg(F.min_by("value", F.when(value.isNotNull(), F.col("event_id"))).alias("first_value"))


@query("""WITH x AS (SELECT doc_id, lang, source, length(text) AS n, sha256(text) AS h FROM documents) SELECT 'documents' AS t, count(*) AS rows, count(*) FILTER (lang IS NOT NULL AND source IS NOT NULL) AS traced, round(100.0 * count(*) FILTER (lang IS NOT NULL AND source IS NOT NULL) / count(*), 2) AS share FROM x
UNION ALL SELECT 'orders', count(*), count(c_custkey), round(100.0 * count(c_custkey) / count(*), 2) FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 2 = 0""")
def q3_traceability(spark: SparkSession, d: str) -> DataFrame:
    """Share of rows whose origin is known, by table."""
    docs = table(spark, d, "documents").select(F.lit("documents").alias("t"), (F.col("lang").isNotNull() & F.col("source").isNotNull()).alias("ok"))
    known = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("ok"))
    orders = table(spark, d, "orders").join(known, "o_custkey", "left").select(F.lit("orders").alias("t"), F.coalesce("ok", F.lit(False)).alias("ok"))
    out = docs.unionByName(orders).groupBy("t").agg(F.count(F.lit(1)).alias("rows"), F.count_if("ok").alias("traced"))
    return out.withColumn("share", F.round(100.0 * F.col("traced") / F.col("rows"), 2))


@query("""WITH s AS (SELECT 'nation' AS t, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'embeddings', count(*) FROM embeddings), c AS (SELECT *, CASE WHEN n = 0 THEN 'ERROR' WHEN n < 10 THEN 'WARN' ELSE 'OK' END AS status FROM s)
SELECT status, count(*) AS tables, sum(n) AS rows, string_agg(t, ', ' ORDER BY t) AS names FROM c GROUP BY status""")
def q7_status(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of tables rolled up by status."""
    return star.status_roll_up({n: table(spark, d, n) for n in ("nation", "region", "labels", "embeddings")})


_SCALED = "(rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0)"


@query(f"""WITH p AS (SELECT source, avg(length(text)) AS a, count(*) AS b FROM documents GROUP BY source), r AS (SELECT {_SCALED.format('a')} AS x, {_SCALED.format('b')} AS y FROM p), c AS (SELECT corr(x, y) AS rho FROM r)
SELECT round(rho, 9) AS rho, CASE WHEN NOT isnan(rho) AND abs(rho) >= 0.6 THEN 'PASS' ELSE 'REVIEW' END AS verdict FROM c""")
def v3_rank_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Spearman's rho of two rankings of the same entities, against a threshold of 0.6."""
    per = table(spark, d, "documents").groupBy("source").agg(F.avg(F.length("text")).alias("a"), F.count(F.lit(1)).alias("b")).withColumn("g", F.lit(1))
    rho = stats.spearman(per, "a", "b", "g")
    return rho.select(F.round("rho", 9).alias("rho"), F.when(F.abs("rho") >= 0.6, "PASS").otherwise("REVIEW").alias("verdict"))


@query()
def v5_parametric_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """95 % intervals of the difference of two normal means, 5,000 draws (tested against the closed form)."""
    docs = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", F.length("text").alias("n")), "doc_id")
    return resampling.parametric_gap(docs, F.col("toxic") == 1, "n", draws=5000)


@query()
def n15_structural_fit(spark: SparkSession, d: str) -> DataFrame:
    """Two factors of three indicators each, fitted to the covariances of lines (tested on known covariances)."""
    lines = table(spark, d, "lineitem").select((F.col("l_quantity") / 10).alias("x1"), (F.col("l_extendedprice") / 10_000).alias("x2"), (F.col("l_quantity") * F.col("l_linenumber") / 50).alias("x3"), (F.col("l_discount") * 10).alias("y1"), (F.col("l_tax") * 20 + F.col("l_discount") * 5).alias("y2"), (F.col("l_discount") * 20 + F.col("l_linenumber") / 10).alias("y3"))
    return structural.fit_table(lines, structural.Model({"f": ["x1", "x2", "x3"], "g": ["y1", "y2", "y3"]}, [("g", "f")]))


@query()
def n16_multigroup(spark: SparkSession, d: str) -> DataFrame:
    """The same model in each group, and the largest difference of loadings (tested on made groups)."""
    lines = table(spark, d, "lineitem").select("l_linestatus", (F.col("l_quantity") / 10).alias("x1"), (F.col("l_extendedprice") / 10_000).alias("x2"), (F.col("l_quantity") * F.col("l_linenumber") / 50).alias("x3"))
    return structural.multigroup(lines, "l_linestatus", structural.Model({"f": ["x1", "x2", "x3"]}, []))


def _features(spark: SparkSession, d: str) -> DataFrame:
    """Columns of lines under the names of indicators."""
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus", (q / 10).alias("y2_sa"), (F.col("l_extendedprice") / 10_000).alias("y3_civil"), (q * n / 50).alias("y4_nv"), (F.col("l_discount") * 10).alias("y5_corpus_type"), (F.col("l_discount") * 20 + n / 10).alias("y6_period"), (F.col("l_tax") * 20 - q / 100).alias("y10_rep"))


@query()
def n14_specifications(spark: SparkSession, d: str) -> DataFrame:
    """The partial and the two-factor model, with marks and main path (tested on known covariances)."""
    out = None
    for name in ("parcial", "dos_factores"):
        model = structural.Model.of(structural.SPECS[name])
        one = structural.fit_table(structural.prepared(_features(spark, d), model), model).select(F.lit(name).alias("model"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query()
def n16_path_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Mean and 95 % interval of the main path over 200 bootstrap replicates of all lines (tested against NumPy with the same weights)."""
    model = structural.Model.of(structural.SPECS["dos_factores"])
    rows = _features(spark, d).withColumnsRenamed(structural.FEATURES)
    return structural.path_interval(structural.path_replicates(rows, model, ["l_orderkey", "l_linenumber"], draws=200))


@query()
def n17_invariance(spark: SparkSession, d: str) -> DataFrame:
    """Equal against free loadings of one factor over two groups of lines (tested on made groups)."""
    return structural.invariance(_features(spark, d), "l_linestatus", structural.Model.of("f =~ y2_sa + y3_civil + y4_nv + y6_period"))


@query()
def n19_plane(spark: SparkSession, d: str) -> DataFrame:
    """Vectors on the plane of their two main components, signs fixed (in place of drawn projections; tested by brute force)."""
    return structural.main_plane(table(spark, d, "embeddings"), "vec_id", "embedding")


_CONTEXT_IDS = "['SP036-2018(42374)', 'AP4064-2016(46318)', '42770(11-12-13)', '05001-23-31-2006-01', 'x(01-02-97)', 'none'][doc_id % 6 + 1]"
_CONTEXT_COURTS = "[NULL, 'Corte Suprema · Sala Penal', 'Consejo de Estado · Sección Tercera', 'JEP · SRVR', 'Otro'][doc_id % 5 + 1]"
_CONTEXT_DATES = "CASE WHEN doc_id % 4 = 0 THEN CAST(1985 + doc_id % 50 AS VARCHAR) || '-03-01' END"
_CONTEXT_KINDS = "['A', 'b', 'C', 'A', 'A-CE'][doc_id % 7 % 5 + 1]"


@query(rf"""WITH t AS (SELECT doc_id, {_CONTEXT_IDS} AS id, {_CONTEXT_COURTS} AS court, {_CONTEXT_DATES} AS date, upper(trim({_CONTEXT_KINDS})) AS kind FROM documents),
y AS (SELECT *, CASE WHEN try_cast(regexp_extract(date, '^(\d{{4}})', 1) AS INTEGER) BETWEEN 1990 AND 2030 THEN try_cast(regexp_extract(date, '^(\d{{4}})', 1) AS INTEGER) END AS own,
try_cast(nullif(regexp_extract(id, '[A-Z]{{2}}\d+-(\d{{4}})', 1), '') AS INTEGER) AS a, try_cast(nullif(regexp_extract(id, '\d+-(\d{{4}})-', 1), '') AS INTEGER) AS b, try_cast(nullif(regexp_extract(id, '\((\d{{2}})-\d{{2}}-(\d{{2}})\)', 2), '') AS INTEGER) AS c FROM t),
z AS (SELECT *, coalesce(own, CASE WHEN a BETWEEN 1990 AND 2030 THEN a END, CASE WHEN b BETWEEN 1990 AND 2030 THEN b END, CASE WHEN c < 31 THEN 2000 + c WHEN c BETWEEN 90 AND 99 THEN 1900 + c END) AS year FROM y),
k AS (SELECT *, CASE WHEN kind IN ('B', 'C') THEN kind WHEN contains(court, 'Consejo') THEN 'A-CE' WHEN contains(court, 'Corte Suprema') THEN 'A-CSJ' WHEN contains(court, 'JEP') THEN 'B' WHEN regexp_matches(upper(id), '^[SA]P\d') THEN 'A-CSJ' ELSE 'A-CE' END AS corpus FROM z)
SELECT doc_id, corpus, CASE corpus WHEN 'A-CE' THEN 0 WHEN 'A-CSJ' THEN 1 WHEN 'B' THEN 2 ELSE 3 END AS y5, year, own IS NULL AND year IS NOT NULL AS inferred, CASE WHEN year IS NULL THEN 0.5 ELSE least(greatest((year - 1994) / 29.0, 0.0), 1.0) END AS y6,
CASE WHEN year IS NULL THEN 'desconocido' WHEN year <= 2008 THEN 'pre-escándalo (≤2008)' WHEN year <= 2016 THEN 'post-escándalo (2009-2016)' WHEN year <= 2020 THEN 'post-acuerdo (2017-2020)' ELSE 'JEP activa (2021+)' END AS period FROM k""")
def t26_context(spark: SparkSession, d: str) -> DataFrame:
    """Corpus type and period of documents, by court, date and id: y5 and y6."""
    k = F.col("doc_id")
    pick = lambda xs, i: F.element_at(F.array(*(F.lit(x).cast("string") for x in xs)), (i + 1).cast("int"))
    docs = table(spark, d, "documents").select("doc_id", pick(["SP036-2018(42374)", "AP4064-2016(46318)", "42770(11-12-13)", "05001-23-31-2006-01", "x(01-02-97)", "none"], k % 6).alias("id"), pick([None, "Corte Suprema · Sala Penal", "Consejo de Estado · Sección Tercera", "JEP · SRVR", "Otro"], k % 5).alias("court"), F.when(k % 4 == 0, F.concat((1985 + k % 50).cast("string"), F.lit("-03-01"))).alias("date"), pick(["A", "b", "C", "A", "A-CE"], k % 7 % 5).alias("kind"))
    return records.context(docs).select("doc_id", "corpus", "y5", "year", "inferred", "y6", "period")


@query("SELECT lang, quantile_cont(length(text), 0.05) AS low, quantile_cont(length(text), 0.95) AS high, avg(length(text)) AS mean, CASE WHEN stddev_pop(length(text)) = 0 THEN 1e-8 ELSE stddev_pop(length(text)) END AS std FROM documents GROUP BY lang")
def a17_scale_fit(spark: SparkSession, d: str) -> DataFrame:
    """What a scale is fitted from, by language: percentiles, mean and deviation of the population."""
    docs = table(spark, d, "documents").select("lang", F.length("text").alias("n"))
    ends = stats.quantiles(docs, "n", (0.05, 0.95), "lang").select(F.col("lang").alias("_lang"), F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
    per = docs.groupBy("lang").agg(F.avg("n").alias("mean"), F.stddev_pop("n").alias("std")).join(ends, F.col("lang").eqNullSafe(F.col("_lang")), "left").drop("_lang")
    return per.withColumn("std", F.when(F.col("std") == 0, 1e-8).otherwise(F.col("std")))


@query(f"SELECT CASE lower(regexp_extract(path, '\\.([A-Za-z0-9_]+)$', 1)) {_KINDS} ELSE 'otro' END AS kind, CASE {_RULES} END AS corpus, count(*) AS files, CAST(sum(n) AS BIGINT) AS bytes FROM (SELECT {_PATHS} AS path, length(text) AS n FROM documents) GROUP BY ALL")
def a22_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Files and bytes by kind and corpus."""
    paths = ["data/B_JEP/auto.JSON", "x/consejo-de-estado/a.docx", "corte_suprema/v.wav", "audiencia casanare/1.tar.gz", "soacha/mafapo.TXT", "cidh.pdf", "plain", "a/b.ipynb"]
    path = F.concat(F.element_at(F.array(*map(F.lit, paths)), (F.col("doc_id") % 8 + 1).cast("int")), F.when(F.col("doc_id") % 3 == 0, "").otherwise(".csv"))
    return table(spark, d, "documents").groupBy(E.file_kind(path).alias("kind"), E.path_corpus(path).alias("corpus")).agg(F.count(F.lit(1)).alias("files"), F.sum(F.length("text")).alias("bytes"))


@query("""SELECT 'section' AS gate, count(*) AS kept, CAST(sum(least(length(trim(text)), 8000)) AS BIGINT) AS chars FROM documents WHERE length(trim(text)) >= 30
UNION ALL SELECT 'layer_one', count(*), CAST(sum(length(text)) AS BIGINT) FROM documents WHERE length(trim(text)) >= 100 UNION ALL SELECT 'embedding', count(*), CAST(sum(length(text)) AS BIGINT) FROM documents WHERE length(text) >= 10
UNION ALL SELECT 'segment', count(*), CAST(sum(length(text)) AS BIGINT) FROM conversations WHERE length(text) % 10 >= 5 UNION ALL SELECT 'window', count(*), CAST(sum(length(text)) AS BIGINT) FROM conversations WHERE length(text) % 10 >= 1""")
def p10_gates(spark: SparkSession, d: str) -> DataFrame:
    """What passes each gate of length (30, with 8,000 characters read; 100; 10) and of duration (5 and 1 seconds; here the last digit of a turn's length)."""
    docs, turns = table(spark, d, "documents"), table(spark, d, "conversations")
    n, bare, seconds = F.length("text"), F.length(F.trim("text")), F.length("text") % 10
    gates = [("section", docs, bare >= 30, F.least(bare, F.lit(8000))), ("layer_one", docs, bare >= 100, n), ("embedding", docs, n >= 10, n), ("segment", turns, seconds >= 5, n), ("window", turns, seconds >= 1, n)]
    out = None
    for name, df, kept, chars in gates:
        one = df.where(kept).agg(F.count(F.lit(1)).alias("kept"), F.sum(chars).alias("chars")).select(F.lit(name).alias("gate"), "kept", "chars")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT count(*) AS total, count(*) FILTER (toxic = 0) AS success, count(*) FILTER (toxic <> 0) AS failed, count(*) FILTER (quality = 0) AS low_confidence, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY CAST(doc_id AS VARCHAR)) FILTER (toxic <> 0) AS failed_files FROM labels""")
def k2_batch_summary(spark: SparkSession, d: str) -> DataFrame:
    """Counters of a batch and the list of what failed."""
    rows = table(spark, d, "labels").withColumn("name", F.col("doc_id").cast("string"))
    out = sinks.batch_summary(rows, F.col("toxic") == 0, F.col("quality") == 0, "name")
    return out.withColumn("failed_files", F.array_join("failed_files", ","))


@query("SELECT source, count(*) AS n, count(*) FILTER (c < 0.5) AS low FROM (SELECT source, 0.25 * CAST(text LIKE '%the%' AS INTEGER) + 0.30 * CAST(text LIKE '%and%' AS INTEGER) + 0.20 * CAST(text LIKE '%der%' AS INTEGER) + 0.10 * CAST(text LIKE '%les%' AS INTEGER) + 0.05 * CAST(text LIKE '%und%' AS INTEGER) + 0.10 * CAST(text LIKE '%los%' AS INTEGER) AS c FROM documents) GROUP BY source")
def m8_low_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose confidence, by the weights of what was found, is below 0.5."""
    weights = {"the": 0.25, "and": 0.30, "der": 0.20, "les": 0.10, "und": 0.05, "los": 0.10}
    confidence = sum((F.when(F.col("text").contains(t), w).otherwise(0.0) for t, w in weights.items()), F.lit(0.0))
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.round(confidence, 6) < 0.5).alias("low"))


@query()
def h2_section_listing(spark: SparkSession, d: str) -> DataFrame:
    """Sections with a star for targets and their words; the first of each label, and the targets, are G4's accessors."""
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("HECHOS PROBADOS:\n"), "text", F.lit("\nRESUELVE:\n"), "text").alias("text"))
    rows = records.section_rows(docs, "A")
    return rows.select("doc_id", "section_index", F.concat("section_id", F.when(F.col("is_target"), " *").otherwise("")).alias("title"), F.regexp_count("text", F.lit(r"\S+")).alias("words"))
