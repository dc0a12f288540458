"""Queries of the statistics, index, audit and governance layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforum.functions import stats, text as T
from lexforum.functions.materialise import written
from lexforum.operators import audit, controls, indices, ranking, regression, resampling, spans
from lexforum.sources.readers import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("SELECT p_brand, regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept, regr_r2(l_extendedprice, l_quantity) AS r2 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand")
def n18_path_slopes(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    lines = table(spark, d, "lineitem").select("l_partkey", "l_extendedprice", "l_quantity")
    y, x = "l_extendedprice", "l_quantity"
    return lines.join(parts, "l_partkey").groupBy("p_brand").agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


@query("""WITH m AS (SELECT var_samp(l_quantity) AS a, var_samp(l_discount) AS b, covar_samp(l_quantity, l_discount) AS ab, covar_samp(l_extendedprice, l_quantity) AS ya, covar_samp(l_extendedprice, l_discount) AS yb FROM lineitem)
SELECT 'l_quantity' AS term, round((ya * b - yb * ab) / (a * b - ab * ab), 4) AS estimate FROM m UNION ALL SELECT 'l_discount', round((yb * a - ya * ab) / (a * b - ab * ab), 4) FROM m""")
def path_analysis(spark: SparkSession, d: str) -> DataFrame:
    fit = regression.least_squares(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"])
    return fit.where("term <> '(intercept)'").select("term", F.round("estimate", 4).alias("estimate"))


@query("SELECT o_orderpriority, avg(year(o_orderdate)) FILTER (o_totalprice > 250000) AS dear_year, avg(year(o_orderdate)) FILTER (NOT o_totalprice > 250000) AS other_year, avg(CASE WHEN year(o_orderdate) >= 1996 THEN 1.0 ELSE 0.0 END) FILTER (o_totalprice > 250000) AS late_share FROM orders GROUP BY o_orderpriority")
def n3_subset_years(spark: SparkSession, d: str) -> DataFrame:
    dear, year = F.col("o_totalprice") > 250000, F.year("o_orderdate")
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.avg(F.when(dear, year)).alias("dear_year"), F.avg(F.when(~dear, year)).alias("other_year"), F.avg(F.when(dear, (year >= 1996).cast("double"))).alias("late_share"))


@query("""WITH r AS (SELECT user_id, min(value) AS lo, max(value) AS hi, min(len) AS l2, max(len) AS h2 FROM (SELECT *, sqrt(value) AS len FROM events) GROUP BY user_id)
SELECT user_id, avg(((value - lo) / (hi - lo + 1e-9) + (sqrt(value) - l2) / (h2 - l2 + 1e-9)) / 2) AS vocal, abs(avg(((value - lo) / (hi - lo + 1e-9) + (sqrt(value) - l2) / (h2 - l2 + 1e-9)) / 2) - 0.5) AS divergence FROM events JOIN r USING (user_id) GROUP BY user_id""")
def n11_vocal_index(spark: SparkSession, d: str) -> DataFrame:
    # The mean of a scaled value is the scaled mean: one aggregation, no window.
    v, root = F.col("value"), F.sqrt("value")
    scaled = lambda x: (F.avg(x) - F.min(x)) / (F.max(x) - F.min(x) + 1e-9)
    vocal = (scaled(v) + scaled(root)) / 2
    return table(spark, d, "events").groupBy("user_id").agg(vocal.alias("vocal"), F.abs(vocal - 0.5).alias("divergence"))


@query("SELECT c_mktsegment, o_orderstatus, count(*) AS n, avg(o_totalprice) AS mean, min(o_totalprice) AS least, max(o_totalprice) AS greatest FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")
def d3_indicator_stats(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    p = F.col("o_totalprice")
    return table(spark, d, "orders").join(customers, "o_custkey").groupBy("c_mktsegment", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean"), F.min(p).alias("least"), F.max(p).alias("greatest"))


@query("""WITH t AS (SELECT conv_id, count(*) AS turns, count(DISTINCT role) AS roles, sum(length(text)) AS chars FROM conversations GROUP BY conv_id), l AS (SELECT doc_id, count(*) AS labels FROM labels GROUP BY doc_id)
SELECT t.*, coalesce(labels, 0) AS labels FROM t LEFT JOIN l ON doc_id = conv_id""")
def d4_hearing_summary(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.count_distinct("role").alias("roles"), F.sum(F.length("text")).alias("chars"))
    labels = table(spark, d, "labels").groupBy(F.col("doc_id").alias("conv_id")).agg(F.count(F.lit(1)).alias("labels"))
    return turns.join(labels, "conv_id", "left").withColumn("labels", F.coalesce("labels", F.lit(0).cast("long")))


@query("SELECT lang, count(*) AS n, count(l.doc_id) AS labelled, 100.0 * count(l.doc_id) / count(*) AS percent, count(*) FILTER (l.doc_id IS NULL) AS uncovered FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id GROUP BY lang")
def q4_coverage(spark: SparkSession, d: str) -> DataFrame:
    labelled = table(spark, d, "labels").select("doc_id").distinct().withColumn("has", F.lit(1))
    joined = table(spark, d, "documents").select("doc_id", "lang").join(labelled, "doc_id", "left")
    n = F.count(F.lit(1))
    return joined.groupBy("lang").agg(n.alias("n"), F.count("has").alias("labelled"), (100.0 * F.count("has") / n).alias("percent"), F.count_if(F.col("has").isNull()).alias("uncovered"))


@query("""WITH e(role, expected) AS (VALUES ('user', 1), ('assistant', 1), ('tool', 0)), o AS (SELECT role, count(DISTINCT conv_id) AS observed FROM conversations GROUP BY role)
SELECT e.role, coalesce(observed, 0) AS observed, CASE WHEN expected = 0 AND coalesce(observed, 0) > 0 THEN 'ERROR' WHEN coalesce(observed, 0) < expected THEN 'WARNING' ELSE 'OK' END AS status FROM e LEFT JOIN o USING (role)""")
def q6_cardinality(spark: SparkSession, d: str) -> DataFrame:
    expected = spark.createDataFrame([("user", 1), ("assistant", 1), ("tool", 0)], "role string, expected int")
    observed = table(spark, d, "conversations").groupBy("role").agg(F.count_distinct("conv_id").alias("o"))
    joined = F.broadcast(expected).join(observed, "role", "left").withColumn("observed", F.coalesce("o", F.lit(0).cast("long")))  # a fixed list
    return joined.select("role", "observed", F.when((F.col("expected") == 0) & (F.col("observed") > 0), "ERROR").when(F.col("observed") < F.col("expected"), "WARNING").otherwise("OK").alias("status"))


@query("SELECT count(*) AS k, max(f) / min(f) AS ratio, stddev_pop(f) / avg(f) AS cv, min(f) >= 0.30 AND max(f) / min(f) <= 3 AND stddev_pop(f) / avg(f) < 0.30 AS fair FROM (SELECT event_type, avg(value) / 60 AS f FROM events GROUP BY 1)")
def v1_disparity(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "events").groupBy("event_type").agg((F.avg("value") / 60).alias("f"))
    ratio, cv = stats.ratio(F.max("f"), F.min("f")), stats.ratio(F.stddev_pop("f"), F.avg("f"))
    return per.agg(F.count(F.lit(1)).alias("k"), ratio.alias("ratio"), cv.alias("cv"), ((F.min("f") >= 0.30) & (ratio <= 3) & (cv < 0.30)).alias("fair"))


@query("WITH y AS (SELECT DISTINCT c_mktsegment AS g, year(o_orderdate) AS y FROM orders JOIN customer ON o_custkey = c_custkey WHERE year(o_orderdate) % 3 <> 0), s AS (SELECT g, unnest(range(min(y), max(y) + 1)) AS y FROM y GROUP BY g) SELECT s.g AS segment, CAST(s.y AS INTEGER) AS missing_year FROM s ANTI JOIN y ON s.g = y.g AND s.y = y.y")
def v6_temporal_gaps(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    years = table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("missing_year")).where("missing_year % 3 <> 0").join(customers, "o_custkey").select("segment", "missing_year").distinct()
    span = years.groupBy("segment").agg(F.explode(F.sequence(F.min("missing_year"), F.max("missing_year"))).alias("missing_year"))
    return span.join(years, ["segment", "missing_year"], "left_anti")


@query("SELECT l_returnflag AS standard, avg(CASE WHEN l_linenumber > 3 THEN 1.0 WHEN l_linenumber = 3 THEN 0.5 ELSE 0.0 END) AS compliance FROM lineitem GROUP BY 1")
def v9_compliance(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    met = F.when(n > 3, True).when(n < 3, False)  # null: partly
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("standard")).agg(F.avg(F.when(met.isNull(), 0.5).when(met, 1.0).otherwise(0.0)).alias("compliance"))


@query("SELECT avg(s) AS score, CASE WHEN avg(s) >= 0.75 THEN 'HIGH' WHEN avg(s) >= 0.55 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM (SELECT event_type, avg(CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END) AS s FROM events GROUP BY 1)")
def v10_consolidated(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "events").groupBy("event_type").agg(F.avg((F.col("value") > 20).cast("double")).alias("s"))
    return per.agg(F.avg("s").alias("score")).withColumn("level", audit.level(F.col("score")))


@query()
def v4_weight_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """Stability of the rankings of classes of customers by the three indices (their channels from means of lines) under 10,000 random weights each: tested by brute force."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.expr("o_custkey % 25").alias("entity"))
    means = {"sa": "l_quantity", "nv": "l_discount", "rep": "l_tax", "y8": "l_extendedprice", "y9": "l_linenumber"}
    # One row a class, read twice for each index: written, so that lines meet orders once.
    classes = written(table(spark, d, "lineitem").join(orders, "l_orderkey").groupBy("entity").agg(*(F.avg(c).alias(k) for k, c in means.items())))
    per = ranking.scaled(classes, list(means))
    channels = per.select("*", F.col("sa").alias("facial"), F.col("nv").alias("vocal"), F.col("y8").alias("verbal"))
    out = None
    for name, weights in (("DIS", indices.DIS), ("IEI", indices.IEI), ("ICM", indices.TRI)):
        one = ranking.sensitivity_summary(ranking.weight_sensitivity(channels, weights)).select(F.lit(name).alias("index"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query()
def v5_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return resampling.bootstrap_gap(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_orderstatus", "o_totalprice", "F", "O", 500)


@query("""WITH t AS (SELECT doc_id, unnest(range(0, len(string_split(text, ' ')))) AS i, unnest(string_split(text, ' ')) AS w FROM documents),
p AS (SELECT doc_id, i, coalesce(sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM t)
SELECT doc_id, CAST(i AS INTEGER) AS token_index, CASE WHEN start >= 40 AND start < 90 THEN 'NV' WHEN start >= 10 AND start < 60 THEN 'SA' ELSE 'O' END AS label FROM p""")
def t36_token_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of all tokens of the whole text from two overlapping character spans, of which the later wins."""
    return spans.token_labels(table(spark, d, "documents"), [(10, 60, "SA"), (40, 90, "NV")])


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS t FROM documents) SELECT doc_id, CAST(len(list_filter(t, lambda x: length(x) > 7 AND (suffix(x, 'tion') OR suffix(x, 'ment') OR suffix(x, 'keit')))) AS INTEGER) AS nominal, CAST(len(list_filter(t, lambda x: x IN ('the', 'der', 'les', 'los'))) AS INTEGER) AS hits FROM w""")
def t5_suffix_tokens(spark: SparkSession, d: str) -> DataFrame:
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    nominal = F.filter(words, lambda x: (F.length(x) > 7) & (F.endswith(x, F.lit("tion")) | F.endswith(x, F.lit("ment")) | F.endswith(x, F.lit("keit"))))
    return table(spark, d, "documents").select("doc_id", F.size(nominal).alias("nominal"), F.size(F.filter(words, lambda x: x.isin("the", "der", "les", "los"))).alias("hits"))


@query("SELECT lang, count(*) AS sections, sum(len(regexp_extract_all(text, '\\S+'))) AS words, count(*) FILTER (length(text) < 100) AS low_confidence FROM documents GROUP BY lang")
def h1_batch_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("sections"), F.sum(T.word_count(F.col("text"))).alias("words"), F.count_if(F.length("text") < 100).alias("low_confidence"))


@query("SELECT a.label AS a, b.label AS b, round(corr(a.x, b.x), 6) AS r FROM (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, range(1, len(embedding) + 1) t(i) GROUP BY label, i) a JOIN (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, range(1, len(embedding) + 1) t(i) GROUP BY label, i) b ON a.i = b.i AND a.label < b.label GROUP BY 1, 2")
def v7_label_correlation(spark: SparkSession, d: str) -> DataFrame:
    means = indices.centroids(table(spark, d, "embeddings"), "label", "embedding")
    long = means.select("label", F.posexplode("c").alias("i", "x"))
    a, b = long.withColumnsRenamed({"label": "a", "x": "xa"}), long.withColumnsRenamed({"label": "b", "x": "xb"})
    return a.join(b, "i").where("a < b").groupBy("a", "b").agg(F.round(F.corr("xa", "xb"), 6).alias("r"))


@query("SELECT l_shipmonth, count(*) AS n, avg(l_discount) AS mean_discount FROM (SELECT date_trunc('month', l_shipdate) AS l_shipmonth, l_discount FROM lineitem) GROUP BY 1")
def yearly_series(spark: SparkSession, d: str) -> DataFrame:
    month = F.date_trunc("month", "l_shipdate").cast("timestamp_ntz")
    return table(spark, d, "lineitem").groupBy(month.alias("l_shipmonth")).agg(F.count(F.lit(1)).alias("n"), F.avg("l_discount").alias("mean_discount"))


@query("SELECT toxic, count(*) AS n, avg(n_chars) AS mean_chars, count(DISTINCT lang) AS langs FROM labels JOIN documents USING (doc_id) GROUP BY toxic")
def label_profile(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "lang")
    return table(spark, d, "labels").join(docs, "doc_id").groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.avg("n_chars").alias("mean_chars"), F.count_distinct("lang").alias("langs"))


_CONTROLLED = ("o_totalprice", "o_custkey")


@query("""WITH l AS (SELECT o_orderstatus = 'F' AS a, year(o_orderdate) AS y, unnest(['o_totalprice', 'o_custkey']) AS code, unnest([CAST(o_totalprice AS DOUBLE), CAST(o_custkey AS DOUBLE)]) AS v FROM orders),
x AS (SELECT *, unnest([FALSE, TRUE]) AS recent FROM l), r AS (SELECT * FROM x WHERE NOT recent OR NOT a OR y BETWEEN 1994 AND 1996),
k AS (SELECT *, rank() OVER (PARTITION BY code, recent ORDER BY v) + (count(*) OVER (PARTITION BY code, recent, v) - 1) / 2.0 AS rk FROM r),
u AS (SELECT code, recent, count(*) FILTER (a) AS na, count(*) FILTER (NOT a) AS nb, avg(v) FILTER (a) AS ma, avg(v) FILTER (NOT a) AS mb, sum(rk) FILTER (a) - count(*) FILTER (a) * (count(*) FILTER (a) + 1) / 2 AS u FROM k GROUP BY ALL)
SELECT p.code, p.na AS n_a, q.na AS n_a_recent, p.nb AS n_b, p.ma AS mean_a, q.ma AS mean_a_recent, p.mb AS mean_b, p.u, q.u AS u_recent FROM u p JOIN u q ON p.code = q.code WHERE NOT p.recent AND q.recent""")
def n18_temporal_control(spark: SparkSession, d: str) -> DataFrame:
    """Filled orders against the others, over all years and with the filled ones of 1994 to 1996 (p and verdict: tests)."""
    orders = table(spark, d, "orders")
    out = controls.temporal_control(orders, F.col("o_orderstatus") == "F", F.year("o_orderdate"), 1994, 1996, _CONTROLLED)
    return out.select("code", "n_a", "n_a_recent", "n_b", "mean_a", "mean_a_recent", "mean_b", "u", "u_recent")


def _rank(c: str) -> str:
    return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"


_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_PAIRS = [(a, b) for i, a in enumerate(_COLUMNS) for b in _COLUMNS[i + 1 :]]


@query("WITH r AS (SELECT {}, count(*) OVER () AS n FROM lineitem), p AS ({}) SELECT a, b, n, round(rho, 9) AS rho, abs(rho) > 0.7 AS redundant FROM p".format(
    ", ".join(f"{_rank(c)} AS {c}" for c in _COLUMNS), " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, corr({a}, {b}) AS rho FROM r" for a, b in _PAIRS)))
def v7_redundant_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Spearman's rho of every two columns, flagged above 0.70."""
    return controls.correlated_pairs(table(spark, d, "lineitem"), _COLUMNS).select("a", "b", "n", F.round("rho", 9).alias("rho"), "redundant")
