"""Queries over the star tables: projections, joins, aggregates, windows, limits, sets, audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexforum.functions import stats, text as T
from lexforum.operators import audit, indices, relational as R
from lexforum.sources.readers import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# -- projections --------------------------------------------------------------


@query("SELECT l_orderkey AS block_id, l_linenumber AS n, l_quantity AS y1_a, CAST(NULL AS DOUBLE) AS y2_b FROM lineitem")
def p1_rename_project(spark: SparkSession, d: str) -> DataFrame:
    renamed = table(spark, d, "lineitem").withColumnsRenamed({"l_orderkey": "block_id", "l_linenumber": "n", "l_quantity": "y1_a"})
    return renamed.withColumn("y2_b", F.lit(None).cast("double")).select("block_id", "n", "y1_a", "y2_b").drop("absent")


@query("SELECT event_id, TRY_CAST(event_type AS DOUBLE) AS as_number, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def p2_try_number(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.col("event_type").try_cast("double").alias("as_number"), F.get_json_object("props", "$.k").try_cast("double").alias("k"))


@query("""SELECT l_orderkey AS block_id, l_linenumber AS n, codigo, valor FROM (
SELECT l_orderkey, l_linenumber, l_quantity AS y1_q, l_discount AS y2_d, CASE WHEN l_tax > 0.02 THEN l_tax END AS y3_t FROM lineitem)
UNPIVOT (valor FOR codigo IN (y1_q, y2_d, y3_t))""")
def p3_unpivot(spark: SparkSession, d: str) -> DataFrame:
    wide = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("block_id"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("y1_q"), F.col("l_discount").alias("y2_d"), F.when(F.col("l_tax") > 0.02, F.col("l_tax")).alias("y3_t"))
    return R.unpivot_indicators(wide, ["block_id", "n"])


@query("SELECT user_id, avg(value) FILTER (event_type = 'click') AS click, avg(value) FILTER (event_type = 'view') AS view FROM events GROUP BY user_id")
def p4_pivot(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").pivot("event_type", ["click", "view"]).avg("value")


@query("SELECT doc_id, CASE lang WHEN 'es' THEN 'A' WHEN 'en' THEN 'B' ELSE 'C' END AS corpus, CASE WHEN text LIKE '%AKIA%' THEN 'KEYED' WHEN text LIKE '%password%' THEN 'PLAIN' ELSE 'OTHER' END AS doc_type FROM documents")
def p5_recode(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("text").contains("AKIA"), "KEYED").when(F.col("text").contains("password"), "PLAIN").otherwise("OTHER")
    return table(spark, d, "documents").select("doc_id", F.when(F.col("lang") == "es", "A").when(F.col("lang") == "en", "B").otherwise("C").alias("corpus"), kind.alias("doc_type"))


@query("SELECT o_orderkey, CASE WHEN y <= 1994 THEN 'early' WHEN y <= 1997 THEN 'middle' ELSE 'late' END AS period, CASE WHEN y > 1993 AND y <= 1996 THEN 1 WHEN y > 1996 AND y <= 2000 THEN 2 END AS bin FROM (SELECT o_orderkey, year(o_orderdate) AS y FROM orders)")
def p6_year_bins(spark: SparkSession, d: str) -> DataFrame:
    y = F.year("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", F.when(y <= 1994, "early").when(y <= 1997, "middle").otherwise("late").alias("period"), F.when((y > 1993) & (y <= 1996), 1).when((y > 1996) & (y <= 2000), 2).alias("bin"))


@query("SELECT DISTINCT l_discount, CASE WHEN l_discount < 0.001 THEN '***' WHEN l_discount < 0.01 THEN '**' WHEN l_discount < 0.05 THEN '*' ELSE '' END AS stars FROM lineitem")
def p7_stars(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_discount", stats.stars(F.col("l_discount")).alias("stars")).distinct()


@query("SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem WHERE l_discount > 0.07 AND l_tax < 0.02 AND l_returnflag IN ('A', 'R') AND l_shipdate IS NOT NULL")
def p8_predicates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").na.drop(subset=["l_discount", "l_tax"])
    return rows.where((F.col("l_discount") > 0.07) & (F.col("l_tax") < 0.02) & F.col("l_returnflag").isin("A", "R") & F.col("l_shipdate").isNotNull()).select("l_orderkey", "l_linenumber", "l_discount", "l_tax")


@query("SELECT conv_id, turn, replace(replace(upper(role), ' ', '_'), '-', '_') AS section FROM conversations WHERE replace(replace(upper(role), ' ', '_'), '-', '_') IN ('USER', 'SYSTEM') OR turn = 0")
def p9_target_sections(spark: SparkSession, d: str) -> DataFrame:
    section = F.translate(F.upper("role"), " -", "__")
    return table(spark, d, "conversations").select("conv_id", "turn", section.alias("section")).where((F.col("turn") == 0) | F.col("section").isin("USER", "SYSTEM"))


@query("SELECT doc_id, length(text) AS n, length(substring(text, 1, 8000)) AS kept FROM documents WHERE length(text) >= 30")
def p10_length_gate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.length("text") >= 30).select("doc_id", F.length("text").cast("long").alias("n"), F.length(F.substring("text", 1, 8000)).cast("long").alias("kept"))


@query("SELECT doc_id, sha256(text) AS sha, substring(sha256(text), 1, 16) AS short, doc_id || '__' || source || '__' || lang AS composite, CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) AS tail FROM documents")
def p13_keys(spark: SparkSession, d: str) -> DataFrame:
    sha = F.sha2("text", 256)
    return table(spark, d, "documents").select("doc_id", sha.alias("sha"), F.substring(sha, 1, 16).alias("short"), F.concat_ws("__", F.col("doc_id").cast("string"), "source", "lang").alias("composite"), F.regexp_extract("source", r"(\d+)$", 1).cast("int").alias("tail"))


@query("""SELECT doc_id, CASE WHEN b >= 1024 * 1024 THEN printf('%.1f MB', b / 1048576.0) WHEN b >= 1024 THEN printf('%.1f KB', b / 1024.0) ELSE printf('%d B', b) END AS readable FROM (SELECT doc_id, strlen(text) * 3 + 1 AS b FROM documents)""")
def p15_readable_bytes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.readable_bytes(F.octet_length("text") * 3 + 1).alias("readable"))


@query("SELECT page_id, CASE WHEN regexp_matches(url, '^https://') THEN 'secure' WHEN regexp_matches(url, '/(en|fr)/') THEN 'labelled' ELSE 'other' END AS kind, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS hearing FROM pages")
def p16_path_rules(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    kind = F.coalesce(T.first_match(url, [("^https://", "secure"), ("/(en|fr)/", "labelled")], ""), F.lit("other"))
    return table(spark, d, "pages").select("page_id", kind.alias("kind"), F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"), F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "").alias("hearing"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def p19_json(spark: SparkSession, d: str) -> DataFrame:
    parsed = F.from_json("props", "map<string,double>")
    return table(spark, d, "events").select("event_id", F.try_element_at(F.from_json(F.to_json(parsed), "map<string,double>"), F.lit("k")).cast("int").alias("k"))


# -- joins --------------------------------------------------------------------


@query("SELECT n_name, o_orderstatus, count(*) AS n, avg(l_quantity) AS mean_q FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, o_orderstatus")
def j1_star(spark: SparkSession, d: str) -> DataFrame:
    # Order statuses are summed up by order first, so that lines meet only their orders.
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))
    orders = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    joined = orders.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name", "o_orderstatus").agg(F.sum("n").alias("n"), (F.sum("q") / F.sum("n")).alias("mean_q"))


@query("SELECT c_custkey, count(o_orderkey) AS orders, min(year(o_orderdate)) AS first_year FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def j2_left_outer(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders"), F.min(F.year("o_orderdate")).alias("first_year"))
    return table(spark, d, "customer").select("c_custkey").join(per, "c_custkey", "left").select("c_custkey", F.coalesce("orders", F.lit(0).cast("long")).alias("orders"), "first_year")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def j3_anti(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("""WITH f AS (SELECT DISTINCT sha256(text) AS name FROM documents), s AS (SELECT doc_id, substring(sha256(text), 1, CAST(12 + doc_id % 12 AS INTEGER)) || '...' AS prefix FROM documents)
SELECT doc_id, prefix, CAST(count(name) AS INTEGER) AS match_count, CASE WHEN count(name) = 1 THEN min(name) END AS matched FROM s LEFT JOIN f ON length(prefix) - 3 >= 16 AND starts_with(name, left(prefix, length(prefix) - 3)) GROUP BY doc_id, prefix""")
def j4_prefix_join(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("name"))
    short = docs.select("doc_id", F.concat(F.expr("substring(name, 1, cast(12 + doc_id % 12 as int))"), F.lit("...")).alias("prefix"))
    return R.prefix_join(short, docs, "prefix", "name")


@query("""WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type = 'click'),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type = 'view')
SELECT a.user_id, CAST(a.n AS INTEGER) AS n, a.event_id AS click_id, b.event_id AS view_id FROM a JOIN b ON a.user_id = b.user_id AND a.n = b.n""")
def j5_ordinal_join(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    one = lambda kind, name: ev.where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(name))
    return R.ordinal_join(one("click", "click_id"), one("view", "view_id"), ["user_id"], "click_id", "view_id")


@query("""WITH a AS (SELECT n_nationkey, n_name, unnest([upper(n_name), ' ' || lower(n_name), n_name || '-alias']) AS alias FROM nation), b AS (SELECT DISTINCT lower(trim(alias)) AS alias, n_nationkey FROM a)
SELECT c_custkey, n_nationkey FROM (SELECT c_custkey, c_nationkey, ' ' || (SELECT n_name FROM nation WHERE n_nationkey = c_nationkey) AS name FROM customer) LEFT JOIN b ON lower(trim(name)) = alias""")
def j8_alias_join(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation").select("n_nationkey", "n_name")
    dim = nation.select("n_nationkey", F.array(F.upper("n_name"), F.concat(F.lit(" "), F.lower("n_name")), F.concat("n_name", F.lit("-alias"))).alias("aliases"))
    named = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")).join(nation, "n_nationkey").select("c_custkey", F.concat(F.lit(" "), "n_name").alias("name"))
    return R.alias_join(named, dim, "name", "aliases").select("c_custkey", "n_nationkey")


@query("SELECT a.event_id AS left_id, b.event_id AS right_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'view' AND round(a.value, 1) = round(b.value, 1)")
def j9_rounded_key(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").select("event_id", "user_id", "event_type", F.round("value", 1).alias("start"))
    a = ev.where("event_type = 'click'").select(F.col("event_id").alias("left_id"), "user_id", "start")
    return a.join(ev.where("event_type = 'view'").select(F.col("event_id").alias("right_id"), "user_id", "start"), ["user_id", "start"]).select("left_id", "right_id")


@query("""WITH o AS (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY 1), l AS (SELECT o_custkey, count(*) AS lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT c_custkey, coalesce(orders, 0) AS orders, coalesce(lines, 0) AS lines FROM customer LEFT JOIN o ON c_custkey = o.o_custkey LEFT JOIN l ON c_custkey = l.o_custkey""")
def j14_fan_out(spark: SparkSession, d: str) -> DataFrame:
    # Children are counted first, so that no row meets another child's rows.
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    per = table(spark, d, "orders").join(lines, "o_orderkey", "left").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders"), F.coalesce(F.sum("n"), F.lit(0)).alias("lines"))
    zero = F.lit(0).cast("long")
    return table(spark, d, "customer").select("c_custkey").join(per, "c_custkey", "left").select("c_custkey", F.coalesce("orders", zero).alias("orders"), F.coalesce("lines", zero).alias("lines"))


# -- aggregates ---------------------------------------------------------------


@query("SELECT lang, count(*) AS n, count(DISTINCT source) AS sources, count(DISTINCT CASE WHEN n_chars > 1000 THEN source END) AS long_sources, avg(n_chars) AS mean, median(n_chars) AS median, stddev_samp(n_chars) AS sd, min(n_chars) AS least, max(n_chars) AS greatest, stddev_pop(n_chars) AS sd_pop FROM documents GROUP BY lang")
def a5_group_statistics(spark: SparkSession, d: str) -> DataFrame:
    n, docs = F.col("n_chars"), table(spark, d, "documents")
    middle = stats.quantiles(docs, "n_chars", [0.5], "lang").select(F.col("lang").alias("_lang"), F.col("q")[0].alias("median"))
    rest = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("sources"), F.count_distinct(F.when(n > 1000, F.col("source"))).alias("long_sources"), F.avg(n).alias("mean"), F.stddev_samp(n).alias("sd"), F.min(n).alias("least"), F.max(n).alias("greatest"), F.stddev_pop(n).alias("sd_pop"))
    return rest.join(middle, F.col("lang").eqNullSafe(F.col("_lang")), "left").drop("_lang")


@query("SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3, quantile_cont(value, 0.05) AS p5, quantile_cont(value, 0.95) AS p95 FROM events GROUP BY event_type")
def a6_describe(spark: SparkSession, d: str) -> DataFrame:
    return stats.quantiles(table(spark, d, "events"), "value", (0.25, 0.5, 0.75, 0.05, 0.95), "event_type").select("event_type", *(F.col("q")[i].alias(c) for i, c in enumerate(("q1", "q2", "q3", "p5", "p95"))))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source")
def a7_value_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source")


@query("SELECT user_id, sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END) AS bought, count(*) FILTER (event_type = 'error') AS errors, count(*) - count(DISTINCT event_type) AS repeats FROM events GROUP BY user_id")
def a9_conditional(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, d, "events").groupBy("user_id").agg(F.sum(F.when(kind == "purchase", F.col("value")).otherwise(0.0)).alias("bought"), F.count_if(kind == "error").alias("errors"), (F.count(F.lit(1)) - F.count_distinct(kind)).alias("repeats"))


@query("SELECT sha256(text) AS sha, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def a10_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("sha")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("SELECT conv_id, arg_max(role, (n, role)) AS speaker, max(n) AS chars FROM (SELECT conv_id, role, sum(length(text)) AS n FROM conversations GROUP BY 1, 2) GROUP BY conv_id")
def a11_talk_time(spark: SparkSession, d: str) -> DataFrame:
    talk = table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.sum(F.length("text")).alias("n"))
    return talk.groupBy("conv_id").agg(F.max_by("role", F.struct("n", "role")).alias("speaker"), F.max("n").alias("chars"))


@query("SELECT corr(l_quantity, l_extendedprice) AS q_p, corr(l_quantity, l_discount) AS q_d, corr(l_extendedprice, l_tax) AS p_t FROM lineitem")
def a13_pearson(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").agg(F.corr("l_quantity", "l_extendedprice").alias("q_p"), F.corr("l_quantity", "l_discount").alias("q_d"), F.corr("l_extendedprice", "l_tax").alias("p_t"))


_RANK = "rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0"


@query(f"SELECT l_returnflag, count(*) AS n, corr(rx, ry) AS rho FROM (SELECT l_returnflag, {_RANK.format(by='l_returnflag', c='l_quantity')} AS rx, {_RANK.format(by='l_returnflag', c='l_extendedprice')} AS ry FROM lineitem) GROUP BY l_returnflag")
def a14_spearman(spark: SparkSession, d: str) -> DataFrame:
    return stats.spearman(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag").drop("p")


@query()
def n2_spearman_p(spark: SparkSession, d: str) -> DataFrame:
    """Spearman's rho with p by Student's law (no SQL function gives it; tested by brute force)."""
    out = stats.spearman(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag")
    return out.select("l_returnflag", "n", "rho", "p", stats.stars(F.col("p")).alias("stars"))


@query("SELECT o_orderpriority, corr(mean_price, y) AS r, count(*) AS years FROM (SELECT o_orderpriority, year(o_orderdate) AS y, avg(o_totalprice) AS mean_price FROM orders GROUP BY 1, 2) GROUP BY 1 HAVING count(*) > 2")
def a16_yearly_trend(spark: SparkSession, d: str) -> DataFrame:
    yearly = table(spark, d, "orders").groupBy("o_orderpriority", F.year("o_orderdate").alias("y")).agg(F.avg("o_totalprice").alias("mean_price"))
    return yearly.groupBy("o_orderpriority").agg(F.corr("mean_price", F.col("y").cast("double")).alias("r"), F.count(F.lit(1)).alias("years")).where("years > 2")


@query("SELECT label, CAST(i AS INTEGER) AS i, avg(CAST(embedding[i] AS DOUBLE)) AS mean FROM embeddings, range(1, len(embedding) + 1) t(i) GROUP BY label, i")
def a18_centroids(spark: SparkSession, d: str) -> DataFrame:
    return indices.centroids(table(spark, d, "embeddings"), "label", "embedding").select("label", F.posexplode("c").alias("p", "mean")).where(F.col("mean").isNotNull()).select("label", (F.col("p") + 1).alias("i"), "mean")


@query("SELECT lang, count(*) AS n, sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS weight FROM documents GROUP BY lang")
def a19_class_weights(spark: SparkSession, d: str) -> DataFrame:
    return stats.class_weights(table(spark, d, "documents"), "lang")


@query("""WITH p AS (SELECT toxic AS t, 1 - quality AS g FROM labels), l AS (SELECT DISTINCT t AS label FROM p UNION SELECT DISTINCT g FROM p),
c AS (SELECT label, (SELECT count(*) FROM p WHERE t = label AND g = label) AS tp, (SELECT count(*) FROM p WHERE t = label) AS support, (SELECT count(*) FROM p WHERE g = label) AS guessed FROM l)
SELECT label, support, guessed, CASE WHEN guessed > 0 THEN tp / guessed ELSE 0.0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall, CASE WHEN guessed + support > 0 THEN 2 * tp / (guessed + support) ELSE 0.0 END AS f1 FROM c""")
def a20_f_scores(spark: SparkSession, d: str) -> DataFrame:
    return stats.f_scores(table(spark, d, "labels").select("toxic", (1 - F.col("quality")).alias("guess")), "toxic", "guess")


@query("SELECT source, count(*) AS k, CASE WHEN count(*) > 1 THEN -sum(p * ln(p)) / ln(count(*)) ELSE 0.0 END AS entropy FROM (SELECT source, lang, count(*) / sum(count(*)) OVER (PARTITION BY source) AS p FROM documents GROUP BY source, lang) GROUP BY source")
def a23_entropy(spark: SparkSession, d: str) -> DataFrame:
    return stats.entropy(table(spark, d, "documents"), "lang", "source")


@query("SELECT event_type, stddev_pop(value) / avg(value) AS cv_pop, stddev_samp(value) / avg(value) AS cv_samp, max(value) / min(value) AS ratio, max(value) - min(value) AS span, count(*) / (SELECT count(*) FROM events) AS share FROM events GROUP BY event_type")
def a24_variation(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    own = table(spark, d, "events").groupBy("event_type").agg(stats.ratio(F.stddev_pop(v), F.avg(v)).alias("cv_pop"), stats.ratio(F.stddev_samp(v), F.avg(v)).alias("cv_samp"), stats.ratio(F.max(v), F.min(v)).alias("ratio"), (F.max(v) - F.min(v)).alias("span"), F.count(F.lit(1)).alias("n"))
    return own.withColumn("share", F.col("n") / own.agg(F.sum("n")).scalar()).drop("n")


@query("SELECT l_returnflag, 3 / 2.0 * (1 - (var_samp(a) + var_samp(b) + var_samp(c)) / var_samp(a + b + c)) AS alpha FROM (SELECT l_returnflag, l_quantity / 50 AS a, l_discount * 10 AS b, l_tax * 12 AS c FROM lineitem) GROUP BY l_returnflag")
def a25_cronbach(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").select("l_returnflag", (F.col("l_quantity") / 50).alias("a"), (F.col("l_discount") * 10).alias("b"), (F.col("l_tax") * 12).alias("c"))
    return stats.cronbach(items, ["a", "b", "c"], "l_returnflag")


@query("SELECT l_linestatus, abs(avg(CASE WHEN l_returnflag = 'A' THEN l_discount END) - avg(CASE WHEN l_returnflag = 'N' THEN l_discount END)) AS gap, avg(CASE WHEN l_returnflag = 'A' THEN l_discount END) > avg(CASE WHEN l_returnflag = 'N' THEN l_discount END) AS as_expected FROM lineitem GROUP BY l_linestatus")
def a27_gap(spark: SparkSession, d: str) -> DataFrame:
    mean = lambda flag: F.avg(F.when(F.col("l_returnflag") == flag, F.col("l_discount")))
    return table(spark, d, "lineitem").groupBy("l_linestatus").agg(F.abs(mean("A") - mean("N")).alias("gap"), (mean("A") > mean("N")).alias("as_expected"))


# -- windows, order, sets -----------------------------------------------------


@query("SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS INTEGER) AS n, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn), turn + 1) AS next_turn, first_value(role) OVER (PARTITION BY conv_id ORDER BY turn) AS opener FROM conversations")
def w1_running(spark: SparkSession, d: str) -> DataFrame:
    whole = W.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", F.row_number().over(W.partitionBy("conv_id", "role").orderBy("turn")).alias("n"), F.coalesce(F.lead("turn").over(whole), F.col("turn") + 1).alias("next_turn"), F.first("role", True).over(whole).alias("opener"))


@query("SELECT user_id, date_trunc('second', ts) - to_seconds(CAST(epoch(date_trunc('second', ts)) AS BIGINT) % 5) AS start, count(*) AS n, avg(value) AS mean FROM events GROUP BY 1, 2")
def w8_five_seconds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id", F.window("ts", "5 seconds").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "mean")


@query("SELECT event_id, (value - min(value) OVER p) / (max(value) OVER p - min(value) OVER p + 1e-9) AS scaled, CASE WHEN count(value) OVER p > 5 THEN (value - avg(value) OVER p) / stddev_samp(value) OVER p END AS z FROM events WINDOW p AS (PARTITION BY event_type)")
def w9_scaling(spark: SparkSession, d: str) -> DataFrame:
    # Group figures are summed up first and joined back: no window holds a whole group.
    ev = table(spark, d, "events")
    own = ev.groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("m"), F.stddev_samp("value").alias("s"), F.count("value").alias("n"))
    return ev.join(own, "event_type").select("event_id", ((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-9)).alias("scaled"), F.when(F.col("n") > 5, (F.col("value") - F.col("m")) / F.col("s")).alias("z"))


@query(f"SELECT event_id, {_RANK.format(by='event_type', c='value')} AS rank, count(*) OVER (PARTITION BY event_type, value) AS ties FROM events")
def w11_average_ranks(spark: SparkSession, d: str) -> DataFrame:
    return stats.average_ranks(table(spark, d, "events"), "value", "event_type").select("event_id", "rank", "ties")


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS k FROM documents) WHERE k <= 50")
def w12_seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    return R.sample_per_group(table(spark, d, "documents").select("doc_id", "lang"), "lang", 50)


@query("SELECT label, CAST(rank() OVER (ORDER BY icm) AS INTEGER) AS place, icm FROM (SELECT label, 0.4 * avg(embedding[1]) + 0.4 * avg(embedding[2]) + 0.2 * avg(embedding[3]) AS icm FROM embeddings GROUP BY label)")
def w14_rank(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    per = table(spark, d, "embeddings").groupBy("label").agg(indices.tri_channel(F.avg(e[0].cast("double")), F.avg(e[1].cast("double")), F.avg(e[2].cast("double"))).alias("icm"))
    # The first of equal places: the mean rank less half of the others.
    return stats.average_ranks(per, "icm").select("label", (F.col("rank") - (F.col("ties") - 1) / 2).cast("int").alias("place"), "icm")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def o1_top_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("SELECT doc_id, 'documents' AS src, CAST(length(text) AS INTEGER) AS n, lang FROM documents UNION ALL SELECT item_id, 'benchmark', CAST(length(text) AS INTEGER), NULL FROM benchmark")
def u1_union(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.lit("documents").alias("src"), F.length("text").alias("n"), "lang")
    return docs.unionByName(table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit("benchmark").alias("src"), F.length("text").alias("n")), allowMissingColumns=True)


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def u4_except(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").distinct().join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


# -- views, audit, governance -------------------------------------------------


@query("SELECT r_name, count(DISTINCT c_custkey) AS customers, count(DISTINCT o_orderkey) AS orders, min(year(o_orderdate)) AS first_year, max(year(o_orderdate)) AS last_year FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey WHERE r_name <> 'ASIA' GROUP BY r_name")
def d2_corpus_summary(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_distinct("o_orderkey").alias("n"), F.min(F.year("o_orderdate")).alias("a"), F.max(F.year("o_orderdate")).alias("b"))
    customers = table(spark, d, "customer").select("c_custkey", "c_nationkey").join(orders, "c_custkey", "left")
    nations = table(spark, d, "nation").join(customers, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    regions = table(spark, d, "region").where("r_name <> 'ASIA'").join(nations, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return regions.groupBy("r_name").agg(F.count_distinct("c_custkey").alias("customers"), F.coalesce(F.sum("n"), F.lit(0)).alias("orders"), F.min("a").alias("first_year"), F.max("b").alias("last_year"))


@query("""SELECT 'lines without order' AS check, CASE WHEN n > 0 THEN 'ERROR' ELSE 'OK' END AS severity, n FROM (SELECT count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))
UNION ALL SELECT 'orders without customer', CASE WHEN n > 0 THEN 'ERROR' ELSE 'OK' END, n FROM (SELECT count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))
UNION ALL SELECT 'labels without document', CASE WHEN n > 0 THEN 'ERROR' ELSE 'OK' END, n FROM (SELECT count(*) AS n FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))
UNION ALL SELECT 'repeated lines', CASE WHEN n > 0 THEN 'ERROR' ELSE 'OK' END, n FROM (SELECT count(*) AS n FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1))""")
def q1_integrity(spark: SparkSession, d: str) -> DataFrame:
    t = lambda name: table(spark, d, name)
    refs = audit.references([("lines without order", t("lineitem"), t("orders"), "l_orderkey", "o_orderkey"), ("orders without customer", t("orders"), t("customer"), "o_custkey", "c_custkey"), ("labels without document", t("labels"), t("documents"), "doc_id", "doc_id")])
    return refs.unionByName(audit.duplicates(t("lineitem"), ["l_orderkey", "l_linenumber"], "repeated lines"))


@query("SELECT 'l_discount' AS code, min(l_discount) AS least, max(l_discount) AS greatest, count(*) FILTER (l_discount IS NULL) AS nulls, count(*) FILTER (l_discount < 0 OR l_discount > 0.05) AS outside FROM lineitem UNION ALL SELECT 'l_tax', min(l_tax), max(l_tax), count(*) FILTER (l_tax IS NULL), count(*) FILTER (l_tax < 0 OR l_tax > 1) FROM lineitem")
def q2_bounds(spark: SparkSession, d: str) -> DataFrame:
    return audit.bounds(table(spark, d, "lineitem"), {"l_discount": (0.0, 0.05), "l_tax": (0.0, 1.0)})


@query("""WITH e(l_returnflag, expected) AS (VALUES ('A', 25.5), ('N', 30.0), ('X', 1.0)), o AS (SELECT l_returnflag, avg(l_quantity) AS observed FROM lineitem GROUP BY 1)
SELECT l_returnflag, CAST(expected AS DOUBLE) AS expected, observed, CASE WHEN observed IS NULL THEN 'MISSING' WHEN abs(observed - expected) <= 0.25 THEN 'OK' ELSE 'OFF' END AS status FROM e LEFT JOIN o USING (l_returnflag)""")
def q5_golden(spark: SparkSession, d: str) -> DataFrame:
    expected = spark.createDataFrame([("A", 25.5), ("N", 30.0), ("X", 1.0)], "l_returnflag string, expected double")
    observed = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.avg("l_quantity").alias("observed"))
    return audit.golden(observed, expected, ["l_returnflag"], 0.25)


@query("""WITH f AS (SELECT event_type, count(*) AS n, avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END) AS rate, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS hits FROM events GROUP BY 1), t AS (SELECT sum(hits) / sum(n) AS p FROM f)
SELECT max(rate) - min(rate) AS span, stddev_pop(rate) / avg(rate) AS cv, sum(power(hits - n * p, 2) / (n * p) + power(n - hits - n * (1 - p), 2) / (n * (1 - p))) AS chi2 FROM f, t""")
def v2_rate_bias(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("hits")).withColumn("rate", F.col("hits") / F.col("n"))
    p = per.agg(F.sum("hits") / F.sum("n")).scalar()
    per = per.withColumn("e", F.col("n") * p)
    chi = F.pow(F.col("hits") - F.col("e"), F.lit(2.0)) / F.col("e") + F.pow(F.col("hits") - F.col("e"), F.lit(2.0)) / (F.col("n") - F.col("e"))
    return per.withColumn("chi", chi).agg((F.max("rate") - F.min("rate")).alias("span"), (F.stddev_pop("rate") / F.avg("rate")).alias("cv"), F.sum("chi").alias("chi2"))


@query("SELECT l_returnflag, l_linestatus, CASE WHEN p * i >= 12 THEN 'HIGH' WHEN p * i >= 6 THEN 'MEDIUM' ELSE 'LOW' END AS bucket, CASE WHEN s >= 0.75 THEN 'HIGH' WHEN s >= 0.55 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM (SELECT l_returnflag, l_linestatus, round(avg(l_linenumber)) AS p, round(avg(l_discount) * 60) AS i, avg(CASE WHEN l_tax > 0.02 THEN 1.0 WHEN l_tax = 0 THEN 0.5 ELSE 0.0 END) AS s FROM lineitem GROUP BY 1, 2)")
def v8_risk_levels(spark: SparkSession, d: str) -> DataFrame:
    tax = F.col("l_tax")
    per = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.avg("l_linenumber")).alias("p"), F.round(F.avg("l_discount") * 60).alias("i"), F.avg(F.when(tax > 0.02, 1.0).when(tax == 0, 0.5).otherwise(0.0)).alias("s"))
    return per.select("l_returnflag", "l_linestatus", audit.risk(F.col("p"), F.col("i")).alias("bucket"), audit.level(F.col("s")).alias("level"))


@query("SELECT count(*) AS n, avg(CAST(quality = toxic AS INTEGER)) AS observed, (avg(quality) * avg(toxic) + (1 - avg(quality)) * (1 - avg(toxic))) AS chance, (avg(CAST(quality = toxic AS INTEGER)) - (avg(quality) * avg(toxic) + (1 - avg(quality)) * (1 - avg(toxic)))) / (1 - (avg(quality) * avg(toxic) + (1 - avg(quality)) * (1 - avg(toxic)))) AS kappa FROM labels")
def t40_kappa(spark: SparkSession, d: str) -> DataFrame:
    return stats.kappa(table(spark, d, "labels"), "quality", "toxic")


# -- indices and tests --------------------------------------------------------

_CHANNELS = "SELECT o_custkey % 25 AS entity, avg(l_quantity) AS sa, avg(l_discount) AS nv, avg(l_tax) AS rep, avg(l_extendedprice) AS y8, avg(l_linenumber) AS y9 FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1"
_SCALE = ", ".join(f"({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER () + 1e-9) AS {c}" for c in ("sa", "nv", "rep", "y8", "y9"))


@query(f"""WITH s AS (SELECT entity, {_SCALE} FROM ({_CHANNELS})), i AS (SELECT entity, 0.35 * sa + 0.35 * nv + 0.30 * (1 - rep) AS dis, 0.35 * y8 + 0.20 * y9 + 0.25 * nv + 0.20 * (1 - rep) AS iei FROM s)
SELECT *, abs(dis - iei) AS dissociation, CASE WHEN dis > iei THEN 'discursive' WHEN dis < iei THEN 'evaluative' ELSE 'none' END AS direction FROM i""")
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Composite indices of entities (customers' classes) from their lines: N13."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.expr("o_custkey % 25").alias("entity"))
    means = {"sa": "l_quantity", "nv": "l_discount", "rep": "l_tax", "y8": "l_extendedprice", "y9": "l_linenumber"}
    per = table(spark, d, "lineitem").join(orders, "l_orderkey").groupBy("entity").agg(*(F.avg(c).alias(k) for k, c in means.items()))
    return indices.composite(per, "entity")


#: Coefficients of the normal tail's approximation, as in functions.stats.
_T = "(1 / (1 + 0.5 * abs(z) / sqrt(2.0)))"
_POLY = "0.17087277"
for _c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368):
    _POLY = f"({_c} + {_T} * {_POLY})"
_NORMAL_P = f"least(1.0, 2 * 0.5 * {_T} * exp(-z * z / 2 - 1.26551223 + {_T} * {_POLY}))"


@query(f"""WITH r AS (SELECT l_linestatus AS g, l_returnflag = 'A' AS a, {_RANK.format(by='l_linestatus', c='l_discount')} AS rk, count(*) OVER (PARTITION BY l_linestatus, l_discount) AS ties FROM lineitem WHERE l_returnflag IN ('A', 'N')),
s AS (SELECT g, count(*) FILTER (a) AS n1, count(*) FILTER (NOT a) AS n2, sum(rk) FILTER (a) AS r1, sum(CAST(ties AS DOUBLE) * ties - 1) AS tie FROM r GROUP BY g),
t AS (SELECT g AS l_linestatus, n1, n2, r1 - n1 * (n1 + 1) / 2 AS u, (abs(r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2) - 0.5) / sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - tie / ((n1 + n2) * CAST(n1 + n2 - 1 AS DOUBLE)))) AS w FROM s WHERE n1 >= 5 AND n2 >= 5)
SELECT l_linestatus, n1, n2, u, w AS z, round({_NORMAL_P}, 6) AS p FROM (SELECT *, greatest(w, 0.0) AS z FROM t)""")
def n1_mann_whitney(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").where(F.col("l_returnflag").isin("A", "N"))
    return stats.mann_whitney(lines, F.col("l_returnflag") == "A", "l_discount", ["l_linestatus"]).withColumn("p", F.round("p", 6))


@query("""WITH c AS (SELECT vec_id, (1 + embedding[1]) / 2 AS v, (1 + embedding[2]) / 2 AS p, (1 + embedding[3]) / 2 AS f FROM embeddings),
i AS (SELECT vec_id, (0.40 * v + 0.35 * p + 0.25 * f) * (1 - least(2 * sqrt((power(v - (v + p + f) / 3, 2) + power(p - (v + p + f) / 3, 2) + power(f - (v + p + f) / 3, 2)) / 3), 1.0)) AS icm FROM (SELECT vec_id, CAST(v AS DOUBLE) AS v, CAST(p AS DOUBLE) AS p, CAST(f AS DOUBLE) AS f FROM c))
SELECT vec_id, round(icm, 5) AS icm, CASE WHEN icm >= 0.6 THEN 'GENUINE' WHEN icm >= 0.35 THEN 'AMBIGUOUS' ELSE 'PERFORMATIVE' END AS klass FROM i""")
def n7_congruence(spark: SparkSession, d: str) -> DataFrame:
    half = lambda i: ((1 + F.col("embedding")[i]) / 2).cast("double")
    icm = indices.congruence(half(0), half(1), half(2))
    return table(spark, d, "embeddings").select("vec_id", F.round(icm, 5).alias("icm"), indices.congruence_class(icm).alias("klass"))
