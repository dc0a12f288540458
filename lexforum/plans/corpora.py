"""Queries of feature jobs over corpora and of the measurement formulae, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforum.operators import features, measurement
from lexforum.sources.readers import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_COURTS = ["Corte Suprema · Sala Penal", "CE · Sección Tercera", "JEP", None]
_NAMES = ["Hechos", "cargo-unico", "ANTECEDENTES", "HECHOS Y CONDUCTAS"]


def _documents(spark: SparkSession, d: str) -> DataFrame:
    """Every text as a document of two sections, the whole text and its first line; each seventh calls itself B, each eleventh could not be read."""
    k, pick = F.col("doc_id"), lambda xs, i: F.element_at(F.array(*(F.lit(x).cast("string") for x in xs)), (i + 1).cast("int"))
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    section = lambda name, target, text: F.struct(name.alias("section_id"), target.alias("is_target"), F.trim(text).alias("text"))
    sections = F.array(section(pick(_NAMES, k % 4), k % 5 == 0, F.col("text")), section(pick(_NAMES, (k + 1) % 4), F.lit(False), first))
    bad = k % 11 == 0
    return table(spark, d, "documents").select(
        k.cast("string").alias("file"), F.concat(F.lit("SP"), k.cast("string"), F.lit("-"), (1990 + k % 30).cast("string")).alias("doc_id"), F.when(k % 7 == 0, "B").otherwise("A").alias("kind"),
        pick(_COURTS, k % 4).alias("tribunal"), F.when(k % 3 == 0, F.concat((1995 + k % 20).cast("string"), F.lit("-03-01"))).alias("date"), F.when(~bad, sections).alias("sections"), F.when(bad, "json_read_error").alias("error"),
    )


def _sql(i: str, name: str) -> str:
    return f"[{', '.join('NULL' if x is None else repr(x) for x in name)}][({i}) % {len(name)} + 1]"


_DOCS = f"""d AS (SELECT doc_id AS k, text, {_sql('doc_id', _COURTS)} AS tribunal, CASE WHEN doc_id % 3 = 0 THEN 1995 + doc_id % 20 ELSE 1990 + doc_id % 30 END AS y, doc_id % 7 = 0 AS b FROM documents WHERE doc_id % 11 <> 0),
c AS (SELECT *, 'SP' || k || '-' || (1990 + k % 30) AS doc, CASE WHEN b THEN CASE WHEN tribunal LIKE '%CE%' THEN 'A-CE' ELSE 'A-CSJ' END WHEN tribunal LIKE 'Corte Suprema%' THEN 'A-CSJ' WHEN tribunal = 'JEP' THEN 'B' ELSE 'A-CSJ' END AS told, y AS year FROM d),
x AS (SELECT k, doc, CASE WHEN told = 'B' THEN CASE WHEN tribunal LIKE '%CE%' THEN 'A-CE' ELSE 'A-CSJ' END ELSE told END AS corpus_type, CASE WHEN b OR told = 'B' THEN 0 ELSE CASE told WHEN 'A-CE' THEN 0 ELSE 1 END END AS y5, year, (least(greatest(year, 1994), 2023) - 1994) / 29.0 AS y6, text, tribunal FROM c)"""


@query(f"""WITH {_DOCS}, s AS (SELECT *, 0 AS place, {_sql('k', _NAMES)} AS section_id, k % 5 = 0 AS t, trim(text) AS body FROM x UNION ALL SELECT *, 1, {_sql('k + 1', _NAMES)}, false, trim(split_part(text, chr(10), 1)) FROM x)
SELECT CAST(k AS VARCHAR) AS file, place, doc AS doc_id, corpus_type, year, CAST(y5 AS INTEGER) AS y5_corpus_type, CAST(y6 AS DOUBLE) AS y6_period, section_id, body AS text FROM s WHERE (t OR section_id IN ('Hechos', 'cargo-unico')) AND length(body) >= 30""")
def t29_target_sections(spark: SparkSession, d: str) -> DataFrame:
    """Target sections of a corpus with their document's context; what calls itself B in A is put right."""
    return features.targets(_documents(spark, d), "A")


@query(f"WITH {_DOCS} SELECT doc AS doc_id, CAST(y5 AS DOUBLE) AS y5, CAST(y6 AS DOUBLE) AS y6 FROM x")
def t27_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Contexts of documents as a matrix, here by columns."""
    rows = features.feature_matrix(features.contexts(_documents(spark, d).where("error is null"), "A"))
    return rows.select("doc_id", F.col("features")[0].alias("y5"), F.col("features")[1].alias("y6"))


@query(f"WITH {_DOCS} SELECT corpus_type, count(*) AS n FROM x GROUP BY corpus_type")
def t27_distribution(spark: SparkSession, d: str) -> DataFrame:
    return features.distribution(features.contexts(_documents(spark, d).where("error is null"), "A"))


@query()
def t29_feature_job(spark: SparkSession, d: str) -> DataFrame:
    """Feature rows of the target sections of corpora A and B, whole sections (tested against feature rows of single sections)."""
    docs = _documents(spark, d)
    return features.section_features(docs, "A", most_chars=None).unionByName(features.section_features(docs, "B", most_chars=None))


@query()
def t29_summary(spark: SparkSession, d: str) -> DataFrame:
    """Indicators of corpus A described (tested against plain statistics of the rows)."""
    out = features.summary(features.section_features(_documents(spark, d), "A", most_chars=None))
    return out.select("corpus", "indicator", "n", *(F.round(c, 8).alias(c) for c in ("mean", "std", "min", "max")))


_DOUBLES = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"


@query(f"""WITH p AS (SELECT label, list(m ORDER BY i) AS pole FROM (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, len(embedding) + 1) t(i) WHERE label IN (0, 1) GROUP BY label, i) GROUP BY label)
SELECT vec_id, round((1 - list_cosine_similarity({_DOUBLES}, (SELECT pole FROM p WHERE label = 0))) / 2, 8) AS y8_distance, round(1 - (1 - list_cosine_similarity({_DOUBLES}, (SELECT pole FROM p WHERE label = 1))) / 2, 8) AS y11_convergence FROM embeddings""")
def t35_poles(spark: SparkSession, d: str) -> DataFrame:
    """Halved distance from one pole, convergence towards another: means of two classes."""
    from lexforum.operators import indices

    vectors = table(spark, d, "embeddings")
    named = None
    for name in (0, 1):
        one = indices.centroids(vectors.where(F.col("label") == name), None, "embedding").toDF("vector").select(F.lit(str(name)).alias("name"), "vector")
        named = one if named is None else named.unionByName(one)
    out = measurement.poles(vectors, named, "embedding", {"y8_distance": ("0", False), "y11_convergence": ("1", True)})
    return out.select("vec_id", *(F.round(c, 8).alias(c) for c in ("y8_distance", "y11_convergence")))


@query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS w FROM documents), c AS (SELECT w, count(*) AS n FROM w GROUP BY w), s AS (SELECT sum(n) AS n FROM c)
SELECT doc_id, round(avg(-ln(c.n / s.n)), 6) AS surprisal, round((avg(-ln(c.n / s.n)) - 3.82) / 1.14, 6) AS y7_surprisal FROM w JOIN c USING (w), s GROUP BY doc_id""")
def t35_surprisal(spark: SparkSession, d: str) -> DataFrame:
    """Surprisal of texts under the corpus' own words, from log probabilities of tokens."""
    tokens = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("w"))
    rows = measurement.own_log_probs(tokens, "w")
    return measurement.mean_surprisal(rows).select("doc_id", *(F.round(c, 6).alias(c) for c in ("surprisal", "y7_surprisal")))


@query("SELECT l_orderkey, l_linenumber, round((0.4 / greatest(l_quantity / 10, 0.1) + (1 - l_tax * 100 / 10.0) * 0.4 + l_discount * 0.2 - 0.52) / 0.18, 8) AS y12 FROM lineitem")
def t35_acoustic(spark: SparkSession, d: str) -> DataFrame:
    """The acoustic score, columns of lines standing for rate, voiced segments and loudness."""
    y12 = measurement.acoustic(F.col("l_quantity") / 10, F.col("l_tax") * 100, F.col("l_discount"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(y12, 8).alias("y12"))
