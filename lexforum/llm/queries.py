"""The registered queries of this subpackage, op1 to op13, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, filtering_lloyd, hnsw, jaccard, kdtree, langid, line_dedup, packing, pitman_yor, secrets, toxicity, turn_repair, url_rules
from .shared import prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = secrets.scan(table(spark, sf_dir, "documents"))
    text = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    joined = lambda part: F.array_join(F.transform(part, text), ",")
    base = F.filter("spans", lambda x: x["kind"] != "learned")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return spans.select("doc_id", *map(count, ("assign", "access", "hex", "learned")), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    return pitman_yor.score(table(spark, sf_dir, "documents"), held_out)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(table(spark, sf_dir, "documents")).select("doc_id", "lines_total", "lines_removed", "text")


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(table(spark, sf_dir, "embeddings"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.top_k(table(spark, sf_dir, "embeddings"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # The labels hold two grades: 0 not toxic, 1 toxic.
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), F.col("toxic"))
    return toxicity.score(docs, model)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    filters = langid.train(docs)
    return langid.predict(docs.select("doc_id", "text"), filters).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents")).drop("set_name")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtering_lloyd.summary(table(spark, sf_dir, "embeddings"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair(turn_repair.damaged(table(spark, sf_dir, "conversations")))


#: verdict, host, path.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), RULES)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_secret_scan, op2_lm_scoring, op3_line_dedup, op4_nearest_neighbours, op5_bpe, op6_toxicity, op7_exact_top_k, op8_language_id, op9_best_fit_packing, op10_jaccard_join, op11_vector_codes, op12_conversation_repair, op13_url_filters)}


def _codes_sql(entries: int = 256, rounds: int = 4) -> str:
    """Lloyd's rounds one after the other, every part held against every entry."""
    ctes = [
        """kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "parts AS MATERIALIZED (SELECT vec_id, label, p, w[p * (len(w) // 4) + 1 : (p + 1) * (len(w) // 4)] AS x FROM kept, range(4) t(p))",
        f"b0 AS (SELECT * FROM (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id, x) - 1 AS k, x AS z FROM parts) WHERE k < {entries})",
    ]
    for r in range(rounds + 1):
        near = f"min(CAST(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - z[i]) * (x[i] - z[i]))) AS BIGINT) * {entries} + k)"
        ctes.append(f"a{r} AS MATERIALIZED (SELECT vec_id, label, p, x, {near} AS m FROM parts JOIN b{r} USING (p) GROUP BY vec_id, label, p, x)")
        if r < rounds:
            ctes.append(f"s{r} AS (SELECT p, m % {entries} AS k, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS v FROM a{r}, range(1, len(x) + 1) t(i) GROUP BY ALL)")
            ctes.append(f"n{r} AS (SELECT p, k, list(v ORDER BY i) AS z FROM s{r} GROUP BY p, k)")
            ctes.append(f"b{r + 1} AS MATERIALIZED (SELECT b.p, b.k, coalesce(n.z, b.z) AS z FROM b{r} b LEFT JOIN n{r} n ON b.p = n.p AND b.k = n.k)")
    ctes.append(f"e AS (SELECT vec_id, label, string_agg(printf('%02x', m % {entries}), '' ORDER BY p) AS code, CAST(sum(m // {entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id, label)")
    ctes.append(f"h AS (SELECT sha256(string_agg(array_to_string(z, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM b{rounds})")
    return "WITH " + ",\n".join(ctes) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e, h"


def _repair_sql() -> str:
    """For each row, the best way to each of four states: cost, audit, byte 1, repaired text, as one string whose order is cost, then audit."""
    none = "'999999'"
    plus = lambda s, cost, letter, line="": f"CASE WHEN {s} = {none} THEN {none} ELSE printf('%06d', CAST(left({s}, 6) AS INT) + {cost}) || replace(substr({s}, 7), chr(1), '{letter}' || chr(1))" + (f" || {line} || chr(10)" if line else "") + " END"
    state = lambda i: f"a[{i}]"
    stay = "(CASE WHEN r.fault = 3 THEN 5 ELSE 0 END)"
    free = "r.fault IN (0, 3)"

    def moved(i: int, before: list[int], name: str) -> str:
        ways = [plus(state(i), 2, "D")]
        for b in before:
            ways.append(f"CASE WHEN {free} AND left(r.role, 1) = '{name[0]}' THEN {plus(state(b), stay, 'K', 'r.role || chr(58) || r.text')} ELSE {none} END")
            if name[0] != "s":
                ways.append(f"CASE WHEN {free} THEN {plus(state(b), stay + ' + 1', 'R', f"'{name}' || chr(58) || r.text")} ELSE {none} END")
        return f"least({', '.join(ways)})"

    def inserted(listed: str) -> str:
        user = ", ".join(plus(state(b), 5, "I", "'user:'") for b in (1, 2, 4))
        return f"list_transform([{listed}], lambda a: [a[1], a[2], least(a[3], {user}), least(a[4], {plus(state(3), 5, 'I', "'assistant:'")})])[1]"

    step = f"[{moved(1, [], ' ')}, {moved(2, [1], 'system')}, {moved(3, [1, 2, 4], 'user')}, {moved(4, [3], 'assistant')}]"
    start = f"['000000' || chr(1), {none}, {none}, {none}]"
    for _ in range(2):
        start, step = inserted(start), inserted(step)
    bits = "list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, length(s) + 1), lambda i: [ascii(s[i]), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)"
    return f"""
WITH d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s FROM conversations),
c AS (SELECT *, xor({bits}, 4294967295) % 20 AS code FROM d),
m AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE WHEN code = 1 THEN '' WHEN code = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
      unnest(CASE WHEN code = 0 THEN [] WHEN code = 3 THEN [0, 1] ELSE [0] END) AS copy FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos FROM m),
f AS (SELECT *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS again, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || left(role, 1) AS pair FROM o),
g AS (SELECT *, CASE WHEN t = '' THEN 1 WHEN again > 1 THEN 2 WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM f),
r AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
      count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal, list({{'w': CAST(NULL AS VARCHAR[]), 'role': role, 'text': text, 'fault': fault}} ORDER BY pos) AS rows FROM g GROUP BY conv_id),
w AS (SELECT *, list_reduce(list_prepend({{'w': {start}, 'role': '', 'text': '', 'fault': 0}}, rows), lambda q, r: {{'w': list_transform([q.w], lambda a: {step})[1], 'role': '', 'text': '', 'fault': 0}}).w AS w FROM r),
b AS (SELECT *, least(w[1], w[4]) AS best FROM w),
n AS (SELECT *, strpos(best, chr(1)) AS cut FROM b)
SELECT DISTINCT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal,
       CAST(coalesce(CAST(left(best, 6) AS INT), 0) AS BIGINT) AS cost, coalesce(substr(best, 7, cut - 7), '') AS audit, sha256(coalesce(CASE WHEN cut < length(best) THEN substr(best, cut + 1, length(best) - cut - 1) ELSE '' END, '')) AS repaired_sha256
FROM c LEFT JOIN n ON c.conv_id IS NOT DISTINCT FROM n.conv_id"""


def _url_sql() -> str:
    fits = [(v, h, p, f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')") for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))]
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{h}{p}'" for _, h, p, c in fits) + " END AS rule"
    own = "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for v, _, _, c in fits) + " END AS own"
    split = "translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path"
    return f"""
WITH RECURSIVE p AS (SELECT page_id, url, html, coalesce(CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END, '') AS rest FROM pages),
j AS (SELECT *, {rule}, {own}, regexp_extract(url, '^[^#]*') AS node FROM (SELECT *, {split} FROM p)),
t AS (SELECT node, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\\s[^>]*>')) AS tag FROM j),
l AS (SELECT node AS a, CASE WHEN regexp_matches(tag, '(?i)rel\\s*=\\s*"?canonical') THEN regexp_extract(tag, '(?i)href\\s*=\\s*"([^"#]*)', 1) WHEN regexp_matches(tag, '(?i)http-equiv\\s*=\\s*"?refresh') THEN regexp_extract(tag, '(?i)url\\s*=\\s*([^"#]*)', 1) END AS b FROM t),
e AS (SELECT a, b FROM l WHERE contains(b, '://') UNION SELECT b, a FROM l WHERE contains(b, '://')),
n AS (SELECT b AS url, *, {own} FROM (SELECT *, {split} FROM (SELECT DISTINCT b, substr(b, strpos(b, '://') + 3) AS rest FROM e))),
r(node) AS (SELECT url FROM n WHERE own = 'block' UNION SELECT e.b FROM r JOIN e ON r.node = e.a)
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN node IN (SELECT node FROM r) THEN 'block' ELSE 'allow' END) AS verdict FROM j"""


ORACLES: dict[str, str] = {
    "op11_vector_codes": _codes_sql(),
    "op12_conversation_repair": _repair_sql(),
    "op13_url_filters": _url_sql(),
    # All runs of 50 words or more that are shortest from their first or up to their last line; of equal ones all but the first go.
    "op3_line_dedup": """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i AS pos, ls[i] AS line, len(regexp_extract_all(ls[i], '[^ \\t\\n\\x0B\\f\\r]+')) AS w FROM d, range(1, len(ls) + 1) t(i)),
c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM l),
fw AS (SELECT a.doc_id, a.pos AS s, min(b.pos) AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.upto - a.upto + a.w >= 50 GROUP BY 1, 2),
bw AS (SELECT b.doc_id, max(a.pos) AS s, b.pos AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.upto - a.upto + a.w >= 50 GROUP BY 1, 3),
r AS (SELECT * FROM fw UNION SELECT * FROM bw),
n AS (SELECT r.doc_id, s, e, array_to_string(d.ls[s:e], chr(10)) AS body FROM r JOIN d USING (doc_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY body, e - s ORDER BY doc_id, s) AS k FROM n),
g AS (SELECT DISTINCT o.doc_id, l.pos FROM o JOIN l ON o.doc_id = l.doc_id AND l.pos BETWEEN o.s AND o.e WHERE k > 1)
SELECT l.doc_id, CAST(count(*) AS INTEGER) AS lines_total, CAST(count(g.pos) AS INTEGER) AS lines_removed,
       coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL), '') AS text
FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id""",
    "op7_exact_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.w) + 1), lambda i: q.w[i] * c.w[i])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.w) = len(c.w)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
}
