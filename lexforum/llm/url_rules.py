"""URL filters: rules by host and path, and block decisions that reach the aliases of a URL.

A rule fits its host and all subdomains where the URL's path starts with the rule's; the
longest (host and path together, then the longer host, then allow) decides. URLs that a
redirect or a canonical link joins are one equivalence class: connected components over
these links, found by distributed star steps, carry a block to every member that no rule
allows by itself. An explicit allow holds for its own URL only; it does not clear its
aliases, or one link to an allowed page would clear a blocked site.

Links are read from the pages (`<link rel="canonical">`, `<meta http-equiv="refresh">`)
and may be given besides, as rows (from_url, to_url). Ends need not be pages: a page is
blocked that leads to a blocked URL. For this, URLs are the same where they differ only
in the letters' case of scheme and host and in what follows `#`.

Null URLs and those without `://` have an empty host and path, fit no rule, have no
links, and are allowed. Null or empty pages have no links. Repeated rows are judged each;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import checkpointed, hot_from, join_keyed

Rule = tuple[str, str, str]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules of a list go into the plan as expressions; longer lists are refused, and given as a table.
LISTED = 500


def _rest(url: Column) -> Column:
    """What follows the first ://."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def node(url: Column) -> Column:
    """The URL's own form, by which links meet: scheme and host in lower case, no fragment. Null where there is no ://."""
    scheme = F.translate(F.substring_index(url, "://", 1), UPPER, LOWER)
    return F.when(F.instr(url, "://") > 0, F.concat(scheme, F.lit("://"), host(url), F.substring_index(F.regexp_extract(_rest(url), r"(?s)^[^/?#]*(.*)$", 1), "#", 1)))


def by_list(rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the deciding one of the rules (verdict, host, path); null where none fits. Columns: host, path."""
    if len(rules) > LISTED:
        raise ValueError(f"more than {LISTED} rules are given as a table")
    fits = [
        F.when(
            ((F.col("host") == h) | F.endswith("host", F.lit("." + h))) & F.startswith("path", F.lit(p)),
            F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict")),
        )
        for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0]))
    ]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def by_table(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url, rule, verdict of distinct URLs (url, host, path) that a rule of the table (verdict, host, path) fits, by joining each host's own suffixes."""
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    each = urls.select("url", "path", F.explode(F.array_distinct(suffixes)).alias("host"))
    own = rules.select("host", F.struct(F.col("path").alias("p"), F.col("verdict").alias("v")).alias("r")).groupBy("host").agg(F.collect_set("r").alias("rs"))
    keyed = own.join(each.groupBy("host").agg(F.count(F.lit(1)).alias("n")), "host")
    met = join_keyed(each, keyed, ["host"], "n", hot_from(urls.sparkSession, each.count()))
    path_ = F.col("path")
    fitting = met.select("url", "host", F.explode(F.filter("rs", lambda r: F.startswith(path_, r["p"]))).alias("r"))
    rank = F.struct(F.length(F.concat("host", "r.p")).alias("all"), F.length("host").alias("h"), (F.col("r.v") == "allow").alias("a"))
    return fitting.groupBy("url").agg(F.max_by(F.struct(F.concat("host", "r.p").alias("rule"), F.col("r.v").alias("verdict")), rank).alias("d")).select("url", "d.rule", "d.verdict")


def _attribute(tag: Column, name: str) -> Column:
    found = F.regexp_extract(tag, rf"""(?is)[\s"']{name}\s*=\s*("([^"]*)"|'([^']*)'|([^\s>"']+))""", 1)
    return F.trim(F.replace(F.regexp_replace(found, r"""^["']|["']$""", ""), F.lit("&amp;"), F.lit("&")))


def resolved(url: Column, link: Column) -> Column:
    """The link as an absolute URL: as it is, of the same scheme (//), of the same host (/), or beside the page; dots in paths go."""
    origin = F.concat(F.substring_index(url, "://", 1), F.lit("://"), host(url))
    folder = F.regexp_extract(path(url), r"(?s)^(.*/)?", 0)
    plain = F.regexp_extract(link, r"(?s)^[^?#]*", 0)
    full = F.when(F.startswith(plain, F.lit("/")), plain).otherwise(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), plain))
    steps = F.aggregate(F.split(full, "/"), F.array().cast("array<string>"), lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.array_append(done, x)))
    beside = F.concat(origin, F.array_join(steps, "/"), F.regexp_extract(link, r"(?s)^[^?#]*(.*)$", 1))
    return F.when(link == "", None).when(F.instr(plain, "://") > 0, link).when(F.startswith(link, F.lit("//")), F.concat(F.substring_index(url, "://", 1), F.lit(":"), link)).otherwise(beside)


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """from_url, to_url of the canonical links and refreshes that pages hold."""
    rows = pages.select(F.col(url).alias("from_url"), F.col(html).alias("html")).where(F.col("html").rlike(r"(?i)canonical|http-equiv") & (F.instr("from_url", "://") > 0))
    tags = rows.select("from_url", F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<(?:link|meta)\s[^>]*>"), F.lit(0))).alias("tag"))
    canonical = F.array_contains(F.split(F.lower(_attribute(F.col("tag"), "rel")), r"\s+"), "canonical") & F.lower("tag").startswith("<link")
    refresh = (F.lower(_attribute(F.col("tag"), "http-equiv")) == "refresh") & F.lower("tag").startswith("<meta")
    leads = F.regexp_replace(F.regexp_extract(_attribute(F.col("tag"), "content"), r"(?is)^\s*[\d.]*\s*[;,]\s*url\s*=\s*(.*)$", 1), r"""^["']|["']$""", "")
    to = F.when(canonical, _attribute(F.col("tag"), "href")).when(refresh, F.trim(leads))
    return tags.select("from_url", to.alias("to")).where(F.col("to") != "").select("from_url", resolved(F.col("from_url"), F.col("to")).alias("to_url"))


def _ruled(urls: DataFrame, rules: list[Rule] | DataFrame) -> DataFrame:
    """rule and verdict beside every row (url, host, path)."""
    if not isinstance(rules, DataFrame):
        return urls.withColumn("_d", by_list(rules)).select("*", "_d.rule", "_d.verdict").drop("_d")
    found = by_table(urls.select("url", "host", "path").distinct(), rules)
    counted = found.join(urls.groupBy("url").agg(F.count(F.lit(1)).alias("n")), "url")
    return join_keyed(urls, counted, ["url"], "n", hot_from(urls.sparkSession, urls.count()), left=True).drop("n")


def judge(pages: DataFrame, rules: list[Rule] | DataFrame, redirects: DataFrame | None = None, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block) of every page. rules: (verdict, host, path), a short list or a table of any length."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url).alias("url"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    ruled = _ruled(rows, rules)
    joined = links(pages, url, html)
    if redirects is not None:
        joined = joined.unionByName(redirects.select("from_url", "to_url"))
    ends = checkpointed(joined.select(node(F.col("from_url")).alias("a"), node(F.col("to_url")).alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).distinct())
    if ends.isEmpty():
        return ruled.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))
    nodes = checkpointed(components(ends))
    named = nodes.select(F.col("node").alias("url"), "component", host(F.col("node")).alias("host"), path(F.col("node")).alias("path"))
    blocked = _ruled(named, rules).where(F.col("verdict") == "block").select("component").distinct()
    reached = nodes.join(blocked, "component", "left_semi").select(F.col("node").alias("_node"))
    # One URL may be many rows: those of frequent ones are spread.
    own = ruled.withColumn("_node", node(F.col("url")))
    counted = reached.join(own.where(F.col("_node").isNotNull()).groupBy("_node").agg(F.count(F.lit(1)).alias("n")), "_node")
    told = join_keyed(own, counted, ["_node"], "n", hot_from(pages.sparkSession, own.count()), left=True)
    return told.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(F.col("n").isNotNull(), F.lit("block")), F.lit("allow")).alias("verdict"))
