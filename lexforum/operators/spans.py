"""Pattern spans in texts: finding, weighing in context, greedy removal of overlaps, scoring."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexforum.functions.stats import scaled


@dataclass(frozen=True)
class Rule:
    """A mechanism's pattern and the weight of each hit."""

    mechanism: str
    pattern: str
    weight: float


def positions(text: Column, pattern: str) -> Column:
    """All matches as array<struct<start, end>> (code points, end exclusive), from the pieces between them."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<start:int,end:int>>")
    fold = F.aggregate(
        F.arrays_zip(gaps.alias("g"), hits.alias("h")),
        F.struct(F.lit(0).alias("at"), empty.alias("found")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["g"]) + F.coalesce(F.length(x["h"]), F.lit(0))).alias("at"),
            F.when(x["h"].isNull(), acc["found"]).otherwise(F.concat(acc["found"], F.array(F.struct((acc["at"] + F.length(x["g"])).alias("start"), (acc["at"] + F.length(x["g"]) + F.length(x["h"])).alias("end"))))).alias("found"),
        ),
    )
    return fold["found"]


def find(df: DataFrame, rules: Sequence[Rule], text: str = "text", flags: str = "(?iu)") -> DataFrame:
    """Adds spans array<struct<mechanism, weight, start, end>>, in order of rules and places."""
    def of(rule: Rule) -> Column:
        return F.transform(positions(F.col(text), flags + rule.pattern), lambda s: F.struct(F.lit(rule.mechanism).alias("mechanism"), F.lit(float(rule.weight)).alias("weight"), s["start"].alias("start"), s["end"].alias("end")))

    parts = [of(r) for r in rules]
    return df.withColumn("spans", F.coalesce(F.concat(*parts), F.array().cast("array<struct<mechanism:string,weight:double,start:int,end:int>>")))


def greedy(spans: Column, share: float = 0.5) -> Column:
    """Spans by weight, heaviest first (ties as found); one that overlaps a kept one by more than `share` of its own length goes."""
    indexed = F.transform(spans, lambda s, i: F.struct((-s["weight"]).alias("order"), i.alias("i"), s.alias("s")))
    sorted_ = F.transform(F.array_sort(indexed), lambda x: x["s"])
    overlap = lambda a, b: F.greatest(F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"]), F.lit(0))
    none = F.filter(spans, lambda s: F.lit(False))
    return F.aggregate(sorted_, none, lambda kept, c: F.when(F.exists(kept, lambda k: overlap(k, c) > share * (c["end"] - c["start"])), kept).otherwise(F.concat(kept, F.array(c))))


def in_context(df: DataFrame, trigger: str, width: int = 150, factor: float = 0.25, text: str = "text") -> DataFrame:
    """Lowers the weight of spans with a trigger within `width` characters and flags them (questioned)."""
    near = lambda s: F.substring(F.col(text), F.greatest(s["start"] - width, F.lit(0)) + 1, s["end"] - F.greatest(s["start"] - width, F.lit(0)) + width).rlike(trigger)
    return df.withColumn("spans", F.transform("spans", lambda s: F.struct(s["mechanism"].alias("mechanism"), F.when(near(s), s["weight"] * factor).otherwise(s["weight"]).alias("weight"), s["start"].alias("start"), s["end"].alias("end"), near(s).alias("questioned"))))


def sentences(text: Column, least_words: int = 3) -> Column:
    """Sentences with so many words or more."""
    # Tells whether so many words are there without counting the rest; nothing is tried twice.
    enough = rf"^\s*+(?:\S++\s++){{{max(least_words, 1) - 1}}}\S"
    pieces = F.split(text, r"(?<=[.!?])\s+")
    return F.filter(pieces, lambda s: s.rlike(enough)) if least_words > 0 else pieces


def score(df: DataFrame, low: float, high: float, text: str = "text", least_words: int = 3, least_chars: int = 20) -> DataFrame:
    """Adds n_spans, raw (weight per sentence), score (raw scaled from low .. high to 0 .. 1) and has_warning for short texts, which score 0."""
    short = F.coalesce(F.length(F.trim(text)) < least_chars, F.lit(True))
    total = F.aggregate("spans", F.lit(0.0), lambda a, s: a + s["weight"])
    raw = F.when(short, F.lit(0.0)).otherwise(total / F.greatest(F.size(sentences(F.col(text), least_words)), F.lit(1)))
    out = df.withColumn("n_spans", F.size("spans")).withColumn("raw", raw)
    return out.withColumn("score", F.when(short, F.lit(0.0)).otherwise(scaled(F.col("raw"), F.lit(low), F.lit(high)))).withColumn("has_warning", short)


def token_windows(df: DataFrame, scorer: str | Column, size: int = 400, step: int = 300, most: int | None = None, key: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """Sliding windows over a token array: key, window, token_index, token; every token is in one window at least. `most` keeps a text's first windows only (the reference: 50)."""
    n = F.size(tokens)
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step))).otherwise(F.array().cast("array<int>"))
    if most is not None:
        starts = F.slice(starts, 1, most)
    wins = df.select(key, tokens, F.posexplode(starts).alias("window", "start"))
    return wins.select(key, "window", F.posexplode(F.slice(F.col(tokens), F.col("start") + 1, size)).alias("i", "token"), "start").select(key, "window", (F.col("start") + F.col("i")).alias("token_index"), "token", F.expr(scorer).alias("token_score") if isinstance(scorer, str) else scorer.alias("token_score"))


def window_summary(windows: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, covered (rows of all windows), tokens (places in one window at least), mean of token_score: of token_windows' rows.

    Rows meet by window where they lie, so a window and not each of its tokens is shuffled; places are counted as ranges.
    """
    per = windows.groupBy(key, "window").agg(F.count(F.lit(1)).alias("n"), F.sum("token_score").alias("sum"), F.count("token_score").alias("scored"), F.min("token_index").alias("low"), (F.max("token_index") + 1).alias("high"))
    ahead = F.max("high").over(W.partitionBy(key).orderBy("low", "window").rowsBetween(W.unboundedPreceding, -1))
    fresh = F.greatest(F.col("high") - F.greatest("low", F.coalesce(ahead, "low")), F.lit(0))
    out = per.withColumn("fresh", fresh).groupBy(key).agg(F.sum("n").alias("covered"), F.sum("fresh").cast("long").alias("tokens"), F.sum("sum").alias("_sum"), F.sum("scored").alias("_n"))
    return out.select(key, "covered", "tokens", (F.col("_sum") / F.nullif(F.col("_n"), F.lit(0))).alias("mean"))


def token_labels(df: DataFrame, spans: Sequence[tuple[int, int, str]], key: str = "doc_id", text: str = "text", other: str = "O") -> DataFrame:
    """A label for every blank-separated token of the whole text: key, token_index, label. A token's first character decides, the later span wins."""
    row = df.select(key, F.monotonically_increasing_id().alias("_row"), F.split(text, " ", -1).alias("_tokens"))
    row = row.select(key, "_row", F.posexplode("_tokens").alias("token_index", "token"))
    before = W.partitionBy(key, "_row").orderBy("token_index").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("token") + 1).over(before), F.lit(0))
    label = F.coalesce(*(F.when((F.col("start") >= s) & (F.col("start") < e), F.lit(x)) for s, e, x in reversed(spans)), F.lit(other))
    return row.withColumn("start", start).select(key, "token_index", label.alias("label"))
