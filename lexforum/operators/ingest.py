"""Ingestion: cleaning with a report, metadata, segmentation, records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexforum.functions import text as T


def clean(df: DataFrame, text: str = "text", rules: Sequence[tuple[str, str]] = (), lower: bool = False) -> DataFrame:
    """Adds clean_text and cleaning_report (lengths, fixes by kind, compression ratio). Null stays null.

    Steps are columns of their own, each read more than once, so that the optimizer keeps them apart and none is worked out twice.
    """
    raw = F.col(text)
    corrections = F.coalesce("_rewritten.n", F.lit(0)) if not rules else F.col("_rewritten.n")
    out = df.withColumn("_encoded", T.lookalike_spaces(raw)).withColumn("_kept", T.drop_unprintable(F.col("_encoded"))).withColumn("_n_kept", F.length("_kept"))
    out = out.withColumn("_typed", T.plain_typography(F.col("_kept"))).withColumn("_rewritten", T.substituted(F.col("_typed"), rules)).withColumn("_fixed", F.col("_rewritten.text")).withColumn("_n_fixed", F.length("_fixed"))
    out = out.withColumn("_out", T.whitespace(F.col("_fixed"))).withColumn("_n_out", F.length("_out"))
    report = F.struct(
        F.length(raw).alias("original_length"),
        F.col("_n_out").alias("final_length"),
        corrections.cast("int").alias("ocr_corrections"),
        (T.count_of(raw, f"[{T.LOOKALIKE_SPACES}]") + F.length("_encoded") - F.col("_n_kept")).cast("int").alias("encoding_fixes"),
        (F.col("_n_fixed") - F.col("_n_out")).alias("whitespace_fixes"),
        (F.length(raw) - F.col("_n_out")).alias("chars_removed"),
        F.when(F.length(raw) > 0, F.round(1 - F.col("_n_out") / F.length(raw), 4)).otherwise(0.0).alias("compression_ratio"),
    )
    clean_text = F.lower("_out") if lower else F.col("_out")
    return out.withColumn("cleaning_report", report).withColumn("clean_text", clean_text).drop("_encoded", "_kept", "_n_kept", "_typed", "_rewritten", "_fixed", "_n_fixed", "_out", "_n_out")


def most_frequent(items: Column) -> Column:
    """The commonest item of an array; of equals the one that comes first."""
    ranked = F.transform(F.array_distinct(items), lambda x: F.struct((-F.size(F.filter(items, lambda y: y == x))).alias("n"), F.array_position(items, x).alias("at"), x.alias("x")))
    return F.try_element_at(F.array_sort(ranked), F.lit(1))["x"]


def segment_lines(df: DataFrame, headings: Sequence[tuple[str, str]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Sections by heading lines: key, section, fragment (in order), body; lines before a heading are section CUERPO."""
    lines = df.select(key, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
    label = T.first_match(F.upper(F.trim("line")), headings, "")
    lines = lines.withColumn("label", label)
    order = W.partitionBy(key).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    lines = lines.withColumn("section", F.coalesce(F.last("label", True).over(order), F.lit("CUERPO"))).withColumn("fragment", F.count("label").over(order).cast("int"))
    body = lines.where("label is null").groupBy(key, "section", "fragment").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("ls"))
    return body.select(key, "section", "fragment", F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("body")).where(F.length(F.trim("body")) > 0)


def merge_short(sections: Column, least_words: int = 20) -> Column:
    """Ordered fold over array<struct<label, body>>: a section of fewer words joins the one before it; a short first one goes; the last always stays."""
    empty = F.filter(sections, lambda s: F.lit(False))
    n = F.size(sections)
    indexed = F.transform(sections, lambda s, i: F.struct(s.alias("s"), (i == n - 1).alias("last")))

    def step(kept: Column, x: Column) -> Column:
        short = (F.size(F.split(F.trim(x["s"]["body"]), r"\s+")) < least_words) & ~x["last"]
        prior = F.try_element_at(kept, F.lit(-1))
        joined = F.concat(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))), F.array(F.struct(prior["label"].alias("label"), F.concat_ws("\n", prior["body"], x["s"]["body"]).alias("body"))))
        return F.when(~short, F.concat(kept, F.array(x["s"]))).when(F.size(kept) > 0, joined).otherwise(kept)

    return F.aggregate(indexed, empty, step)


def pack_words(text: Column, limit: int = 2000, least_words: int = 20) -> Column:
    """Blocks of words closed when their length (words and blanks) reaches `limit`; a last block of `least_words` words or fewer goes."""
    # The fold keeps numbers alone: where blocks end, how many words were seen, and the open block's length.
    start = F.struct(F.array(F.lit(0)).alias("ends"), F.lit(0).alias("i"), F.lit(0).alias("size"))

    def step(acc: Column, w: Column) -> Column:
        i, size = acc["i"] + 1, acc["size"] + F.length(w) + 1
        full = size >= limit
        return F.struct(F.when(full, F.concat(acc["ends"], F.array(i))).otherwise(acc["ends"]).alias("ends"), i.alias("i"), F.when(full, 0).otherwise(size).alias("size"))

    def cut(words: Column) -> Column:
        last = lambda acc: F.when(acc["i"] - F.element_at(acc["ends"], -1) > least_words, F.concat(acc["ends"], F.array(acc["i"]))).otherwise(acc["ends"])
        block = lambda ends: F.transform(F.slice(ends, 2, F.size(ends)), lambda end, k: F.array_join(F.slice(words, F.get(ends, k) + 1, end - F.get(ends, k)), " "))
        return T.bound(F.aggregate(words, start, step, last), block)

    return T.bound(F.filter(F.split(text, r"\s+"), lambda w: F.length(w) > 0), cut)


def upsert(existing: DataFrame, new: DataFrame, key: list[str], fill: Sequence[str] = ()) -> DataFrame:
    """Insert if absent; columns in `fill` of existing rows take the new value where theirs is empty."""
    fresh = new.drop_duplicates(key).join(existing.select(key), key, "left_anti")
    if fill:
        given = new.drop_duplicates(key).select(*key, *(F.col(c).alias(f"_{c}") for c in fill))
        filled = existing.join(given, key, "left")
        existing = filled.select(*(F.coalesce(F.nullif(F.col(c), F.lit("").cast(existing.schema[c].dataType)) if existing.schema[c].dataType.simpleString() == "string" else F.col(c), F.col(f"_{c}")).alias(c) if c in fill else F.col(c) for c in existing.columns))
    return existing.unionByName(fresh, allowMissingColumns=True)
