"""Line dedup by a suffix array over line ids; DataFrame operations only.

Lines get ids in the order of their hashes; lines that occur once cannot be
part of a repeated run and get none. Prefix doubling ranks the suffixes by
their first 1, 2, 4, .. lines: a distributed sort turns the pair (rank of the
suffix, rank of the suffix 2**k lines on) into the next rank, and suffixes whose
rank is nobody else's drop out. The suffixes that share their first m lines are
one longest-common-prefix interval; two ranks name it: those of the first and
of the last 2**k of the m lines. Its first copy stays; in every later copy the
lines of the run are deleted.

A run counts from `min_words` words on. Every line of a repeated run of so many
words lies in a shortest such run that starts, or one that ends, at some line of
it; so these are the intervals to look at, and their union is that of all
maximal repeated runs.

Order of copies: by document id (null first), hash of the text, line. Rows that
are equal in id and text are one document and get the same result. Null text
stays null, empty text empty; a text of which all lines go becomes empty. An empty
table gives an empty result. Other columns pass. Texts are read whole, however long.
Runs that hold a large share of all places are few; where their first copy is is
broadcast, and their places are spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .shared import checkpointed, free_shuffles, hot_from, join_keyed

#: Words that a repeated run has at least.
MIN_WORDS = 50
WORD = r"[^\x20\x09-\x0D]+"
#: Key of a document: whether it has an id, its id, hash of its text.
DOC = ["_some", "_id", "_h"]


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _keys(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    kind = docs.schema[id_col].dataType.simpleString()
    return [F.col(id_col).isNotNull().alias("_some"), F.coalesce(F.col(id_col), F.lit("0").cast(kind)).alias("_id"), F.xxhash64(text_col).alias("_h")]


def _position(pos: str = "pos") -> Column:
    return F.struct(*DOC, F.col(pos).alias("pos"))


def ranked(groups: DataFrame, by: list[str]) -> DataFrame:
    """Adds rank: the place of each (distinct) row in the order of `by`, by range partitions and their offsets."""
    dealt = checkpointed(groups.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy("_part").count().collect()  # one row per partition
    offset, at = [], 0
    for r in sorted(counts):
        offset += [F.lit(r[0]), F.lit(at)]
        at += r[1]
    if not offset:
        return dealt.drop("_part").withColumn("rank", F.lit(0).cast("long"))
    place = F.row_number().over(W.partitionBy("_part").orderBy(*by)).cast("long")
    return dealt.withColumn("rank", place + F.element_at(F.create_map(*offset), F.col("_part"))).drop("_part")


def _shortest_runs(lines: DataFrame, min_words: int) -> DataFrame:
    """start and length of the shortest runs of repeated lines with min_words words, from each line on and up to each line."""
    order = W.partitionBy(*DOC).orderBy("pos")
    runs = lines.select(*DOC, "pos", (F.col("pos") - F.row_number().over(order)).alias("seg"), "words", F.sum("words").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("upto"))
    runs = runs.select(*DOC, "seg", "pos", (F.col("upto") - F.col("words")).alias("before"), "upto")
    # Both questions are growing frames over the same rows; within a stretch (seg) a line's `before` is `upto` of the line above.
    # From a line on: the line above the first one that starts with `before` + min_words words or more; failing that, the last line, if it ends with so many.
    down = W.partitionBy(*DOC, "seg").orderBy(F.desc("before"))
    far, rest = down.rangeBetween(W.unboundedPreceding, -min_words), down.rangeBetween(W.unboundedPreceding, 0)
    end = F.coalesce(F.min("pos").over(far) - 1, F.when(F.max("upto").over(rest) >= F.col("before") + min_words, F.max("pos").over(rest)))
    runs = runs.withColumn("end", end)
    # Up to a line: the line below the last one that ends with `upto` - min_words words or less; failing that, the first line, if it starts with so few.
    up = W.partitionBy(*DOC, "seg").orderBy("upto")
    far, rest = up.rangeBetween(W.unboundedPreceding, -min_words), up.rangeBetween(W.unboundedPreceding, 0)
    start = F.coalesce(F.max("pos").over(far) + 1, F.when(F.min("before").over(rest) <= F.col("upto") - min_words, F.min("pos").over(rest)))
    runs = runs.withColumn("start", start)
    both = F.array(F.struct(F.col("pos").alias("start"), F.col("end").alias("end")), F.struct(F.col("start").alias("start"), F.col("pos").alias("end")))
    return runs.select(*DOC, F.inline(both)).where("start is not null and end is not null").distinct().select(*DOC, "start", (F.col("end") - F.col("start") + 1).alias("m"))


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Later copies of repeated runs: the document's key (see DOC), start (line, from 0), m (lines), first (where the first copy is)."""
    keyed = docs.where(F.col(text_col).isNotNull()).select(*_keys(docs, id_col, text_col), F.posexplode(_lines(F.col(text_col))).alias("pos", "line"))
    lines = keyed.select(*DOC, "pos", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"), F.regexp_count("line", F.lit(WORD)).alias("words"))
    classes = lines.groupBy("h1", "h2").agg(F.min(_position()).alias("low"), F.max(_position()).alias("high")).where("low < high").select("h1", "h2")
    ids = ranked(classes, ["h1", "h2"])
    level = checkpointed(lines.join(ids, ["h1", "h2"]).groupBy(*DOC, "pos").agg(F.first("words").alias("words"), F.first("rank").alias("rank")))
    free_shuffles(docs.sparkSession)
    runs = checkpointed(_shortest_runs(level, min_words))
    sizes = {r.m: r["count"] for r in runs.groupBy("m").count().collect()}  # one row for each length of a run
    longest = max(sizes, default=0)
    level = level.select(*DOC, "pos", "rank")
    found = None
    k = 0
    while 2**k <= longest:
        size = 2**k
        here = runs.where((F.col("m") >= size) & (F.col("m") < 2 * size))
        first, last = level.withColumnsRenamed({"pos": "start", "rank": "a"}), level.withColumnsRenamed({"pos": "tail", "rank": "b"})
        named = here.join(first, [*DOC, "start"]).withColumn("tail", F.col("start") + F.col("m") - size).join(last, [*DOC, "tail"])
        interval = named.groupBy("m", "a", "b").agg(F.min(_position("start")).alias("first"), F.max(_position("start")).alias("high"), F.count(F.lit(1)).alias("copies"))
        interval = checkpointed(interval.where("first < high").select("m", "a", "b", "first", "copies"))
        later = join_keyed(named, interval, ["m", "a", "b"], "copies", hot_from(docs.sparkSession, sum(n for m, n in sizes.items() if size <= m < 2 * size))).where(F.struct(*DOC, F.col("start").alias("pos")) > F.col("first")).select(*DOC, "start", "m", "first")
        found = later if found is None else found.unionByName(later)
        k += 1
        if 2**k > longest:
            break
        # The next rank: of the pair of this rank and the one `size` lines on, among suffixes that share it with another.
        ahead = W.partitionBy(*DOC).orderBy("pos").rangeBetween(size, size)
        pairs = level.withColumn("next", F.max("rank").over(ahead)).where("next is not null")
        groups = pairs.groupBy("rank", "next").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("rank").alias("a"), "next")
        named_next = ranked(groups, ["a", "next"])
        level = checkpointed(pairs.withColumnRenamed("rank", "a").join(named_next, ["a", "next"]).select(*DOC, "pos", "rank"))
    if found is None:
        return runs.withColumn("first", _position("start")).where("false")
    return found


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The rows with later copies of repeated runs deleted from text_col; lines_removed and lines_total (of the given text) are added."""
    runs = repeated_runs(docs, id_col, text_col, min_words)
    # Overlapping runs of a document become one stretch.
    order = W.partitionBy(*DOC).orderBy("start", "m")
    reach = F.max(F.col("start") + F.col("m")).over(order.rowsBetween(W.unboundedPreceding, -1))
    stretch = runs.select(*DOC, "start", "m").withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn("n", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    stretch = stretch.groupBy(*DOC, "n").agg(F.min("start").alias("from"), F.max(F.col("start") + F.col("m")).alias("to"))
    gone = stretch.groupBy(*DOC).agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("_gone"))
    keyed = docs.drop("lines_total", "lines_removed", *DOC).select("*", *_keys(docs, id_col, text_col))
    joined = keyed.join(gone, DOC, "left")
    lines = _lines(F.col(text_col))
    none = F.array().cast("array<struct<from:int,to:int>>")
    stretches = F.coalesce("_gone", none)
    # What stays lies between the stretches.
    froms = F.concat(F.array(F.lit(0)), F.transform(stretches, lambda s: s["to"]))
    tos = F.concat(F.transform(stretches, lambda s: s["from"]), F.array(F.size(lines)))
    kept = F.flatten(F.zip_with(froms, tos, lambda a, b: F.slice(lines, a + 1, F.greatest(b - a, F.lit(0)))))
    removed = F.aggregate(stretches, F.lit(0), lambda n, s: n + s["to"] - s["from"])
    text = F.when(F.size(stretches) == 0, F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    out = joined.withColumns({"lines_total": F.coalesce(F.when(F.col(text_col).isNotNull(), F.size(lines)), F.lit(0)), "lines_removed": F.when(F.col(text_col).isNull(), 0).otherwise(removed), "_text": text})
    return out.select(*(F.col("_text").alias(c) if c == text_col else F.col(c) for c in docs.columns if c not in ("lines_total", "lines_removed")), "lines_total", "lines_removed")
