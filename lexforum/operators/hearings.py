"""Hearings: transcripts found by their start, windows of channels laid over segments, channels side by side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforum.operators import indices
from lexforum.operators import testimony as E

#: Weights of the second verbal score (the first one, the share of victims' words).
VERBAL = (0.6, 0.4)


def tenths(seconds: Column) -> Column:
    """Seconds with one decimal, as keys of transcripts have them: the exact value of the double is rounded, a tie to the even tenth."""
    x = F.abs(seconds.cast("double"))
    # 8x and 2x are exact, and so is what their sum leaves out: it decides where the rounded sum is a half.
    whole = 8 * x + 2 * x
    rest = 2 * x - (whole - 8 * x)
    half = whole - F.floor(whole) == 0.5
    t = F.when(half & (rest > 0), F.ceil(whole)).when(half & (rest < 0), F.floor(whole)).otherwise(F.rint(whole).cast("long"))
    return F.concat(F.when(seconds < 0, "-").otherwise(""), F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"))


def with_transcript(segments: DataFrame, transcripts: DataFrame, hearing: str = "hearing", start: str = "start") -> DataFrame:
    """Segments with `text`, the transcript's entry for their start (a key of one decimal); empty where there is none.

    transcripts: hearing, key, text; of entries of one key the largest text counts. Segments without a hearing or a start have no text.
    """
    one = transcripts.groupBy(F.col(hearing).alias("_h"), F.col("key").alias("_k")).agg(F.max("text").alias("text"))
    out = segments.drop("text").withColumn("_key", tenths(F.col(start))).join(one, (F.col(hearing) == F.col("_h")) & (F.col("_key") == F.col("_k")), "left")
    return out.withColumn("text", F.coalesce("text", F.lit(""))).drop("_h", "_k", "_key")


def overlapping(left: DataFrame, right: DataFrame, by: Sequence[str], width: float = 30.0) -> DataFrame:
    """Pairs of rows of both sides whose [start, end) overlap, with `overlap`, their common time.

    A row goes to each cell of `width` it touches, and a pair counts in the cell where the later one starts: cells spread a
    long hearing over tasks, and no pair comes twice. Rows with nulls in keys or times, or that end at or before their
    start, take no part. Columns of the right side beside `by` need other names than those of the left side, but for start and end.
    """
    cell = lambda t: F.floor(t / float(width)).cast("long")

    def dealt(df: DataFrame) -> DataFrame:
        # The last cell touched is that of the last instant before the end.
        last = F.when(F.col("end") == cell(F.col("end")) * float(width), cell(F.col("end")) - 1).otherwise(cell(F.col("end")))
        return df.where(F.col("start") < F.col("end")).withColumn("_cell", F.explode(F.sequence(cell(F.col("start")), F.greatest(last, cell(F.col("start"))))))

    r = dealt(right).withColumnsRenamed({"start": "_start", "end": "_end"})
    pairs = dealt(left).join(r, [*by, "_cell"])
    later = F.greatest("start", "_start")
    pairs = pairs.where((F.col("start") < F.col("_end")) & (F.col("_start") < F.col("end")) & (F.col("_cell") == cell(later)))
    return pairs.withColumn("overlap", F.least("end", "_end") - later).drop("_cell", "_start", "_end")


def with_windows(segments: DataFrame, windows: DataFrame, values: Sequence[str], key: str = "segment", hearing: str = "hearing", width: float = 30.0) -> DataFrame:
    """Segments with the mean of each value over the windows they overlap, weighted by the common time; null where none holds a value.

    `key` names a segment within its hearing. Sums are made before segments are met again, so windows are shuffled once.
    """
    pairs = overlapping(segments.select(hearing, key, "start", "end"), windows.select(hearing, "start", "end", *values), [hearing], width)
    share = lambda v: F.sum(F.col(v) * F.col("overlap")) / F.sum(F.when(F.col(v).isNotNull(), F.col("overlap")))
    means = pairs.groupBy(F.col(hearing).alias("_h"), F.col(key).alias("_k")).agg(*(share(v).alias(v) for v in values))
    out = segments.drop(*values).join(means, (F.col(hearing) == F.col("_h")) & (F.col(key) == F.col("_k")), "left")
    return out.drop("_h", "_k")


def main_speaker(segments: DataFrame, known: DataFrame | None = None, hearing: str = "hearing", speaker: str = "speaker") -> DataFrame:
    """Segments of each hearing's speaker: the one that `known` (hearing, speaker) names, else the one of most talk time (ties: the last by name)."""
    talk = segments.groupBy(hearing, speaker).agg(F.sum(F.col("end") - F.col("start")).alias("_t"))
    most = talk.groupBy(hearing).agg(F.max_by(speaker, F.struct("_t", speaker)).alias("_most"))
    if known is not None:
        most = most.join(known.groupBy(hearing).agg(F.max(speaker).alias("_known")), hearing, "left").select(hearing, F.coalesce("_known", "_most").alias("_most"))
    return segments.join(most, hearing).where(F.col(speaker) == F.col("_most")).drop("_most")


def segment_scores(segments: DataFrame, prosody: Column, facial: Column, least_seconds: float = 5.0, hearing: str = "hearing") -> DataFrame:
    """verbal, prosody, facial, icm and its class of every segment of `least_seconds` or more; 4 places."""
    out = segments.where(F.col("end") - F.col("start") >= least_seconds)
    out = out.withColumns({"verbal": E.verbal_score(F.col("text")), "prosody": prosody, "facial": facial})
    out = out.withColumn("_icm", indices.congruence(F.col("verbal"), F.col("prosody"), F.col("facial")))
    return out.withColumns({"icm": F.round("_icm", 4), "class": indices.congruence_class(F.col("_icm")), **{c: F.round(c, 4) for c in ("verbal", "prosody", "facial")}}).drop("_icm")


def verbal_inverted(y8: Column, low: Column, high: Column) -> Column:
    """One less the place of y8 between the extremes of all hearings, all with 3 places; 0 where the extremes are the same."""
    a, b, x = F.round(low, 3), F.round(high, 3), F.round(y8, 3)
    return F.round(F.when(b > a, (b - x) / (b - a)).when(b.isNotNull(), 0.0), 3)


def channels(facial: DataFrame, vocal: DataFrame, verbal: DataFrame, hearing: str = "hearing") -> DataFrame:
    """The channels of hearings side by side, a row for each hearing of any side.

    facial: hearing, distress, smile (both rates; the score is distress to their sum). vocal: hearing, vocal (a score).
    verbal: hearing, y8, y11_prop. Gives facial, vocal, verbal_v1 (y8 inverted within its extremes), verbal_v2 (with
    y11_prop), convergence |facial - vocal|, icm_v1, icm_v2, delta (of the two); 3 places.
    A score of a channel that is missing is null, and so is what is made of it. Each side has one row for a hearing.
    """
    edges = verbal.agg(F.struct(F.min("y8").alias("low"), F.max("y8").alias("high")).alias("e"))
    words = verbal.withColumn("_e", edges.scalar()).withColumn("_v1", verbal_inverted(F.col("y8"), F.col("_e.low"), F.col("_e.high")))
    words = words.select(hearing, F.col("_v1").alias("verbal_v1"), (VERBAL[0] * F.col("_v1") + VERBAL[1] * F.col("y11_prop")).alias("_v2"))
    face = facial.select(hearing, F.try_divide("distress", F.col("distress") + F.col("smile")).alias("facial"))
    out = face.join(vocal.select(hearing, "vocal"), hearing, "full").join(words, hearing, "full")
    out = out.withColumn("_i1", indices.tri_channel(F.col("facial"), F.col("vocal"), F.col("verbal_v1"))).withColumn("_i2", indices.tri_channel(F.col("facial"), F.col("vocal"), F.col("_v2")))
    told = {"facial": "facial", "vocal": "vocal", "verbal_v1": "verbal_v1", "_v2": "verbal_v2", "_i1": "icm_v1", "_i2": "icm_v2"}
    rounded = [F.round(c, 3).alias(name) for c, name in told.items()]
    return out.select(hearing, *rounded, F.round(F.abs(F.col("facial") - F.col("vocal")), 3).alias("convergence"), F.round(F.col("_i2") - F.col("_i1"), 3).alias("delta"))
