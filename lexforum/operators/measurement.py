"""Measurement formulae over vectors and acoustic features: halved cosine distances, convergence, surprisal, acoustic recognition.

Vectors, surprisals and acoustic features are inputs, as no language model or audio reader is in the library. Null inputs give null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforum.functions import text as T
from lexforum.functions.materialise import written

# Mean and deviation that surprisals and acoustic scores are told by; weights of slow speech, pauses and loudness; what a slow rate is held to; voiced segments of a second that leave no pause.
SURPRISAL = (3.82, 1.14)
ACOUSTIC = (0.52, 0.18)
ACOUSTIC_WEIGHTS = (0.4, 0.4, 0.2)
LEAST_RATE, MOST_VOICED = 0.1, 10.0
#: Words that are broadcast are fewer than this.
FREQUENT = 1 << 16


def half_distance(a: Column, b: Column) -> Column:
    """Half the cosine distance: 0 for equal directions, 1 for opposite ones; null for zero vectors. y3, y8 and y9 by their poles."""
    return (1 - T.cosine(a, b)) / 2


def convergence(a: Column, b: Column) -> Column:
    """y11: 1 for the pole's direction, 0 for the opposite one."""
    return 1 - half_distance(a, b)


def surprisal(mean_nats: Column, scale: tuple[float, float] = SURPRISAL) -> Column:
    """y7: a text's mean surprisal as deviations from the calibration's mean."""
    return (mean_nats - scale[0]) / scale[1]


def own_log_probs(tokens: DataFrame, word: str, frequent: int = FREQUENT) -> DataFrame:
    """Adds log_prob, the log of a word's share of all tokens; null words are left out.

    Words that hold more than 1 / `frequent` of the tokens are fewer than that: they are broadcast, and their tokens, nearly all of a
    text, stay where they lie. Only rare words' tokens are shuffled to their counts. The tokens are made once for each of the three.
    """
    counts = written(tokens.where(F.col(word).isNotNull()).groupBy(word).agg(F.count(F.lit(1)).alias("_n")))
    known = counts.withColumn("_all", counts.agg(F.sum("_n")).scalar())  # one row
    often = F.col("_n") * frequent > F.col("_all")
    told = lambda own: own.select(word, F.ln(F.col("_n") / F.col("_all")).alias("log_prob"))
    top = F.broadcast(told(known.where(often)))
    return tokens.join(top, word).unionByName(tokens.join(top.select(word), word, "left_anti").join(told(known.where(~often)), word))


def mean_surprisal(tokens: DataFrame, key: str = "doc_id", log_prob: str = "log_prob", weight: str | None = None) -> DataFrame:
    """Mean surprisal (nats) and y7 of texts from the log probabilities of their tokens; weight: how often a row's token occurs (else once). Null ones do not count, a text without any has a mean of 0."""
    x = -F.col(log_prob)
    n = F.when(x.isNotNull(), F.lit(1) if weight is None else F.col(weight))
    mean = F.sum(x * n) / F.nullif(F.sum(n), F.lit(0))
    return tokens.groupBy(key).agg(F.coalesce(mean, F.lit(0.0)).alias("surprisal")).withColumn("y7_surprisal", surprisal(F.col("surprisal")))


def acoustic(rate: Column, voiced: Column, loudness: Column, scale: tuple[float, float] = ACOUSTIC) -> Column:
    """y12: slow speech, pauses (from voiced segments a second) and spread of loudness, as deviations from the calibration's mean."""
    slow, pauses, loud = ACOUSTIC_WEIGHTS
    raw = slow / F.greatest(rate, F.lit(LEAST_RATE)) + (1 - voiced / MOST_VOICED) * pauses + loudness * loud
    return F.when(rate.isNotNull(), (raw - scale[0]) / scale[1])


def poles(df: DataFrame, centroids: DataFrame, vector: str, names: dict[str, tuple[str, bool]]) -> DataFrame:
    """Adds a column for each pole: names of columns by pole (name, whether it is a convergence). centroids: name, vector, one short row a pole (see readers.centroids).

    A missing pole gives nulls. Poles are few, each is read as one value and no rows are shuffled.
    """
    out = df
    for column, (pole, towards) in names.items():
        one = centroids.where(F.col("name") == pole).agg(F.min("vector").alias("v"))
        out = out.withColumn("_pole", one.scalar()).withColumn(column, (convergence if towards else half_distance)(F.col(vector), F.col("_pole"))).drop("_pole")
    return out
