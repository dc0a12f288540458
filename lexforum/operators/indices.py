"""Composite indices over indicators and channels."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of the composite indices (a minus sign: of one minus the scaled value).
DIS = {"sa": 0.35, "nv": 0.35, "-rep": 0.30}
IEI = {"y8": 0.35, "y9": 0.20, "nv": 0.25, "-rep": 0.20}
#: Channel weights and classes of the congruence index.
CHANNELS = {"verbal": 0.40, "prosody": 0.35, "facial": 0.25}
CLASSES = ((0.60, "GENUINE"), (0.35, "AMBIGUOUS"))
TRI = {"facial": 0.4, "vocal": 0.4, "verbal": 0.2}


def centroids(df: DataFrame, by: str | None, vector: str) -> DataFrame:
    """by, c: the means of each component, as many as the longest vector has (one number is read back); shorter vectors count where they reach.

    The averages stand beside each other: one partial sum for each group and task, no row for each component.
    """
    dims = df.agg(F.max(F.size(vector))).first()[0] or 0
    means = F.array(*(F.avg(F.get(vector, F.lit(i)).cast("double")) for i in range(max(dims, 0)))).cast("array<double>").alias("c")
    return df.groupBy(*([by] if by else [])).agg(means)


def weighted(columns: Mapping[str, float], of) -> Column:
    total: Column = F.lit(0.0)
    for name, w in columns.items():
        total = total + w * ((1 - of(name[1:])) if name[0] == "-" else of(name))
    return total


def composite(df: DataFrame, key: str) -> DataFrame:
    """dis, iei and dissociation from columns sa, nv, rep, y8, y9, each scaled over all entities (their extremes are one row, read back)."""
    names = ("sa", "nv", "rep", "y8", "y9")
    edges = df.agg(F.struct(*(F.struct(F.min(c).alias("low"), F.max(c).alias("high")).alias(c) for c in names)).alias("e"))
    scaled = df.withColumn("_e", edges.scalar()).select(key, *(((F.col(c) - F.col(f"_e.{c}.low")) / (F.col(f"_e.{c}.high") - F.col(f"_e.{c}.low") + 1e-9)).alias(c) for c in names))
    out = scaled.select(key, weighted(DIS, F.col).alias("dis"), weighted(IEI, F.col).alias("iei"))
    gap = F.col("dis") - F.col("iei")
    return out.withColumn("dissociation", F.abs(gap)).withColumn("direction", F.when(gap > 0, "discursive").when(gap < 0, "evaluative").otherwise("none"))


def congruence(verbal: Column, prosody: Column, facial: Column) -> Column:
    """Weighted channel score, lowered by twice the population deviation of the channels (at most to 0)."""
    mean = (verbal + prosody + facial) / 3
    sd = F.sqrt(((verbal - mean) ** 2 + (prosody - mean) ** 2 + (facial - mean) ** 2) / 3)
    return (CHANNELS["verbal"] * verbal + CHANNELS["prosody"] * prosody + CHANNELS["facial"] * facial) * (1 - F.least(2 * sd, F.lit(1.0)))


def congruence_class(icm: Column) -> Column:
    out = F.lit("PERFORMATIVE")
    for cut, name in reversed(CLASSES):
        out = F.when(icm >= cut, name).otherwise(out)
    return out


def prosody_score(shimmer: Column, alpha: Column, f0_var: Column, hnr: Column) -> Column:
    """Mean of the terms that are active, each capped at 1; 0 without any. Shimmer and F0 are active above 0, alpha if it is not 0, HNR below 20."""
    terms = [
        F.when(shimmer > 0, F.least(shimmer / 2, F.lit(1.0))), F.when(alpha != 0, F.least(F.abs(alpha) / 10, F.lit(1.0))),
        F.when(f0_var > 0, F.least(f0_var, F.lit(1.0))), F.when(hnr < 20, F.greatest(F.lit(0.0), F.least((20 - hnr) / 20, F.lit(1.0)))),
    ]
    n = sum((F.when(t.isNotNull(), 1).otherwise(0) for t in terms), F.lit(0))
    total = sum((F.coalesce(t, F.lit(0.0)) for t in terms), F.lit(0.0))
    return F.when(n > 0, total / n).otherwise(0.0)


def tri_channel(facial: Column, vocal: Column, verbal: Column) -> Column:
    return TRI["facial"] * facial + TRI["vocal"] * vocal + TRI["verbal"] * verbal
