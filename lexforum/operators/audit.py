"""Integrity audit: every check gives findings rows (check, severity, n, detail)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforum.operators.relational import orphans


def finding(df: DataFrame, check: str, severity: str) -> DataFrame:
    """One row: how many rows violate a check."""
    return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(check).alias("check"), F.when(F.col("n") > 0, severity).otherwise("OK").alias("severity"), "n")


def references(links: Sequence[tuple[str, DataFrame, DataFrame, str, str]]) -> DataFrame:
    return reduce(DataFrame.unionByName, (finding(orphans(child, parent, a, b), name, "ERROR") for name, child, parent, a, b in links))


def duplicates(df: DataFrame, key: Sequence[str], check: str) -> DataFrame:
    return finding(df.groupBy(*key).count().where("count > 1"), check, "ERROR")


def bounds(df: DataFrame, limits: Mapping[str, tuple[float, float]]) -> DataFrame:
    """For each column: least, greatest, nulls, values out of bounds; one pass."""
    row = df.agg(*(x for c, (a, b) in limits.items() for x in (F.min(c).cast("double").alias(f"{c}_min"), F.max(c).cast("double").alias(f"{c}_max"), F.count_if(F.col(c).isNull()).alias(f"{c}_null"), F.count_if((F.col(c) < a) | (F.col(c) > b)).alias(f"{c}_out"))))
    parts = [F.struct(F.lit(c).alias("code"), F.col(f"{c}_min").alias("least"), F.col(f"{c}_max").alias("greatest"), F.col(f"{c}_null").alias("nulls"), F.col(f"{c}_out").alias("outside")) for c in limits]
    return row.select(F.explode(F.array(*parts)).alias("r")).select("r.*")


def golden(observed: DataFrame, expected: DataFrame, key: Sequence[str], tolerance: float = 0.005) -> DataFrame:
    """Expected against observed values: status OK, OFF or MISSING."""
    joined = F.broadcast(expected).join(observed, list(key), "left")  # expectations are a fixed list
    error = F.abs(F.col("observed") - F.col("expected"))
    return joined.select(*key, "expected", "observed", F.when(F.col("observed").isNull(), "MISSING").when(error <= tolerance, "OK").otherwise("OFF").alias("status"))


def level(score: Column) -> Column:
    return F.when(score >= 0.75, "HIGH").when(score >= 0.55, "MEDIUM").otherwise("LOW")


def risk(p: Column, i: Column) -> Column:
    return F.when(p * i >= 12, "HIGH").when(p * i >= 6, "MEDIUM").otherwise("LOW")
