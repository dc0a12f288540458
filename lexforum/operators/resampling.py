"""Seeded resampling: bootstrap intervals. Draw numbers are dealt out, so results do not depend on tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bootstrap_gap(df: DataFrame, group: str, value: str, a: str, b: str, draws: int = 1000, seed: int = 99) -> DataFrame:
    """95 % interval of the difference of means of two groups, by Poisson bootstrap: every row counts 0, 1, 2, .. times in a replicate.

    Rows are not copied: a task adds up its rows' weighted sums for all replicates, and one small row per task and group is summed.
    """

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for frame in frames:
            for g, own in frame.groupby("g"):
                s = total.setdefault(g, np.zeros((2, draws)))
                for at in range(0, len(own), 256):
                    part = own.iloc[at : at + 256]
                    w = np.stack([np.random.default_rng([seed, int(k) & 0x7FFFFFFF, int(k) >> 31 & 0x7FFFFFFF]).poisson(1.0, draws) for k in part["k"]])
                    s[0] += part["v"].to_numpy() @ w
                    s[1] += w.sum(0)
        for g, s in total.items():
            yield pd.DataFrame({"g": g, "draw": np.arange(draws), "s": s[0], "n": s[1]})

    rows = df.where(F.col(group).isin(a, b) & F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"), F.xxhash64(*df.columns).alias("k"))
    per = rows.mapInPandas(sums, "g string, draw int, s double, n double").groupBy("draw").agg(*(F.sum(F.when(F.col("g") == g, F.col(c))).alias(f"{c}{i}") for i, g in enumerate((a, b)) for c in ("s", "n")))
    gap = per.select((F.col("s0") / F.col("n0") - F.col("s1") / F.col("n1")).alias("gap"))
    q = F.percentile("gap", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return gap.agg(q.alias("q")).select(F.col("q")[0].alias("low"), F.col("q")[1].alias("middle"), F.col("q")[2].alias("high"))


def parametric_gap(df: DataFrame, group: Column, value: str, draws: int = 5000, seed: int = 99) -> DataFrame:
    """95 % interval of the difference of two groups' means (where group holds less where not): in each draw both means come from normal laws with the groups' sizes, means and deviations.

    The mean of n normal values is normal with its deviation over the root of n, so a draw takes two numbers, however large the groups are.
    """
    own = df.where(F.col(value).isNotNull()).groupBy(group.alias("g")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))
    told = {r.g: r for r in own.collect()}  # two rows
    if True not in told or False not in told:
        return df.sparkSession.createDataFrame([], "low double, middle double, high double, apart boolean")
    a, b = told[True], told[False]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            z = np.stack([np.random.default_rng([seed, int(i)]).standard_normal(2) for i in frame["id"]])
            yield pd.DataFrame({"gap": a.m - b.m + z[:, 0] * (a.s or 0) / np.sqrt(a.n) - z[:, 1] * (b.s or 0) / np.sqrt(b.n)})

    q = df.sparkSession.range(draws).mapInPandas(run, "gap double").agg(F.percentile("gap", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("q"))
    return q.select(F.col("q")[0].alias("low"), F.col("q")[1].alias("middle"), F.col("q")[2].alias("high"), (F.col("q")[0] > 0).alias("apart"))
