"""Kendall's tau over distributed rankings, and how stable a weighted index's ranking is under other weights.

Pairs of values are counted, and both values are dealt by ranges of about equal counts (a
value too frequent for a range has one of its own). A discordant pair of rows lies in one
range of the first value, or in one range of the second, or in neither: the first two are
counted by merge sort within a range's task, the third from the counts of range by range
cells, of which there are at most (2 PARTS + 2) squared for a group, however many rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexforum.functions.materialise import written
from lexforum.functions.stats import running_totals

#: Ranges of a value at most, about; rows that a range takes before there is more than one.
PARTS, LEAST = 256, 65_536


def inversions(y: np.ndarray, w: np.ndarray) -> float:
    """Sum of w_i w_j over i < j with y_i > y_j, by merge sort."""
    if len(y) <= 64:
        return float((np.triu(y[:, None] > y[None, :], 1) * np.outer(w, w)).sum())
    m = len(y) // 2
    order = np.argsort(y[:m], kind="stable")
    upto = np.concatenate(([0.0], np.cumsum(w[:m][order])))
    above = upto[-1] - upto[np.searchsorted(y[:m][order], y[m:], side="right")]
    return float(above @ w[m:]) + inversions(y[:m], w[:m]) + inversions(y[m:], w[m:])


def discordant(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Weight of pairs with x_i < x_j and y_i > y_j."""
    order = np.lexsort((y, x))
    return inversions(y[order], w[order].astype(float))


def kendall(df: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """Kendall's tau-b within groups: by, n, tau. Rows with a null are left out; null where all of a value are equal."""
    spark = df.sparkSession
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")).agg(F.count(F.lit(1)).alias("w"))
    pairs = written(pairs)  # read once for each value, and again for the counts
    total = pairs.agg(F.sum("w")).first()[0] or 0
    target = max(LEAST, -(-total // min(PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    tasks = -(-total // LEAST) + 1
    half = lambda t: F.col(t).cast("double") * (F.col(t) - 1) / 2
    rows, tied = pairs, []
    for value in ("x", "y"):
        counts = running_totals(pairs.groupBy(*by, value).agg(F.sum("w").alias("t")), by, value, ["t"])
        # Heavy values have odd numbers: a range of their own.
        number = F.floor((F.col("upto_t") - F.col("t")) / target) * 2 + (F.col("t") > target).cast("int")
        rows = rows.join(counts.select(*by, value, number.alias(f"r{value}")), [*by, value])
        tied.append(counts.groupBy(*by).agg(F.sum(half("t")).alias(f"n_{value}"), F.max("all_t").alias("n")))
    schema = StructType([pairs.schema[c] for c in by]).add("q", "double")

    def counted(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
        # Small ranges share a task: about LEAST rows, and what one range has beyond.
        names = [*by, *keys]

        def run(part: pd.DataFrame) -> pd.DataFrame:
            if not names:
                return pd.DataFrame({"q": [discordant(part[x].to_numpy(), part[y].to_numpy(), part["w"].to_numpy())]})
            number = part.groupby(names, dropna=False, sort=False).ngroup().to_numpy()
            order = np.argsort(number, kind="stable")
            at = np.append(np.flatnonzero(np.diff(number[order], prepend=-1)), len(order))
            values = [part[c].to_numpy()[order] for c in (x, y, "w")]
            q = [discordant(*(v[a:b] for v in values)) for a, b in zip(at, at[1:])]
            return part.iloc[order[at[:-1]]][list(by)].reset_index(drop=True).assign(q=q)

        task = F.pmod(F.xxhash64(*names), F.lit(tasks)) if names else F.lit(0)
        return rows.select(*dict.fromkeys([*names, x, y, "w"]), task.alias("_task")).groupBy("_task").applyInPandas(run, schema)

    cells = rows.groupBy(*by, "rx", "ry").agg(F.sum("w").alias("w"))
    found = counted(rows.where("rx % 2 = 0"), ["rx"], "x", "y").unionByName(counted(rows.where("ry % 2 = 0"), ["ry"], "rx", "y")).unionByName(counted(cells, [], "rx", "ry"))
    q = found.groupBy(*by).agg(F.sum("q").alias("q"))
    both = pairs.groupBy(*by).agg(F.sum(half("w")).alias("n_both"))
    joined = tied[0]
    for other in (tied[1].drop("n"), both, q):
        joined = joined.join(other, list(by)) if by else joined.crossJoin(other)  # one row each
    all_pairs = half("n")
    top = all_pairs - F.col("n_x") - F.col("n_y") + F.col("n_both") - 2 * F.col("q")
    scale = F.sqrt((all_pairs - F.col("n_x")) * (all_pairs - F.col("n_y")))
    return joined.select(*by, "n", F.when(scale > 0, top / scale).alias("tau"))


def scaled(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns scaled to 0 .. 1 over all rows (their extremes are one row)."""
    edges = df.agg(F.struct(*(F.struct(F.min(c).alias("low"), F.max(c).alias("high")).alias(c) for c in names)).alias("e"))
    own = df.withColumn("_e", edges.scalar())
    return own.withColumns({c: (F.col(c) - F.col(f"_e.{c}.low")) / (F.col(f"_e.{c}.high") - F.col(f"_e.{c}.low") + 1e-9) for c in names}).drop("_e")


def drawn_weights(weights: Mapping[str, float], draws: int, seed: int, concentration: float) -> np.ndarray:
    """draws x components, from the Dirichlet law around the weights."""
    return np.random.default_rng(seed).dirichlet(concentration * np.array(list(weights.values())), draws)


def weight_sensitivity(df: DataFrame, weights: Mapping[str, float], draws: int = 10_000, seed: int = 42, concentration: float = 10.0) -> DataFrame:
    """draw, n, tau: of the ranking of all rows by the weighted index against that by drawn weights. A name with a minus sign counts as one minus its column; rows with a null are left out.

    Rows are scored under every draw where they lie (draws x components weights go along) and ranked by Spark.
    """
    names = [c.lstrip("-") for c in weights]
    sign = np.array([-1.0 if c[0] == "-" else 1.0 for c in weights])
    base, drawn = np.array(list(weights.values())), drawn_weights(weights, draws, seed, concentration)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            step = max(1, 1_000_000 // draws)
            for at in range(0, len(frame), step):
                x = frame.iloc[at : at + step].to_numpy(float)
                x = np.where(sign < 0, 1 - x, x)
                yield pd.DataFrame({"draw": np.tile(np.arange(draws), len(x)), "base": np.repeat(x @ base, draws), "score": (x @ drawn.T).ravel()})

    rows = df.select(*(F.col(c).cast("double").alias(c) for c in names)).na.drop()
    return kendall(rows.mapInPandas(run, "draw int, base double, score double"), "base", "score", "draw")


def sensitivity_summary(taus: DataFrame, stable: float = 0.80) -> DataFrame:
    """mean, p5 and the share of draws that keep the ranking (one row over as many as there were draws)."""
    return taus.agg(F.avg("tau").alias("mean"), F.percentile("tau", F.lit(0.05)).alias("p5"), F.avg((F.col("tau") >= stable).cast("double")).alias("stable_share"))
