"""Path analysis by least squares: one distributed pass for the moments, small linear algebra on the driver."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def moments(df: DataFrame, columns: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and covariance (sample) of complete rows; columns are few."""
    k = len(columns)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).na.drop().agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)), *(F.covar_samp(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    cov = np.zeros((k, k))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"c{i}_{j}"] or 0.0
    return row["n"], np.array([row[f"m{i}"] or 0.0 for i in range(k)]), cov


def least_squares(df: DataFrame, outcome: str, predictors: Sequence[str]) -> DataFrame:
    """term, estimate, std_error, z, p (normal), r2 of outcome on predictors; none if there are too few rows."""
    from lexforum.functions.stats import stars

    n, mean, cov = moments(df, [outcome, *predictors])
    spark = df.sparkSession
    schema = "outcome string, term string, estimate double, std_error double, z double, p double, r2 double"
    k = len(predictors)
    if n <= k + 1:
        return spark.createDataFrame([], schema).withColumn("stars", F.lit(""))
    inverse = np.linalg.pinv(cov[1:, 1:])
    beta = inverse @ cov[1:, 0]
    residual = max(cov[0, 0] - beta @ cov[1:, 0], 0.0) * (n - 1) / (n - k - 1)
    error = np.sqrt(np.maximum(np.diag(inverse), 0) * residual / (n - 1))
    r2 = float(beta @ cov[1:, 0] / cov[0, 0]) if cov[0, 0] else 0.0
    rows = []
    for name, b, e in zip(predictors, beta, error, strict=True):
        z = float(b / e) if e else 0.0
        rows.append((outcome, name, float(b), float(e), z, math.erfc(abs(z) / math.sqrt(2)), r2))
    rows.append((outcome, "(intercept)", float(mean[0] - beta @ mean[1:]), None, None, None, r2))
    out = spark.createDataFrame(rows, schema)
    return out.withColumn("stars", stars(F.col("p")))
