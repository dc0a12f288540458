"""Structural equation models by specification: covariances in one distributed pass, maximum likelihood over a few indicators.

A model of one table is fitted on the driver from a matrix of a few numbers; models of
groups and of bootstrap replicates are fitted in tasks, one row of moments each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforum.functions.stats import stars
from lexforum.operators.regression import moments

#: What a good fit reaches; where the main path counts as found; rows below which a fit is told to be unsafe.
CFI, RMSEA, SRMR = 0.95, 0.06, 0.08
KEY_P, LEAST_ROWS = 0.01, 50

# The models, the paths of which the first present one is the main one, names of features and their indicators, indicators that may be missing.
SPECS = {
    "completo": """
        xi1 =~ y2 + y3 + y4 + y1
        xi2 =~ y5 + y6
        eta1 =~ y7 + y8 + y9
        eta2 =~ y10 + y11
        eta1 ~ xi1 + xi2
        eta2 ~ eta1
        xi1 ~~ xi2
    """,
    "parcial": """
        xi1 =~ y2 + y3 + y4
        xi2 =~ y5 + y6
        eta2 =~ y10
        eta2 ~ xi1 + xi2
        xi1 ~~ xi2
    """,
    "dos_factores": """
        xi1 =~ y2 + y3 + y4
        eta2 =~ y10
        eta2 ~ xi1
    """,
}
KEY_PATHS = [("eta2", "eta1"), ("eta2", "xi1"), ("eta2", "xi2")]
FEATURES = {"y2_sa": "y2", "y3_civil": "y3", "y4_nv": "y4", "y5_corpus_type": "y5", "y6_period": "y6", "y10_rep": "y10"}
OPTIONAL = ["y1", "y7", "y8", "y9", "y11"]


@dataclass(frozen=True)
class Model:
    """Factors with their indicators (the first one's loading is 1), paths (outcome, predictor) between factors, and covariances beside those of factors that nothing explains.

    An indicator that is its factor's only one has no noise of its own: its variance is the factor's, as a split of it could not be told.
    """

    factors: dict[str, list[str]]
    paths: list[tuple[str, str]] = field(default_factory=list)
    covariances: list[tuple[str, str]] = field(default_factory=list)

    @classmethod
    def of(cls, text: str) -> Model:
        """From lines `factor =~ a + b`, `outcome ~ a + b`, `a ~~ b`; # starts a comment. An observed name in a path is a factor of itself."""
        factors: dict[str, list[str]] = {}
        paths, pairs = [], []
        for line in text.splitlines():
            line = line.split("#")[0].strip()
            if not line:
                continue
            op = next((o for o in ("=~", "~~", "~") if o in line), None)
            left, right = (x.strip() for x in line.split(op, 1)) if op else ("", "")
            terms = [x.strip() for x in right.split("+")]
            if not op or not all(x.isidentifier() for x in (left, *terms)):
                raise ValueError(f"not a line of a model: {line!r}")
            if op == "=~":
                factors.setdefault(left, []).extend(terms)
            else:
                (paths if op == "~" else pairs).extend((left, x) for x in terms)
        for name in (x for pair in paths for x in pair):
            factors.setdefault(name, [name])
        seen = {x for own in factors.values() for x in own}
        for a, b in pairs:
            if a == b or {a, b} - (seen | set(factors)):
                raise ValueError(f"{a} ~~ {b} names no two factors or indicators")
        return cls(factors, paths, pairs)

    @property
    def indicators(self) -> list[str]:
        return list(dict.fromkeys(x for own in self.factors.values() for x in own))

    def without_noise(self) -> set[str]:
        """Indicators that are their factor's only one, and of no other factor."""
        many = [x for own in self.factors.values() for x in own]
        return {own[0] for own in self.factors.values() if len(own) == 1 and many.count(own[0]) == 1}

    def free(self) -> list[tuple[str, str, str]]:
        """Free parameters: loadings, paths, covariances, variances of factors and of the noise of indicators."""
        names = list(self.factors)
        told = {a for a, _ in self.paths}
        out = [(f, "=~", x) for f, own in self.factors.items() for x in own[1:]] + [(a, "~", b) for a, b in self.paths]
        pairs = [(a, b) for i, a in enumerate(names) for b in names[:i] if a not in told and b not in told]
        known = {frozenset(p) for p in pairs}
        out += [(a, "~~", b) for a, b in [*pairs, *(p for p in dict.fromkeys(self.covariances) if frozenset(p) not in known)]]
        fixed = self.without_noise()
        return out + [(f, "~~", f) for f in names] + [(x, "~~", x) for x in self.indicators if x not in fixed and x not in names]

    def implied(self, theta: np.ndarray) -> np.ndarray:
        """Covariances of the indicators at these parameters (variances as logarithms)."""
        names, seen = list(self.factors), self.indicators
        load, beta, psi, noise = np.zeros((len(seen), len(names))), np.zeros((len(names),) * 2), np.zeros((len(names),) * 2), np.zeros((len(seen),) * 2)
        for j, own in enumerate(self.factors.values()):
            load[seen.index(own[0]), j] = 1.0
        for value, (a, op, b) in zip(theta, self.free(), strict=True):
            if op == "=~":
                load[seen.index(b), names.index(a)] = value
            elif op == "~":
                beta[names.index(a), names.index(b)] = value
            else:
                matrix, where = (psi, names) if a in names and b in names else (noise, seen)
                i, j = where.index(a), where.index(b)
                matrix[i, j] = matrix[j, i] = math.exp(min(value, 50.0)) if a == b else value
        way = np.linalg.pinv(np.eye(len(names)) - beta)
        return load @ way @ psi @ way.T @ load.T + noise


def discrepancy(sample: np.ndarray, implied: np.ndarray) -> float:
    """ln |implied| + tr(sample implied^-1) - ln |sample| - p; large where the implied matrix is none of covariances."""
    try:
        root = np.linalg.cholesky(implied)
    except np.linalg.LinAlgError:
        return 1e6
    half = np.linalg.solve(root, sample)
    return float(2 * np.log(np.diag(root)).sum() + np.trace(np.linalg.solve(root, half.T)) - np.linalg.slogdet(sample)[1] - len(sample))


def _minimise(f, x: np.ndarray, steps: int = 400) -> tuple[np.ndarray, float]:
    """Quasi-Newton steps with differences for slopes and a halving line search."""

    def slope(x: np.ndarray) -> np.ndarray:
        h = 1e-6 * np.maximum(1, np.abs(x))
        return np.array([(f(x + e) - f(x - e)) / (2 * h[i]) for i, e in enumerate(np.diag(h))])

    inverse, g, value = np.eye(len(x)), slope(x), f(x)
    for _ in range(steps):
        move = -inverse @ g
        if move @ g >= 0:
            inverse, move = np.eye(len(x)), -g
        t = min(1.0, 2.0 / max(1e-12, np.abs(move).max()))
        while t > 1e-12 and f(x + t * move) > value + 1e-4 * t * (move @ g):
            t /= 2
        new = x + t * move
        g_new, v_new = slope(new), f(new)
        s, y = new - x, g_new - g
        done = abs(value - v_new) < 1e-12 * max(1, abs(value)) and np.abs(g_new).max() < 1e-5
        if s @ y > 1e-12:
            r = 1 / (s @ y)
            left = np.eye(len(x)) - r * np.outer(s, y)
            inverse = left @ inverse @ left.T + r * np.outer(s, s)
        x, g, value = new, g_new, v_new
        if done or t <= 1e-12:
            break
    return x, value


def chi2_tail(x: float, df: float) -> float:
    """P(X > x) of the chi-squared law: the regularised incomplete Gamma function, by its series or continued fraction."""
    a, x = df / 2, x / 2
    if df <= 0:
        return 1.0
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - front * total)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    out = d
    for i in range(1, 10_000):
        step = -i * (i - a)
        b += 2
        d, c = 1 / (step * d + b), b + step / c
        out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


@dataclass(frozen=True)
class Fit:
    n: int
    estimates: list[tuple[str, str, str, float, float | None]]  # left, operator, right, estimate, standard error
    chi2: float
    df: int
    cfi: float
    rmsea: float
    srmr: float
    theta: np.ndarray = field(default_factory=lambda: np.zeros(0), repr=False, compare=False)

    @property
    def p(self) -> float:
        return chi2_tail(self.chi2, self.df)

    def path(self, wanted: Sequence[tuple[str, str]] = KEY_PATHS) -> tuple[str, str, float, float | None, float | None] | None:
        """The first present one of the paths: outcome, predictor, estimate, standard error, p."""
        told = {(a, b): (est, se) for a, op, b, est, se in self.estimates if op == "~"}
        for a, b in wanted:
            if (a, b) in told:
                est, se = told[a, b]
                return a, b, est, se, math.erfc(abs(est / se) / math.sqrt(2)) if se else None
        return None


def _standard(sample: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Correlations, so that all steps are of like size, and the deviations."""
    scale = np.sqrt(np.maximum(np.diag(sample), 1e-12))
    return sample / np.outer(scale, scale), scale


def _start(model: Model) -> np.ndarray:
    return np.array([0.7 if op == "=~" else 0.0 if a != b else math.log(0.5) for a, op, b in model.free()])


def estimate(sample: np.ndarray, model: Model, start: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Parameters over the correlations of a covariance matrix, and the discrepancy there; start: parameters of a like matrix."""
    s, _ = _standard(sample)
    return _minimise(lambda t: discrepancy(s, model.implied(t)), _start(model) if start is None else start)


def _unscaled(model: Model, scale: np.ndarray) -> np.ndarray:
    """Factor by which each parameter over correlations is one over the data."""
    seen = model.indicators
    unit = {f: scale[seen.index(own[0])] for f, own in model.factors.items()}
    size = lambda x: unit[x] if x in unit else scale[seen.index(x)]
    by_op = {"=~": lambda a, b: scale[seen.index(b)] / size(a), "~": lambda a, b: size(a) / size(b), "~~": lambda a, b: size(a) * size(b)}
    return np.array([by_op[op](a, b) for a, op, b in model.free()])


def fit(sample: np.ndarray, n: int, model: Model) -> Fit:
    """Maximum likelihood on a sample covariance matrix of n rows, in the order of model.indicators."""
    s, scale = _standard(sample)
    free = model.free()
    theta, value = estimate(sample, model)
    p = len(s)
    df = p * (p + 1) // 2 - len(free)
    chi2 = max(0.0, (n - 1) * value)
    base = max(0.0, -(n - 1) * np.linalg.slogdet(s)[1])  # of indicators without any covariance
    worse, lost = max(base - p * (p - 1) / 2, chi2 - df, 0.0), max(chi2 - df, 0.0)
    off = (s - model.implied(theta))[np.tril_indices(p)]
    # Standard errors from the curvature of the discrepancy; then back to the scale of the data.
    h, at = 1e-4, lambda t: discrepancy(s, model.implied(t))
    steps = h * np.eye(len(theta))
    hess = np.array([[(at(theta + e + d) - at(theta + e - d) - at(theta - e + d) + at(theta - e - d)) / (4 * h * h) for d in steps] for e in steps])
    error = np.sqrt(np.maximum(np.diag(np.linalg.pinv(hess * (n - 1) / 2)), 0))
    out = []
    for (a, op, b), t, e, k in zip(free, theta.tolist(), error.tolist(), _unscaled(model, scale).tolist(), strict=True):
        if a == b:
            t, e = math.exp(t), e * math.exp(t)
        out.append((a, op, b, t * k, e * k))
    return Fit(n, out, float(chi2), df, 1.0 if worse <= 0 else float(1 - lost / worse), math.sqrt(lost / (df * (n - 1))) if df > 0 else 0.0, float(np.sqrt((off**2).mean())), theta)


def passes(f: Fit) -> dict[str, bool]:
    return {"cfi": f.cfi >= CFI, "rmsea": f.rmsea <= RMSEA, "srmr": f.srmr <= SRMR}


def _rows(f: Fit) -> list[tuple]:
    """Estimates, marks of the fit with whether they pass, and the main path: supported below 0 with p under KEY_P."""
    rows = [(a, op, b, est, se, est / se if se else None, math.erfc(abs(est / se) / math.sqrt(2)) if se else None, None) for a, op, b, est, se in f.estimates]
    good = passes(f)
    marks = (("chi2", f.chi2), ("df", float(f.df)), ("p", f.p), ("cfi", f.cfi), ("rmsea", f.rmsea), ("srmr", f.srmr), ("n", float(f.n)))
    rows += [("fit", "", k, v, None, None, None, good.get(k, f.n >= LEAST_ROWS if k == "n" else None)) for k, v in marks]
    if main := f.path():
        a, b, est, se, p = main
        rows.append(("key path", "~", f"{a} ~ {b}", est, se, est / se if se else None, p, bool(est < 0 and p is not None and p < KEY_P)))
    return rows


_SCHEMA = "left string, op string, right string, estimate double, std_error double, z double, p double, passes boolean"


def prepared(df: DataFrame, model: Model) -> DataFrame:
    """The model's indicators of feature rows, under their short names; absent ones are null. Rows lacking one that may not be missing go."""
    named = df.withColumnsRenamed({long: short for long, short in FEATURES.items() if long in df.columns and short not in df.columns})
    out = named.select(*(F.col(c).cast("double").alias(c) if c in named.columns else F.lit(None).cast("double").alias(c) for c in model.indicators))
    return out.na.drop(subset=[c for c in model.indicators if c not in OPTIONAL])


def fit_table(df: DataFrame, model: Model) -> DataFrame:
    """Estimates (=~ loading, ~ path, ~~ covariance) with z, p and stars, rows `fit` with chi2, df, p, cfi, rmsea, srmr, n and whether they pass, and the main path. Complete rows only; none if there are fewer than parameters."""
    n, _, cov = moments(df, model.indicators)
    rows = _rows(fit(cov, n, model)) if n > len(model.free()) else []
    return df.sparkSession.createDataFrame(rows, _SCHEMA).withColumn("stars", stars(F.col("p")))


def _grouped_moments(df: DataFrame, group: str, names: list[str]) -> DataFrame:
    """One row for each group: n and the covariances, upper triangle by rows."""
    own = df.select(group, *(F.col(c).cast("double").alias(c) for c in names)).na.drop()
    return own.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.array(*(F.covar_samp(a, b) for i, a in enumerate(names) for b in names[i:])).alias("c"))


def _square(upper: Sequence[float], k: int) -> np.ndarray:
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = upper
    return out + out.T - np.diag(np.diag(out))


def multigroup(df: DataFrame, group: str, model: Model) -> DataFrame:
    """The model fitted in each group, in tasks: group, estimates as in fit_table, and the spread of each loading over groups."""
    names, least = model.indicators, len(model.free())
    per = _grouped_moments(df, group, names).where(F.col("n") > least).select(F.col(group).cast("string").alias("g"), "n", "c")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(r.g, *x) for r in frame.itertuples() for x in _rows(fit(_square(r.c, len(names)), int(r.n), model))]
            if rows:
                yield pd.DataFrame(rows, columns=["g", "left", "op", "right", "estimate", "std_error", "z", "p", "passes"])

    table = per.repartition("g").mapInPandas(run, f"g string, {_SCHEMA}").withColumnRenamed("g", group)
    spread = table.where("op = '=~'").groupBy("left", "op", "right").agg((F.max("estimate") - F.min("estimate")).alias("spread"))
    return table.join(spread, ["left", "op", "right"], "left").select(group, "left", "op", "right", "estimate", "std_error", "z", "p", "passes", "spread")


def invariance(df: DataFrame, group: str, model: Model) -> DataFrame:
    """Whether loadings are the same in all groups: chi2 and df of the groups' own fits and of one with equal loadings, their difference and its p. One row; groups are few.

    Groups come as one row of moments each. Equal loadings are searched over the pooled scale; what a group has of its own is fitted within it.
    """
    names, free = model.indicators, model.free()
    told = [(int(r["n"]), _square(r["c"], len(names))) for r in _grouped_moments(df, group, names).where(F.col("n") > len(free)).orderBy(group).collect()]
    schema = "groups int, chi2_free double, df_free int, chi2_equal double, df_equal int, difference double, df int, p double, equal boolean"
    if len(told) < 2:
        return df.sparkSession.createDataFrame([], schema)
    total = sum(n for n, _ in told)
    scale = np.sqrt(sum(n * np.diag(c) for n, c in told) / total)
    samples = [(n, c / np.outer(scale, scale)) for n, c in told]
    shared = np.array([op == "=~" for _, op, _ in free])
    k, m = int(shared.sum()), int((~shared).sum())
    own_fits = [_minimise(lambda t, s=s: discrepancy(s, model.implied(t)), _start(model)) for _, s in samples]
    chi_free = sum((n - 1) * max(0.0, v) for (n, _), (_, v) in zip(samples, own_fits, strict=True))

    def joint(t: np.ndarray) -> float:
        value, theta = 0.0, np.empty(len(free))
        theta[shared] = t[:k]
        for i, (n, s) in enumerate(samples):
            theta[~shared] = t[k + i * m : k + (i + 1) * m]
            value += (n - 1) / total * discrepancy(s, model.implied(theta))
        return value

    start = np.concatenate([np.mean([t[shared] for t, _ in own_fits], 0), *(t[~shared] for t, _ in own_fits)])
    chi_equal = max(chi_free, total * _minimise(joint, start)[1])
    each = len(names) * (len(names) + 1) // 2
    df_free, df_equal = len(samples) * (each - len(free)), len(samples) * each - k - len(samples) * m
    p = chi2_tail(chi_equal - chi_free, df_equal - df_free)
    return df.sparkSession.createDataFrame([(len(samples), chi_free, df_free, chi_equal, df_equal, chi_equal - chi_free, df_equal - df_free, p, p >= 0.05)], schema)


# -- bootstrap of a path --------------------------------------------------------------


def poisson_weights(keys: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """How often each row (by its key) counts in each replicate: Poisson of mean 1 by a hash of key, replicate and seed. Rows x draws."""
    of_draw = np.arange(1, draws + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 0xD6E8FEB86659FD93 % 2**64)
    x = keys.astype(np.uint64)[:, None] ^ of_draw[None]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    # A count of k or more has a chance of 1 - sum e^-1 / i!; beyond 16 it is below 1e-14.
    upto = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(17)])
    return np.searchsorted(upto, (x >> np.uint64(11)).astype(np.float64) / 2.0**53, side="right").astype(np.float64)


def replicate_moments(df: DataFrame, columns: Sequence[str], key: Sequence[str], draws: int, seed: int = 42) -> DataFrame:
    """draw, n, c (covariances, upper triangle) of each of `draws` Poisson bootstraps: one pass, in which a task adds up its rows' weighted sums for all replicates.

    Rows are told apart by `key`; rows that agree in it count together. Values are taken from their means, so that squares keep their digits.
    """
    k = len(columns)
    rows = df.select(F.xxhash64(*key).alias("k"), *(F.col(c).cast("double").alias(c) for c in columns)).na.drop()
    mean = np.array([x or 0.0 for x in rows.agg(*(F.avg(c) for c in columns)).first()])
    upper = np.triu_indices(k)

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((draws, 1 + k + len(upper[0])))
        for frame in frames:
            x = frame[list(columns)].to_numpy() - mean
            whole = np.concatenate((np.ones((len(x), 1)), x, x[:, upper[0]] * x[:, upper[1]]), 1)
            keys = frame["k"].to_numpy().view(np.uint64)
            for a in range(0, len(x), 512):
                total += poisson_weights(keys[a : a + 512], draws, seed).T @ whole[a : a + 512]
        yield pd.DataFrame({"draw": np.arange(draws), "s": total.tolist()})

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        s = np.sum(np.stack(frame["s"].to_list()), 0)  # one row of each task
        n, first = s[0], s[1 : k + 1]
        cov = (s[k + 1 :] - first[upper[0]] * first[upper[1]] / max(n, 1)) / max(n - 1, 1)
        return pd.DataFrame({"draw": [int(frame["draw"].iloc[0])], "n": [int(n)], "c": [cov.tolist()]})

    return rows.mapInPandas(sums, "draw int, s array<double>").groupBy("draw").applyInPandas(merged, "draw int, n long, c array<double>")


def path_replicates(df: DataFrame, model: Model, key: Sequence[str], path: tuple[str, str] | None = None, draws: int = 1000, seed: int = 42) -> DataFrame:
    """draw, estimate of a path (the main one, if none is named) in each bootstrap replicate, each fitted in a task from its moments; null where the fit fails."""
    names, free = model.indicators, model.free()
    n, _, cov = moments(df, names)
    empty = df.sparkSession.createDataFrame([], "draw int, estimate double")
    wanted = [path] if path else KEY_PATHS
    main = next((p for p in wanted if (p[0], "~", p[1]) in free), None)
    if main is None or n <= len(free):
        return empty
    at, start = free.index((main[0], "~", main[1])), estimate(cov, model)[0]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples():
                sample = _square(r.c, len(names))
                value = None
                if r.n > len(free) and np.diag(sample).min() > 0:
                    theta, left = estimate(sample, model, start)
                    if left < 1e5:
                        value = float(theta[at] * _unscaled(model, _standard(sample)[1])[at])
                out.append((int(r.draw), value))
            yield pd.DataFrame(out, columns=["draw", "estimate"]).astype({"estimate": "float64"})

    parts = max(1, min(draws, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return replicate_moments(df, names, key, draws, seed).repartition(parts, "draw").mapInPandas(run, "draw int, estimate double").withColumn("estimate", F.nanvl("estimate", F.lit(None).cast("double")))


def path_interval(replicates: DataFrame, level: float = 0.95) -> DataFrame:
    """valid replicates, mean, low and high end of the interval, and whether it lies below 0. One row over as many rows as there were draws."""
    a = (1 - level) / 2
    out = replicates.where(F.col("estimate").isNotNull()).agg(F.count(F.lit(1)).alias("valid"), F.avg("estimate").alias("mean"), F.percentile("estimate", F.array(F.lit(a), F.lit(1 - a))).alias("q"))
    return out.select("valid", "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), (F.col("q")[1] < 0).alias("below"))


def main_plane(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key, x, y: centred vectors on their two main components; each component's largest entry is positive. Vectors of another length than the first by key, and null ones, are left out."""
    spark = df.sparkSession
    clean = df.where(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    first = clean.orderBy("k").first()
    if first is None:
        return spark.createDataFrame([], "k long, x double, y double").withColumnRenamed("k", key)
    d = len(first["v"])
    own = clean.where(F.size("v") == d)

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, q = 0, np.zeros(d), np.zeros((d, d))
        for frame in frames:
            m = np.stack(frame["v"].to_list()) if len(frame) else np.zeros((0, d))
            n, s, q = n + len(m), s + m.sum(0), q + m.T @ m
        yield pd.DataFrame({"n": [n], "s": [s.tolist()], "q": [q.ravel().tolist()]})

    parts = own.select("v").mapInPandas(sums, "n long, s array<double>, q array<double>").collect()  # one row of d x d numbers for each task
    n = sum(r.n for r in parts)
    mean = np.sum([r.s for r in parts], 0) / n
    cov = np.sum([r.q for r in parts], 0).reshape(d, d) / n - np.outer(mean, mean)
    axes = np.linalg.eigh(cov)[1][:, ::-1][:, :2]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    dot = lambda w: F.aggregate(F.zip_with("v", F.array(*map(F.lit, w.tolist())), lambda a, b: a * b), F.lit(float(-(mean @ w))), lambda s, x: s + x)
    return own.select(F.col("k").alias(key), dot(axes[:, 0]).alias("x"), dot(axes[:, 1]).alias("y") if d > 1 else F.lit(0.0).alias("y"))
