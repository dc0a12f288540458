"""Statistical expressions and operators without external libraries."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window as W

from lexforum.functions.materialise import written


def normal_tail(z: Column) -> Column:
    """P(Z > |z|) of the standard normal, by the rational approximation of erfc with relative error below 1.2e-7."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.5 * x)
    #: Coefficients of the approximation.
    poly = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368):
        poly = F.lit(c) + t * poly
    return 0.5 * t * F.exp(-x * x - 1.26551223 + t * poly)


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def ratio(a: Column, b: Column) -> Column:
    """a / b of doubles as IEEE 754 has it: by zero it is infinite, and no number for zero by zero. Null where one is null."""
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    by_zero = F.when(F.isnan(a) | (a == 0), nan).when(a > 0, inf).when(a < 0, -inf)
    return F.when(b == 0, by_zero).otherwise(a / b)


def scaled(x: Column, low: Column, high: Column) -> Column:
    """(x - low) / (high - low) within 0 .. 1; 0.5 where the span is degenerate."""
    return F.when(F.abs(high - low) < 1e-9, F.lit(0.5)).otherwise(clamp((x - low) / (high - low)))


@F.pandas_udf(DoubleType())
def student_tail(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided P(|T| > |t|) of Student's law with df degrees of freedom; one row for each group, so Python costs nothing here."""

    def tail(t: float | None, df: float | None) -> float | None:
        if t is None or df is None or t != t or df != df or df <= 0:
            return None
        if math.isinf(t):
            return 0.0
        return _beta_share(df / (df + t * t), df / 2, 0.5)

    return pd.Series([tail(a, b) for a, b in zip(t, df, strict=True)], dtype="float64")


def _beta_share(x: float, a: float, b: float) -> float:
    """Regularised incomplete Beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(1 - x, b, a)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    out = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d)
            c = 1 + step / c
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


def running_totals(df: DataFrame, by: Sequence[str], value: str, amounts: Sequence[str]) -> DataFrame:
    """Adds upto_<amount>, each amount's sum over the rows of the group up to this value (values are distinct within a group), and all_<amount>, its sum over the group.

    Rows are dealt by ranges of (group, value); what a range has before it in its group is added, so a large group takes many tasks.
    The ranges come from a sample, so the dealt rows are written once: another branch that dealt them anew could draw other ranges.
    Null groups are groups of their own.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [f"_key{i}" for i in range(len(by))]
    named = df.withColumns({k: F.struct(b) for k, b in zip(keys, by, strict=True)})
    dealt = written(named.repartitionByRange(parts, *by, value).withColumn("_part", F.spark_partition_id()))
    per = dealt.groupBy("_part", *keys).agg(*(F.sum(a).alias(f"_sum_{a}") for a in amounts))  # ranges and groups: few rows
    earlier = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    before = per.select("_part", *keys, *(c for a in amounts for c in (F.coalesce(F.sum(f"_sum_{a}").over(earlier), F.lit(0)).alias(f"_before_{a}"), F.sum(f"_sum_{a}").over(whole).alias(f"all_{a}"))))
    own = W.partitionBy("_part", *keys).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    out = dealt.join(before, ["_part", *keys]).withColumns({f"upto_{a}": F.sum(a).over(own) + F.col(f"_before_{a}") for a in amounts})
    return out.drop("_part", *keys, *(f"_before_{a}" for a in amounts))


def quantiles(df: DataFrame, value: str, shares: Sequence[float], *by: str) -> DataFrame:
    """by, n and q, the array of interpolated quantiles (of n values the one at place share * (n - 1), from 0), within groups; nulls are left out.

    Values are counted, dealt by ranges and selected by their running counts: no task or buffer holds a group's values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("ties"))
    ranked = running_totals(counts, by, "_v", ["ties"])
    place = lambda s: (F.col("all_ties") - 1) * F.lit(float(s))
    of = lambda k: F.max(F.when((F.col("upto_ties") - F.col("ties") <= k) & (k < F.col("upto_ties")), F.col("_v").cast("double")))
    picked = [c for i, s in enumerate(shares) for c in (of(F.floor(place(s))).alias(f"_low{i}"), of(F.ceil(place(s))).alias(f"_high{i}"))]
    found = ranked.groupBy(*by).agg(F.max("all_ties").alias("n"), *picked)
    between = lambda i, s: F.col(f"_low{i}") + (F.col(f"_high{i}") - F.col(f"_low{i}")) * ((F.col("n") - 1) * float(s) - F.floor((F.col("n") - 1) * float(s)))
    return found.where(F.col("n").isNotNull()).select(*by, "n", F.array(*(F.when(F.col(f"_low{i}") == F.col(f"_high{i}"), F.col(f"_low{i}")).otherwise(between(i, s)) for i, s in enumerate(shares))).alias("q"))


def average_ranks(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Adds rank (ties get their mean) and ties (rows with this value), within groups.

    Ranks come from counts by value, so that ties, however many, are one row, and values from ranges, so that groups are split.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("ties"))
    ranks = running_totals(counts, by, value, ["ties"]).withColumn("rank", F.col("upto_ties") - (F.col("ties") - 1) / 2)
    return df.join(ranks.drop("upto_ties", "all_ties"), [*by, value])


def mann_whitney(df: DataFrame, group: Column, value: str, by: list[str], least: int = 5) -> DataFrame:
    """Two-sided Mann-Whitney by `by`: n1, n2, u (of the rows where group holds), z with tie and continuity correction, p.

    Works on counts by value: one pass, no row order beyond distinct values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count_if(group).alias("a"), F.count_if(~group).alias("b"))
    ranked = running_totals(counts.withColumn("t", F.col("a") + F.col("b")), by, value, ["t"]).withColumn("rank", F.col("upto_t") - (F.col("t") - 1) / 2)
    sums = ranked.groupBy(*by).agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"), F.sum(F.col("a") * F.col("rank")).alias("r1"), F.sum(F.col("t").cast("double") ** 3 - F.col("t")).alias("tie"))
    n = (F.col("n1") + F.col("n2")).cast("double")
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    mean = F.col("n1") * F.col("n2") / 2
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12.0 * ((n + 1) - F.col("tie") / (n * (n - 1))))
    out = sums.where((F.col("n1") >= least) & (F.col("n2") >= least)).withColumn("u", u)
    out = out.withColumn("z", (F.abs(F.col("u") - mean) - 0.5) / F.nullif(sd, F.lit(0.0)))
    return out.select(*by, "n1", "n2", "u", "z", F.least(F.lit(1.0), 2 * normal_tail(F.greatest(F.col("z"), F.lit(0.0)))).alias("p"))


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation of n pairs; null for fewer than 3."""
    free = (n - 2).cast("double")
    t = F.when(F.abs(r) >= 1, F.lit(float("inf"))).otherwise(r * F.sqrt(free / (1 - r * r)))
    return F.when(free > 0, student_tail(t, free))


#: Ranks of a column are broadcast if it has so many distinct values at most.
FEW_VALUES = 10_000


def spearman(df: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """Spearman's rho within groups (ties get mean ranks): by, n, rho, p. Null groups are groups of their own."""
    return spearman_pairs(df, [a, b], *by).drop("a", "b")


def spearman_pairs(df: DataFrame, columns: Sequence[str], *by: str) -> DataFrame:
    """Spearman's rho of every two columns within groups, over the rows that hold both: by, a, b, n, rho, p.

    Each column's values are counted once, by the columns that their rows hold, too; all ranks come from these counts.
    Rows then meet the ranks of all columns but the one with the most values. They are summed by its values, and these sums meet its ranks.
    """
    k, groups = range(len(columns)), [f"_by{m}" for m in range(len(by))]
    pairs = list(combinations(k, 2))
    rows = df.select(*(F.col(c).alias(g) for c, g in zip(by, groups, strict=True)), *(F.col(c).alias(f"_v{i}") for i, c in enumerate(columns)))
    kinds = [rows.schema[f"_v{i}"].dataType for i in k]
    # Values of different types are told apart by their place in a struct.
    key = lambda i: F.col(f"_v{i}") if len({t.simpleString() for t in kinds}) == 1 else F.struct(*((F.col(f"_v{j}") if j == i else F.lit(None).cast(kinds[j])).alias(f"v{j}") for j in k))
    values = F.explode(F.array(*(F.struct(F.lit(i).alias("code"), key(i).alias("value"), F.col(f"_v{i}").isNotNull().alias("held")) for i in k)))
    told = rows.select(*groups, *(F.col(f"_v{j}").isNotNull().alias(f"_held{j}") for j in k), values.alias("_p")).where("_p.held")
    counts = told.groupBy(*groups, F.col("_p.code").alias("_code"), F.col("_p.value").alias("_value")).agg(*(F.count_if(f"_held{j}").alias(f"_n{j}") for j in k))
    # Ranks are taken from their mean, so sums of products are covariances. _n<j> and _r<j> are those among the rows that hold column j.
    centred = [(F.col(f"upto__n{j}") - (F.col(f"_n{j}") - 1) / 2 - (F.col(f"all__n{j}") + 1) / 2).alias(f"_r{j}") for j in k]
    ranks = written(running_totals(counts, [*groups, "_code"], "_value", [f"_n{j}" for j in k]).select(*groups, "_code", "_value", *(f"_n{j}" for j in k), *centred))
    sizes = {r[0]: r[1] for r in ranks.groupBy("_code").count().collect()}  # a row for each column
    last = max(k, key=lambda i: sizes.get(i, 0))

    def ranked(left: DataFrame, i: int, value: Column) -> DataFrame:
        own = ranks.where(F.col("_code") == i).select(*(F.col(g).alias(f"_own{g}") for g in groups), F.col("_value").alias("_key"), *(F.col(f"_r{j}").alias(f"_r{i}_{j}") for j in k if j != i))
        on = reduce(lambda c, g: c & F.col(g).eqNullSafe(F.col(f"_own{g}")), groups, value == F.col("_key"))
        return left.join(F.broadcast(own) if sizes.get(i, 0) <= FEW_VALUES else own, on, "left").drop("_key", *(f"_own{g}" for g in groups))

    for i in k:
        rows = ranked(rows, i, key(i)) if i != last else rows
    product = lambda i, j: F.col(f"_r{i}_{j}") * F.col(f"_r{j}_{i}")
    own = [(i, j) for i, j in pairs if last not in (i, j)]
    sums = rows.groupBy(*groups, key(last).alias("_last")).agg(*(F.sum(product(i, j)).alias(f"_xy{i}_{j}") for i, j in own), *(F.sum(f"_r{i}_{last}").alias(f"_r{i}_{last}") for i in k if i != last))
    xy = ranked(sums, last, F.col("_last")).groupBy(*groups).agg(*(F.sum(f"_xy{i}_{j}" if (i, j) in own else product(i, j)).alias(f"_xy{i}_{j}") for i, j in pairs))
    of = lambda i, c: F.sum(F.when(F.col("_code") == i, c))
    square = lambda i, j: of(i, F.col(f"_n{j}") * F.col(f"_r{j}") * F.col(f"_r{j}"))
    squares = ranks.groupBy(*groups).agg(*(c for i, j in pairs for c in (of(i, F.col(f"_n{j}")).alias(f"_n{i}_{j}"), square(i, j).alias(f"_xx{i}_{j}"), square(j, i).alias(f"_yy{i}_{j}"))))
    both = xy.unionByName(squares, allowMissingColumns=True).groupBy(*groups).agg(*(F.max(c).alias(c) for i, j in pairs for c in (f"_n{i}_{j}", f"_xy{i}_{j}", f"_xx{i}_{j}", f"_yy{i}_{j}")))
    each = F.array(*(F.struct(F.lit(columns[i]).alias("a"), F.lit(columns[j]).alias("b"), *(F.col(f"_{c}{i}_{j}").alias(c) for c in ("n", "xy", "xx", "yy"))) for i, j in pairs))
    out = both.select(*groups, F.explode(each).alias("_p")).where("_p.n > 0")
    out = out.select(*(F.col(g).alias(c) for g, c in zip(groups, by, strict=True)), "_p.a", "_p.b", "_p.n", (F.col("_p.xy") / F.nullif(F.sqrt(F.col("_p.xx") * F.col("_p.yy")), F.lit(0.0))).alias("rho"))
    return out.withColumn("p", correlation_p(F.col("rho"), F.col("n")))


def cronbach(df: DataFrame, columns: list[str], *by: str) -> DataFrame:
    k = len(columns)
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    parts = sum((F.var_samp(c) for c in columns[1:]), F.var_samp(columns[0]))
    return df.groupBy(*by).agg((k / (k - 1) * (1 - parts / F.var_samp(total))).alias("alpha"))


def entropy(df: DataFrame, label: str, *by: str) -> DataFrame:
    """Shannon entropy of label shares over ln of the number of labels."""
    counts = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("c"))
    # -sum p ln p = ln n - sum c ln c / n: sums alone, no window over a group.
    k, n = F.count(F.lit(1)), F.sum("c")
    return counts.groupBy(*by).agg(k.alias("k"), F.when(k > 1, (F.ln(n) - F.sum(F.col("c") * F.ln("c")) / n) / F.ln(k)).otherwise(F.lit(0.0)).alias("entropy"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Inverse-frequency weights total / (k count)."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.struct(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k")).alias("w")).scalar()
    return counts.withColumn("_w", whole).withColumn("weight", F.col("_w.total") / (F.col("_w.k") * F.greatest("n", F.lit(1)))).drop("_w")


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two raters over 0/1 ratings, with counts of a confusion table."""
    x, y = F.col(a), F.col(b)
    counts = df.where(x.isNotNull() & y.isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.count_if(x == y).alias("same"), F.sum(x).alias("sa"), F.sum(y).alias("sb"))
    n = F.col("n").cast("double")
    chance = (F.col("sa") * F.col("sb") + (n - F.col("sa")) * (n - F.col("sb"))) / (n * n)
    return counts.select("n", (F.col("same") / n).alias("observed"), chance.alias("chance"), ((F.col("same") / n - chance) / (1 - chance)).alias("kappa"))


def f_scores(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Precision, recall and F1 of each label; 0 where undefined."""
    both = df.groupBy(truth, guess).count()
    hits = both.where(F.col(truth) == F.col(guess)).select(F.col(truth).alias("label"), F.col("count").alias("tp"))
    support = both.groupBy(F.col(truth).alias("label")).agg(F.sum("count").alias("support"))
    guessed = both.groupBy(F.col(guess).alias("label")).agg(F.sum("count").alias("guessed"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = support.join(guessed, "label", "full").join(hits, "label", "left").select("label", zero("support").alias("support"), zero("guessed").alias("guessed"), zero("tp").alias("tp"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return out.select("label", "support", "guessed", ratio(F.col("tp"), F.col("guessed")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"), ratio(2 * F.col("tp"), F.col("guessed") + F.col("support")).alias("f1"))
