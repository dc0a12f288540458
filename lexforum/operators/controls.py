"""Controls of findings: gaps between corpora within a span of years, redundant indicators, explainability of indices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforum.functions import stats

#: From which size of a correlation two indicators are redundant; scores of the explainability tests (passed, failed).
REDUNDANT = 0.70
EXPLAINED = {"correlations": (0.8, 0.5), "weights": (0.85, 0.4)}


def temporal_control(df: DataFrame, group: Column, year: Column, first: int, last: int, values: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Is a gap between rows where `group` holds (A) and the others (B) one of time? Compares each value over all rows, and with A held to years first .. last.

    Gives code, n_a, n_a_recent, n_b, mean_a, mean_a_recent, mean_b, u and p of Mann-Whitney and u_recent and p_recent, stars of the
    latter, and gap: `structural` where both p are below alpha, `temporal` where only that of all rows is, else `none`. Rows
    with a null group are left out; rows of A without a year are not recent. A comparison with fewer than 5 rows of a side has no p.
    All values and both comparisons are ranked in one pass.
    """
    parts = F.array(*(F.struct(F.lit(v).alias("code"), F.col(v).cast("double").alias("v")) for v in values))
    recent = ~F.col("_a") | F.coalesce(F.col("_y").between(first, last), F.lit(False))
    long = df.select(group.alias("_a"), year.alias("_y"), F.explode(parts).alias("_p")).select("_a", "_y", "_p.*").where("_a is not null and v is not null and not isnan(v)")
    of = F.when(recent, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    rows = long.select("_a", "code", "v", F.explode(of).alias("recent"))
    means = rows.groupBy("code").agg(
        *(F.count_if(c).alias(f"n_{n}") for n, c in (("a", F.col("_a") & ~F.col("recent")), ("a_recent", F.col("_a") & F.col("recent")), ("b", ~F.col("_a") & ~F.col("recent")))),
        *(F.avg(F.when(c, F.col("v"))).alias(f"mean_{n}") for n, c in (("a", F.col("_a") & ~F.col("recent")), ("a_recent", F.col("_a") & F.col("recent")), ("b", ~F.col("_a") & ~F.col("recent")))),
    )
    tests = stats.mann_whitney(rows, F.col("_a"), "v", ["code", "recent"])
    pick = lambda c, r: F.max(F.when(F.col("recent") == r, F.col(c)))
    both = tests.groupBy("code").agg(*(pick(c, r).alias(c + ("_recent" if r else "")) for c in ("u", "p") for r in (False, True)))
    out = means.join(both, "code", "left")
    gap = F.when((F.col("p") < alpha) & (F.col("p_recent") < alpha), "structural").when((F.col("p") < alpha) & F.col("p_recent").isNotNull(), "temporal").when(F.col("p_recent").isNotNull(), "none")
    return out.withColumn("stars", stats.stars(F.col("p_recent"))).withColumn("gap", gap)


def correlated_pairs(df: DataFrame, columns: Sequence[str], above: float = REDUNDANT) -> DataFrame:
    """Spearman's rho of every two columns over the rows that hold both: a, b, n, rho, p, redundant (size above the limit).

    All columns are ranked in one pass; a pair without a rho (a constant column) is not redundant.
    """
    values = df.select(*(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in columns))
    return stats.spearman_pairs(values, columns).withColumn("redundant", F.coalesce(F.abs("rho") > above, F.lit(False)))


def explainability(df: DataFrame, columns: Sequence[str], weights: Mapping[str, Mapping[str, float]], checks: Mapping[str, bool], above: float = REDUNDANT) -> DataFrame:
    """Rows test, passed, score, detail: no redundant indicators (detail: their pairs), weights of each index that sum to one, share of a checklist that holds."""
    pairs = correlated_pairs(df, columns, above)
    told = F.concat_ws(" ", "a", "b", F.format_number("rho", 3))
    found = pairs.agg(F.count_if("redundant").alias("n"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("redundant"), told))), ", ").alias("detail"))  # a row for each two columns
    row = lambda test, passed, score, detail: F.struct(F.lit(test).alias("test"), passed.alias("passed"), score.cast("double").alias("score"), detail.alias("detail"))
    good, bad = EXPLAINED["correlations"]
    alone = F.col("n") == 0
    off = [name for name, w in weights.items() if abs(sum(w.values()) - 1.0) >= 0.001]
    share = sum(checks.values()) / len(checks) if checks else 0.0
    missed = ", ".join(k for k, v in checks.items() if not v)
    rows = F.array(
        row("correlations", alone, F.when(alone, good).otherwise(bad), F.col("detail")),
        row("weights", F.lit(not off), F.lit(EXPLAINED["weights"][bool(off)]), F.lit(", ".join(off))),
        row("checklist", F.lit(share == 1.0), F.lit(round(share, 3)), F.lit(missed)),
    )
    return found.select(F.explode(rows).alias("_r")).select("_r.*")
