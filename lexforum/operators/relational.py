"""Relational operators: joins by prefix, ordinal and alias, unpivot, folds over intervals."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def unpivot_indicators(df: DataFrame, key: Sequence[str], pattern: str = r"y\d+_.*") -> DataFrame:
    """Long form of every column whose name matches: key, codigo, valor; nulls and NaN are left out."""
    columns = [c for c in df.columns if re.fullmatch(pattern, c)]
    long = df.select(*key, *(F.col(c).cast("double").alias(c) for c in columns)).unpivot(list(key), columns, "codigo", "valor")
    return long.withColumn("valor", F.nanvl("valor", F.lit(None).cast("double"))).where("valor is not null")


def prefix_join(short: DataFrame, full: DataFrame, prefix: str, name: str, least: int = 16) -> DataFrame:
    """Each prefix (of `least` characters or more, ellipsis dropped) with the one name that starts with it.

    Adds match_count and, where it is 1, the name as matched; an equi-join on the first `least` characters comes first.
    """
    key = F.regexp_replace(F.col(prefix), r"(\.\.\.|…)$", "")
    left = short.withColumn("_p", key).withColumn("_k", F.when(F.length(key) >= least, F.substring(key, 1, least)))
    right = full.select(F.col(name).alias("_n"), F.substring(name, 1, least).alias("_k")).distinct()
    joined = left.join(right, (left["_k"] == right["_k"]) & right["_n"].startswith(left["_p"]), "left")
    return joined.groupBy(*(left[c] for c in short.columns)).agg(F.count("_n").cast("int").alias("match_count"), F.when(F.count("_n") == 1, F.min("_n")).alias("matched"))


def ordinal_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_order: str, right_order: str, how: str = "inner") -> DataFrame:
    """The n-th row of a group on the left with the n-th on the right; adds n."""
    number = lambda df, order: df.withColumn("n", F.row_number().over(W.partitionBy(*by).orderBy(order)))
    return number(left, left_order).join(number(right, right_order), [*by, "n"], how)


def alias_join(df: DataFrame, dim: DataFrame, name: str, aliases: str, how: str = "left") -> DataFrame:
    """Rows with the dimension row one of whose aliases equals the name, case and outer blanks aside."""
    exploded = dim.withColumn("_alias", F.explode(aliases)).withColumn("_alias", F.lower(F.trim("_alias"))).drop_duplicates(["_alias"]).drop(aliases)
    return df.withColumn("_alias", F.lower(F.trim(name))).join(exploded, "_alias", how).drop("_alias")


def interval_of(point: Column, intervals: Column) -> Column:
    """Index of the interval (struct<start, end>) of an array that holds the point; -1 if none does."""
    hit = F.filter(F.transform(intervals, lambda s, i: F.struct(i.alias("i"), s.alias("s"))), lambda x: (x["s"]["start"] <= point) & (point < x["s"]["end"]))
    return F.coalesce(F.try_element_at(hit, F.lit(1))["i"], F.lit(-1))


def keep_apart(positions: Column, least: int) -> Column:
    """Ordered fold: a position nearer than `least` to any kept one goes."""
    none = F.filter(positions, lambda p: F.lit(False))
    return F.aggregate(positions, none, lambda kept, p: F.when(F.exists(kept, lambda k: F.abs(k - p) < least), kept).otherwise(F.concat(kept, F.array(p))))


def replace_near(positions: Column, least: int) -> Column:
    """Ordered fold: of a chain of positions less than `least` after the last kept one, the latest stays in its place."""
    none = F.filter(positions, lambda p: F.lit(False))
    last = lambda kept: F.try_element_at(kept, F.lit(-1))
    return F.aggregate(positions, none, lambda kept, p: F.when(last(kept).isNotNull() & (p - last(kept) < least), F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(p))).otherwise(F.concat(kept, F.array(p))))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return child.join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def seeded(seed: int, key: str) -> Column:
    """A text that orders rows as if drawn: the same wherever the row is read."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def sample_per_group(df: DataFrame, by: str, most: int, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """At most `most` rows of each group, by a seeded hash of the key."""
    order = W.partitionBy(by).orderBy(seeded(seed, key), key)
    return df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def priority_sample(df: DataFrame, by: str, priority: Column, most: int = 35, others: int = 15, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """Of each group at most `most` priority rows and `others` of the rest, drawn by a seeded hash; adds is_priority."""
    flagged = df.withColumn("is_priority", F.coalesce(priority, F.lit(False)))
    order = W.partitionBy(by, "is_priority").orderBy(seeded(seed, key), key)
    return flagged.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= F.when(F.col("is_priority"), most).otherwise(others)).drop("_n")


def in_training(key: str, per_cent: int = 80, seed: int = 42) -> Column:
    """Whether a row belongs to the larger part of a split by a seeded hash."""
    return F.conv(F.substring(seeded(seed, key), 1, 8), 16, 10).cast("long") % 100 < per_cent


def fragments(text: Column, size: int = 800) -> Column:
    """Head, middle and tail of long texts (over 3 sizes), else the whole, blanks collapsed."""
    flat = F.regexp_replace(F.regexp_replace(text, r"\n+", " "), r" +", " ")
    n = F.length(flat)
    half = (n / 2).cast("int")
    three = F.array(F.substring(flat, 1, size), F.substring(flat, F.greatest(half - size // 2, F.lit(0)) + 1, F.lit(size)), F.substring(flat, F.greatest(n - size, F.lit(0)) + 1, F.lit(size)))
    return F.when(n > 3 * size, three).otherwise(F.array(F.substring(flat, 1, size)))


def representative(text: Column, most: int = 800, least: int = 200) -> Column:
    """One fragment of a text: blanks collapsed; of a text of more than `most` characters its beginning, up to the last full stop that a blank follows, if that stands behind `least` characters; null for shorter texts than `least`."""
    flat = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\n+", " "), r" {2,}", " "), r"^\s+|\s+$", "")
    head = F.substring(flat, 1, most)
    stop = F.length(head) - F.length(F.substring_index(head, ". ", -1)) - 2  # place of the full stop
    cut = F.when(head.contains(". ") & (stop > least), F.substring(head, F.lit(1), stop + 1)).otherwise(head)
    return F.when(F.length(flat) > most, F.regexp_replace(cut, r"^\s+|\s+$", "")).when(F.length(flat) >= least, flat)
