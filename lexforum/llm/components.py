"""Connected components of a table of links.

Up to ONE_TASK links, a bounded number, one task joins them by union-find; beyond,
large-star and small-star steps alternate until nothing changes. Both give the
least node of each component.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed


#: Links that one task takes at most.
ONE_TASK = 200_000


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict = {}

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parent.setdefault(a, a), parent.setdefault(b, b)
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    if parent:
        nodes = list(parent)
        kind = batch.schema.field(0).type
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([root(x) for x in nodes], kind)], ["node", "component"])


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Each node links its neighbours (large: those above it; small: those below it) to the least of itself and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.where("b < a")
    least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    out = both.join(least, "a")
    kept = out.where("b > a") if large else out
    links = kept.select(F.col("b").alias("a"), F.col("low").alias("b"))
    if not large:
        links = links.unionByName(least.select("a", F.col("low").alias("b")))
    return links.where("a <> b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", one_task: int = ONE_TASK) -> DataFrame:
    """node, component (the least node reachable) for every node that has a link to another; null ends are left out."""
    edges = checkpointed(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(f"`{a}` is not null and `{b}` is not null and `{a}` <> `{b}`").distinct())
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    if edges.count() <= one_task:
        kind = edges.schema["a"].dataType.simpleString()
        return checkpointed(edges.repartition(1).mapInArrow(_union_find, f"node {kind}, component {kind}"))
    before = None
    while True:  # the number of rounds follows the logarithm of the longest path
        edges = checkpointed(_stars(_stars(edges, True), False))
        # Both steps keep the components; when nothing changes the links are stars around the least nodes.
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.count_distinct("a")).first()
        if now == before or now[0] == now[2] and edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
