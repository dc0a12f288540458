"""Exact top-k by integer inner product: a KD-tree per shard, searched best first.

Trees are split at medians of the widest dimension, and every node keeps the
tight bounding box of its vectors. The box gives the largest inner product any
vector inside can have with a query; nodes are visited in this order, until it
falls below the k-th best score so far, which is carried on from shard to shard, and
from the first group of shards to all others.
Nulls, ties, repeated rows and empty tables: see `vectors` (zero vectors take
part here).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from . import vectors

#: Vectors of a leaf at most; largest component for which sums of products stay exact as doubles.
LEAF, SCALE = 128, 1024


def _clean(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.floor(matrix * SCALE).astype(np.int64), np.ones(len(matrix), bool)


def build(matrix: np.ndarray) -> vectors.Index:
    """order: rows by leaf; first, last: each node's range of it; left, right: children (-1: leaf); low, high: boxes."""
    order = np.arange(len(matrix))
    first, last, left, right, low, high = [], [], [], [], [], []

    def node(a: int, b: int) -> int:
        i = len(first)
        part = matrix[order[a:b]]
        first.append(a), last.append(b), left.append(-1), right.append(-1), low.append(part.min(0)), high.append(part.max(0))
        return i

    todo = [node(0, len(matrix))]
    while todo:
        i = todo.pop()
        a, b = first[i], last[i]
        if b - a <= LEAF:
            continue
        spread = high[i].astype(float) - low[i].astype(float)
        column = matrix[order[a:b], int(spread.argmax())]
        middle = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(column, middle, kind="introselect")]
        left[i], right[i] = node(a, a + middle), node(a + middle, b)
        todo += [left[i], right[i]]
    return {"order": order, "first": np.array(first), "last": np.array(last), "left": np.array(left), "right": np.array(right), "low": np.array(low), "high": np.array(high)}


def _exact(*parts: np.ndarray) -> bool:
    """Whether inner products of these fit a double's 53 bits."""
    a, b = (float(np.abs(p.astype(float)).max()) if p.size else 0.0 for p in parts)
    return a * b * max(1, parts[0].shape[-1]) < 2.0**53


def _search(indexes: list[vectors.Index], queries: np.ndarray, own: np.ndarray, k: int, known: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    kth = known.astype(float).copy()  # carried from group to group, and from shard to shard
    ids: list[list[np.ndarray]] = [[] for _ in queries]
    scores: list[list[np.ndarray]] = [[] for _ in queries]
    for x in indexes:
        numbers = np.float64 if _exact(x["vectors"], queries) else np.int64
        matrix, q = x["vectors"][x["order"]].astype(numbers), queries.astype(numbers)
        bounds = np.maximum(q, 0).astype(float) @ x["high"].astype(float).T + np.minimum(q, 0).astype(float) @ x["low"].astype(float).T
        # Where sums are not exact, a bound is raised by what rounding can take: of the terms' sizes, not of their sum.
        sizes = 0.0 if numbers is np.float64 else np.abs(q).astype(float) @ np.maximum(np.abs(x["high"].astype(float)), np.abs(x["low"].astype(float))).T
        bounds = bounds + 1e-9 * sizes
        count = np.diff(x["off"])[x["order"]]
        start = x["off"][:-1][x["order"]]
        first, last, left, right = (x[c].tolist() for c in ("first", "last", "left", "right"))
        for i in range(len(q)):
            bound = bounds[i]
            heap = [(-bound[0], 0)]
            while heap:
                b, node = heapq.heappop(heap)
                if -b < kth[i]:  # an equal score may still win by its id
                    break
                if left[node] >= 0:
                    for child in (left[node], right[node]):
                        if bound[child] >= kth[i]:
                            heapq.heappush(heap, (-bound[child], child))
                    continue
                a, z = first[node], last[node]
                s = matrix[a:z] @ q[i]
                good = np.flatnonzero(s >= kth[i])
                if not len(good):
                    continue
                c = count[a + good]
                at = np.repeat(start[a + good] - (np.cumsum(c) - c), c) + np.arange(c.sum())
                found, score = x["ids"][at], np.repeat(s[good], c).astype(np.int64)
                other = found != own[i]
                ids[i].append(found[other]), scores[i].append(score[other])
                joined, names = np.concatenate(scores[i]), np.concatenate(ids[i])
                if len(joined) > k:
                    keep = np.lexsort((names, -joined))[:k]
                    joined, names = joined[keep], names[keep]
                ids[i], scores[i] = [names], [joined]
                if len(joined) >= k:
                    kth[i] = max(kth[i], float(joined.min()))
    for i in range(len(queries)):
        if ids[i]:
            yield i, ids[i][0], scores[i][0]


def top_k(table: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = vectors.SHARD_ROWS) -> DataFrame:
    """The k rows with the largest inner product for every query row, vectors taken as floor(1024 x): query_id, rank, vec_id, score."""
    return vectors.top_k(table, id_col, vector_col, every, k, _clean, build, _search, "long", shard_rows)
