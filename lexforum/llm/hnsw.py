"""Approximate nearest neighbours by cosine: one hierarchical navigable small-world graph per shard, results merged.

Shards are dealt by a hash of the vector, so that equal vectors meet; every
distinct vector is a node of its shard's graph. Neighbours are kept in flat
arrays, one for the ground layer and one for the layers above. Nulls, ties,
repeated rows and empty tables: see `vectors`.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from . import vectors

#: Links of a node on upper layers (twice as many on the ground), beam while building, beam while searching.
LINKS, BUILD_BEAM, SEARCH_BEAM = 16, 64, 80


class Graph:
    """Flat neighbour arrays over unit vectors. ground: n x 2 LINKS; upper: one row of LINKS for each layer above of each node, at row[node] + layer - 1."""

    def __init__(self, unit: np.ndarray, level: np.ndarray, ground: np.ndarray, upper: np.ndarray, row: np.ndarray, entry: int):
        self.unit, self.level, self.ground, self.upper, self.row, self.entry = unit, level, ground, upper, row, entry
        self.seen, self.mark = np.zeros(len(unit), np.int64), 0

    @classmethod
    def build(cls, unit: np.ndarray, seed: int = 1) -> Graph:
        n = len(unit)
        level = np.minimum((-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(LINKS)).astype(np.int64), 12)
        row = np.cumsum(level) - level
        g = cls(unit, level, np.full((n, 2 * LINKS), -1, np.int32), np.full((int(level.sum()), LINKS), -1, np.int32), row, 0)
        for i in range(1, n):
            g._insert(i)
        return g

    def _links(self, node: int, layer: int) -> np.ndarray:
        return self.ground[node] if layer == 0 else self.upper[self.row[node] + layer - 1]

    def beam(self, q: np.ndarray, start: list[tuple[float, int]], width: int, layer: int) -> list[tuple[float, int]]:
        """The `width` nearest nodes found from the start nodes, as (distance, node), nearest first."""
        self.mark += 1
        seen, mark, unit = self.seen, self.mark, self.unit
        for _, x in start:
            seen[x] = mark
        ahead = list(start)
        heapq.heapify(ahead)
        best = [(-d, x) for d, x in start]
        heapq.heapify(best)
        while ahead:
            d, x = heapq.heappop(ahead)
            if d > -best[0][0] and len(best) >= width:
                break
            near = self._links(x, layer)
            near = near[near >= 0]
            near = near[seen[near] != mark]
            if not len(near):
                continue
            seen[near] = mark
            far = 1.0 - unit[near] @ q
            worst = -best[0][0]
            if len(best) >= width:
                ok = far < worst
                near, far = near[ok], far[ok]
            for e, y in zip(far.tolist(), near.tolist(), strict=True):
                if len(best) < width:
                    heapq.heappush(best, (-e, y))
                elif e < -best[0][0]:
                    heapq.heapreplace(best, (-e, y))
                else:
                    continue
                heapq.heappush(ahead, (e, y))
        return sorted((-d, x) for d, x in best)

    def _select(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Near nodes that lie in different directions: each nearer to the new node than to those taken; the rest fill up."""
        nodes = np.array([x for _, x in found])
        if len(nodes) <= most:
            return nodes.tolist()
        between = 1.0 - self.unit[nodes] @ self.unit[nodes].T
        taken: list[int] = []
        left: list[int] = []
        for i, (d, _) in enumerate(found):
            if len(taken) == most:
                break
            (taken if not taken or d < between[i, taken].min() else left).append(i)
        return nodes[(taken + left)[:most]].tolist()

    def _insert(self, i: int) -> None:
        q, top = self.unit[i], int(self.level[self.entry])
        near = [(float(1.0 - self.unit[self.entry] @ q), self.entry)]
        for layer in range(top, int(self.level[i]), -1):
            near = self.beam(q, near, 1, layer)
        for layer in range(min(top, int(self.level[i])), -1, -1):
            near = self.beam(q, near, BUILD_BEAM, layer)
            for x in (chosen := self._select(near, LINKS)):
                links = self._links(x, layer)
                free = np.flatnonzero(links < 0)
                if len(free):
                    links[free[0]] = i
                else:
                    own = np.append(links, i)
                    far = 1.0 - self.unit[own] @ self.unit[x]
                    links[:] = self._select(sorted(zip(far.tolist(), own.tolist(), strict=True)), len(links))
            self._links(i, layer)[: len(chosen)] = chosen
        if self.level[i] > top:
            self.entry = i

    def search(self, q: np.ndarray, width: int) -> list[int]:
        near = [(float(1.0 - self.unit[self.entry] @ q), self.entry)]
        for layer in range(int(self.level[self.entry]), 0, -1):
            near = self.beam(q, near, 1, layer)
        return [x for _, x in self.beam(q, near, width, 0)]


def _unit(matrix: np.ndarray) -> np.ndarray:
    scaled = matrix / np.abs(matrix).max(1, keepdims=True)
    return (scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))).astype(np.float32)


def _clean(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return matrix, (matrix != 0).any(1)


def _build(matrix: np.ndarray) -> vectors.Index:
    g = Graph.build(_unit(matrix))
    return {"level": g.level, "ground": g.ground, "upper": g.upper, "row": g.row, "entry": np.array(g.entry)}


def cosine(matrix: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines of rows with q in double precision; sums run in the same order for every row."""
    return (matrix * q).sum(1) / (np.sqrt((matrix * matrix).sum(1)) * np.sqrt((q * q).sum()))


def _search(indexes: list[vectors.Index], queries: np.ndarray, own: np.ndarray, k: int, known: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    unit = _unit(queries)
    graphs = [Graph(_unit(x["vectors"]), x["level"], x["ground"], x["upper"], x["row"], int(x["entry"])) for x in indexes]
    for i in range(len(queries)):
        ids, scores = [], []
        for x, g in zip(indexes, graphs, strict=True):
            nodes = np.array(g.search(unit[i], max(SEARCH_BEAM, 2 * k)))[: 2 * k + 8]
            exact = cosine(x["vectors"][nodes], queries[i])
            counts = x["off"][nodes + 1] - x["off"][nodes]
            ids.append(x["ids"][np.concatenate([np.arange(a, a + c) for a, c in zip(x["off"][nodes], counts, strict=True)])])
            scores.append(np.repeat(exact, counts))
        found, score = np.concatenate(ids), np.concatenate(scores)
        other = found != own[i]
        yield i, found[other], score[other]


def nearest(table: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = vectors.SHARD_ROWS) -> DataFrame:
    """The k nearest found rows of every query row: query_id, rank, vec_id, score (cosine)."""
    return vectors.top_k(table, id_col, vector_col, every, k, _clean, _build, _search, "double", shard_rows)
