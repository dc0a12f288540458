"""Byte-level BPE encoding and decoding of whole texts.

Pre-tokens are found by the automaton of `pretokens`; equal slices of a batch
are encoded once: their pairs are merged together, round by round, through a
hash table of all pairs (long slices singly, behind a bounded cache), and the ids
are laid out for all documents with array operations. Byte offsets of the ids are kept,
and decoding joins the ids' byte strings the same way.

Null texts count as empty; an empty text has no ids. Other columns are passed
through or ignored as stated at each function.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel, pretokens

#: Long slices kept in a worker's cache; beyond, the cache starts anew (results do not depend on it).
CACHE_SLICES = 10_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file, or of a byte-level BPE .json file whose ids are ordered as its merges."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        ranks = {bytes(back[c] for c in token): i for token, i in model["vocab"].items() if all(c in back for c in token)}
        merged = {bytes(back[c] for pair in m for c in pair) for m in (m.split(" ") if isinstance(m, str) else m for m in model["merges"])}
        return {k: v for k, v in ranks.items() if len(k) == 1 or k in merged}
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one slice: the adjacent pair of lowest rank, leftmost first, is merged until none is left."""
    if len(piece) > 64:
        return _merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """As merge(), with a heap: n log n for long slices."""
    n = len(piece)
    ends, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or ends[j] != end:
            continue
        alive[j], ends[i], after[i] = False, end, after[j]
        if after[i] < n:
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] < n:
                e = ends[after[k]]
                if (r := ranks.get(piece[k:e])) is not None:
                    heapq.heappush(heap, (r, k, e))
    return [ranks[piece[i : ends[i]]] for i in range(n) if alive[i]]


class PairTable:
    """Open-addressed map from a pair of ids to the id of their merge, probed for whole arrays at a time."""

    EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
    NONE = np.int32(0x7FFFFFFF)

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {(left << 32) | right: i for token, i in ranks.items() for k in range(1, len(token)) if (left := ranks.get(token[:k])) is not None and (right := ranks.get(token[k:])) is not None}
        keys, values = np.fromiter(pairs.keys(), np.uint64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs))
        bits = max(10, (8 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, self.EMPTY), np.full(1 << bits, self.NONE)
        at = self._slots(keys)
        while len(keys):
            free = self.keys[at] == self.EMPTY
            self.keys[at[free]], self.values[at[free]] = keys[free], values[free]  # of several for a slot one stays
            left = self.keys[at] != keys
            keys, values, at = keys[left], values[left], (at[left] + 1) & self.mask
        # A slot's key and value may come from two writers; write the values anew where the keys have settled.
        keys, values = np.fromiter(pairs.keys(), np.uint64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs))
        at = self._slots(keys)
        while len(keys):
            here = self.keys[at] == keys
            self.values[at[here]] = values[here]
            keys, values, at = keys[~here], values[~here], (at[~here] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of each merged pair, NONE where the pair does not merge."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        at = self._slots(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], self.NONE)
        todo = np.flatnonzero((found != keys) & (found != self.EMPTY))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            found = self.keys[at[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (found != self.EMPTY)]
        return out


class Encoder:
    """Encodes batches of documents with one rank file."""

    #: Slices of up to so many bytes are merged together, in one array for each class of lengths.
    WIDTHS = (2, 4, 6, 8, 11, 16, 24, 40)

    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        self.pairs = PairTable(self.ranks)
        #: Ids and ranks are kept in so few bytes as they need; the largest value stands for none.
        self.small = np.uint16 if max(self.ranks.values()) < 0xFFFF else np.uint32
        self.none = np.iinfo(self.small).max
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.cache: dict[bytes, list[int]] = {}
        size = max(self.ranks.values()) + 1
        by_id: list[bytes] = [b""] * size
        for token, i in self.ranks.items():
            by_id[i] = token
        self.lengths = np.fromiter(map(len, by_id), np.int64, size)
        self.offsets = np.concatenate(([0], np.cumsum(self.lengths)))
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)

    def _long(self, piece: bytes) -> list[int]:
        ids = self.cache.get(piece)
        if ids is None:
            ids = merge(piece, self.ranks)
            if len(self.cache) >= CACHE_SLICES:
                self.cache.clear()
            if len(piece) <= 200:
                self.cache[piece] = ids
        return ids

    def _merge_all(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of slices of 2 to `width` bytes, joined, and how many each has: every round merges each slice's best pair.

        One array row holds one position of all slices, so that a round is a few passes over long rows.
        """
        n, none = len(starts), self.none
        ids = np.full((width + 1, n), none, self.small)
        rank = np.full((width + 1, n), none, self.small)  # of the pair that starts at a position
        for w in range(width):
            own = np.flatnonzero(lengths > w)
            ids[w, own] = self.single[data[starts[own] + w]]
        for w in range(width - 1):
            own = np.flatnonzero(lengths > w + 1)
            rank[w, own] = self._ranks_of(ids[w, own], ids[w + 1, own])
        all_ids, left, live = ids, lengths.copy(), np.arange(n)
        while True:
            best = rank.min(0)
            go = np.flatnonzero(best != none)
            if not len(go):
                break
            if len(go) < 0.7 * len(best):  # slices that are done leave
                all_ids[:, live] = ids
                live, ids, rank, best = live[go], ids[:, go], rank[:, go], best[go]
                go = np.arange(len(live))
            at = np.full(len(best), width + 1, np.int8)
            for w in range(width - 1, -1, -1):
                np.copyto(at, np.int8(w), where=(rank[w] == best) & (best != none))
            for w in range(width):
                np.copyto(ids[w], best, where=at == w)
                after = at < w
                np.copyto(ids[w], ids[w + 1], where=after)
                np.copyto(rank[w], rank[w + 1], where=after)
            a = at[go].astype(np.int64)
            for x in (a, a - 1):
                ok = x >= 0
                g, x = go[ok], x[ok]
                right = ids[x + 1, g]
                r = self._ranks_of(ids[x, g], right)
                r[right == none] = none
                rank[x, g] = r
            left[live[go]] -= 1
        all_ids[:, live] = ids
        return all_ids.T[np.arange(width + 1) < left[:, None]], left

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        r = self.pairs.get(left, right)
        return np.where(r == PairTable.NONE, self.none, r).astype(self.small)

    def _slices(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the slices, joined, and how many each has."""
        lengths = ends - starts
        counts = np.ones(len(starts), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = [(at := np.flatnonzero(lengths == 1), self.single[data[starts[at]]])]
        low = 1
        for width in self.WIDTHS:
            at = np.flatnonzero((lengths > low) & (lengths <= width))
            if len(at):
                ids, counts[at] = self._merge_all(data, starts[at], lengths[at], width)
                parts.append((at, ids))
            low = width
        at = np.flatnonzero(lengths > low)
        if len(at):
            raw = data.tobytes()
            long = [self._long(raw[a:b]) for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            counts[at] = [len(x) for x in long]
            parts.append((at, np.array([i for x in long for i in x], np.int32)))
        first = np.cumsum(counts) - counts
        flat = np.empty(int(counts.sum()), np.uint32)
        for at, ids in parts:
            flat[kernel.ragged(first[at], counts[at])] = ids
        return flat, counts

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents (uint32) and the number of ids before each (n + 1 values)."""
        starts = pretokens.boundaries(data, off)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        ends = np.append(starts[1:], len(data))
        h = kernel.slice_hashes(data, starts, ends)
        _, one, rank = kernel.distinct(h)
        check = kernel.slice_hashes(data, starts, ends, second=True)
        if not np.array_equal(check[one][rank], check):  # two slices with one hash: take both hashes as the key
            _, one, rank = np.unique(np.stack((h, check)), axis=1, return_index=True, return_inverse=True)
            rank = rank.ravel()
        flat, counts = self._slices(data, starts[one], ends[one])
        first = np.cumsum(counts) - counts
        each = counts[rank]
        ids = flat[kernel.ragged(first[rank], each)]
        total = np.concatenate(([0], np.cumsum(each)))
        return ids, total[np.searchsorted(starts, off)]

    def byte_offsets(self, ids: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Start of each id's bytes within its own document's text."""
        ends = np.cumsum(self.lengths[ids])
        starts = ends - self.lengths[ids]
        return starts - np.repeat(np.append(ends, 0)[before[:-1] - 1] * (before[:-1] > 0), np.diff(before))

    def decode(self, ids: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all documents, and the number of bytes before each."""
        lengths = self.lengths[ids]
        data = self.bytes[kernel.ragged(self.offsets[ids], lengths)]
        return data, np.concatenate(([0], np.cumsum(lengths)))[before]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids and byte offsets of every whole text: id_col, ids array<int>, offsets array<int>.

    Null text: empty lists. Repeated rows each give a row. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch, data, off in kernel.blocks(batches):
            ids, before = e.encode(data, off)
            at = pa.array(before, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(at, pa.array(ids.view(np.int32))), pa.ListArray.from_arrays(at, pa.array(e.byte_offsets(ids, before).astype(np.int32)))], ["id", "ids", "offsets"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>, offsets array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """Bytes of the texts that encode() gave ids for: id_col, content binary. Null ids: empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            lists = batch.column(1)
            n = np.array([0 if x is None else x for x in lists.value_lengths().to_pylist()], np.int64)
            ids = np.asarray(lists.flatten()).astype(np.int64)
            data, at = e.decode(ids, np.concatenate(([0], np.cumsum(n))))
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["id", "content"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("id"), "ids").mapInArrow(run, f"id {kind}, content binary").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every whole text in one pass: id_col, n_tokens, ids_sha256, decoded_sha256, round_trip boolean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch, data, off in kernel.blocks(batches):
            ids, before = e.encode(data, off)
            back, at = e.decode(ids, before)
            raw, raw_ids, raw_back = data.tobytes(), ids.astype("<u4").tobytes(), back.tobytes()
            rows = range(len(off) - 1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.diff(before), pa.int64()),
                    pa.array([hashlib.sha256(raw_ids[4 * before[i] : 4 * before[i + 1]]).hexdigest() for i in rows], pa.string()),
                    pa.array([hashlib.sha256(raw_back[at[i] : at[i + 1]]).hexdigest() for i in rows], pa.string()),
                    pa.array([raw_back[at[i] : at[i + 1]] == raw[off[i] : off[i + 1]] for i in rows], pa.bool_()),
                ],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean").withColumnRenamed("id", id_col)


def crc32_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
