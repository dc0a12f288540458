"""LM scoring by a hierarchical Pitman-Yor model over words, with a model of spellings below it.

A text is the sequence of its lower-cased words, closed by an end mark. The
restaurant of a context (the word before; a mark before the first word) has the
restaurant of all words as its parent, whose new dishes come from restaurants of
bytes: a word is spelled byte by byte, in the context of the two bytes before,
whose parents are those of one byte and of none. A new table is a customer of
the parent.

Seating is sampled by Gibbs, in blocks: in a sweep every customer of a pair
(context, symbol) leaves, and the tables of all of them are drawn anew. Given a
Gamma variable of each restaurant, the pairs of it are independent, and c customers
of a pair take t tables with a chance proportional to S(c, t) L**t (S: generalised
Stirling numbers of the discount; L: discount * Gamma variable * probability in
the parent). `seated` draws t at a cost of about t steps, however large c is: where
tables are many, by seating the Chinese restaurant of a strength that suits L table by
table and keeping it with the chance that makes the law right (from CROWD tables on,
from the law itself, taken at its saddle point); where one
table holds most customers, by STEPS Metropolis steps that draw all others anew. Strengths are sampled with auxiliary
variables, discounts are estimated from the pairs that have come once and twice.
Predictive probabilities are averaged over samples.

How it is dealt. Words that hold more than a share of 1 / ranges of all tokens are
found first; as contexts they are split into classes by the word before them (the
first word's context by the document's id), so that no restaurant outgrows its
range. A second pass counts each chunk's distinct pairs and words, which travel as
packed arrays: pairs to the range of their context, words to the range of their
hash. (1) Ranges of contexts sample their restaurants over a root of their own, and
send the tables of each word on. (2) Ranges of words sample the common root from
these, over the spellings. (3) A third pass counts the pairs again, which takes less
than keeping them; ranges of contexts sample their restaurants once more, given the
root's averaged probabilities, and answer every chunk's pairs. (4) Chunks score their
texts.

Approximate are: levels pass on averages (3 is not fed back to 2); pairs within a
range that agree in 63 bits of their hash are one; what the root's ranges hold of
it stands for the tables of all.

Null text: empty, the end mark alone. Null ids and null `held_out` count as held
in. Repeated rows count as often as they occur. Very long texts are a chunk of their
own. An empty table gives an empty result; other columns are not read, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel
from .shared import buckets, checkpointed, free_shuffles, prepare

#: Sweeps before the first sample, and samples.
BURN, SAMPLES = 2, 3
#: Metropolis steps of a pair in a sweep, where it takes such.
STEPS = 2
#: Tables of a pair, and customers beyond them, from which its law is taken by the saddle point.
CROWD = 64
#: Bytes before a byte of a spelling that are its context.
SPELLING = 2
#: Bytes of text whose pairs are counted together, and texts, at most.
CHUNK_BYTES, CHUNK_TEXTS = 20 << 20, 60_000
#: A pair in one number: bits of its context, of its symbol, and one for whether it was learned from.
CONTEXT_BITS, SYMBOL_BITS = 26, 37
_SYMBOL = np.uint64((1 << SYMBOL_BITS) - 1)
#: log10 below which a probability from the level above is held while a level samples; what it lacks is added to the logarithms of those that nothing was learned of.
FLOOR = -200.0
#: The end mark and what stands before a text, as hashes; what closes a spelling.
END, START, CLOSE = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F), 32


# -- the sampler --------------------------------------------------------------


def seated(customers: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator, tables: np.ndarray | None = None, beside: np.ndarray | None = None, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Tables of so many customers (1 or more) that eat the same dish: t with a chance proportional to S(customers, t) weight**t; and how many sit beside the first customer's table.

    tables, beside: where Metropolis steps go on from (one table, if not given).
    """
    out, others = np.ones(len(customers), np.int64), np.zeros(len(customers), np.int64)
    if tables is not None:
        fits = customers - beside >= 1
        out, others = np.where(fits, tables, 1), np.where(fits, beside, 0)
    weight = np.maximum(weight, 1e-12)
    more = customers > 1
    out[~more], others[~more] = 1, 0
    many = weight > discount ** (2 - discount) * customers.astype(float) ** discount
    if len(at := np.flatnonzero(many & more)):
        out[at] = _of_similar_sizes(customers[at], weight[at], discount, rng)
        others[at] = out[at] - 1
    if len(at := np.flatnonzero(~many & more)):
        out[at], others[at] = _beside_a_large_one(customers[at], weight[at], discount, rng, out[at], others[at], steps)
    return out, others


def _of_similar_sizes(customers: np.ndarray, weight: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Exact, where tables are many for the customers.

    Drawn from the Chinese restaurant of strength a, whose chance is proportional to S(customers, t) (a + d) .. (a + (t - 1) d),
    and kept with a chance proportional to the quotient of both, which is largest at t = top.
    """
    n = customers.astype(float)
    # log of 1 - z, where tables of sizes tempered by z have the asked sum on average: weight z (1 - z)**(d - 1) = n.
    goal = np.log(n) - np.log(weight)
    u = np.minimum(-np.logaddexp(0, goal) / (1 - d), -1e-12)
    for _ in range(8):
        e = np.exp(u)
        u = np.minimum(u - (np.log1p(-e) + (d - 1) * u - goal) / (-e / (1 - e) + d - 1), 0.3 * u)
    strength = np.maximum(weight * np.exp(d * u), 1e-9) - d
    top = np.clip(np.ceil((weight - strength) / d), 1, n)
    n, out, open_ = customers, np.ones(len(customers), np.int64), np.arange(len(customers))
    mean = 1 + weight / d * -np.expm1(d * u)
    crowd = (mean >= CROWD) & (n - mean >= CROWD)
    for i in np.flatnonzero(crowd).tolist():
        out[i] = _of_a_crowd(float(n[i]), float(weight[i]), float(mean[i]), float(u[i]), d, rng)
    n, weight, strength, top, open_ = (x[~crowd] for x in (n, weight, strength, top, open_))
    quotient = lambda t, w, s: t * np.log(w / d) - _rising(s / d + 1, t - 1)
    best = quotient(top, weight, strength)
    while len(open_):
        t = _chinese(n, strength, d, rng)
        kept = np.log(1 - rng.random(len(t))) <= quotient(t, weight, strength) - best
        out[open_[kept]] = t[kept]
        open_, n, weight, strength, best = (x[~kept] for x in (open_, n, weight, strength, best))
    return out


def _of_a_crowd(n: float, weight: float, mean: float, u: float, d: float, rng: np.random.Generator) -> int:
    """One pair's tables where they are CROWD or more: from the law itself, on a grid of 48 places a square root of the mean.

    S(n, t) is n! / (t! d**t) times the n-th coefficient of (1 - (1 - z)**d)**t, which is taken at its saddle point; the error falls with 1 / t.
    """
    step = max(1.0, np.floor(np.sqrt(mean) / 48))
    t = np.arange(np.floor(max(2.0, mean - 8 * np.sqrt(mean))), min(n - 1, mean + 8 * np.sqrt(mean)), step)
    u = np.full(len(t), u)
    goal = np.log(n / t)
    for _ in range(12):
        z, e = -np.expm1(u), np.exp(d * u)
        size = d * z * np.exp((d - 1) * u) / (1 - e)  # mean size of a table at this tilt
        off = np.log(size) - goal
        slope = -(np.exp(u) / z) * (1 + (1 - d) * z / np.exp(u) - size)
        u = np.minimum(u - off / slope, 0.1 * u)
    z, e = -np.expm1(u), np.exp(d * u)
    size = d * z * np.exp((d - 1) * u) / (1 - e)
    spread = size * (1 + (1 - d) * z / np.exp(u) - size)
    law = t * (np.log(weight / d) + np.log(1 - e)) - n * np.log(z) - _log_gamma(t + 1) - 0.5 * np.log(t * spread)
    p = np.cumsum(np.exp(law - law.max()))
    k = int(np.searchsorted(p, rng.random() * p[-1]))
    return int(min(n, t[k] + rng.integers(0, int(step))))


def _beside_a_large_one(customers: np.ndarray, weight: np.ndarray, d: float, rng: np.random.Generator, tables: np.ndarray, beside: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """By Metropolis steps, where one table holds most customers: the others are drawn freely, a Poisson number of sizes with a long tail, and
    the first customer's table holds the rest. That table's size n has a chance proportional to G(n - d) / G(n) besides."""
    t, own = tables.copy(), (customers - beside).astype(float)
    room = lambda n: _log_gamma(n - d) - _log_gamma(n)
    mean = weight / d
    for _ in range(steps):
        others = rng.poisson(mean)
        some = np.flatnonzero((others > 0) | (t > 1))
        k = others[some]
        p = np.maximum(rng.beta(d, 1 - d, int(k.sum())), 1e-15)
        sizes = np.ceil(np.log(1 - rng.random(len(p))) / np.log1p(-np.minimum(p, 1 - 1e-15)))
        left = customers[some] - np.bincount(np.repeat(np.arange(len(k)), k), np.maximum(sizes, 1), len(k))
        fits = np.flatnonzero(left >= 1)
        some, k, left = some[fits], k[fits], left[fits]
        taken = np.log(1 - rng.random(len(some))) <= room(left) - room(own[some])
        t[some[taken]], own[some[taken]] = k[taken] + 1, left[taken]
    return t, customers - own.astype(np.int64)


def _rising(a: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log of a (a + 1) .. (a + n - 1)."""
    return _log_gamma(a + n) - _log_gamma(a)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the Gamma function of positive numbers, by Stirling's series from 8 up (error below 1e-10)."""
    y, below = x.astype(float), np.zeros(len(x))
    small = np.flatnonzero(y < 8)
    if len(small):
        z, product = y[small].copy(), np.ones(len(small))
        for _ in range(8):
            low = z < 8
            product[low] *= z[low]
            z += low
        y[small], below[small] = z, np.log(product)
    r = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r / 1188)))) / y - below


def _chinese(n: np.ndarray, strength: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables that n customers of a Chinese restaurant take: the first table gets a Beta share of all others, the next of what is left."""
    out = np.zeros(len(n), np.int64)
    who, left, k = np.arange(len(n)), n.copy(), 1
    while len(who):
        out[who] += 1
        share = rng.beta(1 - d, strength[who] + k * d)
        left = left - 1 - rng.binomial(left - 1, share)
        go = left > 0
        who, left, k = who[go], left[go], k + 1
    return out


class Level:
    """Restaurants of one level: pairs (context, symbol) with customers and tables."""

    def __init__(self, context: np.ndarray, customers: np.ndarray, rng: np.random.Generator, discount: float | None = None, strength: float = 1.0, sampled: bool = True):
        self.context, self.rng, self.strength, self.sampled = context, rng, strength, sampled
        self.rooms = int(context.max(initial=-1)) + 1
        self.seat(customers)
        once, twice = int((customers == 1).sum()), int((customers == 2).sum())
        self.discount = float(np.clip((once + 1) / (once + 2 * twice + 2), 0.05, 0.95)) if discount is None else discount

    def seat(self, customers: np.ndarray) -> None:
        """So many customers of each pair are there, at one table to begin with."""
        self.customers, self.tables, self.beside = customers, np.minimum(customers, 1), np.zeros(len(customers), np.int64)
        self._sum()

    def _sum(self) -> None:
        self.all_customers = np.bincount(self.context, self.customers, self.rooms)
        self.all_tables = np.bincount(self.context, self.tables, self.rooms)

    def predict(self, parent: np.ndarray) -> np.ndarray:
        """Probability of each pair's symbol in its context, given that in the parent context."""
        whole = self.strength + self.all_customers
        new = (self.strength + self.discount * self.all_tables) / whole
        return (self.customers - self.discount * self.tables) / whole[self.context] + new[self.context] * parent

    def move(self, parent: np.ndarray) -> None:
        """Every customer of every pair leaves and is seated anew."""
        x = self.rng.standard_gamma(self.strength / self.discount + self.all_tables)
        some = np.flatnonzero(self.customers)
        tables, beside = np.zeros((2, len(self.customers)), np.int64)
        tables[some], beside[some] = seated(self.customers[some], self.discount * x[self.context[some]] * parent[some], self.discount, self.rng, self.tables[some], self.beside[some])
        self.tables, self.beside = tables, beside
        self._sum()

    def strengthen(self) -> None:
        """A new strength, given the seating, by auxiliary Beta and Bernoulli variables and a Gamma prior with mean 1."""
        some = self.all_customers >= 2
        if not self.sampled or not some.any():
            return
        c, t = self.all_customers[some], self.all_tables[some].astype(np.int64)
        lost = -np.log(np.maximum(self.rng.beta(self.strength + 1, c - 1), 1e-300)).sum()
        # Tables of all restaurants by their place: how many have a k-th one.
        have = np.cumsum(np.bincount(t)[::-1])[::-1][2:]
        drawn = self.rng.binomial(have, self.strength / (self.strength + self.discount * np.arange(1, len(have) + 1))).sum() if len(have) else 0
        self.strength = float(np.clip(self.rng.gamma(1 + drawn) / (1 + lost), 1e-3, 1e4))


class Part(Level):
    """Some pairs of one restaurant, of which all customers are known; of its tables, these pairs' ones stand for all. Its strength stays: with so many tables it does not matter."""

    def __init__(self, customers: np.ndarray, rng: np.random.Generator, total: float, rest: float):
        self.total, self.rest = total, rest
        super().__init__(np.zeros(len(customers), np.int64), customers, rng, sampled=False)

    def _sum(self) -> None:
        self.all_customers, self.all_tables = np.full(self.rooms, self.total), np.full(self.rooms, self.tables.sum() * self.rest)


class Restaurants:
    """Levels from the longest contexts to the shortest; parents[j]: the pair of level j + 1 that stands for each pair of level j."""

    def __init__(self, levels: list[Level], parents: list[np.ndarray], base: np.ndarray):
        self.levels, self.parents, self.base = levels, parents, base
        for j, at in enumerate(parents):
            self._send(j, at)

    def _send(self, j: int, at: np.ndarray) -> None:
        """The tables of a level are the customers of the next."""
        upper = self.levels[j + 1]
        upper.customers = np.bincount(at, self.levels[j].tables, len(upper.context)).astype(np.int64)
        upper.tables = np.minimum(np.maximum(upper.tables, upper.customers > 0), upper.customers)
        upper._sum()

    def predict(self) -> list[np.ndarray]:
        p = [np.zeros(0)] * len(self.levels)
        above = self.base
        for j in range(len(self.levels) - 1, -1, -1):
            p[j] = self.levels[j].predict(above)
            above = p[j][self.parents[j - 1]] if j else above
        return p

    def sweep(self) -> None:
        p = self.predict()
        for j, level in enumerate(self.levels):
            level.move(self.base if j == len(self.levels) - 1 else p[j + 1][self.parents[j]])
            level.strengthen()
            if j < len(self.parents):
                self._send(j, self.parents[j])

    def average(self, burn: int = BURN, samples: int = SAMPLES) -> list[np.ndarray]:
        """Predictive probabilities of all levels' pairs, averaged over samples of the seating."""
        for _ in range(burn):
            self.sweep()
        total = [np.zeros(len(x.context)) for x in self.levels]
        for _ in range(samples):
            self.sweep()
            for own, p in zip(total, self.predict(), strict=True):
                own += p / samples
        return total


# -- spellings ----------------------------------------------------------------


def spelling_grams(spelled: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Every byte of every word, and what closes it, with the SPELLING bytes before it, as one number; words follow each other."""
    n = lengths + 1
    start = np.cumsum(n) - n
    x = np.full(int(n.sum()), CLOSE, np.uint32)
    x[kernel.ragged(start, lengths)] = spelled
    place = np.arange(len(x)) - np.repeat(start, n)
    key = x.copy()
    for j in range(1, SPELLING + 1):
        shifted = np.full(len(x), CLOSE, np.uint32)
        shifted[j:] = x[:-j]
        key |= np.where(place >= j, shifted, CLOSE).astype(np.uint32) << np.uint32(8 * j)
    return key


def spelling_model(keys: np.ndarray, counts: np.ndarray, seed: int = 1) -> np.ndarray:
    """log10 of the averaged probability of each byte n-gram (distinct keys in order), whose restaurants' parents have one context byte less."""
    rng = np.random.default_rng(seed)
    levels, parents, own, customers = [], [], keys, counts
    for j in range(SPELLING, -1, -1):
        contexts = np.unique(own >> np.uint32(8), return_inverse=True)[1] if j else np.zeros(len(own), np.int64)
        levels.append(Level(contexts, customers, rng))
        if j:
            own, at = np.unique(own & np.uint32((1 << 8 * j) - 1), return_inverse=True)
            parents.append(at)
            customers = np.bincount(at, np.minimum(customers, 1), len(own)).astype(np.int64)
    return np.log10(Restaurants(levels, parents, np.full(len(own), 1 / 256)).average()[0])


# -- texts to numbers -----------------------------------------------------------


def tokens(data: np.ndarray, off: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: each token's symbol, the one before it, the one before that (first: from the text's seed), and the texts' offsets."""
    h, before = kernel.word_hashes(data, off)
    n = np.diff(before)
    at = before + np.arange(len(off))
    symbol = np.full(len(h) + len(n), END, np.uint64)
    symbol[np.arange(len(h)) + np.repeat(np.arange(len(n)), n)] = h
    last, before_last = np.full(len(symbol), START, np.uint64), np.full(len(symbol), START, np.uint64)
    last[1:], before_last[2:] = symbol[:-1], symbol[:-2]
    last[at[:-1]], before_last[at[:-1]] = START, seeds
    second = at[:-1][n > 0] + 1
    before_last[second] = START
    return symbol, last, before_last, at


def contexts(last: np.ndarray, before_last: np.ndarray, hot: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Hash of each token's context: the word before, and of hot ones the class of the word before that."""
    own = last.copy()
    if len(hot):
        at = np.minimum(np.searchsorted(hot, last), len(hot) - 1)
        is_hot = np.flatnonzero(hot[at] == last)
        own[is_hot] += (kernel.mix(before_last[is_hot] + np.uint64(3)) % classes[at[is_hot]]) * np.uint64(0x9E3779B97F4A7C15)
    return kernel.mix(own * np.uint64(0xD1342543DE82EF95) + np.uint64(1))


def range_of(h: np.ndarray, parts: int) -> np.ndarray:
    return (h % np.uint64(parts)).astype(np.uint16 if parts <= 65536 else np.uint32)


def word_range(h: np.ndarray, parts: int) -> np.ndarray:
    """Range of a word, by the bits that pairs keep of it."""
    return range_of(kernel.mix((h & _SYMBOL) + np.uint64(5)), parts)


def by_range(keys: np.ndarray, part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys by range and, in it, by size; and the ranges' edges."""
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    sorted_ = keys[order]
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a > 1:
            order[a:b] = order[a:b][np.argsort(sorted_[a:b])]
    return order, edges


def runs(keys: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of keys in order within ranges: where each distinct one starts, and the ranges' edges among these."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    new[edges[:-1][edges[:-1] < len(keys)]] = True
    start = np.flatnonzero(new)
    return start, np.searchsorted(start, edges)


def pairs(symbol: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Context and symbol in one number, with a free lowest bit."""
    return (context >> np.uint64(64 - CONTEXT_BITS)) << np.uint64(SYMBOL_BITS + 1) | (symbol & _SYMBOL) << np.uint64(1)


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and their counts' sums."""
    joined = np.concatenate([*keys, np.zeros(0, np.uint64)])
    order = np.argsort(joined, kind="stable")
    s = joined[order]
    at = np.flatnonzero(np.concatenate((np.ones(min(1, len(s)), bool), s[1:] != s[:-1])))
    c = np.concatenate([*counts, np.zeros(0, np.int64)])[order]
    return s[at], (np.add.reduceat(c, at) if len(at) else c.astype(np.int64))


_ROWS = "part int, chunk long, kind int, a binary, b binary, c binary"
_COLUMNS = ["part", "chunk", "kind", "a", "b", "c"]
_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
_PAIR, _WORD, _TEXT, _SUM = 0, 1, 2, 3


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _COLUMNS)


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_rows(rows)] if rows else [], pa.schema(list(zip(_COLUMNS, _TYPES, strict=True))))


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return zstandard.compress(sink.getvalue(), 3)


def _squeeze(x: np.ndarray, rising: bool = False) -> bytes:
    """Numbers as compressed byte planes, those in rising order by their steps."""
    if rising and len(x):
        x = np.concatenate((x[:1], np.diff(x)))
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def _expand(blob: bytes, dtype: str, rising: bool = False) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    x = np.ascontiguousarray(planes.T).view(dtype).ravel()
    return np.cumsum(x, dtype=dtype) if rising else x


def _sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of each text's values, added up by themselves, so that equal texts have equal sums."""
    out = np.zeros(len(off) - 1)
    some = np.flatnonzero(off[1:] > off[:-1])
    if len(some):
        out[some] = np.add.reduceat(values, off[:-1][some])
    return out


# -- what tasks do ----------------------------------------------------------------


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]]:
    held, size, texts = [], 0, 0
    for batch, data, off in kernel.blocks(batches):
        if held and (size + len(data) > CHUNK_BYTES or texts + batch.num_rows > CHUNK_TEXTS):
            yield held
            held, size, texts = [], 0, 0
        held.append((batch, data, off))
        size, texts = size + len(data), texts + batch.num_rows
    if held:
        yield held


def _frequent(parts: int):
    """Contexts (words, and the mark before a text) that hold a share of 1 / 2 parts of a chunk's tokens or more, with their count; and that of all tokens (hash 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            h = np.concatenate([kernel.word_hashes(data, off)[0] for _, data, off in chunk])
            texts = sum(b.num_rows for b, _, _ in chunk)
            total = len(h) + texts
            h = np.sort(h)
            at = np.flatnonzero(np.concatenate((np.ones(min(1, len(h)), bool), h[1:] != h[:-1])))
            n = np.diff(np.append(at, len(h)))
            most = n * 2 * parts >= total
            keys, n = np.concatenate((h[at[most]], [START])), np.concatenate((n[most], [texts]))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(keys, np.uint64(0)).view(np.int64)), pa.array(np.append(n, total).astype(np.int64))], ["h", "n"])

    return run


def _packed(batch: pa.RecordBatch, data: np.ndarray, off: np.ndarray, hot: np.ndarray, classes: np.ndarray, parts: int) -> tuple[np.ndarray, ...]:
    """Pairs of a block's tokens, their ranges, and the texts' offsets."""
    symbol, last, before_last, at = tokens(data, off, batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64))
    context = contexts(last, before_last, hot, classes)
    return pairs(symbol, context), range_of(context, parts), at


def _count(hot: np.ndarray, classes: np.ndarray, parts: int, words_too: bool):
    """Texts to rows: distinct pairs, and words if asked for, with their training counts by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, blocks in enumerate(_chunks(batches)):
            chunk = TaskContext.get().partitionId() << 32 | number  # the same when a lost task is run again
            keys, part, words, counts, spelled, lengths = [], [], [], [], [], []
            for batch, data, off in blocks:
                k, p, at = _packed(batch, data, off, hot, classes, parts)
                held = np.asarray(batch.column(2))
                keys.append(k | np.repeat(~held, np.diff(at)).astype(np.uint64)), part.append(p)
                if words_too:
                    starts, ends, before = kernel.words(data, off)
                    h = kernel.slice_hashes(data, starts, ends, lower=True)
                    some, first, rank = kernel.distinct(h)
                    words.append(some), counts.append(np.bincount(rank, np.repeat(~held, np.diff(before)), len(some)).astype(np.int64))
                    n = ends[first] - starts[first]
                    own = data[kernel.ragged(starts[first], n)]
                    spelled.append(np.where((own >= 65) & (own <= 90), own + 32, own).astype(np.uint8)), lengths.append(n)
            keys, part = np.concatenate(keys), np.concatenate(part)
            order, edges = by_range(keys, part, parts)
            keys = keys[order]
            at, edges = runs(keys >> np.uint64(1), edges)
            learned = np.add.reduceat((keys & np.uint64(1)).astype(np.int64), at)
            keys, learned = keys[at] >> np.uint64(1), np.minimum(learned, 0xFFFFFFFF).astype("<u4")
            for p in range(0, parts, 64):
                rows = [(q, chunk, _PAIR, _squeeze(keys[edges[q] : edges[q + 1]], True), _squeeze(learned[edges[q] : edges[q + 1]]), None) for q in range(p, min(parts, p + 64)) if edges[q] < edges[q + 1]]
                if rows:
                    yield _rows(rows)
            if not words_too:
                continue
            h, n, counts, spelled = np.concatenate(words), np.concatenate(lengths), np.concatenate(counts), np.concatenate(spelled)
            some, first, rank = kernel.distinct(h)
            counts = np.bincount(rank, counts, len(some)).astype(np.int64)
            order, edges = by_range(some, word_range(some, parts), parts)
            at = np.cumsum(n) - n
            for p in range(0, parts, 64):
                rows = []
                for q in range(p, min(parts, p + 64)):
                    if edges[q] < edges[q + 1]:
                        own = order[edges[q] : edges[q + 1]]
                        letters = spelled[kernel.ragged(at[first[own]], n[first[own]])].tobytes()
                        rows.append((q, chunk, _WORD, _squeeze(some[own], True), _squeeze(np.stack((counts[own], n[first[own]])).astype("<u4").ravel()), zstandard.compress(letters, 3)))
                if rows:
                    yield _rows(rows)

    return run


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunks' own texts; the same chunks as _count makes of the same rows."""
    for number, blocks in enumerate(_chunks(batches)):
        for batch, _, _ in blocks:
            yield _rows([(0, TaskContext.get().partitionId() << 32 | number, _TEXT, _ipc(batch), None, None)])


def _words(part: pa.Table) -> list[tuple]:
    """Of a range of words: all with their training counts and spellings (chunk -1), each chunk's counts, and the byte n-grams of learned and of all words."""
    p = part["part"][0].as_py()
    keys = [_expand(x, "<u8", True) for x in part["a"].to_pylist()]
    numbers = [_expand(x, "<u4").reshape(2, -1).astype(np.int64) for x in part["b"].to_pylist()]
    letters = np.frombuffer(b"".join(zstandard.decompress(x) for x in part["c"].to_pylist()), np.uint8)
    joined, n = np.concatenate(keys), np.concatenate([x[1] for x in numbers])
    at = np.cumsum(n) - n
    some, first, rank = kernel.distinct(joined)
    counts = np.bincount(rank, np.concatenate([x[0] for x in numbers]), len(some)).astype(np.int64)
    n = n[first]
    spelled = letters[kernel.ragged(at[first], n)]
    out = [(p, -1, _WORD, _squeeze(some, True), _squeeze(np.stack((counts, n)).ravel()), zstandard.compress(spelled.tobytes(), 1))]
    out += [(p, c, _WORD, _squeeze(counts[np.searchsorted(some, k)]), None, None) for c, k in zip(part["chunk"].to_pylist(), keys, strict=True)]
    grams = spelling_grams(spelled, n)
    g, of = np.unique(grams, return_inverse=True)
    times = np.bincount(of, np.repeat(counts > 0, n + 1), len(g)).astype(np.int64)
    for q in range(16):  # dealt anew by their last bits
        own = g % 16 == q
        if own.any():
            out.append((q, -1, _SUM, _squeeze(g[own], True), _squeeze(times[own]), None))
    out.append((p, -2, _SUM, np.array([counts.sum(), (counts > 0).sum()], "<i8").tobytes(), None, None))
    return out


def _summed(part: pa.Table) -> pa.Table:
    keys, counts = merged([_expand(x, "<u4", True).astype(np.uint64) for x in part["a"].to_pylist()], [_expand(x, "<i8") for x in part["b"].to_pylist()])
    return _table([(0, -1, _SUM, _squeeze(keys.astype("<u4"), True), _squeeze(counts), None)])


def _spelling(part: pa.Table) -> pa.Table:
    """The model of spellings, of 2**24 byte n-grams at most: in one task."""
    keys, counts = merged([_expand(x, "<u4", True).astype(np.uint64) for x in part["a"].to_pylist()], [_expand(x, "<i8") for x in part["b"].to_pylist()])
    keys = np.append(keys, np.uint64(0x202020)) if 0x202020 not in keys else keys  # the end mark: a spelling without a letter
    order = np.argsort(keys)
    counts = np.append(counts, np.zeros(len(keys) - len(counts), np.int64))[order]
    keys = keys[order].astype(np.uint32)
    counts[keys == 0x202020] += 1
    return _table([(0, -1, _SUM, _squeeze(keys.astype("<u4"), True), _squeeze(spelling_model(keys, counts).astype("<f4")), None)])


def _seating(part: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a range with their counts, each chunk's pairs; and the pairs' contexts, distinct symbols by word, places of the pairs among these."""
    keys = [_expand(x, "<u8", True) for x in part["a"].to_pylist()]
    k, c = merged(keys, [_expand(x, "<u4").astype(np.int64) for x in part["b"].to_pylist()])
    context = k >> np.uint64(SYMBOL_BITS)
    room = np.cumsum(np.concatenate((np.zeros(min(1, len(k)), bool), context[1:] != context[:-1]))).astype(np.int64)
    symbols, at = np.unique(k & _SYMBOL, return_inverse=True)
    return k, c, keys, room, symbols, at


def _tables(parts: int):
    """(1): how many tables each word has in a range's restaurants, sampled over a root of the range's own; to the ranges of words. And what _words gives."""

    def seating(part: pa.Table) -> list[tuple]:
        p = part["part"][0].as_py()
        _, c, _, room, symbols, at = _seating(part)
        rng = np.random.default_rng(p)
        lower = Level(room, c, rng)
        root = Level(np.zeros(len(symbols), np.int64), np.bincount(at, lower.tables, len(symbols)).astype(np.int64), rng)
        r = Restaurants([lower, root], [at], np.full(len(symbols), 1 / max(1, len(symbols))))
        for _ in range(BURN + 1):
            r.sweep()
        tables = root.customers
        order, edges = by_range(symbols, word_range(symbols, parts), parts)
        out = [(q, p, _PAIR, _squeeze(symbols[own], True), _squeeze(tables[own].astype("<i8")), None) for q in range(parts) if len(own := order[edges[q] : edges[q + 1]])]
        sums = np.array([(c == 1).sum(), (c == 2).sum(), tables.sum(), lower.strength * len(c), len(c)], "<f8")
        return [*out, (p, -3, _SUM, sums.tobytes(), None, None)]

    def run(part: pa.Table) -> pa.Table:
        kinds, out = np.asarray(part["kind"]), []
        for kind, work in ((_PAIR, seating), (_WORD, _words)):
            if (kinds == kind).any():
                out += work(part.filter(pa.array(kinds == kind)))
        return _table(out)

    return run


def _lifted(log: np.ndarray) -> np.ndarray:
    """Probabilities of these logarithms, no smaller than the floor's."""
    return 10.0 ** np.maximum(log.astype(float), FLOOR)


def _logged(average: np.ndarray, above: np.ndarray, learned: np.ndarray) -> np.ndarray:
    """log10 of averaged probabilities. Those of which nothing was learned are a share of what stands above, whose logarithm may lie below the floor."""
    log = np.log10(np.maximum(average, 1e-300))
    return log + np.where(learned > 0, 0.0, np.minimum(above.astype(float) - FLOOR, 0.0))


def _root(total: float, words: int, spelling, seed: int = 99):
    """(2): the root's averaged probability of each word that a range has asked for, in the order of its request."""

    def run(known: pa.Table, asked: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return _table([])
        p = asked["part"][0].as_py()
        wanted = [_expand(x, "<u8", True) for x in asked["a"].to_pylist()]
        symbols, customers = merged(wanted, [_expand(x, "<i8") for x in asked["b"].to_pylist()])
        # Probability of each spelling; words that agree in what pairs keep of them are one.
        above = np.full(len(symbols), float(_spelled(spelling.value, np.zeros(0, np.uint8), np.zeros(1, np.int64))[0]))
        if known.num_rows:
            h = _expand(known["a"][0].as_py(), "<u8", True) & _SYMBOL
            n = _expand(known["b"][0].as_py(), "<i8").reshape(2, -1)[1]
            above[np.searchsorted(symbols, h)] = _spelled(spelling.value, np.frombuffer(zstandard.decompress(known["c"][0].as_py()), np.uint8), n)
        rng = np.random.default_rng(seed + p)
        own = int((customers > 0).sum())
        level = Part(customers, rng, total, max(1.0, words / max(1, own)))
        log = _logged(Restaurants([level], [], _lifted(above)).average()[0], above, customers).astype("<f4")
        return _table([(r, p, _PAIR, _squeeze(log[np.searchsorted(symbols, w)]), None, None) for r, w in zip(asked["chunk"].to_pylist(), wanted, strict=True)])

    return run


def _spelled(model: tuple[np.ndarray, np.ndarray], spelled: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log10 probability of each spelling."""
    keys, log = model
    grams = spelling_grams(spelled, lengths)
    return kernel.segment_sums(log[np.minimum(np.searchsorted(keys, grams), len(keys) - 1)].astype(float), np.concatenate(([0], np.cumsum(lengths + 1))))


def _answers(parts: int, discount: float, strength: float):
    """(3): log10 probability of every chunk's pairs, in the order they came."""

    def run(part: pa.Table, given: pa.Table) -> pa.Table:
        if not part.num_rows:
            return _table([])
        p = part["part"][0].as_py()
        k, c, keys, room, symbols, at = _seating(part)
        order, edges = by_range(symbols, word_range(symbols, parts), parts)
        above = np.full(len(symbols), FLOOR)
        for q, blob in zip(given["chunk"].to_pylist(), given["a"].to_pylist(), strict=True):
            above[order[edges[q] : edges[q + 1]]] = _expand(blob, "<f4")
        level = Level(room, c, np.random.default_rng(parts + p), discount, strength)
        log = _logged(Restaurants([level], [], _lifted(above[at])).average()[0], above[at], c)
        # 18 bits behind the point are enough, and pack well.
        log = (np.round(log * 4096) / 4096).astype("<f4")
        return _table([(p, chunk, _PAIR, _squeeze(log[np.searchsorted(k, own)]), None, None) for chunk, own in zip(part["chunk"].to_pylist(), keys, strict=True)])

    return run


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    prepare(spark)
    parts = buckets(spark)
    docs = docs.select(id_col, text_col, F.coalesce(held_out, F.lit(False)).alias("held_out"))
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        docs = checkpointed(docs)  # texts are read three times, and must come in the same order
    id_kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col("held_out"), F.xxhash64(id_col).alias("seed"))
    seen = checkpointed(texts.mapInArrow(_frequent(parts), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    every = sum(r.n for r in seen.where("h = 0").collect())
    seen = {r.h: r.n for r in seen.where((F.col("h") != 0) & (F.col("n") * parts > every)).collect()}  # 2 parts rows at most
    share = {h: -(-n * parts // every) for h, n in seen.items()}
    hot = np.array(sorted(np.array(list(share), np.int64).view(np.uint64)), np.uint64)
    classes = np.array([share[int(h)] for h in hot.view(np.int64)], np.uint64)
    ranges = checkpointed(texts.mapInArrow(_count(hot, classes, parts, True), _ROWS).groupBy("part").applyInArrow(_tables(parts), _ROWS))
    free_shuffles(spark)
    words, tables = ranges.where((F.col("kind") == _WORD)), ranges.where(F.col("kind") == _PAIR)
    sums_of = lambda chunk, dtype, none: np.sum([none, *(np.frombuffer(r.a, dtype) for r in ranges.where((F.col("kind") == _SUM) & (F.col("chunk") == chunk)).select("a").collect())], 0)  # noqa: E731  one row for each range
    grams = ranges.where((F.col("kind") == _SUM) & (F.col("chunk") == -1)).groupBy("part").applyInArrow(_summed, _ROWS).groupBy("kind").applyInArrow(_spelling, _ROWS).collect()
    none = [(np.array([0x202020], np.uint32), np.zeros(1, "<f4"))]
    spelling = spark.sparkContext.broadcast(([(_expand(r.a, "<u4", True), _expand(r.b, "<f4")) for r in grams] or none)[0])  # 2**24 numbers at most
    n, v = (int(x) for x in sums_of(-2, "<i8", np.zeros(2, np.int64)))
    ends = texts.where(~F.col("held_out")).count()
    sums = sums_of(-3, "<f8", np.zeros(5))
    discount = float(np.clip((sums[0] + 1) / (sums[0] + 2 * sums[1] + 2), 0.05, 0.95))
    strength = float(sums[3] / sums[4]) if sums[4] else 1.0
    known = words.where(F.col("chunk") == -1)
    root = checkpointed(known.groupBy("part").cogroup(tables.groupBy("part")).applyInArrow(_root(float(sums[2]), v + (ends > 0), spelling), _ROWS))
    free_shuffles(spark)
    # The pairs are counted again, which costs less than keeping them.
    answers = texts.mapInArrow(_count(hot, classes, parts, False), _ROWS).groupBy("part").cogroup(root.groupBy("part")).applyInArrow(_answers(parts, discount, strength), _ROWS)
    n_all, v_all = n + ends, v + (ends > 0)

    def final(part: pa.Table, own: pa.Table) -> pa.Table:
        kinds, ranges = np.asarray(part["kind"]), np.asarray(part["part"])
        blobs = part["a"]
        batches = [pa.ipc.open_stream(zstandard.decompress(x)).read_all().combine_chunks().to_batches()[0] for x in own["a"].to_pylist()]
        bytes_of = [kernel.utf8(b.column(1)) for b in batches]
        blocks = [_packed(b, data, off, hot, classes, parts) for b, (data, off) in zip(batches, bytes_of, strict=True)]
        hashes = [kernel.word_hashes(data, off) for data, off in bytes_of]
        values = []
        for kind, keys, own, dtype in (
            (_PAIR, np.concatenate([x[0] >> np.uint64(1) for x in blocks]), np.concatenate([x[1] for x in blocks]), "<f4"),
            (_WORD, h := np.concatenate([x[0] for x in hashes]), word_range(h, parts), "<i8"),
        ):
            order, edges = by_range(keys, own, parts)
            at, edges = runs(keys[order], edges)
            found = np.zeros(len(at), dtype)
            for i in np.flatnonzero(kinds == kind).tolist():
                found[edges[ranges[i]] : edges[ranges[i] + 1]] = _expand(blobs[i].as_py(), dtype)
            spread = np.empty(len(keys), dtype)
            spread[order] = np.repeat(found, np.diff(np.append(at, len(keys))))
            values.append(spread)
        log, count = values
        out, a, z = [], 0, 0
        unit = np.log10(n_all + 0.5 * (v_all + 1))
        for b, (_, _, at), (_, before) in zip(batches, blocks, hashes, strict=True):
            c = count[z : z + before[-1]]
            model = _sums(log[a : a + at[-1]].astype(float), at)
            a, z = a + int(at[-1]), z + int(before[-1])
            many = np.diff(at)
            base = _sums(np.log10(c + 0.5) - unit, before) + np.log10(ends + 0.5) - unit
            known = kernel.segment_sums((c > 0).astype(np.int64), before) + int(ends > 0)
            out.append(pa.table([b.column(0), b.column(2), pa.array(many), pa.array(known), pa.array(np.full(len(many), n_all, np.int64)), pa.array(base), pa.array(model)], names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]))
        return pa.concat_tables(out)

    rows = answers.unionByName(words.where(F.col("chunk") >= 0)).select("chunk", "part", "kind", "a")
    # Texts have an exchange of their own, so that partitions, which name chunks, are numbered as before.
    own = texts.mapInArrow(_texts, _ROWS).select("chunk", "a")
    result = rows.groupBy("chunk").cogroup(own.groupBy("chunk")).applyInArrow(final, f"id {id_kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return result.withColumnRenamed("id", id_col)
