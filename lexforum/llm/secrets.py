"""Secret scan: exact base rules, and a character convolutional network over every other candidate in its context.

The network (numpy only) reads windows of characters that slide over the whole
candidate, whose score is its highest one; what a run has outside of base findings
is a candidate of its own.

Training. Labelled findings are spans of the base rules; ordinary windows are long
runs of the same texts, unlabelled candidates among them. All distinct windows of all
texts are learned from: they are dealt by their hashes to parts of about `sample`
windows of a kind, each part is fitted for an epoch by a task of its own, and the means of
the parts' weights start the next epoch. A quarter of the findings and of the ordinary
windows is held out before anything is derived from them. Both are filled up, so that the network learns
the look of a secret rather than the rules: findings' values are drawn anew over
several alphabets and set into the surroundings of ordinary windows, and ordinary
names are joined from words of these surroundings (in capitals, with marks, with
digits). Scores become probabilities by a logistic fit (Platt) on the held-out part,
and the threshold is the highest one that keeps the asked recall of the findings as
they came and of those over each alphabet; the share of held-out ordinary windows
that pass is told beside, and decides nothing.

Null text: empty, no findings. Repeated rows each give a row; equal windows count once
in training. An empty table gives an empty result. Very long texts are read whole.
Columns other than id and text are not read by `scan` and pass through `redact`,
whatever their names. With fewer than LEAST_FINDINGS distinct findings to learn from,
the base rules alone apply (threshold 2).
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .shared import checkpointed, prepare

KINDS = ("assign", "access", "hex", "learned")
#: Fixed values of the base rules.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
LEAST = {"assign": 6, "access": 20, "hex": 24}

#: Longest part of a candidate, and context to each side, that the network reads at once; step from part to part of a longer one.
INSIDE, CONTEXT, STEP = 40, 20, 20
#: Labelled findings and ordinary runs that one task fits the network to at once, about (each).
SAMPLE = 3000
#: Parts of a unit to which weights are rounded to be summed in any order, and held-out outputs (downwards) to be counted.
_WEIGHT, _OUTPUT = 2.0**44, 2.0**8
#: Shortest candidate; distinct findings without which nothing is learned.
SHORTEST, LEAST_FINDINGS = 16, 2

_HEX_BYTE = np.zeros(256, bool)
_HEX_BYTE[[*range(48, 58), *range(97, 103)]] = True
_RUN_BYTE = np.zeros(256, bool)
_RUN_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_=-"]] = True
_DIGIT, _UPPER, _LOWER = (np.array([a <= b <= z for b in range(256)]) for a, z in ((48, 57), (65, 90), (97, 122)))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base rules' findings in a text, in code points."""
    found = []
    low = text.lower() if text.isascii() else text.encode().lower().decode()  # A-Z only, so that places stay
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def runs(data: np.ndarray, off: np.ndarray, member: np.ndarray, least: int, taken: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the maximal runs of member bytes within documents that are not taken, with `least` bytes or more."""
    inside = member[data] if taken is None else member[data] & ~taken
    change = np.zeros(len(data) + 1, bool)
    change[1:-1] = inside[1:] != inside[:-1]
    change[off] = True
    at = np.flatnonzero(change)
    a, b = at[:-1], at[1:]
    ok = (b - a >= least) & inside[a]
    return a[ok], b[ok]


def candidates(data: np.ndarray, off: np.ndarray, taken: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Runs that could be a secret: of SHORTEST bytes or more, with two kinds of letters and digits, but not words in title case."""
    a, b = runs(data, off, _RUN_BYTE, SHORTEST, taken)
    if not len(a):
        return a, b
    counts = []
    for member in (_DIGIT, _UPPER, _LOWER):
        sums = np.concatenate(([0], np.cumsum(member[data], dtype=np.int64)))
        counts.append(sums[b] - sums[a])
    digits, upper, lower = counts
    mixed = ((digits >= 3) & (upper + lower >= 3)) | ((upper >= 3) & (lower >= 3))
    return a[mixed], b[mixed]


def pieces(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parts of INSIDE bytes at most that cover each candidate, STEP apart, the last one to its end; and whose parts they are."""
    many = 1 + -(-np.maximum(b - a - INSIDE, 0) // STEP)
    of = np.repeat(np.arange(len(a)), many)
    k = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    start = np.minimum(a[of] + k * STEP, np.maximum(a, b - INSIDE)[of])
    return start, np.minimum(start + INSIDE, b[of]), of


# -- the network ------------------------------------------------------------

#: Symbols of the input: lower case and digits singly (upper case as lower, with a flag), some marks, other.
_SYMBOL = np.zeros(256, np.int64)
for _i, _c in enumerate(b"abcdefghijklmnopqrstuvwxyz0123456789=:\"'+/_-., \n"):
    _SYMBOL[_c] = _i + 2
_SYMBOL[65:91] = _SYMBOL[97:123]
_SYMBOL[_SYMBOL == 0] = 1
_N_SYMBOLS = int(_SYMBOL.max()) + 1
WIDTH = INSIDE + 2 * CONTEXT


def windows(data: np.ndarray, off: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bytes of each part of a candidate (padded with 0 to INSIDE) between CONTEXT bytes to each side; 0 beyond the document."""
    doc = np.searchsorted(off, a, "right") - 1
    low, high = off[doc], off[doc + 1]
    columns = np.arange(WIDTH)
    left, body = columns < CONTEXT, (columns >= CONTEXT) & (columns < CONTEXT + INSIDE)
    place = np.where(left, a[:, None] - CONTEXT + columns, np.where(body, a[:, None] + columns - CONTEXT, b[:, None] + columns - CONTEXT - INSIDE))
    ok = np.where(body, place < b[:, None], (place >= low[:, None]) & (place < high[:, None]))
    return np.where(ok, data[np.clip(place, 0, max(0, len(data) - 1))], 0).astype(np.uint8)


def features(window: np.ndarray) -> np.ndarray:
    """Input of the network: embedding index of every byte, and whether it is upper case or part of the candidate."""
    return np.where(window == 0, 0, _SYMBOL[window]), _UPPER[window]


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Network:
    """Embedding, one convolution, pooling (largest over the candidate, mean over it, largest over its context), one hidden layer, logistic output, calibrated by scale and shift."""

    weights: dict[str, np.ndarray]
    threshold: float = 2.0
    recall: float = 0.0
    false_rate: float = 0.0
    scale: float = 1.0
    shift: float = 0.0

    DIM, FILTERS, SPAN, HIDDEN = 12, 32, 4, 24

    @classmethod
    def new(cls, seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        return cls({
            "e": r.normal(0, 0.3, (_N_SYMBOLS, cls.DIM)), "k": r.normal(0, 0.2, (cls.SPAN * (cls.DIM + 1), cls.FILTERS)), "kb": np.zeros(cls.FILTERS),
            "h": r.normal(0, 0.2, (3 * cls.FILTERS, cls.HIDDEN)), "hb": np.zeros(cls.HIDDEN), "o": r.normal(0, 0.2, cls.HIDDEN), "ob": np.zeros(1),
        })

    def forward(self, window: np.ndarray) -> tuple[np.ndarray, tuple]:
        w = self.weights
        index, upper = features(window)
        n, width = index.shape
        places = width - self.SPAN + 1
        # The convolution, byte by byte: an embedding times its part of the filters is a row of a small table.
        kernels = w["k"].reshape(self.SPAN, self.DIM + 1, self.FILTERS)
        tables = w["e"] @ kernels[:, : self.DIM]  # SPAN x symbols x filters
        conv = np.full((n, places, self.FILTERS), w["kb"])
        for i in range(self.SPAN):
            conv += tables[i][index[:, i : i + places]]
            conv += upper[:, i : i + places, None] * kernels[i, self.DIM]
        np.maximum(conv, 0, out=conv)
        inner, outer = slice(CONTEXT, CONTEXT + INSIDE - self.SPAN + 1), np.r_[0 : CONTEXT - self.SPAN + 1, CONTEXT + INSIDE : places]
        held = (window[:, CONTEXT + self.SPAN - 1 : CONTEXT + INSIDE] > 0).astype(float)  # places whole within the candidate
        many = np.maximum(held.sum(1, keepdims=True), 1)
        body = conv[:, inner] * held[:, :, None]
        at = np.stack((body.argmax(1) + CONTEXT, outer[conv[:, outer].argmax(1)]), 1)  # n x 2 x filters
        pooled = np.concatenate((body.max(1), body.sum(1) / many, np.take_along_axis(conv, at[:, 1:], 1)[:, 0]), 1)
        hidden = np.maximum(pooled @ w["h"] + w["hb"], 0)
        z = hidden @ w["o"] + w["ob"]
        return z, (index, upper, conv, held / many, at, pooled, hidden)

    def score(self, window: np.ndarray) -> np.ndarray:
        """Calibrated probability of each window."""
        return _logistic(self.scale * self.outputs(window) + self.shift)

    def gradients(self, window: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss."""
        w = self.weights
        z, (index, upper, conv, share, at, pooled, hidden) = self.forward(window)
        n, places, _ = conv.shape
        d = (_logistic(z) - label) / n
        g = {"o": hidden.T @ d, "ob": np.array([d.sum()])}
        dh = d[:, None] * w["o"] * (hidden > 0)
        g |= {"h": pooled.T @ dh, "hb": dh.sum(0)}
        most, mean, around = np.split(dh @ w["h"].T, 3, 1)
        dc = np.zeros_like(conv)
        inside = slice(CONTEXT, CONTEXT + INSIDE - self.SPAN + 1)
        dc[:, inside] = share[:, :, None] * mean[:, None]
        rows, filters = np.arange(n)[:, None], np.arange(self.FILTERS)
        dc[rows, at[:, 0], filters] += most * (pooled[:, : self.FILTERS] > 0)
        dc[rows, at[:, 1], filters] += around
        dc *= conv > 0
        g["kb"] = dc.sum((0, 1))
        kernels = w["k"].reshape(self.SPAN, self.DIM + 1, self.FILTERS)
        gk, g["e"] = np.zeros_like(kernels), np.zeros_like(w["e"])
        flat = dc.reshape(-1, self.FILTERS)
        for i in range(self.SPAN):
            own = index[:, i : i + places].ravel()
            of = np.zeros((_N_SYMBOLS, self.FILTERS))
            order = np.argsort(own, kind="stable")
            some, first = np.unique(own[order], return_index=True)
            of[some] = np.add.reduceat(flat[order], first)
            gk[i, : self.DIM] = w["e"].T @ of
            gk[i, self.DIM] = (upper[:, i : i + places].reshape(-1, 1) * flat).sum(0)
            g["e"] += of @ kernels[i, : self.DIM].T
        g["k"] = gk.reshape(w["k"].shape)
        return g

    def fit(self, window: np.ndarray, label: np.ndarray, epochs: int = 8, rate: float = 0.005, seed: int = 11) -> None:
        r = np.random.default_rng(seed)
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.weights.items()}
        for epoch in range(epochs):
            moments = self.epoch(window, label, moments, epoch, rate, r)

    def epoch(self, window: np.ndarray, label: np.ndarray, moments: dict[str, tuple[np.ndarray, np.ndarray]], number: int, rate: float, r: np.random.Generator) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """One pass over the windows by Adam, from these moments; the moments after it."""
        batches = np.array_split(r.permutation(len(label)), max(1, len(label) // 64))
        for step, part in enumerate(batches, 1 + number * len(batches)):
            for k, g in self.gradients(window[part], label[part]).items():
                m, v = moments[k]
                m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
                moments = moments | {k: (m, v)}
                self.weights[k] = self.weights[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return moments

    def outputs(self, window: np.ndarray) -> np.ndarray:
        """Uncalibrated output of each window."""
        return np.concatenate([np.zeros(0), *(self.forward(window[i : i + 1024])[0] for i in range(0, len(window), 1024))])

    def calibrate(self, window: np.ndarray, label: np.ndarray, recall: float, group: np.ndarray | None = None) -> None:
        """calibrated() by held-out windows."""
        group = np.zeros(len(label), np.int64) if group is None else group
        self.calibrated(self.outputs(window), label, recall, group, np.ones(len(label), np.int64))

    def calibrated(self, z: np.ndarray, label: np.ndarray, recall: float, group: np.ndarray, many: np.ndarray) -> None:
        """Scale and shift that make held-out outputs probabilities (`many` windows have each); then the threshold: the highest that finds the asked share of every group of held-out findings. The share of ordinary windows that pass is kept beside."""
        self.scale, self.shift = 1.0, 0.0
        if not len(z):
            return
        a, b = 1.0, 0.0
        for _ in range(30):  # Newton's method with a small ridge around (1, 0)
            p = _logistic(a * z + b)
            v, e = many * p * (1 - p), many * (p - label)
            grad = np.array([(e * z).sum() + 0.1 * (a - 1), e.sum() + 0.1 * b])
            step = np.linalg.solve(np.array([[(v * z * z).sum() + 0.1, (v * z).sum()], [(v * z).sum(), v.sum() + 0.1]]), grad)
            a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
        self.scale, self.shift = max(float(a), 1e-3), float(b)
        p, yes, no = _logistic(self.scale * z + self.shift), label == 1, label == 0
        least = []
        for x in np.unique(group[yes]):
            own = np.flatnonzero(yes & (group == x))
            own = own[np.argsort(p[own], kind="stable")]
            up_to = np.cumsum(many[own])
            least.append(float(p[own[np.searchsorted(up_to, int((1 - recall) * up_to[-1]), "right")]]))
        if least:
            self.threshold = min(least)
            self.recall = float(many[yes & (p >= self.threshold)].sum() / many[yes].sum())
        self.false_rate = float(many[no & (p >= self.threshold)].sum() / many[no].sum()) if no.any() else 0.0


# -- training ---------------------------------------------------------------

_LABELLED = "label int, window binary, key long"


def _labelled(sample: int | None = None):
    """Batches of texts to a task's distinct windows of base findings' values (label 1), of candidates outside of base findings (label 2) and of other long runs there (label 0): all of them, or the `sample` of each with the smallest hashes."""

    def told(kept: dict[int, set[tuple[int, bytes]]]) -> Iterator[pa.RecordBatch]:
        rows = [(kind, w, k) for kind, seen in kept.items() for k, w in (sorted(seen) if sample is None else heapq.nsmallest(sample, seen))]
        if rows:
            kind, window, key = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(window, pa.binary()), pa.array(key, pa.int64())], ["label", "window", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, set[tuple[int, bytes]]] = {0: set(), 1: set(), 2: set()}
        for _, data, off in kernel.blocks(batches):
            raw = data.tobytes()
            a, b, label = [], [], []
            taken = np.zeros(len(data), bool)
            low = raw.lower()
            if any(k.encode() in low for k in KEYWORDS):
                for m in re.finditer(ASSIGN.pattern.encode(), raw, re.IGNORECASE):
                    if len(m[2]) >= LEAST["assign"]:
                        taken[m.start() : m.end()] = True
                    if len(m[2]) >= SHORTEST:
                        a.append(m.start(2)), b.append(m.end(2)), label.append(1)
            for m in re.finditer(rb"AKIA[A-Z0-9]{16,}", raw) if b"AKIA" in raw else ():
                taken[m.start() : m.end()] = True
                a.append(m.start()), b.append(m.end()), label.append(1)
            hex_a, hex_b = runs(data, off, _HEX_BYTE, LEAST["hex"])
            taken[kernel.ragged(hex_a, hex_b - hex_a)] = True
            # Ordinary: candidates, and the other runs of their alphabet.
            run_a, run_b = runs(data, off, _RUN_BYTE, SHORTEST, taken)
            other_a, other_b = candidates(data, off, taken)
            rest = ~np.isin(run_a, other_a)
            run_a, run_b = run_a[rest], run_b[rest]
            a, b = (np.concatenate(x).astype(np.int64) for x in ((a, hex_a, other_a, run_a), (b, hex_b, other_b, run_b)))
            label = np.concatenate((label, np.ones(len(hex_a)), np.full(len(other_a), 2), np.zeros(len(run_a)))).astype(np.int64)
            if not len(a):
                continue
            start, end, of = pieces(a, b)
            window, label = windows(data, off, start, end), label[of]
            key = kernel.slice_hashes(window.ravel(), np.arange(len(of)) * WIDTH, np.arange(1, len(of) + 1) * WIDTH).view(np.int64)
            for kind, seen in kept.items():
                seen.update((k, w.tobytes()) for k, w in zip(key[label == kind].tolist(), window[label == kind], strict=True))
                if sample is not None and len(seen) > 4 * sample:
                    kept[kind] = set(heapq.nsmallest(sample, seen))
            if sample is None and sum(map(len, kept.values())) > 4 * SAMPLE:
                yield from told(kept)
                kept = {kind: set() for kind in kept}
        yield from told(kept)

    return run


#: Alphabets that values are drawn over.
ALPHABETS = [np.frombuffer(x, np.uint8) for x in (b"0123456789abcdef", b"0123456789ABCDEF", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", b"abcdefghijklmnopqrstuvwxyz0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_")]


def _name(words: list[bytes], r: np.random.Generator) -> bytes:
    """An ordinary long run: words joined as in names of files, classes, constants and links, or numbers and dates."""
    some = [words[int(i)] for i in r.integers(0, len(words), 8)]
    kind = int(r.integers(0, 9))
    number = str(int(r.integers(0, 10 ** int(r.integers(1, 7))))).encode()
    if kind == 0:
        out = b"".join(w.capitalize() for w in some)
    elif kind == 1:
        out = some[0] + b"".join(w.capitalize() for w in some[1:])
    elif kind in (2, 3):
        out = b"_/-"[kind - 2 : kind - 1].join(some)
    elif kind == 4:
        out = b"_".join(w.upper() for w in some)
    elif kind == 5:
        out = b"/".join(w.capitalize() if r.random() < 0.3 else w for w in some)
    elif kind == 6:
        out = b"-".join(str(int(x)).encode() for x in r.integers(0, 3000, 8))
    elif kind == 7:
        out = b"-".join([*some[:2], number, *some[2:]])
    else:
        out = b"".join(some)
    if kind < 6 and r.random() < 0.5:
        at = int(r.integers(0, 3))
        out = (out[: int(r.integers(8, 18))] + number) if at == 0 else (number + b"-" + out) if at == 1 else out[:10] + number + out[10:]
    return out


def filled(findings: np.ndarray, ordinary: np.ndarray, many: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows with `many` drawn findings and `many` drawn ordinary names beside them, in surroundings of ordinary windows; their labels; and the alphabets of drawn findings (others: 0)."""
    r = np.random.default_rng(seed)
    around = ordinary if len(ordinary) else findings
    text = b" ".join(x[part].tobytes().replace(b"\0", b" ") for x in around for part in (slice(0, CONTEXT), slice(CONTEXT + INSIDE, WIDTH)))
    words = sorted(set(re.findall(rb"(?<![A-Za-z])[A-Za-z][a-z]{2,9}(?![A-Za-z])", text))) or [b"name", b"file", b"value", b"item"]
    words = [w.lower() for w in words]
    drawn, plain = (around[r.integers(0, len(around), many)].copy() for _ in range(2))
    for i in range(many):
        n = int(r.integers(SHORTEST, INSIDE + 1)) if i % 2 else INSIDE
        for window, body in ((drawn, r.choice(ALPHABETS[i % len(ALPHABETS)], n)), (plain, np.frombuffer(_name(words, r)[: int(r.integers(SHORTEST, INSIDE + 1))], np.uint8))):
            window[i, CONTEXT : CONTEXT + INSIDE] = 0
            window[i, CONTEXT : CONTEXT + len(body)] = body
    alphabet = np.concatenate((np.zeros(len(findings), np.int64), 1 + np.arange(many) % len(ALPHABETS), np.zeros(len(ordinary) + many, np.int64)))
    return np.concatenate((findings, drawn, ordinary, plain)), np.repeat([1, 0], [len(findings) + many, len(ordinary) + many]), alphabet


def _split(label: np.ndarray, window: np.ndarray, key: np.ndarray, part: int, sample: int) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """A part's windows to fit and those held out: each windows, labels and groups, filled up."""
    order = np.lexsort((key, label))
    label, window = label[order], window[order]
    out = np.random.default_rng(3 + 8 * part).random(len(label)) < 0.25
    own = lambda held: (window[(label == 1) & (out == held)], window[(label != 1) & (out == held)])
    return filled(*own(False), sample, 5 + 8 * part), filled(*own(True), sample // 2, 6 + 8 * part)


def _arrays(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Label, window and key of the rows of a part."""
    window = np.frombuffer(b"".join(rows.column("window").to_pylist()), np.uint8).reshape(-1, WIDTH)
    return rows.column("label").to_numpy(), window, rows.column("key").to_numpy()


def _fitted(dealt: DataFrame, network: Network, sample: int, recall: float, epochs: int = 8, rate: float = 0.005) -> None:
    """Fits and calibrates the network by parts: a task passes over a part, the sums of weights and moments, and counts of held-out outputs, are all that is sent back."""
    names = list(network.weights)
    state = [np.stack((v, np.zeros_like(v), np.zeros_like(v))) for v in network.weights.values()]
    ends = np.cumsum([0, *(x.size for x in state)])

    def passed(number: int, state: list[np.ndarray]):
        def run(rows: pa.Table) -> pa.Table:
            part = rows.column("part")[0].as_py()
            (window, label, _), _ = _split(*_arrays(rows), part, sample)
            own = Network({k: x[0] for k, x in zip(names, state, strict=True)})
            moments = own.epoch(window, label, {k: (x[1], x[2]) for k, x in zip(names, state, strict=True)}, number, rate, np.random.default_rng((11, part, number)))
            flat = np.concatenate([y.ravel() for k in names for y in (own.weights[k], *moments[k])])
            return pa.table({"at": np.arange(len(flat), dtype=np.int32), "value": np.rint(flat * _WEIGHT).astype(np.int64)})

        return run

    def held(own: Network):
        def run(rows: pa.Table) -> pa.Table:
            _, (window, label, group) = _split(*_arrays(rows), rows.column("part")[0].as_py(), sample)
            z, many = np.unique(np.stack((label, group, np.floor(own.outputs(window) * _OUTPUT).astype(np.int64))), axis=1, return_counts=True)
            return pa.table({"label": z[0], "own": z[1], "z": z[2], "n": many})

        return run

    for number in range(epochs):
        sums = dealt.groupBy("part").applyInArrow(passed(number, state), "at int, value bigint").groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n"))
        flat = np.zeros(ends[-1])
        for x in sums.collect():
            flat[x.at] = float(x.s) / x.n / _WEIGHT
        state = [flat[a:b].reshape(x.shape) for a, b, x in zip(ends, ends[1:], state)]
    network.weights = {k: x[0] for k, x in zip(names, state, strict=True)}
    counts = dealt.groupBy("part").applyInArrow(held(network), "label bigint, own bigint, z bigint, n bigint").groupBy("label", "own", "z").agg(F.sum("n").alias("n"))
    label, group, z, many = (np.array(x) for x in zip(*sorted(map(tuple, counts.collect()))))
    network.calibrated(z / _OUTPUT, label, recall, group, many)


def train(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE, recall: float = 0.95) -> Network:
    """Network fitted on all distinct windows of findings, of unlabelled candidates and of other long runs, in parts of about `sample` windows of a kind. One pass over the texts; each epoch passes over the windows."""
    prepare(docs.sparkSession)
    network = Network.new()
    if not sample:
        return network
    found = checkpointed(docs.select(F.col(text_col).alias("text")).mapInArrow(_labelled(), _LABELLED).distinct())
    counts = {x.label: x.n for x in found.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if counts.get(1, 0) < LEAST_FINDINGS:
        return network
    parts = -(-max(counts.values()) // sample)
    if parts > 1:
        _fitted(found.withColumn("part", F.pmod(F.col("key"), F.lit(parts)).cast("int")), network, sample, recall)
        return network
    rows = found.toArrow()
    fitted, (held, label, group) = _split(*_arrays(rows), 0, sample)
    network.fit(*fitted[:2])
    network.calibrate(held, label, recall, group)
    return network


# -- scan -------------------------------------------------------------------


def find(texts: list[str], data: np.ndarray, off: np.ndarray, network: Network) -> list[list[tuple[int, int, str]]]:
    """Findings of each text: the base rules', and candidates outside of these that the network takes for secrets."""
    found: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    raw = data.tobytes()
    low = raw.lower()
    mark = set()
    for word in (*KEYWORDS, "AKIA"):
        word, where = word.encode(), raw if word == "AKIA" else low
        i = where.find(word)
        while i >= 0:
            mark.add(int(np.searchsorted(off, i, "right")) - 1)
            i = where.find(word, i + len(word))
    hex_a, _ = runs(data, off, _HEX_BYTE, LEAST["hex"])
    mark |= set((np.searchsorted(off, hex_a, "right") - 1).tolist())
    for d in mark:
        if d < len(texts):
            found[d] = base_spans(texts[d])
    if network.threshold > 1:
        return found
    taken = np.zeros(len(data), bool)
    for d in mark:
        if d < len(texts):
            for s, e, _ in found[d]:
                x = off[d] + len(texts[d][:s].encode())
                taken[x : x + len(texts[d][s:e].encode())] = True
    a, b = candidates(data, off, taken)
    if len(a):
        start, end, of = pieces(a, b)
        best = np.zeros(len(a))
        np.maximum.at(best, of, network.score(windows(data, off, start, end)))
        good = best >= network.threshold
        for x, y in zip(a[good].tolist(), b[good].tolist(), strict=True):
            d = int(np.searchsorted(off, x, "right")) - 1
            start = len(raw[off[d] : x].decode("utf-8"))
            found[d].append((start, start + y - x, "learned"))
            found[d].sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return found


def scan(docs: DataFrame, network: Network | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Findings in every whole text: id_col, spans array<struct<start, end, kind>> in order of start."""
    prepare(docs.sparkSession)
    network = network or train(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in kernel.blocks(batches):
            found = find([x or "" for x in batch.column(1).to_pylist()], data, off, network)
            spans = pa.array([[{"start": s, "end": e, "kind": k} for s, e, k in f] for f in found], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), spans], ["id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, spans array<struct<start:bigint,end:bigint,kind:string>>").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, network: Network | None = None, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The rows with every finding in text_col replaced by the mask; all other columns and null texts as they were."""
    prepare(docs.sparkSession)
    network = network or train(docs, text_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in kernel.blocks(batches, text_col):
            texts = batch.column(at).to_pylist()
            for i, spans in enumerate(find([x or "" for x in texts], data, off, network)):
                out, last = [], 0
                for s, e, _ in spans:
                    if e > last:
                        out += [texts[i][last : max(last, s)], mask if s >= last else ""]
                        last = e
                if spans:
                    texts[i] = "".join(out) + texts[i][last:]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(batch.num_columns)], batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def digest(spans: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in spans).encode()).hexdigest()
