"""Toxicity: cumulative-link ordinal regression over hashed words.

Grades 0 .. K share one weight vector; ordered thresholds t_1 < .. < t_K give
P(grade >= k) = logistic(w x - t_k). The expected severity is the sum of these
over k. Fitted on a bounded sample of labelled texts; a held-out fifth of it
sets the cut above which a text counts as toxic. What the grades are is the caller's
choice (`grade`): with two of them, as the given labels have, one threshold is left.
Null text: empty. Very long texts are read whole; columns other than those named are
not read, whatever their names. Labels
without a text, and null grades, are left out. Without labels nothing is toxic.
Repeated rows each give a row; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel
from .shared import prepare

#: Labelled texts to learn from at most; hashed words; texts a word must occur in to count.
SAMPLE, DIMENSIONS, LEAST_TEXTS = 8_000, 1 << 20, 5
#: Bytes of the beginnings of words that are features too.
BEGINNINGS = (4, 6, 8)
#: Standard errors by which a feature's share among toxic texts must differ from its share among others.
LEAST_Z = 3.0


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each document, its words and their beginnings, and the number of features before each.

    Letters and digits only: marks at words' ends do not count.
    """
    inside = np.zeros(256, bool)
    inside[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
    clean = np.where(inside[data], data, 32).astype(np.uint8)
    starts, ends, before = kernel.words(clean, off)
    n = len(off) - 1
    doc = np.repeat(np.arange(n, dtype=np.uint64), np.diff(before)) << np.uint64(32)
    parts = [doc | (kernel.slice_hashes(clean, starts, ends, lower=True) & np.uint64(DIMENSIONS - 1))]
    for size in BEGINNINGS:
        long = ends - starts > size
        h = kernel.slice_hashes(clean, starts[long], starts[long] + size, lower=True) + np.uint64(size)
        parts.append(doc[long] | (kernel.mix(h) & np.uint64(DIMENSIONS - 1)))
    key = np.sort(np.concatenate(parts))
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    return (key & np.uint64(0xFFFFFFFF)).astype(np.int64), np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << np.uint64(32))


@dataclass
class Ordinal:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(DIMENSIONS, np.float32))
    thresholds: np.ndarray = field(default_factory=lambda: np.array([40.0]))
    cut: float = float("inf")  # expected severity from which a text counts as toxic

    def linear(self, words: np.ndarray, before: np.ndarray) -> np.ndarray:
        return kernel.segment_sums(self.weights[words].astype(float), before)

    def at_least(self, linear: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. K: rows x K."""
        return 1 / (1 + np.exp(-np.clip(linear[:, None] - self.thresholds, -40, 40)))

    def severity(self, linear: np.ndarray) -> np.ndarray:
        return self.at_least(linear).sum(1)

    def fit(self, words: np.ndarray, before: np.ndarray, grade: np.ndarray, epochs: int = 150, rate: float = 0.1, penalty: float = 0.02) -> None:
        """Adam on the mean log loss of grades under the cumulative link, thresholds kept in order by positive steps."""
        n, top = len(grade), max(1, int(grade.max(initial=0)))
        doc = np.repeat(np.arange(n), np.diff(before))
        share = np.array([np.clip((grade >= k).mean(), 1e-4, 1 - 1e-4) for k in range(1, top + 1)])
        base = -np.log(share / (1 - share))
        steps = np.log(np.maximum(np.diff(base), 1e-2))
        used, at = np.unique(words, return_inverse=True)
        params = [np.zeros(len(used)), np.concatenate((base[:1], steps))]
        moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
        rows = np.arange(n)
        for step in range(1, epochs + 1):
            w, t = params
            thresholds = np.concatenate((t[:1], t[0] + np.cumsum(np.exp(t[1:]))))
            eta = np.bincount(doc, w[at], n)
            above = np.concatenate((np.ones((n, 1)), 1 / (1 + np.exp(-np.clip(eta[:, None] - thresholds, -40, 40))), np.zeros((n, 1))), 1)
            p = np.maximum(above[rows, grade] - above[rows, grade + 1], 1e-12)
            slope = above * (1 - above)  # of P(grade >= k) by eta
            d = -(slope[rows, grade] - slope[rows, grade + 1]) / p / n
            by_threshold = np.zeros((n, top + 2))
            by_threshold[rows, grade] += slope[rows, grade] / p / n
            by_threshold[rows, grade + 1] -= slope[rows, grade + 1] / p / n
            gt = by_threshold.sum(0)[1:-1]
            g = [np.bincount(at, d[doc], len(used)) + penalty / n * w * 10, np.concatenate(([gt.sum()], np.exp(t[1:]) * np.cumsum(gt[::-1])[::-1][1:]))]
            for q, (value, grad) in enumerate(zip(params, g, strict=True)):
                moments[q][0] = 0.9 * moments[q][0] + 0.1 * grad
                moments[q][1] = 0.999 * moments[q][1] + 0.001 * grad**2
                params[q] = value - rate * (moments[q][0] / (1 - 0.9**step)) / (np.sqrt(moments[q][1] / (1 - 0.999**step)) + 1e-8)
        w, t = params
        self.weights = np.zeros(DIMENSIONS, np.float32)
        self.weights[used] = w
        self.thresholds = np.concatenate((t[:1], t[0] + np.cumsum(np.exp(t[1:]))))

    def calibrate(self, words: np.ndarray, before: np.ndarray, grade: np.ndarray) -> None:
        """The cut with the best F1 for grade >= 1 on held-out texts; between neighbouring severities the middle."""
        s = self.severity(self.linear(words, before))
        order = np.argsort(-s)
        hit = np.cumsum(grade[order] > 0)
        if not len(hit) or not hit[-1]:
            self.cut = 0.5
            return
        f1 = 2 * hit / (np.arange(1, len(hit) + 1) + hit[-1])
        i = int(f1.argmax())
        self.cut = float((s[order][i] + s[order][min(i + 1, len(s) - 1)]) / 2)


def train(docs: DataFrame, labels: DataFrame, grade: Column | str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Ordinal:
    """Fitted on the `sample` labels with the smallest hashes of their ids. grade: an integer from 0 up, by labels' columns."""
    prepare(docs.sparkSession)
    grade = F.col(grade) if isinstance(grade, str) else grade
    chosen = labels.select(F.col(id_col).alias("id"), grade.cast("int").alias("grade")).where("id is not null and grade >= 0").distinct().orderBy(F.xxhash64("id"), "id", "grade").limit(sample)
    joined = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")  # `sample` rows at most are broadcast
    # Of several texts with one id the one with the smallest hash is learned from, so that `sample` rows at most come back.
    joined = joined.groupBy("id", "grade").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("id", "text", "grade")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in kernel.blocks(batches):
            words, before = features(data, off)
            flat = words.astype("<i4")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([flat[a:b].tobytes() for a, b in zip(before[:-1], before[1:], strict=True)], pa.binary())], ["id", "grade", "words"])

    rows = sorted(((str(r.id), r.grade, r.words) for r in joined.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, grade int, words binary").toLocalIterator()))
    model = Ordinal()
    grades = np.array([r[1] for r in rows], np.int64)
    if not len(grades) or grades.max() == 0:
        return model
    lists = [np.frombuffer(r[2], "<i4").astype(np.int64) for r in rows]
    out = np.array([kernel.mix(np.array([i], np.uint64))[0] % np.uint64(5) == 0 for i in range(len(rows))])

    def part(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = [x for x, y in zip(lists, which, strict=True) if y]
        return np.concatenate([*own, np.zeros(0, np.int64)]), np.concatenate(([0], np.cumsum([len(x) for x in own]))).astype(np.int64)

    words, before = part(~out)
    # Words that occur often enough, and clearly more or less often in toxic texts than in others.
    toxic = grades[~out] > 0
    n, n1 = len(toxic), max(1, int(toxic.sum()))
    texts = np.bincount(words, minlength=DIMENSIONS)
    among = np.bincount(words[np.repeat(toxic, np.diff(before))], minlength=DIMENSIONS)
    rate = texts / n
    z = (among / n1 - (texts - among) / max(1, n - n1)) / np.sqrt(np.maximum(rate * (1 - rate), 1e-9) * (1 / n1 + 1 / max(1, n - n1)))
    keep = ((texts >= min(LEAST_TEXTS, 1 + n // 200)) & (np.abs(z) >= LEAST_Z))[words]
    before = np.concatenate(([0], np.cumsum(keep)))[before]
    model.fit(words[keep], before, grades[~out])
    model.calibrate(*part(out), grades[out])
    return model


def score(docs: DataFrame, model: Ordinal, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Severity of every whole text: id_col, expected_severity, p_toxic (of grade 1 or more), grade (the most likely one), toxic."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch, data, off in kernel.blocks(batches):
            above = m.at_least(m.linear(*features(data, off)))
            steps = np.concatenate((np.ones((len(above), 1)), above, np.zeros((len(above), 1))), 1)
            severity = above.sum(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(severity), pa.array(above[:, 0]), pa.array((steps[:, :-1] - steps[:, 1:]).argmax(1).astype(np.int32)), pa.array(severity >= m.cut)], ["id", "expected_severity", "p_toxic", "grade", "toxic"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, expected_severity double, p_toxic double, grade int, toxic boolean").withColumnRenamed("id", id_col)
