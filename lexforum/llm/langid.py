"""Language ID by language-bitmask n-gram filters.

For every language the n-grams (3 and 4 letters, over word ends) that are typical
of it are put into one bit-sliced Bloom filter: a slot holds one bit for each
language, and looking an n-gram up (the AND of its slots) gives all languages
that contain it at once. A text's n-grams are counted per language, the counts
are corrected for each filter's false positives, and the largest decides.

Learned from a bounded sample of labelled texts (SAMPLE of each language, however many
languages there are: a slot has a bit for each). Texts are read whole, however long. Null text, or text without a
letter: `und`, score 0. Ties go to the language that sorts first. An empty table, or
one without labels, gives `und` for all. Repeated rows each give a row; columns
other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel, pretokens
from .shared import prepare

UND = "und"
#: Labelled texts to learn from, for each language, about (chosen by a hash of the id).
SAMPLE = 400
#: An n-gram belongs to a language if it occurs so often compared with the language where it is most frequent.
SHARE = 0.2
#: Lookups of an n-gram; slots for each n-gram kept.
LOOKUPS, SLOTS = 2, 8
#: Bytes of text whose n-grams are found at once: each byte takes some 200 in arrays of n-grams.
PIECE_BYTES = 128 << 10


#: Bytes that are no letter nor part of one.
_ENDS = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])


@lru_cache(maxsize=1)
def _fold() -> np.ndarray:
    """Lower-case letter of each codepoint, 0 for what is no letter."""
    table = np.zeros(0x110000, np.uint32)
    letters = np.flatnonzero(np.isin(pretokens.symbols(), (0, 6, 7, 8, 9, 10)))
    table[letters] = letters
    for c in letters.tolist():
        low = chr(c).lower()
        if len(low) == 1:
            table[c] = ord(low)
    return table


def pieces(data: np.ndarray, off: np.ndarray, size: int = PIECE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The documents as they are, or one longer text in pieces of about `size` bytes. Texts are cut where a word ends, which no n-gram spans, so pieces hold the same n-grams together; a run of letters alone stays whole."""
    if len(off) != 2 or len(data) <= size:
        yield data, off
        return
    a = 0
    while a < len(data):
        b = a + size
        while b < len(data) and not (cut := _ENDS[data[b : b + size]]).any():
            b += size
        b = min(b + int(cut.argmax()), len(data)) if b < len(data) else len(data)
        yield data[a:b], np.array([0, b - a])
        a = b


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams, and the number of them before each document (n + 1 values)."""
    n = len(off) - 1
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = (data & 0xC0) != 0x80
    edge = np.concatenate(([0], np.cumsum(lead)))[off[:-1]]
    breaks = edge + np.arange(n)  # a word end stands before every document, and one at the end
    letters = np.zeros(len(points) + n + 1, np.uint32)
    place = np.ones(len(letters), bool)
    place[breaks], place[-1] = False, False
    letters[place] = _fold()[points]
    keep = letters != 0
    keep[1:] |= letters[:-1] != 0  # of several word ends the first stays
    keep[breaks] = True
    first = np.cumsum(keep) - 1
    start = np.append(first[breaks], first[-1] if keep[-1] else first[-1] + 1)
    x = letters[keep].astype(np.uint64)
    if len(x) < 3:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    # A window may end at the next document's first word end, but not go beyond.
    end = np.repeat(start[1:], np.diff(start))[: len(x)]
    end = np.concatenate((end, np.full(len(x) - len(end), len(x))))
    k1, k2, k3, k4 = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
    three = x[:-2] * k1 + x[1:-1] * k2 + x[2:] * k3
    at = np.arange(len(three))
    good3 = (at + 2 <= end[:-2]) & (x[1:-1] != 0)
    four = three[:-1] + x[3:] * k4 + np.uint64(1)
    good4 = (at[:-1] + 3 <= end[:-3]) & (x[1:-2] != 0) & (x[2:-1] != 0)
    both = np.zeros((len(three), 2), np.uint64)
    both[:, 0], both[:-1, 1] = three, four
    good = np.zeros((len(three), 2), bool)
    good[:, 0], good[:-1, 1] = good3, good4
    before = np.concatenate(([0], np.cumsum(good.sum(1))))
    return kernel.mix(both[good]), before[np.minimum(start, len(three))]


@dataclass
class Filters:
    """Bit-sliced Bloom filters: slots[i, w] holds the bits of languages 8 w .. 8 w + 7."""

    languages: list[str]
    slots: np.ndarray
    false: np.ndarray  # expected share of false positives of each language

    @classmethod
    def of(cls, sets: dict[str, np.ndarray]) -> Filters:
        names = sorted(sets)
        size = 1 << max(12, int(SLOTS * max([1, *map(len, sets.values())])).bit_length())
        slots = np.zeros((size, max(1, -(-len(names) // 8))), np.uint8)
        for i, name in enumerate(names):
            for at in cls.places(sets[name], size):
                slots[at, i // 8] |= np.uint8(1 << i % 8)
        fill = np.array([((slots[:, i // 8] >> i % 8) & 1).mean() for i in range(len(names))])
        return cls(names, slots, fill**LOOKUPS)

    @staticmethod
    def places(h: np.ndarray, size: int) -> list[np.ndarray]:
        return [((h >> np.uint64(24 * i)) & np.uint64(size - 1)).astype(np.int64) for i in range(LOOKUPS)]

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Languages of each n-gram, as bits."""
        first, *rest = self.places(h, len(self.slots))
        found = self.slots[first]
        for at in rest:
            found = found & self.slots[at]
        return found

    def predict(self, data: np.ndarray, off: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score (corrected share of n-grams that the language contains) of each document."""
        n, totals = np.zeros(len(off) - 1, np.int64), np.zeros((len(self.languages), 1), np.int64)
        for part, ends in pieces(data, off):
            h, before = grams(part, ends)
            n += np.diff(before)
            found = self.lookup(h)
            if len(part) < len(data):  # one text in pieces
                totals[:, 0] += np.unpackbits(found, axis=1, bitorder="little").sum(0, np.int64)[: len(totals)]
        if not self.languages or not n.any():
            return [UND] * len(n), np.zeros(len(n))
        cut = len(part) < len(data)
        best, most = np.zeros(len(n), np.int64), np.full(len(n), -np.inf)  # one language after the other: no documents x languages table
        for i in range(len(self.languages)):
            hits = totals[i] if cut else kernel.segment_sums(((found[:, i // 8] >> (i % 8)) & 1).astype(np.int64), before)
            share = (hits / np.maximum(n, 1) - self.false[i]) / (1 - self.false[i])
            more = share > most
            best[more], most[more] = i, share[more]
        score = np.clip(most, 0, 1)
        return [self.languages[b] if k else UND for b, k in zip(best.tolist(), n.tolist(), strict=True)], np.where(n > 0, score, 0.0)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose crc32(id as text) mod 5 is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Filters:
    """Filters from about `sample` labelled texts of each language that are not held out, all of them if there are fewer."""
    prepare(docs.sparkSession)
    labelled = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    many = {r[0]: min(1.0, sample / r[1]) * 2**32 for r in labelled.groupBy(lang_col).count().collect()}  # one row for each language, like the filters themselves
    if not many:
        return Filters.of({})
    # The share of each language that the sample takes, as a limit on a hash; one row for each language is broadcast, so texts are chosen where they lie. A list of rows would start Python workers of their own, an Arrow table starts none.
    limits = F.broadcast(docs.sparkSession.createDataFrame(pa.table({"_lang": pa.array(many.keys(), pa.string()), "_limit": pa.array(many.values(), pa.float64())})))
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(F.lit(17), F.col(id_col)), F.lit(1 << 32)).alias("_draw"))
    chosen = rows.join(limits, F.col("lang") == F.col("_lang")).where("_draw < _limit").select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in kernel.blocks(batches, size=PIECE_BYTES):
            for part, ends in pieces(data, off):
                h, before = grams(part, ends)
                langs = np.repeat(np.array(batch.column(0).to_pylist(), object), np.diff(before))
                for lang in set(langs.tolist()):
                    keys, counts = np.unique(h[langs == lang], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([keys.tobytes()], pa.binary()), pa.array([counts.astype("<i8").tobytes()], pa.binary())], ["lang", "keys", "counts"])

    parts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for r in chosen.mapInArrow(run, "lang string, keys binary, counts binary").toLocalIterator():  # bounded by the sample
        parts.setdefault(r.lang, []).append((np.frombuffer(r["keys"], np.uint64), np.frombuffer(r["counts"], np.int64)))
    tables = {}
    for lang, own in parts.items():
        keys, at = np.unique(np.concatenate([k for k, _ in own]), return_inverse=True)
        tables[lang] = keys, np.bincount(at, np.concatenate([c for _, c in own]))
    every = np.unique(np.concatenate([k for k, _ in tables.values()])) if tables else np.zeros(0, np.uint64)
    most = np.zeros(len(every))
    for keys, counts in tables.values():
        at = np.searchsorted(every, keys)
        most[at] = np.maximum(most[at], counts / counts.sum())
    sets = {}
    for lang, (keys, counts) in tables.items():
        sets[lang] = keys[counts / counts.sum() >= SHARE * most[np.searchsorted(every, keys)]]
    return Filters.of(sets)


def predict(docs: DataFrame, filters: Filters | None = None, text_col: str = "text") -> DataFrame:
    """The rows with lang_pred and score added (columns of these names are replaced)."""
    prepare(docs.sparkSession)
    filters = filters if filters is not None else train(docs, text_col=text_col)
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in kernel.blocks(batches, text_col, PIECE_BYTES):
            langs, scores = shared.value.predict(data, off)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores)], [*batch.schema.names, "lang_pred", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *StructType().add("lang_pred", StringType()).add("score", DoubleType()).fields]))
