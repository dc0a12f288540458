"""Discourse indicators: pattern mechanisms over whole texts, detectors over parsed tokens, distance from a lexicon, feature rows.

Patterns are found by one Arrow function that reads each text once for all rules, as
they need Unicode word edges and look-ahead; everything after is columns. Null and
empty texts give no spans; texts of fewer than 20 characters score 0 with a warning.
"""

from __future__ import annotations

import json
import math
import operator
import re
import sys
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforum.functions import lexicons as L
from lexforum.functions.materialise import small_batches
from lexforum.functions.patterns import Finder, folded
from lexforum.functions.stats import clamp, quantiles
from lexforum.functions.text import bound
from lexforum.operators.spans import sentences


@dataclass(frozen=True)
class Mechanism:
    """A mechanism's patterns and the weight of each hit."""

    name: str
    weight: float
    patterns: Sequence[str]


NV = [Mechanism("recategorizacion_combatiente", L.NV_WEIGHTS["recategorizacion_combatiente"], L.NV_COMBATANT), Mechanism("atribucion_armamento", L.NV_WEIGHTS["atribucion_armamento"], L.NV_WEAPONS), Mechanism("descalificacion_moral", L.NV_WEIGHTS["descalificacion_moral"], L.NV_MORAL)]
REP = [
    Mechanism("reconocimiento_responsabilidad", L.REP_WEIGHTS["reconocimiento_responsabilidad"], L.REP_ACKNOWLEDGED),
    Mechanism("restitución_identidad", L.REP_WEIGHTS["restitución_identidad"], L.REP_IDENTITY),
    Mechanism("restitución_identidad", L.REP_WEIGHTS["restitución_identidad"] * L.REP_NAMED_FACTOR, L.REP_NAMED),
    Mechanism("lenguaje_dih_reparador", L.REP_WEIGHTS["lenguaje_dih_reparador"], L.REP_LAW),
    Mechanism("compromiso_reparación", L.REP_WEIGHTS["compromiso_reparación"], L.REP_REPAIR),
]
SA = [Mechanism("patron_lexical", L.SA_WEIGHTS["patron_lexical"], L.SA_LEXICAL)]

SPAN = "struct<mechanism:string,weight_base:double,weight:double,start:int,end:int,text:string,questioned:boolean>"


def separated(spans: list[dict], share: float = 0.5, cell: int = 64) -> list[dict]:
    """Spans by weight, heaviest first (ties as found), without those that share more than `share` of their length with a kept one.

    Kept spans are looked up by the cells of text they reach, so that a text of many spans takes time in proportion.
    """
    kept, at = [], defaultdict(list)
    for s in sorted(spans, key=lambda x: -x["weight"]):
        cells = range(s["start"] // cell, (s["end"] - 1) // cell + 1)
        length = s["end"] - s["start"]
        if any(min(s["end"], b) - max(s["start"], a) > share * length for c in cells for a, b in at[c]):
            continue
        kept.append(s)
        for c in cells:
            at[c].append((s["start"], s["end"]))
    return kept


def pattern_spans(mechanisms: Sequence[Mechanism], questioned: Sequence[str] = (), width: int = 150, factor: float = 0.25, apart: bool = False):
    """A column function: all matches of a text as array of SPAN, in order of mechanisms, patterns and places.

    A span with a match of `questioned` within `width` characters keeps `factor` of its weight. `apart`: see separated().
    """
    found = _found(mechanisms, questioned, width, factor, apart)
    small_batches()

    @F.pandas_udf(f"array<{SPAN}>")
    def spans(text: pd.Series) -> pd.Series:
        return text.map(found, na_action=None)

    return spans


def _found(mechanisms: Sequence[Mechanism], questioned: Sequence[str] = (), width: int = 150, factor: float = 0.25, apart: bool = False):
    """The matches of one text, for pattern_spans."""
    rules = [(m.name, float(m.weight), Finder(p)) for m in mechanisms for p in m.patterns]
    doubts = [re.compile(p, re.IGNORECASE) for p in questioned]

    def found(text: str | None) -> list[dict]:
        out, low = [], folded(text or "")
        for name, weight, pattern in rules:
            for m in pattern.finditer(text or "", low):
                a, b = m.span()
                near = text[max(0, a - width) : b + width] if doubts else ""
                doubted = any(d.search(near) for d in doubts)
                out.append({"mechanism": name, "weight_base": weight, "weight": weight * (factor if doubted else 1.0), "start": a, "end": b, "text": m[0], "questioned": doubted})
        return separated(out) if apart else out

    return found


def nv_spans(text: Column) -> Column:
    """Denial of victimhood (patterns only; see recategorised, armed, dehumanised for parsed tokens)."""
    return pattern_spans(NV, L.NV_QUESTIONED)(text)


def rep_spans(text: Column) -> Column:
    """Positive epistemic rupture, overlaps removed."""
    return pattern_spans(REP, apart=True)(text)


def sa_spans(text: Column) -> Column:
    """Suppressed agency: lexical patterns."""
    return pattern_spans(SA)(text)


# -- scales -------------------------------------------------------------------


@dataclass(frozen=True)
class Scale:
    """Maps raw scores to 0 .. 1: by low and high percentile, by standard deviations (-3 .. 3), or as they are."""

    method: str = "percentile"
    low: float = 0.0
    high: float = 1.0
    mean: float = 0.0
    std: float = 1.0
    fitted: bool = False

    @classmethod
    def fit(cls, df: DataFrame, column: str, method: str = "percentile", low: float = 5.0, high: float = 95.0) -> Scale:
        """From a column's values (two rows are collected)."""
        ends = quantiles(df, column, (low / 100, high / 100)).first()
        if ends is None:
            return cls(method)
        mean, std = df.agg(F.avg(column), F.stddev_pop(column)).first()
        return cls(method, float(ends.q[0]), float(ends.q[1]), float(mean), float(std) or 1e-8, True)

    def __call__(self, raw: Column) -> Column:
        if self.method == "passthrough":
            return clamp(raw)
        if self.method == "zscore":
            return clamp(((raw - self.mean) / self.std + 3) / 6)
        span = self.high - self.low
        return clamp((raw - self.low) / span) if span > 1e-10 else F.when(raw.isNotNull(), F.lit(0.5))

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Scale:
        return cls(**json.loads(text))


NV_SCALE, REP_SCALE, SA_SCALE = (Scale("percentile", *x) for x in (L.NV_SCALE, L.REP_SCALE, L.SA_SCALE))


def indicator(spans: Column, text: Column, scale: Scale, mechanisms: Sequence[str], least_words: int = 3, least_chars: int = 20, top: int = 5) -> Column:
    """Struct: score, score_raw (weight per sentence), n_sentences, n_instances, n_questioned, by_mechanism (map of counts), top_spans (heaviest first), warning."""
    short = F.coalesce(F.length(F.trim(text)) < least_chars, F.lit(True))
    none = F.filter(spans, lambda s: F.lit(False))
    own = F.when(short, none).otherwise(spans)
    return bound(F.when(short, 0).otherwise(F.size(sentences(text, least_words))), lambda n: _told(own, short, n, scale, mechanisms, top))


def _told(own: Column, short: Column, n: Column, scale: Scale, mechanisms: Sequence[str], top: int) -> Column:
    """The struct of indicator, of the number of sentences."""
    raw = F.when(n > 0, F.aggregate(own, F.lit(0.0), lambda a, s: a + s["weight"]) / n).otherwise(0.0)
    count = lambda m: F.size(F.filter(own, lambda s: s["mechanism"] == m))
    order = F.array_sort(F.transform(own, lambda s, i: F.struct((-s["weight"]).alias("w"), i.alias("i"), s.alias("s"))))
    return F.struct(
        F.when(short, 0.0).otherwise(scale(raw)).alias("score"), raw.alias("score_raw"), n.alias("n_sentences"), F.size(own).alias("n_instances"),
        F.size(F.filter(own, lambda s: s["questioned"])).alias("n_questioned"),
        F.map_from_arrays(F.array(*map(F.lit, mechanisms)), F.array(*map(count, mechanisms))).alias("by_mechanism"),
        F.transform(F.slice(order, 1, top), lambda x: x["s"]).alias("top_spans"),
        F.when(short, "texto_vacio_o_muy_corto").alias("warning"),
    )


# -- parsed tokens --------------------------------------------------------------
# One row per token: doc_id, sent, i (place in the document), start, end, token, lemma, pos, dep, head (i of its head), ent. A parser outside of this engine gives it.

_KEY = ["doc_id", "sent"]


def _marks() -> dict[str, Column]:
    """What the detectors ask of a token by itself. Names that end in _child hold for tokens that hang on another (a root is its own head)."""
    word, lemma, dep = F.lower("token"), F.lower("lemma"), F.col("dep")
    either = lambda words: lemma.isin(*words) | word.isin(*words)
    named = F.col("ent").isin("PER", "ORG")
    out = {
        "passive": dep == "nsubjpass", "por": word == "por", "agent_child": (dep == "agent") | (word.isin("por", "mediante") & (dep == "prep")),
        "se": (word == "se") & dep.isin("expl", "expl:pv", "nsubj", "obj", "iobj"), "named_child": (dep == "nsubj") & named,
        "action": (F.col("pos") == "NOUN") & is_nominalisation(word, lemma), "owner_child": dep.isin("nmod", "nmod:poss") & named,
        "subject": dep.isin("nsubj", "nsubjpass"), "institution": either(L.SA_INSTITUTIONS), "institution_child": dep.isin("det", "amod") & lemma.isin(*L.SA_INSTITUTIONS),
        "reports": lemma.isin(*L.SA_REPORT_VERBS), "acts": lemma.isin(*L.SA_ACTION_VERBS), "proceeds": (F.col("pos") == "VERB") & lemma.isin(*L.SA_INSTITUTION_VERBS),
        "combatant": lemma.isin(*L.NV_COMBATANT_LEMMAS) & (F.col("pos") != "VERB"), "neg_child": dep == "neg",
        "weapon": lemma.isin(*L.NV_WEAPON_LEMMAS) & F.col("pos").isin("NOUN", "PROPN"), "holds_child": lemma.isin(*L.NV_POSSESSION_LEMMAS) | word.isin(*L.NV_POSSESSION_WORDS),
        "denied": F.col("pos").isin("NOUN", "PRON", "PROPN") & (either(L.NV_DIRECT_LEMMAS) | (either(L.NV_CONTEXT_LEMMAS) & dep.isin("nsubj", "nsubjpass", "obj", "dobj"))),
    }
    return {k: F.coalesce(c & (F.col("i") != F.col("head")) if k.endswith("_child") else c, F.lit(False)) for k, c in out.items()}


class _Tokens:
    """Tokens of whole sentences as arrays: the number of their sentence, their marks, and one number for their sentence with their own place (`own`) and with their head's (`head`), -1 where there is none.

    Within a sentence, places lie less than 2^40 from its first token's.
    """

    def __init__(self, sentence: np.ndarray, first: np.ndarray, i: pa.Array, head: pa.Array, marks: np.ndarray, bits: dict[str, int]) -> None:
        self.sentence, self.marks, self.bits = sentence, marks, bits
        base = i.fill_null(0).to_numpy(zero_copy_only=False)[first][sentence]
        far = 1 << 40

        def numbered(x: pa.Array) -> np.ndarray:
            place = np.clip(x.fill_null(0).to_numpy(zero_copy_only=False) - base, 8 - far, far - 8) + far
            return np.where(x.is_valid().to_numpy(zero_copy_only=False), sentence * (2 * far) + place, -1)

        self.own, self.head = numbered(i), numbered(head)
        order = np.argsort(self.own, kind="stable")
        self.order, self.places = order, self.own[order]

    def has(self, rows: np.ndarray, mark: str) -> np.ndarray:
        return (self.marks[rows] & self.bits[mark] != 0) & (rows >= 0)

    def all(self, mark: str) -> np.ndarray:
        return np.flatnonzero(self.marks & self.bits[mark])

    def without(self, rows: np.ndarray, mark: str, *by: str) -> np.ndarray:
        """The rows of which none of the places `by` is the head of a token with the mark."""
        taken = self.head[self.all(mark)]
        for b in by:
            rows = rows[~np.isin(getattr(self, b)[rows], taken)]
        return rows

    def heads(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a token and its head; -1 where the sentence lacks it."""
        low, high = (np.searchsorted(self.places, self.head[rows], side) for side in ("left", "right"))
        high = np.where(self.head[rows] >= 0, high, low)
        many = np.maximum(high - low, 1)
        at = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
        return np.repeat(rows, many), np.where(np.repeat(high > low, many), self.order[np.minimum(at, len(self.order) - 1)], -1)


@dataclass(frozen=True)
class Detector:
    """A mechanism over parsed tokens, and the marks it asks for. `find` gives tokens, their heads where instances reach these (else the tokens), and weights."""

    mechanism: str
    marks: tuple[str, ...]
    find: Callable[[_Tokens], tuple[np.ndarray, np.ndarray, np.ndarray]]


def long_sentences(tokens: DataFrame, least: int = 5) -> DataFrame:
    """Tokens of sentences of so many tokens or more (blank ones do not count)."""
    keep = tokens.where(F.trim("token") != "").groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select(*_KEY)
    return tokens.join(keep, _KEY, "left_semi")


def passive_without_agent(t: _Tokens):
    """Passive subjects whose verb has no agent: no child `agent`, no preposition por or mediante, no "por" among the five tokens after it."""
    free, por = t.without(t.all("passive"), "agent_child", "head"), t.own[t.all("por")]
    before = (por[por >= 0][:, None] - np.arange(1, 6)).ravel()
    rows, heads = t.heads(free[~np.isin(t.head[free], before)])
    return rows, heads, np.where(t.has(heads, "reports"), L.SA_REPORT_FACTOR, 1.0) * L.SA_WEIGHTS["pasiva_sin_agente"]


def impersonal_se(t: _Tokens):
    """"se" on a verb without a named subject; verbs of no procedure count half."""
    rows, heads = t.heads(t.without(t.all("se"), "named_child", "head"))
    return rows, heads, np.where(t.has(heads, "acts"), 1.0, L.SA_GENERIC_FACTOR) * L.SA_WEIGHTS["se_impersonal"]


def is_nominalisation(word: Column, lemma: Column) -> Column:
    """Whether a noun stands for an action: a listed one, or one with such a suffix and more than three letters before it; no ranks, offices and persons."""
    suffix = F.lit(False)
    for s in L.SA_SUFFIXES:
        suffix = suffix | (word.endswith(s) & (F.length(word) > len(s) + 3))
    return ~(lemma.isin(*L.SA_NO_ACTION) | word.isin(*L.SA_NO_ACTION)) & (lemma.isin(*L.SA_TRIGGERS) | word.isin(*L.SA_TRIGGERS) | suffix)


def nominalisations(t: _Tokens):
    """Nouns that stand for an action without a named owner; as subjects they weigh more."""
    rows = t.without(t.all("action"), "owner_child", "own")
    return rows, rows, np.where(t.has(rows, "subject"), L.SA_SUBJECT_FACTOR, 1.0) * L.SA_WEIGHTS["nominalizacion"]


def institutional_subjects(t: _Tokens):
    """Institutions, by themselves or by a determiner or adjective, as subjects of verbs of procedure."""
    subjects = t.all("subject")
    rows, heads = t.heads(subjects[t.has(subjects, "institution") | np.isin(t.own[subjects], t.head[t.all("institution_child")])])
    acts = t.has(heads, "proceeds")
    return rows[acts], heads[acts], np.full(acts.sum(), L.SA_WEIGHTS["sujeto_institucional"])


def recategorised(t: _Tokens):
    """Words for combatants that are no verbs and not directly negated."""
    rows = t.without(t.all("combatant"), "neg_child", "own", "head")
    return rows, rows, np.full(len(rows), L.NV_WEIGHTS["recategorizacion_combatiente"])


def armed(t: _Tokens):
    """Weapons that someone is said to hold: a sibling is a verb of possession, "con" or "sin"; they count 0.7 of the mechanism."""
    rows, holds = t.all("weapon"), t.all("holds_child")
    rows, holds = rows[(t.head[rows] >= 0) & (t.own[rows] >= 0)], holds[np.lexsort((t.own[holds], t.head[holds]))]
    # A sibling at another place: the least or the largest place of those that hold is another one.
    low, high = (np.searchsorted(t.head[holds], t.head[rows], side) for side in ("left", "right"))
    rows, low, high = rows[high > low], low[high > low], high[high > low]
    rows = rows[(t.own[holds[low]] != t.own[rows]) | (t.own[holds[high - 1]] != t.own[rows])]
    return rows, rows, np.full(len(rows), L.NV_WEIGHTS["atribucion_armamento"] * 0.7)


def dehumanised(t: _Tokens):
    """Words that deny a person: some always, others as subject or object; not directly negated."""
    rows = t.without(t.all("denied"), "neg_child", "own", "head")
    return rows, rows, np.full(len(rows), L.NV_WEIGHTS["deshumanizacion"])


SA_TOKENS = (
    Detector("pasiva_sin_agente", ("passive", "agent_child", "por", "reports"), passive_without_agent), Detector("se_impersonal", ("se", "named_child", "acts"), impersonal_se),
    Detector("nominalizacion", ("action", "owner_child", "subject"), nominalisations), Detector("sujeto_institucional", ("subject", "institution", "institution_child", "proceeds"), institutional_subjects),
)
NV_TOKENS = (Detector("recategorizacion_combatiente", ("combatant", "neg_child"), recategorised), Detector("atribucion_armamento", ("weapon", "holds_child"), armed), Detector("deshumanizacion", ("denied", "neg_child"), dehumanised))

#: Tokens that a task looks at together, at least: whole sentences of several batches.
BLOCK = 1 << 16


def _starts(column: pa.Array) -> np.ndarray:
    """Whether a value differs from the one before (the first one does); nulls are equal."""
    out = np.zeros(len(column), bool)
    out[:1] = True
    if pa.types.is_struct(column.type):
        for part in column.flatten():
            out |= _starts(part)
    elif len(column) > 1:
        out[1:] = pc.not_equal(column[1:], column[:-1]).fill_null(False).to_numpy(zero_copy_only=False)
    if column.null_count:
        known = column.is_valid().to_numpy(zero_copy_only=False)
        out[1:] |= known[1:] != known[:-1]
    return out


def _sentence_rows(detectors: Sequence[Detector], bits: dict[str, int], placed: int):
    """Batches of tokens in order of sentences to a row per sentence, as told in sentence_instances."""
    def told(tokens: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        column = {c: tokens.column(c).combine_chunks() if tokens.column(c).num_chunks != 1 else tokens.column(c).chunk(0) for c in tokens.column_names}
        first, sentence = np.flatnonzero(starts), np.cumsum(starts) - 1
        marks, many = column["marks"].to_numpy(), len(first)
        t = _Tokens(sentence, first, column["i"], column["head"], marks, bits)
        found = [d.find(t) for d in detectors]
        counts = np.stack([np.bincount(sentence[x[0]], minlength=many) for x in found], 1)
        sums = np.stack([np.bincount(sentence[x[0]], x[2], many) for x in found], 1)
        rows, heads, weights = (np.concatenate([x[k] for x in found[placed:]] or [np.zeros(0, np.int64)]) for k in range(3))
        kinds = np.repeat(np.arange(placed, len(found), dtype=np.int32), [len(x[0]) for x in found[placed:]])
        order = np.argsort(sentence[rows], kind="stable")
        rows, heads = rows[order], heads[order]
        ends = lambda least, c: least(column[c].take(pa.array(rows)), column[c].take(pa.array(heads, mask=heads < 0)))
        offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(sentence[rows], minlength=many)))), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(kinds[order]), pa.array(weights[order].astype(float)), ends(pc.min_element_wise, "start"), ends(pc.max_element_wise, "end"))]
        fixed = pa.array(np.arange(many + 1) * len(found), pa.int32())
        over = lambda f, c, none: f.reduceat(column[c].fill_null(none).to_numpy(zero_copy_only=False), first)
        low, high = over(np.minimum, "start", np.iinfo(np.int64).max), over(np.maximum, "end", np.iinfo(np.int64).min)
        values = [
            column["doc_id"].take(pa.array(first)), column["sent"].take(pa.array(first)), pa.array(np.diff(np.append(first, len(starts)))), pa.array(np.add.reduceat((marks & 1).astype(np.int64), first)),
            pa.array(low, mask=low == np.iinfo(np.int64).max), pa.array(high, mask=high == np.iinfo(np.int64).min),
            pa.ListArray.from_arrays(fixed, pa.array(counts.ravel().astype(np.int64))), pa.ListArray.from_arrays(fixed, pa.array(sums.ravel())), *lists,
        ]
        return pa.RecordBatch.from_arrays(values, _SENTENCE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def block(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            tokens = pa.Table.from_batches(held)
            starts = reduce(operator.or_, (_starts(tokens.column(c).combine_chunks() if tokens.column(c).num_chunks != 1 else tokens.column(c).chunk(0)) for c in ("doc_id", "sent", "alone")))
            end = len(starts) if last else int(np.flatnonzero(starts)[-1])  # the last sentence may go on
            if end:
                yield told(tokens.slice(0, end), starts[:end])
            held, size = tokens.slice(end).combine_chunks().to_batches(), len(starts) - end

        fresh = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size, fresh = size + batch.num_rows, fresh + batch.num_rows
            if fresh >= max(BLOCK, size // 2):
                fresh = 0
                yield from block(False)
        if size:
            yield from block(True)

    return run


_SENTENCE = ["doc_id", "sent", "n", "full", "start", "end", "counts", "sums", "kinds", "weights", "starts", "ends"]


def sentence_instances(tokens: DataFrame, detectors: Sequence[Detector], placed: int = 0) -> DataFrame:
    """A row per sentence: doc_id, sent, n (tokens), full (those that are not blank), start, end, counts and sums (of weights) of each detector's instances; kinds (numbers of detectors), weights, starts and ends of all instances, from detector number `placed` on.

    Tokens are marked where they lie and cross the network once for all detectors, as numbers; a task reads its sentences in order, many at once. Tokens without a document stand alone, those without a sentence hang on none.
    """
    small_batches()
    bits = {m: 2 << k for k, m in enumerate(dict.fromkeys(m for d in detectors for m in d.marks))}
    all_marks, marks = _marks(), F.when(F.trim("token") != "", 1).otherwise(0)
    for name, bit in bits.items():
        marks = marks.bitwiseOR(F.when(all_marks[name], bit).otherwise(0))
    long = lambda c: F.col(c).cast("long").alias(c)
    head = F.when(F.col("doc_id").isNotNull() & F.col("sent").isNotNull(), F.col("head")).cast("long").alias("head")
    own = tokens.select(*_KEY, F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).alias("alone"), long("i"), head, long("start"), long("end"), marks.alias("marks"))
    kind = {c: tokens.schema[c].dataType.simpleString() for c in _KEY}
    schema = f"doc_id {kind['doc_id']}, sent {kind['sent']}, n bigint, full bigint, start bigint, end bigint, counts array<bigint>, sums array<double>, kinds array<int>, weights array<double>, starts array<bigint>, ends array<bigint>"
    return own.repartition(*_KEY, "alone").sortWithinPartitions(*_KEY, "alone").mapInArrow(_sentence_rows(detectors, bits, placed), schema)


def token_instances(tokens: DataFrame, detectors: Sequence[Detector], least: int = 0, blank: bool = True) -> DataFrame:
    """doc_id, sent, mechanism, weight, start, end: all instances of several detectors over one table of parsed tokens, in sentences of `least` tokens or more (blank ones count if asked); tokens without a document or sentence stand alone."""
    n = F.when(F.col("doc_id").isNotNull() & F.col("sent").isNotNull(), F.col("n" if blank else "full")).otherwise(F.least("n" if blank else "full", F.lit(1)))
    rows = sentence_instances(tokens, detectors).where(n >= least).select(*_KEY, "weights", "starts", "ends", F.posexplode("kinds").alias("_k", "_kind"))
    names = F.array(*(F.lit(d.mechanism) for d in detectors))
    of = lambda c, name: F.get(F.col(c), F.col("_k")).cast(tokens.schema[name].dataType).alias(name)
    return rows.select(*_KEY, F.get(names, F.col("_kind")).alias("mechanism"), F.get("weights", F.col("_k")).alias("weight"), of("starts", "start"), of("ends", "end"))


# -- scores from tokens and patterns together -------------------------------------------

#: Characters to each side that a trigger reaches, and what it leaves of a weight.
REACH, DOUBTED = 150, 0.25


def pattern_counts(mechanisms: Sequence[Mechanism]):
    """A column function: how many matches of the mechanisms a text has."""
    rules = [Finder(p) for m in mechanisms for p in m.patterns]
    small_batches()

    def found(text: str | None) -> int:
        low = folded(text or "")
        return sum(1 for p in rules for _ in p.finditer(text or "", low))

    @F.pandas_udf("long")
    def counts(text: pd.Series) -> pd.Series:
        return text.map(found, na_action=None).astype("int64")

    return counts


def questioned(text: str, low: str, triggers: Sequence[Finder], start: np.ndarray, end: np.ndarray, width: int = REACH) -> np.ndarray:
    """Whether a trigger lies within `width` characters of each span of a text. Triggers begin at a word's edge; at the cut of a window a word may begin that is the rest of one."""
    hits = sorted((m.start(), m.end()) for p in triggers for m in p.finditer(text, low))
    if not hits:
        return np.zeros(len(start), bool)
    edge = re.compile(r"\b")
    first, last = np.maximum(start - width, 0), end + width

    def reached(own: list[tuple[int, int]], exact: bool) -> np.ndarray:
        a, b = (np.array([x[k] for x in own] + [np.iinfo(np.int64).max], np.int64) for k in (0, 1))
        at = np.searchsorted(a, first)
        if exact:  # the first hit at a place ends first
            return (a[at] == first) & (b[at] <= last)
        return np.minimum.accumulate(b[::-1])[::-1][at] <= last

    return reached(hits, True) | reached([x for x in hits if edge.match(text, x[0])], False)


def denials(mechanisms: Sequence[Mechanism] = tuple(NV), whole: Sequence[str] = ("descalificacion_moral",), names: Sequence[str] = tuple(L.NV_WEIGHTS), patterns: Sequence[str] = L.NV_QUESTIONED, factor: float = DOUBTED):
    """A column function of a text, its sentences' starts and ends, and the kinds (numbers of `names`), weights, starts and ends of its tokens' instances: struct of weight, n_questioned and n (instances by name), of these and of the patterns' matches, `whole` ones in the whole text and others within a sentence.

    Instances near a trigger keep `factor` of their weight.
    """
    rules = [(names.index(m.name), float(m.weight), m.name in whole, Finder(p)) for m in mechanisms for p in m.patterns]
    triggers = [Finder(p.removeprefix(r"\b")) for p in patterns]
    small_batches()

    def spans(text: str, low: str, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, float, int, int]]:
        same = len(low) == len(text)  # then both have the same places
        for kind, weight, all_of, p in rules:
            if not p.within(low):
                continue
            if all_of:
                yield from ((kind, weight, *m.span()) for m in p.pattern.finditer(text))
                continue
            first, last = p.reach(low) if same else (0, len(text))
            near = (ends >= first) & (starts <= last)
            for a, b in zip(starts[near].tolist(), ends[near].tolist(), strict=True):
                piece = text[a:b]
                yield from ((kind, weight, a + m.start(), a + m.end()) for m in p.finditer(piece, low[a:b] if same else folded(piece)))

    def told(text: str | None, starts, ends, kinds, weights, low_at, high_at) -> tuple[float, int, list[int]]:
        low = folded(text or "")
        found = list(spans(text or "", low, starts, ends))
        kind, weight, a, b = (np.concatenate((x, np.array(y, x.dtype))) for x, y in zip((kinds, weights, low_at, high_at), zip(*found) if found else ((),) * 4, strict=True))
        doubted = questioned(text or "", low, triggers, a, b)
        return float((weight * np.where(doubted, factor, 1.0)).sum()), int(doubted.sum()), np.bincount(kind, minlength=len(names)).tolist()

    @F.pandas_udf("weight double, n_questioned long, n array<long>")
    def scores(text: pd.Series, starts: pd.Series, ends: pd.Series, kinds: pd.Series, weights: pd.Series, low: pd.Series, high: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([told(*x) for x in zip(text, starts, ends, kinds, weights, low, high, strict=True)], columns=["weight", "n_questioned", "n"])

    return scores


def _parsed_texts(texts: DataFrame, tokens: DataFrame, agency: bool, denied: bool, text: str) -> DataFrame:
    """The texts' rows with the structs `_agency` and `_denial` (_w, n_sentences, n_questioned, a count for each mechanism), as asked: tokens meet by sentence, sentences by document, documents their text, each once."""
    sa, nv = SA_TOKENS if agency else (), NV_TOKENS if denied else ()
    rows = sentence_instances(tokens.where(F.col("doc_id").isNotNull()), (*sa, *nv), len(sa))
    known, aggs = F.col("sent").isNotNull(), []
    if agency:
        long = known & (F.col("full") >= 5)
        total = lambda c: F.sum(F.when(long, c))
        aggs += [F.count_if(F.col("full") >= 5).alias("_sa_n"), total(sum((F.col("sums")[k] for k in range(1, len(sa))), F.col("sums")[0])).alias("_sa_w"), *(total(F.col("counts")[k]).alias(f"_sa_{k}") for k in range(len(sa)))]
    if denied:
        long = F.col("n") >= 3
        aggs += [F.collect_list(F.when(long, F.coalesce(c, F.lit(0)))).alias(f"_nv_{c}") for c in ("start", "end")]
        aggs += [F.flatten(F.collect_list(F.when(long & known, F.col(c)))).alias(f"_nv_{c}") for c in ("kinds", "weights", "starts", "ends")]
    out = texts.join(rows.groupBy("doc_id").agg(*aggs), "doc_id", "left")
    if agency:
        lexical = pattern_counts(SA)(F.col(text))
        out = out.withColumn("_lexical", lexical)
        weight = F.coalesce("_sa_w", F.lit(0.0)) + L.SA_WEIGHTS["patron_lexical"] * F.col("_lexical")
        counts = [F.coalesce(f"_sa_{k}", F.lit(0)).alias(f"n_{d.mechanism}") for k, d in enumerate(sa)]
        out = out.withColumn("_agency", F.struct(weight.alias("_w"), F.coalesce("_sa_n", F.lit(0)).alias("n_sentences"), F.lit(0).alias("n_questioned"), *counts, F.col("_lexical").alias("n_patron_lexical")))
    if denied:
        names = list(L.NV_WEIGHTS)
        empty = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>"))
        kinds = F.transform(empty("_nv_kinds", "int"), lambda k: F.get(F.array(*(F.lit(names.index(d.mechanism)) for d in nv)), k - len(sa)))
        own = [empty(f"_nv_{c}", kind) for c, kind in (("start", "bigint"), ("end", "bigint"), ("weights", "double"), ("starts", "bigint"), ("ends", "bigint"))]
        out = out.withColumn("_found", denials()(F.col(text), own[0], own[1], kinds, *own[2:]))
        out = out.withColumn("_denial", F.struct(F.col("_found.weight").alias("_w"), F.size(own[0]).alias("n_sentences"), F.col("_found.n_questioned").alias("n_questioned"), *(F.col("_found.n")[k].alias(f"n_{m}") for k, m in enumerate(names))))
    return out


def _scored(x: str, scale: Scale, mechanisms: Sequence[str], text: str) -> dict[str, Column]:
    """Columns of suppressed_agency and denial, of a struct that _parsed_texts gives."""
    short = F.coalesce(F.length(F.trim(text)) < 20, F.lit(True))
    n = F.col(f"{x}.n_sentences")
    raw = F.when(~short & (n > 0), F.col(f"{x}._w") / n).otherwise(0.0)
    counts = {"n_sentences": n, "n_instances": sum((F.col(f"{x}.n_{m}") for m in mechanisms[1:]), F.col(f"{x}.n_{mechanisms[0]}")), "n_questioned": F.col(f"{x}.n_questioned"), **{f"n_{m}": F.col(f"{x}.n_{m}") for m in mechanisms}}
    out = {"score": F.when(short, 0.0).otherwise(scale(raw)), "score_raw": raw} | {k: F.when(short, 0).otherwise(c).cast("long") for k, c in counts.items()}
    return out | {"valid": F.coalesce(F.length(text) > 20, F.lit(False)) & ~short & (n > 0), "warning": F.when(short, "texto_vacio_o_muy_corto")}


def suppressed_agency(texts: DataFrame, tokens: DataFrame, scale: Scale = SA_SCALE, text: str = "text") -> DataFrame:
    """y2 of each text (doc_id, text; one row each) with its parsed tokens: weights of instances in sentences of 5 tokens or more, and of lexical patterns in the whole text, by the number of these sentences.

    doc_id, score, score_raw, n_sentences, n_instances, n_questioned (0), a count for each mechanism, valid (more than 20 characters and a sentence), warning. Texts under 20 characters score 0; texts without tokens have no sentences and a raw score of 0.
    """
    out = _scored("_agency", scale, list(L.SA_WEIGHTS), text)
    return _parsed_texts(texts, tokens, True, False, text).select("doc_id", *(c.alias(k) for k, c in out.items()))


def denial(texts: DataFrame, tokens: DataFrame, scale: Scale = NV_SCALE, text: str = "text") -> DataFrame:
    """y4 of each text with its parsed tokens, columns as suppressed_agency: instances and phrases in sentences of 3 tokens or more (blank ones count), moral phrases in the whole text; instances of both kinds near a trigger keep a quarter."""
    out = _scored("_denial", scale, list(L.NV_WEIGHTS), text)
    return _parsed_texts(texts, tokens, False, True, text).select("doc_id", *(c.alias(k) for k, c in out.items()))


# -- civil lexicon ----------------------------------------------------------------


# Two classes, as a class that reaches beyond the first 65,536 characters is searched range by range.
_MARKS, _FAR_MARKS = (re.compile("[" + "".join(c for c in map(chr, r) if unicodedata.combining(c)) + "]+") for r in (range(0x10000), range(0x10000, sys.maxunicode + 1)))
_FAR = re.compile("[\U00010000-\U0010ffff]")


def plain(word: str) -> str:
    """Lower case without accents."""
    low = word.lower()
    if low.isascii():
        return low
    low = _MARKS.sub("", unicodedata.normalize("NFKD", low))
    return _FAR_MARKS.sub("", low) if _FAR.search(low) else low


def words_of(text: str) -> list[str]:
    """Words of more than two characters; what is no word character separates."""
    return re.findall(r"\w{3,}", text)


def _terms(words: list[str]) -> Counter:
    return Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])])


def lexicon_terms(lexicon: dict[str, list[str]] = L.CIVIL, repeats: int = L.CIVIL_REPEATS) -> dict[str, float]:
    """1 + ln(frequency) of each word and pair of words of the lexicon, read as one text `repeats` times."""
    words = words_of(plain(" ".join([w for own in lexicon.values() for w in own] * repeats)))
    return {t: 1 + math.log(n) for t, n in _terms(words).items()}


def lexicon_similarity(reference: dict[str, float]):
    """A column function: cosine of a text's and the reference's TF-IDF vectors over these two texts (terms in both weigh 1, others 1 + ln 1.5)."""
    rare = (1 + math.log(1.5)) ** 2
    whole = sum(x * x for x in reference.values())
    single, double = {t: y for t, y in reference.items() if " " not in t}, {tuple(t.split(" ")): y for t, y in reference.items() if " " in t}
    small_batches()

    def cosine(text: str | None) -> float:
        words = words_of(plain(text or ""))
        dot = own = shared = b = 0.0
        # Terms that are not the reference's count by their frequencies alone.
        for terms, known in ((Counter(words), single), (Counter(zip(words, words[1:])), double)):
            own += sum(k * (1 + math.log(n)) ** 2 for n, k in sorted(Counter(terms.values()).items()))
            for t, y in known.items():
                if t in terms:
                    x = 1 + math.log(terms[t])
                    shared, b, dot = shared + x * x, b + y * y, dot + x * y
        a = rare * (own - shared) + shared
        b += rare * (whole - b)
        return dot / math.sqrt(a * b) if a and b else 0.0

    @F.pandas_udf("double")
    def similarity(text: pd.Series) -> pd.Series:
        return text.map(cosine, na_action=None).astype(float)

    return similarity


def civil_words(text: Column) -> Column:
    """Lower-case words of more than two characters (accents kept)."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) > 2)


def civil_terms(text: Column, lexicon: dict[str, list[str]] = L.CIVIL) -> Column:
    """Struct: n_words, by_dimension (map: Jaccard of the text's word set and each lexicon, 4 places), top (the first ten words found, in order of appearance).

    The text is split once; beyond that only words of the lexicon are looked at.
    """
    sets = {k: list(dict.fromkeys(w.lower() for w in ws)) for k, ws in lexicon.items()}
    flat = list(dict.fromkeys(w for ws in lexicon.values() for w in ws))
    known = sorted({w for ws in sets.values() for w in ws} | set(flat))

    def told(x: Column) -> Column:
        def jaccard(ws: list[str]) -> Column:
            return bound(F.size(F.filter(x["found"], lambda w: w.isin(*ws))), lambda n: F.round(n / (x["own"] + len(ws) - n), 4))

        by = F.create_map(*(c for k, ws in sets.items() for c in (F.lit(k), jaccard(ws))))
        top = F.slice(F.filter(x["found"], lambda w: w.isin(*flat)), 1, 10)
        return F.struct(x["n"].alias("n_words"), by.alias("by_dimension"), top.alias("top"))

    counts = lambda ws: F.struct(F.size(ws).alias("n"), F.size(F.array_distinct(ws)).alias("own"), F.array_distinct(F.filter(ws, lambda w: w.isin(*known))).alias("found"))
    return bound(bound(civil_words(text), counts), told)


def civil_distance(df: DataFrame, text: str = "text", lexicon: dict[str, list[str]] = L.CIVIL, terms: bool = True) -> DataFrame:
    """Adds y3_civil_similarity_raw, y3_civil_distance, similarity_by_dimension (see civil_terms), top_civil_tokens and civil_warning. A text of fewer than 20 characters or 5 words has a warning instead: its similarity is 0. Without `terms`, similarity_by_dimension and top_civil_tokens are left out."""
    short = F.coalesce(F.length(F.trim(text)) < 20, F.lit(True))
    own = df.withColumn("_civil", civil_terms(F.col(text), lexicon) if terms else F.struct(F.size(civil_words(F.col(text))).alias("n_words")))
    warning = F.when(short, "texto_vacio_o_muy_corto").when(F.col("_civil.n_words") < 5, "texto_muy_corto")
    out = own.withColumn("civil_warning", warning).withColumn("y3_civil_similarity_raw", F.when(F.col("civil_warning").isNull(), lexicon_similarity(lexicon_terms(lexicon))(F.col(text))).otherwise(0.0))
    out = out.withColumn("y3_civil_distance", clamp(1 - F.col("y3_civil_similarity_raw")))
    if not terms:
        return out.drop("_civil")
    out = out.withColumn("similarity_by_dimension", F.when(F.col("civil_warning").isNull(), F.col("_civil.by_dimension")))
    return out.withColumn("top_civil_tokens", F.when(F.col("civil_warning").isNull(), F.col("_civil.top"))).drop("_civil")


def parsed_feature_rows(sections: DataFrame, tokens: DataFrame, most_chars: int | None = 8000, least_chars: int = 30) -> DataFrame:
    """feature_rows with y2 and y4 from tokens and patterns together. sections: doc_id, text, one row each; tokens: their parse.

    y1_ebi, y5_corpus_type, y6_period: the sections' columns of these names, where there are any (the first is 0 where it is not given, as no model is in the library).
    """
    own = tokens if most_chars is None else tokens.where(F.col("end") <= most_chars)
    df = _parsed_texts(_bodies(sections, "text", most_chars, least_chars).where(F.col("doc_id").isNotNull()), own, True, True, "_text")
    sa, nv = _scored("_agency", SA_SCALE, list(L.SA_WEIGHTS), "_text"), _scored("_denial", NV_SCALE, list(L.NV_WEIGHTS), "_text")
    df, extra = _featured(df)
    extra |= {"y2_sa": sa["score"], "n_sa_instances": sa["n_instances"], "y4_nv": nv["score"], "n_nv_instances": nv["n_instances"], "n_nv_questioned": nv["n_questioned"]}
    if "y1_ebi" not in sections.columns:
        extra["y1_ebi"] = F.lit(0.0)
    return df.select("doc_id", *(c for c in sections.columns if c not in ("doc_id", "text")), *(c.alias(n) for n, c in extra.items()))


def _bodies(sections: DataFrame, text: str, most_chars: int | None, least_chars: int) -> DataFrame:
    """Sections of so many characters or more with what is read of them, `_text`."""
    df = sections.withColumn("_text", F.trim(text)).where(F.length("_text") >= least_chars)
    return df if most_chars is None else df.withColumn("_text", F.substring("_text", 1, most_chars))


def _featured(df: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """Rows of _bodies with what feature rows need of `_text` beside y2 and y4; the columns made of it."""
    df = civil_distance(df.withColumn("_rep", rep_spans(F.col("_text"))), "_text", terms=False)
    df = df.withColumn("_rep", indicator(F.col("_rep"), F.col("_text"), REP_SCALE, list(L.REP_WEIGHTS)))
    extra = {"text_length_chars": F.length("_text"), "y3_civil": F.col("y3_civil_distance"), "y10_rep": F.col("_rep.score"), "n_rep_instances": F.col("_rep.n_instances")}
    return df, extra | {"has_warning": F.coalesce(F.col("civil_warning"), F.col("_rep.warning")).isNotNull()}


def feature_rows(sections: DataFrame, text: str = "text", corpus_type: str = "corpus_type", most_chars: int | None = 8000, least_chars: int = 30) -> DataFrame:
    """One row per section of `least_chars` characters or more: lengths, y2_sa and y4_nv (patterns alone; see parsed_feature_rows), y3_civil, y10_rep, counts, has_warning.

    `most_chars`: characters of a section that are read (the reference reads 8,000; None: all).
    """
    body = F.col("_text")
    df = _bodies(sections, text, most_chars, least_chars)
    df = df.withColumns({"_sa": sa_spans(body), "_nv": nv_spans(body)})
    df = df.withColumns({"_sa": indicator(F.col("_sa"), body, SA_SCALE, ["patron_lexical"], 5), "_nv": indicator(F.col("_nv"), body, NV_SCALE, list(L.NV_WEIGHTS))})
    df, own = _featured(df)
    own |= {"y2_sa": F.col("_sa.score"), "y4_nv": F.col("_nv.score"), "n_sa_instances": F.col("_sa.n_instances"), "n_nv_instances": F.col("_nv.n_instances"), "n_nv_questioned": F.col("_nv.n_questioned")}
    names = ("text_length_chars", "y2_sa", "y3_civil", "y4_nv", "y10_rep", "n_sa_instances", "n_nv_instances", "n_rep_instances", "n_nv_questioned", "has_warning")
    return df.select(*(c for c in sections.columns if c != text), *(own[n].alias(n) for n in names))
