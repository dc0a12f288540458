"""Indicators from tokens and patterns together, against a plain reading of their rules over each text."""

import random
import re

import pytest

from lexforum.functions import lexicons as L
from lexforum.operators import indicators as I

VOCABULARY = [
    ("fue", "ser", "AUX"), ("reportado", "reportar", "VERB"), ("por", "por", "ADP"), ("se", "él", "PRON"), ("realizó", "realizar", "VERB"), ("operación", "operación", "NOUN"),
    ("batallón", "batallón", "NOUN"), ("guerrillero", "guerrillero", "NOUN"), ("fusil", "fusil", "NOUN"), ("con", "con", "ADP"), ("sujeto", "sujeto", "NOUN"), ("cuerpo", "cuerpo", "NOUN"),
    ("comandante", "comandante", "NOUN"), ("enfrentamiento", "enfrentamiento", "NOUN"), ("presunto", "presunto", "ADJ"), ("falsamente", "falsamente", "ADV"), ("presentado", "presentar", "VERB"),
    ("sin", "sin", "ADP"), ("oficio", "oficio", "NOUN"), ("conocido", "conocer", "ADJ"), ("portaba", "portar", "VERB"), ("un", "uno", "DET"), ("grupo", "grupo", "NOUN"), ("armado", "armado", "ADJ"), ("hallado", "hallar", "VERB"),
]
DEPS = ["nsubjpass", "nsubj", "obj", "expl", "neg", "agent", "nmod", "prep", "det", "dobj", "amod", "root"]
TOKEN = "doc_id long, sent int, i int, start long, end long, token string, lemma string, pos string, dep string, head int, ent string"


def made(seed, docs):
    rng = random.Random(seed)
    texts, tokens = [], []
    for d in range(docs):
        text, i = "", 0
        for s in range(rng.randint(1, 30)):
            n = rng.randint(1, 12)
            first = i
            for _ in range(n):
                word, lemma, pos = rng.choice(VOCABULARY)
                filler = "x" * rng.choice([0, 0, 0, 0, 40, 139])  # so that triggers stand at the edges of windows, and words are cut there
                if filler and rng.random() < 0.5:
                    text += filler
                    tokens.append((d, s, i, len(text) - len(filler), len(text), filler, filler, "X", "x", first, ""))
                    i += 1
                    text += " " if rng.random() < 0.8 else ""
                tokens.append((d, s, i, len(text), len(text) + len(word), word, lemma, pos, rng.choice(DEPS), first + rng.randrange(n), rng.choice(["", "", "PER", "ORG"])))
                text += word + " "
                i += 1
        texts.append((d, text))
    return texts + [(docs, None), (docs + 1, "corto"), (docs + 2, "sin oficio conocido y nada analizado")], tokens


def sentences(tokens, d):
    out = {}
    for t in tokens:
        if t[0] == d:
            out.setdefault(t[1], []).append(dict(zip([x.split()[0] for x in TOKEN.split(", ")], t, strict=True)))
    return out.values()


def children(sent, t):
    return [c for c in sent if c["head"] == t["i"] and c is not t]


def head(sent, t):
    return next((h for h in sent if h["i"] == t["head"]), None)


def plain_agency(text, sents):
    total, n, by = 0.0, 0, {}

    def add(m, w):
        nonlocal total
        total, by[m] = total + w, by.get(m, 0) + 1

    for sent in sents:
        if sum(t["token"].strip() != "" for t in sent) < 5:
            continue
        n += 1
        for t in sent:
            h, w = head(sent, t), t["token"].lower()
            if t["dep"] == "nsubjpass":
                agent = any(c["dep"] == "agent" or (c["token"].lower() in ("por", "mediante") and c["dep"] == "prep") for c in children(sent, h))
                if not agent and not any(c["token"].lower() == "por" and h["i"] < c["i"] <= h["i"] + 5 for c in sent):
                    add("pasiva_sin_agente", 1.3 if h["lemma"] in L.SA_REPORT_VERBS else 1.0)
            if w == "se" and t["dep"] in ("expl", "expl:pv", "nsubj", "obj", "iobj") and not any(c["dep"] == "nsubj" and c["ent"] in ("PER", "ORG") for c in children(sent, h)):
                add("se_impersonal", 0.85 if h["lemma"] in L.SA_ACTION_VERBS else 0.425)
            listed = t["lemma"] in L.SA_TRIGGERS or w in L.SA_TRIGGERS or any(w.endswith(s) and len(w) > len(s) + 3 for s in L.SA_SUFFIXES)
            if t["pos"] == "NOUN" and listed and w not in L.SA_NO_ACTION and t["lemma"] not in L.SA_NO_ACTION and not any(c["dep"] in ("nmod", "nmod:poss") and c["ent"] in ("PER", "ORG") for c in children(sent, t)):
                add("nominalizacion", 0.78 if t["dep"] in ("nsubj", "nsubjpass") else 0.65)
            whole = t["lemma"] in L.SA_INSTITUTIONS or w in L.SA_INSTITUTIONS or any(c["dep"] in ("det", "amod") and c["lemma"] in L.SA_INSTITUTIONS for c in children(sent, t))
            if t["dep"] in ("nsubj", "nsubjpass") and whole and h["pos"] == "VERB" and h["lemma"] in L.SA_INSTITUTION_VERBS:
                add("sujeto_institucional", 0.5)
    for p in L.SA_LEXICAL:
        for _ in re.finditer(p, text, re.I):
            add("patron_lexical", 0.75)
    return total / n if n else 0.0, n, by, 0


def plain_denial(text, sents):
    total, n, by, doubts = 0.0, 0, {}, 0

    def add(m, w, a, b):
        nonlocal total, doubts
        near = text[max(0, a - 150) : b + 150]
        doubted = any(re.search(p, near, re.I) for p in L.NV_QUESTIONED)
        total, by[m], doubts = total + w * (0.25 if doubted else 1.0), by.get(m, 0) + 1, doubts + doubted

    for sent in sents:
        if len(sent) < 3:
            continue
        n += 1
        start, end = min(t["start"] for t in sent), max(t["end"] for t in sent)
        for m, patterns, w in (("recategorizacion_combatiente", L.NV_COMBATANT, 1.0), ("atribucion_armamento", L.NV_WEAPONS, 0.9)):
            for p in patterns:
                for x in re.finditer(p, text[start:end], re.I):
                    add(m, w, start + x.start(), start + x.end())
        for t in sent:
            h = head(sent, t)
            negated = any(c["dep"] == "neg" for c in [*children(sent, t), *children(sent, h)])
            if t["lemma"] in L.NV_COMBATANT_LEMMAS and t["pos"] != "VERB" and not negated:
                add("recategorizacion_combatiente", 1.0, t["start"], t["end"])
            if t["lemma"] in L.NV_WEAPON_LEMMAS and t["pos"] in ("NOUN", "PROPN") and any((c["lemma"] in L.NV_POSSESSION_LEMMAS or c["token"] in L.NV_POSSESSION_WORDS) for c in children(sent, h) if c is not t):
                add("atribucion_armamento", 0.63, t["start"], t["end"])
            direct = t["lemma"] in L.NV_DIRECT_LEMMAS
            if t["pos"] in ("NOUN", "PRON", "PROPN") and (direct or (t["lemma"] in L.NV_CONTEXT_LEMMAS and t["dep"] in ("nsubj", "nsubjpass", "obj", "dobj"))) and not negated:
                add("deshumanizacion", 0.7, t["start"], t["end"])
    for p in L.NV_MORAL:
        for x in re.finditer(p, text, re.I):
            add("descalificacion_moral", 0.65, x.start(), x.end())
    return total / n if n else 0.0, n, by, doubts


@pytest.mark.parametrize("name", ["suppressed_agency", "denial"])
def test_scores_follow_the_rules(spark, name):
    texts, tokens = made(3, 60)
    got = {r.doc_id: r for r in getattr(I, name)(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(tokens, TOKEN)).collect()}
    plain, top, mechanisms = (plain_agency, 0.5, L.SA_WEIGHTS) if name == "suppressed_agency" else (plain_denial, 0.6, L.NV_WEIGHTS)
    seen, doubted = set(), 0
    for d, text in texts:
        r = got[d]
        if len((text or "").strip()) < 20:
            assert (r.score, r.score_raw, r.n_sentences, r.n_instances, r.valid, r.warning) == (0, 0, 0, 0, False, "texto_vacio_o_muy_corto")
            continue
        raw, n, by, doubts = plain(text, sentences(tokens, d))
        assert (r.n_sentences, r.n_questioned, {m: r[f"n_{m}"] for m in mechanisms}) == (n, doubts, {m: by.get(m, 0) for m in mechanisms}), d
        assert r.score_raw == pytest.approx(raw) and r.score == pytest.approx(min(raw / top, 1.0)) and r.n_instances == sum(by.values()) and r.warning is None
        assert r.valid == (len(text) > 20 and n > 0)
        seen |= set(by)
        doubted += doubts
    assert seen == set(mechanisms) and (name == "suppressed_agency" or doubted > 10)


def test_feature_rows_take_both(spark):
    texts, tokens = made(4, 12)
    sections = spark.createDataFrame([(d, t, "A", 1.0) for d, t in texts], "doc_id long, text string, corpus_type string, y6_period double")
    parsed = spark.createDataFrame(tokens, TOKEN)
    rows = {r.doc_id: r for r in I.parsed_feature_rows(sections, parsed, most_chars=None).collect()}
    sa = {r.doc_id: r.score for r in I.suppressed_agency(sections, parsed).collect()}
    assert set(rows) == {d for d, t in texts if len((t or "").strip()) >= 30}
    assert all(rows[d].y2_sa == pytest.approx(sa[d]) and rows[d].y1_ebi == 0 and rows[d].y6_period == 1 for d in rows)
