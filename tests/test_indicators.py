"""Indicators, court records, sections and statistics against brute force and given values."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lexforum.functions import courts as C
from lexforum.functions import lexicons as L
from lexforum.functions import stats
from lexforum.operators import indicators as I
from lexforum.operators import indices, records
from lexforum.operators import relational as R
from lexforum.plans import indicators as plans

WORDS = "fusil portaba un de la baja presunto guerrillero no era civil inocente fue reportado por se presentó víctimas reconozco mi responsabilidad en madre hijo casa. Era, joven".split()


def texts(n=60, seed=1):
    r = random.Random(seed)
    return [" ".join(r.choice(WORDS + plans.SENTENCES) for _ in range(r.randint(0, 30))) for _ in range(n)] + ["", None, "corto", "é" * 40]


def docs(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(2)


def brute(text, rules, doubts=(), apart=False):
    found = []
    for name, weight, patterns in rules:
        for p in patterns:
            for m in re.finditer(p, text, re.I):
                doubted = any(re.search(q, text[max(0, m.start() - 150) : m.end() + 150], re.I) for q in doubts)
                found.append((name, weight * (0.25 if doubted else 1), m.start(), m.end(), doubted))
    if apart:
        kept = []
        for s in sorted(found, key=lambda x: -x[1]):
            if not any(min(s[3], k[3]) - max(s[2], k[2]) > 0.5 * (s[3] - s[2]) for k in kept):
                kept.append(s)
        found = kept
    return found


def brute_score(text, found, high, least):
    if text is None or len(text.strip(" ")) < 20:
        return 0.0, 0.0, 0
    n = sum(len(s.split()) >= least for s in re.split(r"(?<=[.!?])\s+", text))
    raw = sum(s[1] for s in found) / n if n else 0.0
    return min(raw / high, 1.0), raw, n


@pytest.mark.parametrize("kind", ["nv", "rep", "sa"])
def test_mechanisms_by_brute_force(spark, kind):
    rows = texts()
    spans, rules, doubts, scale, names, least = {
        "nv": (I.nv_spans, I.NV, L.NV_QUESTIONED, I.NV_SCALE, list(L.NV_WEIGHTS), 3),
        "rep": (I.rep_spans, I.REP, (), I.REP_SCALE, list(L.REP_WEIGHTS), 3),
        "sa": (I.sa_spans, I.SA, (), I.SA_SCALE, ["patron_lexical"], 5),
    }[kind]
    out = docs(spark, rows).withColumn("spans", spans(F.col("text")))
    out = {r.doc_id: r for r in out.select("doc_id", "spans", I.indicator(F.col("spans"), F.col("text"), scale, names, least).alias("i")).collect()}
    some = 0
    for i, text in enumerate(rows):
        want = brute(text or "", [(m.name, m.weight, m.patterns) for m in rules], doubts, kind == "rep")
        assert sorted((s.mechanism, round(s.weight, 9), s.start, s.end, s.questioned) for s in out[i].spans) == sorted((a, round(b, 9), c, d, e) for a, b, c, d, e in want)
        score, raw, n = brute_score(text, want, scale.high, least)
        assert (out[i].i.score, out[i].i.score_raw, out[i].i.n_sentences) == (pytest.approx(score), pytest.approx(raw), n)
        assert (out[i].i.warning is None) == (text is not None and len(text.strip(" ")) >= 20)
        some += len(want)
    assert some > 50


def test_many_spans_are_separated_in_time():
    spans = [{"start": i, "end": i + 30, "weight": 1.0 + (i % 7)} for i in range(0, 60_000, 3)]
    kept = I.separated(spans)
    assert all(k["weight"] > 0 for k in kept) and 1000 < len(kept) < len(spans)


def test_scales_fit_and_round_trip(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "x double")
    scale = I.Scale.fit(df, "x")
    assert (scale.low, scale.high, scale.mean) == (5.0, 95.0, 50.0) and scale.std == pytest.approx(29.1547, abs=1e-3)
    assert I.Scale.from_json(scale.to_json()) == scale
    got = [r[0] for r in spark.createDataFrame([(0.0,), (50.0,), (200.0,)], "x double").select(scale(F.col("x"))).collect()]
    assert got == [0.0, 0.5, 1.0]
    z = I.Scale("zscore", mean=1.0, std=2.0)
    assert spark.range(1).select(z(F.lit(3.0))).first()[0] == pytest.approx(4 / 6)
    assert spark.range(1).select(I.Scale("percentile", 1.0, 1.0)(F.lit(9.0))).first()[0] == 0.5
    assert spark.range(1).select(I.Scale("passthrough")(F.lit(1.7))).first()[0] == 1.0
    assert I.Scale.fit(df.where("x < 0"), "x") == I.Scale("percentile")


def parsed(spark, *sentences):
    """Rows of (token, lemma, pos, dep, head, ent) for each sentence; heads count within it."""
    rows, at, i = [], 0, 0
    for s, sentence in enumerate(sentences):
        base = i
        for token, lemma, pos, dep, head, *ent in sentence:
            rows.append((1, s, i, at, at + len(token), token, lemma, pos, dep, base + head, ent[0] if ent else ""))
            at, i = at + len(token) + 1, i + 1
    return spark.createDataFrame(rows, "doc_id int, sent int, i int, start int, end int, token string, lemma string, pos string, dep string, head int, ent string")


def test_agency_over_parsed_tokens(spark):
    passive = [("cuerpo", "cuerpo", "NOUN", "nsubjpass", 2), ("fue", "ser", "AUX", "aux", 2), ("reportado", "reportar", "VERB", "ROOT", 2), ("ayer", "ayer", "ADV", "advmod", 2)]
    agent = [*passive[:3], ("por", "por", "ADP", "case", 4), ("Juan", "Juan", "PROPN", "obl", 2)]
    se = [("Se", "él", "PRON", "expl", 1), ("realizó", "realizar", "VERB", "ROOT", 1), ("la", "el", "DET", "det", 3), ("operación", "operación", "NOUN", "nsubj", 1)]
    named = [("Se", "él", "PRON", "expl", 1), ("fue", "ir", "VERB", "ROOT", 1), ("Juan", "Juan", "PROPN", "nsubj", 1, "PER"), ("comandante", "comandante", "NOUN", "appos", 2)]
    unit = [("batallón", "batallón", "NOUN", "nsubj", 1), ("reportó", "reportar", "VERB", "ROOT", 1), ("captura", "captura", "NOUN", "obj", 1), ("Pérez", "Pérez", "PROPN", "nmod", 2, "PER")]
    tokens = parsed(spark, passive, agent, se, named, unit)
    got = {(r.sent, r.mechanism): round(r.weight, 4) for r in I.token_instances(tokens, I.SA_TOKENS).collect()}
    assert got == {(0, "pasiva_sin_agente"): 1.3, (2, "se_impersonal"): 0.85, (2, "nominalizacion"): 0.78, (4, "sujeto_institucional"): 0.5}
    assert I.long_sentences(tokens).select("sent").distinct().count() == 1


def test_denial_over_parsed_tokens(spark):
    plain = [("guerrillero", "guerrillero", "NOUN", "nsubj", 1), ("portaba", "portar", "VERB", "ROOT", 1), ("fusil", "fusil", "NOUN", "obj", 1)]
    negated = [("no", "no", "ADV", "neg", 1), ("era", "ser", "AUX", "ROOT", 1), ("guerrillero", "guerrillero", "NOUN", "attr", 1)]
    held = [("con", "con", "ADP", "case", 2), ("arma", "arma", "NOUN", "obl", 2), ("llegó", "llegar", "VERB", "ROOT", 2), ("sujeto", "sujeto", "NOUN", "nsubj", 2), ("cadáver", "cadáver", "NOUN", "nmod", 3)]
    got = sorted((r.sent, r.mechanism, round(r.weight, 3)) for r in I.token_instances(parsed(spark, plain, negated, held), I.NV_TOKENS).collect())
    # "portaba" is the head, not a sibling, of "fusil"; "con" and "arma" share their head.
    assert got == [(0, "recategorizacion_combatiente", 1.0), (2, "atribucion_armamento", 0.63), (2, "deshumanizacion", 0.7)]


def test_lexicon_distance(spark):
    out = {r.doc_id: r for r in I.civil_distance(docs(spark, ["mi hijo era carpintero y vivía en la casa del barrio", "la tropa reportó una baja en combate contra bandidos", "hijo casa", None, " ".join(w for own in L.CIVIL.values() for w in own)])).collect()}
    assert out[0].y3_civil_distance < out[1].y3_civil_distance == 1.0
    assert out[0].top_civil_tokens == ["hijo", "carpintero", "casa", "barrio"]
    assert out[2].civil_warning == out[3].civil_warning == "texto_vacio_o_muy_corto" and out[3].y3_civil_distance == 1.0
    assert out[4].y3_civil_distance < 0.05 and out[0].similarity_by_dimension["identidad"] > 0


def test_feature_rows(spark):
    rows = [plans.SENTENCES[0] * 3, "x", "y" * 9000]
    out = {r.doc_id: r for r in I.feature_rows(docs(spark, rows)).collect()}
    assert sorted(out) == [0, 2]
    assert out[2].text_length_chars == 8000 and out[0].n_nv_instances == 6 and out[0].n_sa_instances == 3
    assert {r.doc_id: r for r in I.feature_rows(docs(spark, rows), most_chars=None).collect()}[2].text_length_chars == 9000


@pytest.mark.parametrize(
    ("k", "tribunal", "number", "date", "region", "kind", "parties", "confidence"),
    [
        (0, "Corte Suprema · Sala Penal", "SP1234-2015", "2008-03-15", "Bogotá", "sentencia", {"procesado": "Juan Carlos Pérez", "fiscal": "María López"}, 1.0),
        (1, "Consejo de Estado · Sección Tercera", "05001-23-31-000-2005-01234-01(40112)", "2013-05-03", "Medellín", "auto", None, 0.9),
        (2, "Tribunal Administrativo · SUCRE", "2005-00123-01", "2007-07-20", "Sucre", "providencia", {"defensor": "Luis Gómez Ruiz"}, 1.0),
        (3, "JEP", "019-2021", "2021-02-11", "Norte de santander", "auto", None, 0.9),
        (4, "Juzgado 3 · Soacha", "2007-0015", "2009-08-30", "Soacha", "fallo", {"procesado": "Teniente Pedro Ramírez Soto"}, 1.0),
        (5, "Tribunal Superior · Montería", "23001", "1998-06-12", "Montería", "resolucion", None, 0.9),
        (6, "Fiscalía General de la Nación", "110016000253", None, None, "audiencia", None, 0.65),
        (7, None, None, None, None, None, None, 0.0),
    ],
)
def test_metadata_of_heads(spark, k, tribunal, number, date, region, kind, parties, confidence):
    df = spark.createDataFrame([(plans.HEADS[k],)], "clean_text string")
    r = records.metadata(df).first()
    assert (r.tribunal, r.case_number, r.date_issued, r.region, r.doc_type) == (tribunal, number, date, region, kind)
    assert r.parties == (parties or {}) and r.extraction_confidence == pytest.approx(confidence)
    assert ("date_not_found" in r.extraction_warnings) == (date is None)


def test_metadata_fallbacks_and_nulls(spark):
    df = spark.createDataFrame([("nada", "SP123-2019_fallo.pdf"), ("nada", "proceso (4512).pdf"), ("nada", "x 110016000253200680526.txt"), (None, None)], "clean_text string, f string")
    out = records.metadata(df, file_name="f").collect()
    assert [r.case_number for r in out] == ["SP123-2019", "4512", "110016000253200680526", None]
    assert "case_number_from_filename" in out[0].extraction_warnings and out[3].extraction_confidence == 0 and out[3].doc_sha is None


def brute_sections(text, corpus, least=20):
    found = []
    for label, patterns, target in C.SECTIONS[corpus]:
        for p in patterns:
            for m in re.finditer(p, text, re.I | re.M):
                if not any(x[1] == label and abs(x[0] - m.start()) < 200 for x in found):
                    found.append((m.start(), label, target))
    marks = []
    for f in sorted(found, key=lambda x: x[0]):
        if marks and f[0] - marks[-1][0] < 50:
            marks[-1] = f
        else:
            marks.append(f)
    if not marks:
        return [("CUERPO", 0, len(text))]
    if marks[0][0] > 100:
        marks.insert(0, (0, "ENCABEZADO", False))
    out = []
    for i, (at, label, _) in enumerate(marks):
        end = marks[i + 1][0] if i + 1 < len(marks) else len(text)
        if len(text[at:end].split()) < least and i < len(marks) - 1:
            if out:
                out[-1] = (*out[-1][:2], end)
            continue
        out.append((label, at, end))
    return out


@pytest.mark.parametrize("corpus", ["A", "B", "C"])
def test_sections_by_brute_force(spark, corpus):
    r = random.Random(ord(corpus))
    heads = ["\nHECHOS PROBADOS:\n", "\nRESUELVE\n", "\nII. ANTECEDENTES\n", "\nCONSIDERACIONES\n", "\nHECHOS Y CONDUCTAS\n", "\nCOMPARECIENTE: ", "\nCIERRE DE LA AUDIENCIA\n", "\nVÍCTIMA: ", "JEP, ", "\nI. ASUNTO\n"]
    rows = ["".join(r.choice([*heads, "palabra " * r.randint(1, 40)]) for _ in range(r.randint(0, 14))) for _ in range(80)] + [""]
    out = {}
    for x in records.section_rows(docs(spark, rows), corpus).collect():
        out.setdefault(x.doc_id, []).append((x.section_index, x.section_id, x.char_start, x.char_end, x.text))
    for i, text in enumerate(rows):
        assert [s[1:4] for s in sorted(out[i])] == brute_sections(text, corpus)
        assert all(s[4] == text[s[2] : s[3]].strip() for s in out[i]) or out[i][0][1] == "CUERPO"
    assert records.section_rows(docs(spark, [None]), corpus).count() == 0


def test_corrections_by_brute_force(spark):
    rows = ["Senten|ia de la Fiscalia, sent0ncia cap1tulo carrnen rn vvisto", "par-\ntido || liama I" + "glesia", "jep Numeral Art|culo habeas  corpus", ""]
    out = {r.doc_id: r for r in docs(spark, rows).withColumn("f", records.corrected(F.col("text"))[0]).withColumn("n", records.corrected(F.col("text"))[1]).collect()}
    for i, text in enumerate(rows):
        n = 0
        for p, to in C.SCAN_CORRECTIONS:
            text, k = re.subn(p, to.replace("$", "\\"), text, flags=re.I)
            n += k
        assert (out[i].f, out[i].n) == (text, n)


def test_published_composites(spark):
    """Five hearings' means, and the indices published for them."""
    rows = [
        ("casanare", 0.9737941666666666, 0.4829166666666667, 0.11813, 0.19294688009446664, 0.2639126811296709, 0.8080861570267859, 0.516825384301466, 0.2912607727253199),
        ("catatumbo", 0.5320137931034483, 0.22012758620689657, 0.12087241379310346, 0.20681135613342808, 0.27071125445694755, 0.1102499047306301, 0.6240844483702976, 0.5138345436396675),
        ("dabeiba", 0.7713433333333334, 0.21057583333333335, 0.06608083333333334, 0.18935702534185514, 0.2619457286265161, 0.489608556430958, 0.2991430000855252, 0.19046555634543283),
        ("huila", 0.7943541666666667, 0.22629083333333336, 0.14744416666666668, 0.1861843386692787, 0.2631516091859163, 0.22803506684501468, 0.08101559801982107, 0.14701946882519362),
        ("costa_caribe", 0.7989241666666668, 0.3730191666666667, 0.13562166666666667, 0.18928259285166857, 0.2593783247284591, 0.4638156983342617, 0.23074997372517142, 0.23306572460909025),
    ]
    df = spark.createDataFrame([r[:6] for r in rows], "k string, sa double, nv double, rep double, y8 double, y9 double")
    out = {r.k: r for r in indices.composite(df, "k").collect()}
    for k, *_, dis, iei, gap in rows:
        assert (out[k].dis, out[k].iei, out[k].dissociation) == (pytest.approx(dis, abs=1e-4), pytest.approx(iei, abs=1e-4), pytest.approx(gap, abs=1e-4))


def test_prosody_terms(spark):
    at = lambda *x: spark.range(1).select(indices.prosody_score(*(F.lit(v).cast("double") for v in x))).first()[0]
    assert at(1, 2, 0.5, 25) == pytest.approx(0.4) and at(0, 0, 0, 20) == 0.0 and at(None, None, None, None) == 0.0 and at(-1, 0, -1, 10) == 0.5


def test_student_tail_and_spearman(spark):
    t = lambda a, b: spark.range(1).select(stats.student_tail(F.lit(float(a)), F.lit(float(b)))).first()[0]
    # Points of the law's tables.
    for x, free, p in ((12.706, 1, 0.05), (2.776, 4, 0.05), (2.228, 10, 0.05), (3.169, 10, 0.01), (1.96, 1e6, 0.05), (0, 5, 1.0)):
        assert t(x, free) == pytest.approx(p, rel=1e-3)
    r = random.Random(4)
    rows = [(i % 2, r.randint(0, 20), r.randint(0, 20)) for i in range(200)]
    out = {x.g: x for x in stats.spearman(spark.createDataFrame(rows, "g int, a int, b int"), "a", "b", "g").collect()}
    for g in (0, 1):
        own = [x for x in rows if x[0] == g]
        rank = lambda v: [sum(y < x for y in v) + (sum(y == x for y in v) + 1) / 2 for x in v]
        x, y = rank([o[1] for o in own]), rank([o[2] for o in own])
        mx, my = sum(x) / len(x), sum(y) / len(y)
        rho = sum((a - mx) * (b - my) for a, b in zip(x, y)) / math.sqrt(sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y))
        assert out[g].rho == pytest.approx(rho) and out[g].p == pytest.approx(t(rho * math.sqrt((len(x) - 2) / (1 - rho * rho)), len(x) - 2))


def test_running_totals_over_ranges(spark):
    r = random.Random(6)
    values = {g: r.sample(range(10_000), 400 if g == "a" else 5) for g in "abc"}
    df = spark.createDataFrame([(g, v, v % 7) for g, vs in values.items() for v in vs], "g string, v int, n int").repartition(4)
    for x in stats.running_totals(df, ["g"], "v", ["n"]).collect():
        assert x.upto_n == sum(v % 7 for v in values[x.g] if v <= x.v)


def test_representative_fragment(spark):
    rows = ["a" * 100, "b" * 300, "c" * 500 + ". " + "d" * 600, "e. " + "f" * 900, None]
    out = {r.doc_id: r.f for r in docs(spark, rows).select("doc_id", R.representative(F.col("text")).alias("f")).collect()}
    assert out == {0: None, 1: "b" * 300, 2: "c" * 500 + ".", 3: ("e. " + "f" * 900)[:800], 4: None}


def test_stems_stand_in_every_match():
    from lexforum.functions.patterns import Finder, folded, stem

    assert stem(r"\bme\s+declaro\s+responsable") == "responsable" and stem(r"\b(?:abc|xyz)") == "" and stem(r"a(?:bcd)?e") in ("a", "e")
    assert stem(r"(?:^|\n)(?:[IVXLC]+\.?\s+)?HECHOS?(?:\s*:|\s*\n)") == "hecho"
    r = random.Random(8)
    every = [p for ps in (L.NV_COMBATANT, L.NV_WEAPONS, L.NV_MORAL, L.REP_ACKNOWLEDGED, L.REP_IDENTITY, L.REP_NAMED, L.REP_LAW, L.REP_REPAIR, L.SA_LEXICAL) for p in ps]
    pool = [*plans.SENTENCES, "PRE\u017fUNTO GUERRİLLERO", "RECONOZCO MI RESPONSABİLIDAD POR", "SANCIÓN PROPIA", "ACCIÓN", "\u212Ait del falso positivo", "peRDón a Juan"]
    for _ in range(200):
        text = " ".join(r.choice(pool) for _ in range(3))
        text = text.upper() if r.random() < 0.3 else text
        for p in every:
            assert [m.span() for m in Finder(p).finditer(text, folded(text))] == [m.span() for m in re.finditer(p, text, re.I)]
