"""Testimony: grammatical person, hedging, emotions, verbal and facial scores, hearings; kinds and corpora of files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforum.functions import lexicons as L
from lexforum.functions import text as T
from lexforum.operators import indices


def hits(low: Column, terms: Sequence[str]) -> Column:
    """Occurrences of all terms in a lower-case text, each counted by itself."""
    total: Column = F.lit(0)
    for term in terms:
        total = total + T.occurrences(low, term)
    return total


def _words(text: Column) -> Column:
    return F.greatest(T.word_count(text), F.lit(1))


def grammatical_person(text: Column) -> Column:
    """Struct: primera_persona_ratio, sa_ratio (to words) and accountability_score, 4 places."""
    return T.bound(F.lower(text), lambda low: T.bound(_words(text), lambda n: T.bound(F.struct((hits(low, L.FIRST_PERSON) / n).alias("p"), (hits(low, L.IMPERSONAL) / n).alias("s")), _person)))


def _person(x: Column) -> Column:
    p, s = x["p"], x["s"]
    return F.struct(F.round(p, 4).alias("primera_persona_ratio"), F.round(s, 4).alias("sa_ratio"), F.round(p / (p + s + 0.001), 4).alias("accountability_score"))


def hedging(text: Column, markers: Mapping[str, float] = L.HEDGES, most: int = 10) -> Column:
    """Struct: hedging_count, hedging_density (of 100 words), hedging_weight, marcadores (the first ones found, in the lexicon's order, with their counts)."""
    n = _words(text)
    # Bound by lambdas, the lower-case text is made once, and the markers are counted once for all four results.
    counted = lambda low: F.filter(F.array(*(F.struct(F.lit(k).alias("k"), T.occurrences(low, k).alias("n"), F.lit(float(w)).alias("w")) for k, w in markers.items())), lambda x: x["n"] > 0)

    def told(own: Column) -> Column:
        count = F.aggregate(own, F.lit(0), lambda a, x: a + x["n"])
        weight = F.aggregate(own, F.lit(0.0), lambda a, x: a + x["n"] * x["w"])
        names = F.array_join(F.transform(F.slice(own, 1, most), lambda x: F.concat(x["k"], F.lit("("), x["n"].cast("string"), F.lit(")"))), ", ")
        return F.struct(count.alias("hedging_count"), F.round(count / n * 100, 4).alias("hedging_density"), F.round(weight, 4).alias("hedging_weight"), names.alias("marcadores"))

    return F.element_at(F.transform(F.transform(F.array(F.lower(text)), counted), told), 1)


def emotions(text: Column, lexicon: Mapping[str, Sequence[str]] = L.EMOTIONS) -> Column:
    """Struct: occurrences of each dimension's terms in 100 words, 4 places, and balance_victimas: that of victims to it and institutional violence."""
    own = lambda low: T.bound(_words(text), lambda n: F.struct(*(F.round(hits(low, terms) / n * 100, 4).alias(k) for k, terms in lexicon.items())))
    return T.bound(T.bound(F.lower(text), own), lambda x: _balance(x, lexicon))


def _balance(own: Column, lexicon: Mapping[str, Sequence[str]]) -> Column:
    victims, violence = own["reconocimiento_victimas"], own["violencia_institucional"]
    return F.struct(*(own[k].alias(k) for k in lexicon), F.round(victims / (victims + violence + 0.001), 4).alias("balance_victimas"))


def verbal_score(text: Column, terms: Sequence[str] = L.VERBAL) -> Column:
    return F.least(T.bound(F.lower(text), lambda low: hits(low, terms)) / _words(text) * 10, F.lit(1.0))


def layer_one(sections: DataFrame, text: str = "text", least: int = 100) -> DataFrame:
    """The three text features of every section of `least` characters or more, beside its other columns."""
    own = [c for c in sections.columns if c != text]
    kept = sections.where(F.length(F.trim(text)) >= least)
    return kept.select(*own, grammatical_person(F.col(text)).alias("p"), hedging(F.col(text)).alias("h"), emotions(F.col(text)).alias("e")).select(*own, "p.*", "h.*", "e.*")


def facial_score(au01: Column, au04: Column, au15: Column, au17: Column, au06: Column, au12: Column, pose_rx: Column) -> Column:
    """Mean of distress (AU 1, 4) and sadness (AU 15, 17), less 0.3 for a smile without the eyes, plus 0.2 as a third term for a lowered head; within 0 .. 1, and 0.5 without any value."""
    units = (au01, au04, au15, au17, au06, au12, pose_rx)
    a, b, c, d, e, f, rx = (F.coalesce(u.cast("double"), F.lit(0.0)) for u in units)
    total = F.least((a + b) / 4, F.lit(1.0)) + F.least((c + d) / 4, F.lit(1.0)) - F.when((f > 1.0) & (e < 0.5), 0.3).otherwise(0.0) + F.when(rx < -0.1, 0.2).otherwise(0.0)
    score = F.greatest(F.lit(0.0), F.least(total / F.when(rx < -0.1, 3).otherwise(2), F.lit(1.0)))
    return F.when(F.coalesce(*units).isNull(), 0.5).otherwise(score)


def hearing_summary(segments: DataFrame, hearing: str = "hearing", speaker: str = "speaker", least_seconds: float = 5.0, top: int = 5) -> DataFrame:
    """Of each hearing's main speaker (most talk time; ties: the last by name): segments of 5 seconds or more, mean index, share of each class, the best five.

    segments: hearing, speaker, start, end, text, prosody, facial.
    """
    seconds = F.col("end") - F.col("start")
    talk = segments.groupBy(hearing, speaker).agg(F.sum(seconds).alias("t")).groupBy(hearing).agg(F.max_by(speaker, F.struct("t", speaker)).alias(speaker))
    own = segments.join(talk, [hearing, speaker]).where(seconds >= least_seconds)
    icm = own.withColumn("verbal", verbal_score(F.col("text"))).withColumn("icm", indices.congruence(F.col("verbal"), F.col("prosody"), F.col("facial"))).withColumn("klass", indices.congruence_class(F.col("icm")))
    order = F.struct((-F.col("icm")).alias("m"), "start", "icm")
    share = lambda k: F.round(F.avg((F.col("klass") == k).cast("double")), 4).alias(k.lower())
    out = icm.groupBy(hearing, speaker).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("icm"), 4).alias("icm"), *map(share, ("GENUINE", "AMBIGUOUS", "PERFORMATIVE")), F.min_by("start", order).alias("best_start"), F.slice(F.array_sort(F.collect_list(order)), 1, top).alias("best"))
    return out.withColumn("best", F.transform("best", lambda x: x["start"]))


# -- files ----------------------------------------------------------------------


def file_kind(path: Column) -> Column:
    """Kind by extension; `otro` for others."""
    kinds = F.create_map(*(F.lit(x) for k, v in L.FILE_KINDS.items() for x in (k, v)))
    return F.coalesce(F.try_element_at(kinds, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9_]+)$", 1))), F.lit("otro"))


def path_corpus(path: Column) -> Column:
    """Corpus by the first rule that occurs in a path; null if none does."""
    return F.coalesce(*(F.when(path.rlike("(?i)" + p), F.lit(c)) for p, c in L.PATH_CORPORA))


def hearing_of_file(name: Column) -> Column:
    """Name of the hearing in a file of facial units; null for other files."""
    out = F.replace(F.substr(name, F.lit(5)), F.lit(".csv"), F.lit(""))
    for p in (r"_SPEAKER_\d+$", r"_v\d+$"):
        out = F.regexp_replace(out, p, "")
    return F.when(name.startswith("aus_"), F.replace(out, F.lit("_comparecientes"), F.lit("")))
