"""Court records: metadata with fallbacks and warnings, dates in words, parties, sections by heading schemes, corrections of scans."""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforum.functions import courts as C
from lexforum.functions import text as T
from lexforum.functions.materialise import small_batches
from lexforum.functions.patterns import Finder, folded, stem
from lexforum.functions.text import bound
from lexforum.operators.ingest import most_frequent

#: Characters of a text that hold its head, and those that are looked at first for a date.
HEAD, TOP = 3000, 600


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _low(text: Column) -> Column:
    """The text in one case, as far as patterns with (?iu) take letters for equal: each of their matches holds the pattern's stem here."""
    return F.lower(F.translate(text, "İıſ\u212a", "iisk"))


def court_found(head: Column) -> Column:
    """Struct of the first court whose pattern occurs, in one pass over the patterns: name, whose places the groups of the match fill, and raw, what the pattern found. Null without a court or head.

    A pattern is tried only where the head holds the letters that each of its matches has.
    """
    return bound(_low(head), lambda low: F.coalesce(*_courts(head, low)))


def _courts(head: Column, low: Column) -> list[Column]:
    own = []
    for pattern, name in C.COURTS:
        p = "(?iuU)" + pattern
        parts = [F.regexp_extract(head, p, int(x[1])) if x.startswith("\\") else F.lit(x) for x in re.split(r"(\\\d)", name)]
        value = F.trim(F.regexp_replace(F.concat(*parts), r"\s*·\s*$", "")) if len(parts) > 1 else parts[0]
        own.append(F.when(low.contains(stem(pattern)) & head.rlike(p), F.struct(value.alias("name"), _found(head, p).alias("raw"))))
    return own


def court(head: Column) -> Column:
    """Name of the first court whose pattern occurs."""
    return court_found(head)["name"]


def case_number(head: Column, file_name: Column | None = None) -> tuple[Column, Column]:
    """Case number of the head, else of the file's name; and whether it is the latter's."""

    def tried(low: Column) -> Column:
        own = []
        for p in C.CASE_NUMBERS:
            groups = re.compile(p).groups
            value = _found(head, p, 1) if groups == 1 else F.when(head.rlike(p), F.concat_ws("-", *(F.regexp_extract(head, p, i + 1) for i in range(groups))))
            own.append(F.when(low.contains(stem(p)), value))
        return F.coalesce(*own)

    inside = bound(_low(head), tried)
    if file_name is None:
        return inside, F.lit(False)
    named = F.coalesce(*(_found(file_name, p, 1) for p in C.FILE_NUMBERS))
    return F.coalesce(inside, named), inside.isNull() & named.isNotNull()


def _iso(day: Column, month: Column, year: Column, low: int = 1990, high: int = 2030) -> Column:
    """ISO text of a calendar day within these years."""
    iso = F.format_string("%04d-%02d-%02d", year, month, day)
    return F.when(year.between(low, high) & F.try_to_date(iso, "yyyy-MM-dd").isNotNull(), iso)


def date_found(head: Column) -> Column:
    """Struct of the ISO date of issue and raw, the text that tells it: dates in words of the first TOP characters, then of the head; D/M/Y likewise; an ISO date. Null without a date.

    Each pattern is searched once, where those before it told no date; its groups are read from what it found.
    """
    months = F.create_map(*(F.lit(x) for k, v in C.MONTHS.items() for x in (k, v)))
    years = F.create_map(*(F.lit(x) for k, v in C.YEARS.items() for x in (k, v)))

    def told(zone: Column, p: str, iso: Callable[[Column], Column]) -> Column:
        whole = bound(_found(zone, p), lambda got: F.struct(F.when(got.isNotNull(), iso(got)).alias("iso"), got.alias("raw")))
        return bound(whole, lambda x: F.when(x["iso"].isNotNull(), x))

    def in_words(p: str, kind: str) -> Callable[[Column], Column]:
        def iso(got: Column) -> Column:
            month = F.try_element_at(months, F.lower(F.regexp_extract(got, p, 2)))
            third = F.regexp_extract(got, p, 3)
            year = F.try_element_at(years, F.trim(F.lower(third))) if kind == "words" else third.try_cast("int")
            return _iso(F.regexp_extract(got, p, 1).try_cast("int"), month, year, *((2000, 2025) if kind == "recent" else ()))

        return iso

    def in_digits(p: str, *places: int, high: int = 2030) -> Callable[[Column], Column]:
        return lambda got: _iso(*(F.regexp_extract(got, p, i).try_cast("int") for i in places), 1990, high)

    zones = (F.substring(head, 1, TOP), head)
    worded = head.rlike(rf"(?iuU)\d\s*\)?\s+de\s+{C.MONTH}\s+de\s")  # holds wherever one of C.DATES does
    slashed, iso = r"(\d{1,2})[/\-](\d{1,2})[/\-](\d{4})", r"(20\d{2})-(0[1-9]|1[0-2])-(\d{2})"
    words = F.coalesce(*(told(zone, "(?iuU)" + p, in_words("(?iuU)" + p, kind)) for zone in zones for p, kind in C.DATES))
    tries = [F.when(worded, words)] + [told(zone, slashed, in_digits(slashed, 1, 2, 3, high=2025)) for zone in zones]
    return F.coalesce(*tries, told(head, iso, in_digits(iso, 3, 2, 1)))


def issue_date(head: Column) -> tuple[Column, Column]:
    """ISO date of issue, and the text that tells it."""
    found = date_found(head)
    return found["iso"], found["raw"]


def parties(head: Column) -> Column:
    """Map of party to name, of those found."""
    own = [F.struct(F.lit(k).alias("k"), F.trim(F.coalesce(*(_found(head, p, 1) for p in ps))).alias("v")) for k, ps in C.PARTIES.items()]
    return F.map_from_entries(F.filter(F.array(*own), lambda x: x["v"].isNotNull()))


def place(text: Column) -> Column:
    """The place that is named most often; of equals the first. Only the first letter is upper case."""
    initials = "".join(sorted({x[0] for x in C.PLACES}))
    names = F.regexp_extract_all(text, F.lit(rf"(?iu)(?=[{initials}])(?<![\p{{L}}\p{{N}}_])(" + "|".join(C.PLACES) + r")(?![\p{L}\p{N}_])"), F.lit(1))
    best = bound(F.transform(names, F.lower), most_frequent)
    return bound(best, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2))))


def metadata(df: DataFrame, text: str = "clean_text", file_name: str | None = None) -> DataFrame:
    """Adds doc_sha, tribunal, tribunal_raw, case_number, date_issued, date_text_raw, parties, region, doc_type, word_count, extraction_confidence, extraction_warnings. Null text: all null, confidence 0."""
    out = df.withColumn("_head", F.substring(text, 1, HEAD))
    head = F.col("_head")
    number, from_file = case_number(head, F.col(file_name) if file_name else None)
    kinds = F.coalesce(*(F.when(head.rlike("(?iu)" + p), F.lit(k)) for k, p in C.DOC_TYPES))
    out = out.withColumns({"_court": court_found(head), "_date": date_found(head)})
    out = out.withColumns({
        "doc_sha": F.sha2(F.col(text), 256), "tribunal": F.col("_court.name"), "tribunal_raw": F.col("_court.raw"), "case_number": number, "date_issued": F.col("_date.iso"), "date_text_raw": F.col("_date.raw"),
        "parties": parties(head), "region": place(F.col(text)), "doc_type": kinds, "word_count": T.word_count(F.col(text)), "_file": from_file,
    })
    has = {c: F.col(c).isNotNull() for c in C.CONFIDENCE} | {"parties": F.coalesce(F.size("parties") > 0, F.lit(False))}
    confidence = sum((F.when(has[c], w).otherwise(0.0) for c, w in C.CONFIDENCE.items()), F.lit(0.0))
    warnings = F.array_compact(F.array(
        F.when(~has["tribunal"], "tribunal_not_found"), F.when(F.col("_file"), "case_number_from_filename"), F.when(~has["case_number"], "case_number_not_found"),
        F.when(~has["date_issued"], "date_not_found"), F.when(~has["parties"], "parties_not_found"),
    ))
    return out.withColumn("extraction_confidence", F.round(confidence, 4)).withColumn("extraction_warnings", warnings).drop("_file", "_head", "_court", "_date")


def corrected(text: Column, rules: Sequence[tuple[str, str]] = tuple(C.SCAN_CORRECTIONS)) -> tuple[Column, Column]:
    """Text after the corrections of scans, and how many they were."""
    return T.substitutions(text, rules)


def plain_clean(text: Column) -> Column:
    """The second cleaner: line ends, control characters, blanks, page numbers, running headings, empty lines."""
    for pattern, to in C.PLAIN_CLEANER:
        text = F.regexp_replace(text, pattern, to)
    return text


# -- sections -----------------------------------------------------------------

SECTION = "struct<section_id:string,section_index:int,char_start:int,char_end:int,is_target:boolean,text:string>"


def boundaries(text: str, scheme: Sequence[tuple[str, Sequence[Finder], bool]], same: int = 200, other: int = 50) -> list[tuple[int, str, bool]]:
    """Where headings stand, in order. One within `same` characters of a like one found before is none; of two within `other`, the later one stays."""
    found, low = [], folded(text)
    for label, patterns, target in scheme:
        own: list[int] = []
        for p in patterns:
            for m in p.finditer(text, low):
                i = bisect.bisect_left(own, m.start())
                if not any(abs(x - m.start()) < same for x in own[max(0, i - 1) : i + 1]):
                    own.insert(i, m.start())
                    found.append((m.start(), len(found), label, target))
    out: list[tuple[int, str, bool]] = []
    for at, _, label, target in sorted(found):
        if out and at - out[-1][0] < other:
            out.pop()
        out.append((at, label, target))
    return out


def cutter(corpus: str, least_words: int = 20, schemes: dict = C.SECTIONS):
    """A function of a text: its sections (dicts of SECTION), coverage (share of the text in named sections) and warnings.

    A section of fewer words joins the one before it, or goes if there is none; the last always stays. A first heading behind
    the 100th character leaves a head section; without headings the whole text is CUERPO. Null text: no sections.
    """
    scheme = [(label, [Finder(p, re.MULTILINE) for p in patterns], target) for label, patterns, target in schemes[corpus]]

    def cut(text: str | None) -> dict:
        if text is None:
            return {"sections": [], "coverage": 0.0, "warnings": []}
        marks = boundaries(text, scheme)
        if not marks:
            return {"sections": [dict(section_id="CUERPO", section_index=0, char_start=0, char_end=len(text), is_target=False, text=text)], "coverage": 0.0, "warnings": ["no_sections_found"]}
        warnings = []
        if marks[0][0] > 100:
            marks.insert(0, (0, "ENCABEZADO", False))
            warnings.append("encabezado_inferred")
        out: list[dict] = []
        ends = [at for at, _, _ in marks[1:]] + [len(text)]
        for k, ((start, label, target), end) in enumerate(zip(marks, ends, strict=True)):
            body = text[start:end].strip()
            if len(body.split()) >= least_words or k == len(marks) - 1:
                out.append(dict(section_id=label, section_index=len(out), char_start=start, char_end=end, is_target=target, text=body))
                continue
            warnings.append(f"short_section_merged: {label}")
            if out:
                out[-1].update(char_end=end, text=text[out[-1]["char_start"] : end].strip())
        return {"sections": out, "coverage": sum(s["char_end"] - s["char_start"] for s in out) / len(text) if text else 0.0, "warnings": warnings}

    return cut


def sections(corpus: str, least_words: int = 20, schemes: dict = C.SECTIONS):
    """A column function of what cutter gives: struct of sections, coverage and warnings."""
    cut = cutter(corpus, least_words, schemes)
    small_batches()

    @F.pandas_udf(f"sections array<{SECTION}>, coverage double, warnings array<string>")
    def run(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([cut(x) for x in text], columns=["sections", "coverage", "warnings"])

    return run


def section_rows(df: DataFrame, corpus: str, text: str = "text", least_words: int = 20, schemes: dict = C.SECTIONS) -> DataFrame:
    """One row per section of each text, by the headings of a scheme (C.SECTIONS, C.SECTIONS_LOOSE or another): the other columns, section_id, section_index, char_start, char_end, is_target, coverage, text of the section."""
    own = [c for c in df.columns if c != text]
    cut = df.withColumn("_cut", sections(corpus, least_words, schemes)(F.col(text)))
    rows = cut.select(*own, F.col("_cut.coverage").alias("coverage"), F.explode("_cut.sections").alias("_s"))
    return rows.select(*own, *(F.col(f"_s.{c}").alias(c) for c in ("section_id", "section_index", "char_start", "char_end", "is_target")), "coverage", F.col("_s.text").alias(text))


def section_text(text: Column, start: Column, end: Column) -> Column:
    """Text of a range of characters (end exclusive), without blank ends; null where the range is none."""
    return F.when((start >= 0) & (end >= start), F.trim(F.substring(text, start + 1, end - start)))


def section_text_or(source: Column, start: Column, end: Column, inline: Column) -> Column:
    """Text of the section's range in its source, without blank ends; the inline text, alike, where there is no source (null or empty) or no range; empty where neither is."""
    found = F.when(F.length(source) > 0, section_text(source, start, end))
    return F.coalesce(found, F.trim(inline), F.lit(""))


# -- context ----------------------------------------------------------------------

#: Codes of corpora; first and last year of the scale; courts by what their name holds.
CORPUS_CODES = {"A-CE": 0, "A-CSJ": 1, "B": 2, "C": 3}
FIRST_YEAR, LAST_YEAR = 1994, 2023
COURT_CORPORA = [("consejo de estado", "A-CE"), ("tribunal administrativo", "A-CE"), ("corte suprema", "A-CSJ"), ("jep", "B"), ("jurisdicción especial para la paz", "B")]
#: Years in ids; the last pattern's has two digits, from 50 on of the century before.
ID_YEARS = [(r"[A-Z]{2}\d+-(\d{4})", 1), (r"\d+-(\d{4})-", 1), (r"\((\d{2})-\d{2}-(\d{2})\)", 2)]
PERIODS = [(2008, "pre-escándalo (≤2008)"), (2016, "post-escándalo (2009-2016)"), (2020, "post-acuerdo (2017-2020)")]


def context(df: DataFrame, kind: str = "kind", court: str = "court", date: str = "date", name: str = "id") -> DataFrame:
    """Adds corpus, y5 (its code), year, inferred (the id tells the year), y6 (0 .. 1 from FIRST_YEAR to LAST_YEAR, 0.5 without a year), period."""
    told = F.upper(F.trim(kind))
    by_court = F.coalesce(*(F.when(F.lower(court).contains(x), F.lit(c)) for x, c in COURT_CORPORA))
    by_name = F.when(F.upper(name).rlike(r"^[SA]P\d"), "A-CSJ").otherwise("A-CE")
    valid = lambda y: F.when(y.between(1990, 2030), y)
    own = valid(F.regexp_extract(date, r"^(\d{4})", 1).try_cast("int"))
    others = []
    for pattern, group in ID_YEARS:
        year = F.regexp_extract(name, pattern, group).try_cast("int")
        others.append(valid(F.when(year < 50, 2000 + year).otherwise(1900 + year) if group == 2 else year))
    out = df.withColumn("corpus", F.when(told.isin("B", "C"), told).otherwise(F.coalesce(by_court, by_name)))
    out = out.withColumn("y5", F.element_at(F.create_map(*(F.lit(x) for kv in CORPUS_CODES.items() for x in kv)), F.col("corpus")))
    out = out.withColumn("year", F.coalesce(own, *others)).withColumn("inferred", own.isNull() & F.col("year").isNotNull())
    scaled = (F.least(F.greatest("year", F.lit(FIRST_YEAR)), F.lit(LAST_YEAR)) - FIRST_YEAR) / float(LAST_YEAR - FIRST_YEAR)
    period = F.lit("JEP activa (2021+)")
    for upto, label in reversed(PERIODS):
        period = F.when(F.col("year") <= upto, label).otherwise(period)
    return out.withColumn("y6", F.when(F.col("year").isNull(), 0.5).otherwise(scaled)).withColumn("period", F.when(F.col("year").isNull(), "desconocido").otherwise(period))
