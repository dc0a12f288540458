"""Text expressions: cleaning, counting and scoring, all as Column functions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexforum.functions.materialise import small_batches

#: Code points that look like a space; typographic marks and what stands for them.
LOOKALIKE_SPACES = "    ​‌‍﻿­"
TYPOGRAPHY = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "…": "..."}


def lookalike_spaces(text: Column) -> Column:
    """Look-alike spaces become spaces."""
    return F.translate(text, LOOKALIKE_SPACES, " " * len(LOOKALIKE_SPACES))


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


@F.pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc(text: Column) -> Column:
    """Unicode NFC; no JVM expression offers it."""
    small_batches()
    return _nfc(text)


def drop_unprintable(text: Column) -> Column:
    """Keeps letters, numbers, punctuation, symbols, separators, line breaks and tabs."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}\p{P}\p{S}\p{Z}\n\t\r]", "")


def plain_typography(text: Column) -> Column:
    single = {k: v for k, v in TYPOGRAPHY.items() if len(v) == 1}
    text = F.translate(text, "".join(single), "".join(single.values()))
    for k, v in TYPOGRAPHY.items():
        if len(v) > 1:
            text = F.replace(text, F.lit(k), F.lit(v))
    return text


def whitespace(text: Column) -> Column:
    """LF line ends, no blanks at line ends, single blanks, at most one empty line in a row, no blank ends."""
    for pattern, to in ((r"\r\n?", "\n"), (r"[ \t]+(?=\n|$)", ""), (r"[ \t]{2,}", " "), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", "")):
        text = F.regexp_replace(text, pattern, to)
    return text


def bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """What the function gives for a value that is computed once, however often the function names it."""
    return F.element_at(F.transform(F.array(value), of), 1)


def substituted(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Struct of text after ordered case-insensitive rewrites and n, how many matches they found (each on the text so far). A rule's matches are counted once, and the text is rewritten only where it has some."""
    state = F.struct(text.alias("text"), F.when(text.isNotNull(), 0).alias("n"))

    def rewritten(pattern: str, to: str) -> Callable[[Column], Column]:
        p = f"(?iu){pattern}"
        step = lambda s: bound(count_of(s["text"], p), lambda k: F.struct(F.when(k > 0, F.regexp_replace(s["text"], p, to)).otherwise(s["text"]).alias("text"), (s["n"] + k).alias("n")))
        return step

    for pattern, to in rules:
        state = bound(state, rewritten(pattern, to))
    return state


def substitutions(text: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """Text and number of matches of substituted(), as two columns; where both are used, a column of the struct is cheaper."""
    both = substituted(text, rules)
    return both["text"], both["n"] if rules else F.lit(0)


def occurrences(text: Column, term: str) -> Column:
    """Non-overlapping occurrences of a substring."""
    return F.when(text.contains(term), ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("int")).when(text.isNotNull(), 0)


def weighted_terms(text: Column, lexicon: Mapping[str, float]) -> Column:
    """Sum over terms of occurrences times weight."""
    total: Column = F.lit(0.0)
    for term, weight in lexicon.items():
        total = total + occurrences(text, term) * F.lit(float(weight))
    return total


def tokens(text: Column, longer_than: int = 0) -> Column:
    """Lower-case words; what is no word character separates."""
    words = F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "), " ")
    return F.filter(words, lambda w: F.length(w) > longer_than)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null for zero vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a) * dot(b, b)), F.lit(0.0))


def visible_text(html: Column) -> Column:
    """Visible text of HTML: scripts, styles, comments and the head go, tags become line breaks, entities are read, blank lines go."""
    for pattern, to in ((r"(?is)<script[^>]*>.*?</script>", ""), (r"(?is)<style[^>]*>.*?</style>", ""), (r"(?s)<!--.*?-->", ""), (r"(?s)<[^>]+>", "\n")):
        html = F.regexp_replace(html, pattern, to)
    for entity, mark in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        html = F.replace(html, F.lit(entity), F.lit(mark))
    return F.regexp_replace(F.regexp_replace(html, r"[ \t]*\n\s*", "\n"), r"^\s+|\s+$", "")


def first_match(text: Column, rules: Sequence[tuple[str, str]], flags: str = "(?iu)") -> Column:
    """Label of the first rule whose pattern occurs."""
    return F.coalesce(*(F.when(text.rlike(flags + pattern), F.lit(label)) for pattern, label in rules))


def first_extract(text: Column, patterns: Sequence[str], group: int = 0) -> Column:
    """Text of the first pattern that occurs; null if none does."""
    return F.coalesce(*(F.nullif(F.regexp_extract(text, p, group), F.lit("")) for p in patterns))


def readable_bytes(n: Column) -> Column:
    """Bytes in their unit to one place; of two equally near values the even one, as C has it (Java rounds up)."""
    out = F.format_string("%d B", n.cast("long"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        out = F.when(n >= 1024**power, F.format_string(f"%.1f {unit}", F.bround(n / float(1024**power), 1))).otherwise(out)
    return out
