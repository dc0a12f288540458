"""Every text operator on nulls, empty and very long texts, repeated rows, ties, empty tables and columns with the operators' own names."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lexforum.llm import bpe, jaccard, langid, line_dedup, packing, pitman_yor, secrets, toxicity

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
R = random.Random(4)
LONG = " ".join(R.choice("the of and that with this from was have".split()) + R.choice(["", "s", "ing"]) for _ in range(160_000)) + " password=abc123def456 end"
ROWS = [(1, None, "en"), (2, "", "en"), (3, LONG, "en"), (4, "the cat and the dog", "en"), (4, "the cat and the dog", "en"), (5, "le chat et le chien", "fr"), (6, "12 !!", None), (None, "the cat", "en")]
DDL = "doc_id long, text string, lang string"
#: Names that the operators use inside.
CLASHES = ("id", "part", "chunk", "kind", "key", "name", "n", "spans", "score", "held_out", "lang_pred", "length", "piece", "packed", "_h", "seed", "words", "grade", "lines_total", "component_id")


def operators():
    return {
        "secrets": lambda df: secrets.scan(df),
        "redact": lambda df: secrets.redact(df),
        "pitman_yor": lambda df: pitman_yor.score(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1),
        "line_dedup": lambda df: line_dedup.dedup(df),
        "bpe": lambda df: bpe.digests(df, RANKS),
        "toxicity": lambda df: toxicity.score(df, toxicity.train(df, df.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")))),
        "langid": lambda df: langid.predict(df, langid.train(df)),
        "packing": lambda df: packing.pack(df, JSON),
        "jaccard": lambda df: jaccard.join(df),
    }


@pytest.mark.parametrize("name", list(operators()))
def test_edges(spark, name):
    run = operators()[name]
    assert run(spark.createDataFrame([], DDL)).count() == 0
    plain = spark.createDataFrame(ROWS, DDL)
    crowded = plain.select("*", *(F.lit("clash").alias(c) for c in CLASHES))
    rows = run(crowded.repartition(3)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == {1, 2, 3, 4, 5, 6, None}
    twice = 2
    if name != "packing":
        assert len(rows) == len(ROWS) and len(by[4]) == twice and by[4][0] == by[4][1]
    a, b, long = by[1][0], by[2][0], by[3][0]
    if name == "secrets":
        at = LONG.index("password")
        assert a.spans == b.spans == [] and [(s.start, s.end, s.kind) for s in long.spans] == [(at, at + 21, "assign")]
    elif name == "redact":
        assert a.text is None and b.text == "" and long.text == LONG.replace("password=abc123def456", "[SECRET]") and long.score == "clash"
    elif name == "pitman_yor":
        assert (a.n_tokens, b.n_tokens, long.n_tokens) == (1, 1, len(LONG.split()) + 1) and all(r.score < 0 for r in rows)
    elif name == "line_dedup":
        assert a.text is None and b.text == "" and long.text == LONG and long.name == "clash"
    elif name == "bpe":
        assert a.n_tokens == b.n_tokens == 0 and long.n_tokens > 160_000
    elif name == "toxicity":
        assert 0 <= a.p_toxic == b.p_toxic <= 1 and 0 <= long.p_toxic <= 1
    elif name == "langid":
        assert a.lang_pred == b.lang_pred == by[6][0].lang_pred == "und" and long.lang_pred == "en" and long.kind == "clash"
    elif name == "packing":
        assert (len(by[1]), by[1][0].length, by[2][0].length) == (1, 1, 1) and len(by[4]) == twice
        assert sum(r.length for r in by[3]) > 160_000 and all(r.length == 1024 for r in by[3] if r.piece > 0)
    else:
        assert a.n_shingles == b.n_shingles == 0 and long.n_shingles > 10_000 and by[4][0].component_id == 4
