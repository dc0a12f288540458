"""Corpus pipeline: language ID, line dedup, near-duplicate removal, secret redaction, packing.

Each stage is a function of (spark, docs, sf_dir) and works on all that the
stage before has kept. All but the last return the columns they were given, whatever
their names. Null and empty texts: language ID rejects them, as they hold no letter.
An empty table gives an empty result. Texts are read whole, however long.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforum.llm import jaccard, langid, line_dedup, packing, secrets
from lexforum.llm.shared import checkpoint_dir, prepare

#: A text is rejected if so small a share of its n-grams belongs to its best language (clean texts: over 0.5).
LEAST_LANGUAGE_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts in a known language. Null and wordless texts go; without any language to learn from, all do. Repeated rows stay or go together; equal scores go to the language that sorts first."""
    prepare(spark)
    rows, back = _shielded(docs, "lang_pred", "score")
    kept = langid.predict(rows, langid.train(rows)).where((F.col("lang_pred") != langid.UND) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return kept.select(back)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of repeated runs of lines; documents of which nothing is left are copies and go. Null and empty texts stay as they are; rows equal in id and text are one document and keep the same lines."""
    prepare(spark)
    rows, back = _shielded(docs, "lines_total", "lines_removed", "_gone", "_text", *line_dedup.DOC)
    out = line_dedup.dedup(rows).where("lines_removed < lines_total or lines_removed = 0")
    return _resized(out.where((F.col("lines_removed") == 0) | F.col("text").rlike(r"\S"))).select(back)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of linked texts: the one with the smallest id (null last), of equal ids that with the smallest hash of its text.

    A document is named by its id and its text, so different texts with one id are told apart, and rows equal in both are one. Null and wordless texts link with nothing.
    """
    prepare(spark)
    key = _free(docs, "key")
    named = docs.withColumn(key, F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), F.hash("text").alias("h2"), F.length("text").alias("n")))
    copies = jaccard.join(named, key).where((F.col("n_shingles") > 0) & (F.col(key) != F.col("component_id"))).select(key).distinct()
    return named.join(copies, key, "left_anti").drop_duplicates([key]).select(docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every finding by a mask. Null and empty texts stay; repeated rows get the same result."""
    return _resized(secrets.redact(docs)).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences: one row per piece. Null and empty texts are the separator alone; repeated rows are packed as often as they occur."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


def _free(docs: DataFrame, name: str) -> str:
    """The name, made longer until no column has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _shielded(docs: DataFrame, *names: str) -> tuple[DataFrame, list[Column]]:
    """The rows with columns of these names, which a stage uses itself, renamed; and the columns that give them back."""
    used, new, rows = {n.lower() for n in names}, {}, docs
    for c in docs.columns:
        if c.lower() in used:
            new[c] = _free(rows, f"{c}_")
            rows = rows.withColumnRenamed(c, new[c])
    return rows, [F.col(f"`{new.get(c, c)}`").alias(c) for c in docs.columns]


def _resized(docs: DataFrame) -> DataFrame:
    """n_chars, where there is such a column, follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack_sequences),
]

#: The tokeniser and the trained stages have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet to the shared folder and read again."""
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
