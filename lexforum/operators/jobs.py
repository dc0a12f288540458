"""Document jobs: from files to text, metadata and sections, each step's failure a row instead of an exception."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforum.functions import courts as C
from lexforum.functions.materialise import small_batches, written
from lexforum.operators import ingest, records
from lexforum.sources import readers, sinks

#: Version that results carry.
VERSION = "1"
#: Confidence of metadata below which a document is flagged.
LEAST_CONFIDENCE = 0.5
READ = "text string, extractor int, error string"


def read_text(files: DataFrame, extractors: Sequence[Callable[[bytes | None], str | None]] = (), content: str = "content") -> DataFrame:
    """Adds text and read_error. Without extractors bytes are decoded on the JVM (UTF-8, else Latin-1).

    With extractors (functions of a file's bytes) the first that gives a text counts; where none does, read_error holds what
    the last one raised, or that it gave nothing. A file without content cannot be read.
    """
    lost = F.col(content).isNull()
    if not extractors:
        return files.withColumn("text", readers.decoded(F.col(content))).withColumn("read_error", F.when(lost, "no content"))
    small_batches()

    @F.pandas_udf(READ)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for data in batch:
                text, place, error = None, None, "no extractor gives a text"
                for i, f in enumerate(extractors):
                    try:
                        text = f(data)
                    except Exception as e:  # kept as the row's own
                        error = f"{type(e).__name__}: {e}"
                        continue
                    if text is not None:
                        place, error = i, None
                        break
                rows.append((text, place, error))
            yield pd.DataFrame(rows, columns=["text", "extractor", "error"]).astype({"extractor": "Int32"})

    read = files.withColumn("_read", F.when(~lost, run(F.col(content))))
    return read.withColumns({"text": F.col("_read.text"), "read_error": F.when(lost, "no content").otherwise(F.col("_read.error"))}).drop("_read")


def document_job(files: DataFrame, corpus: str, extractors: Sequence[Callable[[bytes | None], str | None]] = (), name: str = "path", content: str = "content", rules: Sequence[tuple[str, str]] = tuple(C.SCAN_CORRECTIONS), least_words: int = 20, least_confidence: float = LEAST_CONFIDENCE, schemes: dict = C.SECTIONS) -> DataFrame:
    """One row per file, whatever happens to it: `name`, corpus_type, version, success, step, error_message, sha256_source, sha256_clean, clean_text, cleaning_report, metadata, sections, coverage, warnings, low_confidence.

    Steps are read, clean and segment. A file fails at `read` without content or text, at `clean` if nothing is left of its text, at
    `segment` if its sections cannot be found; it then keeps what the steps before gave. low_confidence: the metadata's own
    confidence is below `least_confidence`; null for failed files. Other columns are not carried.
    """
    read = read_text(files.select(name, content), extractors, content)
    clean = ingest.clean(read, "text", rules).drop(content)
    meta = records.metadata(clean.withColumn("_file", F.regexp_extract(name, r"([^/\\]*)$", 1)), "clean_text", "_file")
    bare = F.col("read_error").isNull() & (F.coalesce(F.length("clean_text"), F.lit(0)) == 0)
    cut = meta.withColumn("_cut", guarded_sections(corpus, least_words, schemes)(F.when(F.col("read_error").isNull() & ~bare, F.col("clean_text"))))
    errors = [("read", F.col("read_error")), ("clean", F.when(bare, "no text is left")), ("segment", F.col("_cut.error"))]
    failed = F.coalesce(*(e for _, e in errors))
    facts = ("doc_sha", "tribunal", "tribunal_raw", "case_number", "date_issued", "date_text_raw", "parties", "region", "doc_type", "word_count", "extraction_confidence", "extraction_warnings")
    kept = lambda c: F.when(F.col("read_error").isNull() & ~bare, c)
    return cut.select(
        name, F.lit(corpus).alias("corpus_type"), F.lit(VERSION).alias("version"), failed.isNull().alias("success"), F.coalesce(*(F.when(e.isNotNull(), F.lit(s)) for s, e in errors)).alias("step"), failed.alias("error_message"),
        F.sha2("text", 256).alias("sha256_source"), kept(F.col("doc_sha")).alias("sha256_clean"), kept(F.col("clean_text")).alias("clean_text"), kept(F.col("cleaning_report")).alias("cleaning_report"),
        kept(F.struct(*facts)).alias("metadata"), F.col("_cut.sections").alias("sections"), F.col("_cut.coverage").alias("coverage"), F.col("_cut.warnings").alias("warnings"),
        F.when(failed.isNull(), F.col("extraction_confidence") < least_confidence).alias("low_confidence"),
    )


def guarded_sections(corpus: str, least_words: int = 20, schemes: dict = C.SECTIONS):
    """A column function: sections, coverage and warnings as records.sections gives them, or the error that finding them raised; null text: all null."""
    cut = records.cutter(corpus, least_words, schemes)
    small_batches()

    def tried(text: str | None) -> dict:
        if text is None:
            return {"sections": None, "coverage": None, "warnings": None, "error": None}
        try:
            return {**cut(text), "error": None}
        except Exception as e:  # kept as the row's own
            return {"sections": None, "coverage": None, "warnings": None, "error": f"{type(e).__name__}: {e}"}

    @F.pandas_udf(f"sections array<{records.SECTION}>, coverage double, warnings array<string>, error string")
    def run(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([tried(x) for x in text], columns=["sections", "coverage", "warnings", "error"])

    # So no filter on the error is moved before the function, where it could not be told.
    return run.asNondeterministic()


def counters(results: DataFrame, name: str = "path") -> DataFrame:
    """One row, of names: total, success, failed, low_confidence. What failed is in the quarantine, by rows."""
    files = results.groupBy(name).agg(F.max("success").alias("success"), F.max("low_confidence").alias("low_confidence"))
    return files.agg(F.count(F.lit(1)).alias("total"), F.count_if("success").alias("success"), F.count_if(~F.col("success")).alias("failed"), F.count_if("low_confidence").alias("low_confidence"))


def deliver(results: DataFrame, folder: str, name: str = "path", stop_on_error: bool = False) -> DataFrame:
    """Writes good documents to `documents` and failed ones to `quarantine` (name, step, error_message, sha256_source), each once; gives the counters of what is there.

    Good documents are kept by name and sha256_clean, failed ones by name and step; a file that is read well later stays in the
    quarantine's history and counts as good. The job runs once: both tables are made from its written rows.
    stop_on_error: nothing is delivered, and the first failed file by name is told, if any failed.
    """
    done = written(results)
    if stop_on_error:
        first = done.where("not success").agg(F.min(F.struct(name, "step", "error_message"))).first()[0]
        if first is not None:
            raise RuntimeError(f"{first[0]}: {first[1]}: {first[2]}")
    sinks.append_new(done.where("success"), f"{folder}/documents", [name, "sha256_clean"])
    sinks.append_new(done.where("not success").select(name, "step", "error_message", "sha256_source"), f"{folder}/quarantine", [name, "step"])
    spark = results.sparkSession
    good = spark.read.schema(results.schema).parquet(f"{folder}/documents").select(name, "success", "low_confidence")
    bad = spark.read.schema(results.select(name).schema).parquet(f"{folder}/quarantine").withColumns({"success": F.lit(False), "low_confidence": F.lit(None).cast("boolean")})
    return counters(good.unionByName(bad), name)


def run(spark: SparkSession, folder: str, output: str, corpora: Sequence[str] = ("A", "B"), suffixes: Sequence[str] = (".txt", ".text"), stop_on_error: bool = False, extractors: Sequence[Callable[[bytes | None], str | None]] = (), **options) -> DataFrame:
    """The job over folder/<corpus> of each corpus, delivered below output/<corpus>; counters by corpus_type. A folder without files gives zeros."""
    out = None
    for corpus in corpora:
        results = document_job(readers.binary_files(spark, f"{folder}/{corpus}", suffixes), corpus, extractors, **options)
        one = deliver(results, f"{output}/{corpus}", stop_on_error=stop_on_error).select(F.lit(corpus).alias("corpus_type"), "*")
        out = one if out is None else out.unionByName(one)
    return out
