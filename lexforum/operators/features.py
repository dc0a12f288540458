"""Feature jobs: segmented documents of a corpus to a row of indicators for each target section; contexts as a matrix; summaries.

Documents are rows: file, doc_id, kind, tribunal, date, sections (array of section_id, is_target, text), error.
They come from JSON files (`documents`) or from document jobs (`from_jobs`). A document that could not be read
has an error and no sections; it is counted and stops nothing. Null sections are none; empty texts give no row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforum.functions.materialise import written
from lexforum.operators import indicators, records
from lexforum.sources import readers, sinks

# Sections that a corpus is read for, beside those that a document itself marks as targets.
TARGETS = {
    "A": ("HECHOS", "CONSIDERACIONES", "DECISION", "HECHOS_PROBADOS", "HECHOS_JURIDICAMENTE_RELEVANTES", "HECHOS_JR", "CARGOS", "CARGO_UNICO", "CONSIDERACIONES_DE_LA_CORTE", "CONSIDERACIONES_CORTE"),
    "B": ("HECHOS_Y_CONDUCTAS", "PATRONES_MACROCRIMINALES", "CALIFICACION_JURIDICA", "RECONOCIMIENTO", "RESUELVE"),
}
# Columns of a feature row, and those that a summary describes.
COLUMNS = ("doc_id", "section_id", "corpus_type", "year", "y1_ebi", "y2_sa", "y3_civil", "y4_nv", "y5_corpus_type", "y6_period", "y10_rep", "text_length_chars", "n_sa_instances", "n_nv_instances", "n_rep_instances", "n_nv_questioned", "has_warning")
SUMMARISED = ("y2_sa", "y3_civil", "y4_nv", "y10_rep", "y6_period")

_JSON = "doc_id string, source_file string, metadata struct<doc_id:string, tribunal:string, date_issued:string>, segmentation struct<corpus_type:string, sections:array<struct<section_id:string, is_target:boolean, char_range:array<bigint>, text:string>>>"
_DOCUMENT = "file string, doc_id string, kind string, tribunal string, date string, sections array<struct<section_id:string, is_target:boolean, text:string>>, error string"


def _place(path: Column, root: str) -> Column:
    """A path in one form: slashes forward, without a local scheme and without the root before it."""
    plain = F.regexp_replace(F.translate(path, "\\", "/"), r"^file:/+", "/")
    base = root.rstrip("/") + "/"
    return F.when(plain.startswith(base), F.substr(plain, F.lit(len(base) + 1))).otherwise(plain)


def documents(spark: SparkSession, folder: str, first: int | None = None, sources: DataFrame | None = None, root: str = "") -> DataFrame:
    """Documents from the JSON files of a folder (the `first` ones by name, if asked for); a folder that is not there or empty gives none.

    sources: path, text. A section's text is cut from the file's source by its range of characters; without a source
    of that path (as it is, or below `root`) or a range, the section's own text counts.
    """
    try:
        read = readers.json_documents(spark, f"{folder.rstrip('/')}/*.json", _JSON, first=first)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], _DOCUMENT)
    docs = read.withColumn("_place", _place(F.col("source_file"), root))
    if sources is None:
        docs = docs.withColumn("_source", F.lit(None).cast("string"))
    else:
        one = sources.select(_place(F.col("path"), root).alias("_place"), F.col("text").alias("_source")).groupBy("_place").agg(F.min("_source").alias("_source"))
        docs = docs.join(one, "_place", "left")

    def section(s: Column) -> Column:
        ranged = F.size(s["char_range"]) == 2
        at = lambda i: F.when(ranged, F.try_element_at(s["char_range"], F.lit(i))).cast("int")
        return F.struct(F.coalesce(s["section_id"], F.lit("")).alias("section_id"), F.coalesce(s["is_target"], F.lit(False)).alias("is_target"), records.section_text_or(F.col("_source"), at(1), at(2), s["text"]).alias("text"))

    name = F.regexp_replace("file", r"\.json$", "")
    error = F.when(F.col("warning").isNotNull(), F.coalesce("warning", "source_file"))  # names a column of the files, as Spark reads none for its own mark alone
    return docs.select("file", F.coalesce("doc_id", F.col("metadata.doc_id"), name).alias("doc_id"), F.coalesce(F.col("segmentation.corpus_type"), F.lit("A")).alias("kind"), F.col("metadata.tribunal").alias("tribunal"), F.col("metadata.date_issued").alias("date"), F.transform("segmentation.sections", section).alias("sections"), error.alias("error"))


def from_jobs(results: DataFrame, name: str = "path") -> DataFrame:
    """Documents from the rows of a document job; failed ones keep their error."""
    sections = F.transform("sections", lambda s: F.struct(s["section_id"].alias("section_id"), s["is_target"].alias("is_target"), F.trim(s["text"]).alias("text")))
    return results.select(F.col(name).cast("string").alias("file"), F.substring("sha256_clean", 1, 16).alias("doc_id"), F.col("corpus_type").alias("kind"), F.col("metadata.tribunal").alias("tribunal"), F.col("metadata.date_issued").alias("date"), sections.alias("sections"), F.col("error_message").alias("error"))


def contexts(docs: DataFrame, corpus: str | None = None) -> DataFrame:
    """Adds corpus_type, y5_corpus_type, year, y6_period. In a corpus of A a document that calls itself B is one of A: of its first court if the tribunal's name holds CE, else of the second, with the code 0."""
    own = docs.columns
    out = records.context(docs, "kind", "tribunal", "date", "doc_id")
    kind, code = F.col("corpus"), F.col("y5")
    if corpus == "A":
        wrong = kind == "B"
        kind = F.when(wrong, F.when(F.coalesce(F.col("tribunal").contains("CE"), F.lit(False)), "A-CE").otherwise("A-CSJ")).otherwise(kind)
        code = F.when(wrong, 0).otherwise(code)
    return out.select(*own, kind.alias("corpus_type"), code.alias("y5_corpus_type"), "year", F.col("y6").alias("y6_period"))


def feature_matrix(rows: DataFrame, columns: Sequence[str] = ("y5_corpus_type", "y6_period"), key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The key and `features`, the columns as an array of doubles in their order."""
    return rows.select(*key, F.array(*(F.col(c).cast("double") for c in columns)).alias("features"))


def distribution(rows: DataFrame, column: str = "corpus_type") -> DataFrame:
    """Rows by the values of a column."""
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def targets(docs: DataFrame, corpus: str, least_chars: int = 30) -> DataFrame:
    """One row per section that is a target by its mark or its name and has so many characters: file, place, the document's context, section_id, text."""
    wanted = TARGETS[corpus]
    rows = contexts(docs.where("error is null"), corpus).select("file", "doc_id", "corpus_type", "year", "y5_corpus_type", "y6_period", F.posexplode("sections").alias("place", "_s"))
    name = F.translate(F.upper("_s.section_id"), " -", "__")
    return rows.where((F.col("_s.is_target") | name.isin(*wanted)) & (F.length("_s.text") >= least_chars)).select("file", "place", "doc_id", "corpus_type", "year", "y5_corpus_type", "y6_period", F.col("_s.section_id").alias("section_id"), F.col("_s.text").alias("text"))


def section_features(docs: DataFrame, corpus: str, tokens: DataFrame | None = None, y1: DataFrame | None = None, most_chars: int | None = 8000, least_chars: int = 30) -> DataFrame:
    """Feature rows of a corpus: corpus, file, place, COLUMNS.

    tokens: a parse of the sections' texts, keyed by file and place; without it y2 and y4 are those of patterns alone.
    y1: file, place, y1_ebi of a model; 0 where there is none. most_chars: characters of a section that are read (None: all).
    """
    rows = targets(docs, corpus, least_chars)
    if tokens is None:
        out = indicators.feature_rows(rows, most_chars=most_chars, least_chars=least_chars)
    else:
        keyed = rows.withColumnRenamed("doc_id", "_doc").withColumn("doc_id", F.struct("file", "place"))
        parse = tokens.drop("doc_id").withColumn("doc_id", F.struct(F.col("file").cast("string").alias("file"), F.col("place").cast("int").alias("place"))).drop("file", "place")
        out = indicators.parsed_feature_rows(keyed, parse, most_chars, least_chars).drop("doc_id", "y1_ebi").withColumnRenamed("_doc", "doc_id")
    if y1 is None:
        out = out.withColumn("y1_ebi", F.lit(0.0))
    else:
        given = y1.groupBy(F.col("file").cast("string").alias("file"), F.col("place").cast("int").alias("place")).agg(F.max("y1_ebi").alias("y1_ebi"))
        out = out.join(given, ["file", "place"], "left").withColumn("y1_ebi", F.coalesce("y1_ebi", F.lit(0.0)))
    return out.select(F.lit(corpus).alias("corpus"), "file", "place", *COLUMNS)


def summary(rows: DataFrame, by: Sequence[str] = ("corpus",), columns: Sequence[str] = SUMMARISED) -> DataFrame:
    """n, mean, std (of a sample), min and max of each indicator, by group: one pass over the rows."""
    long = rows.select(*by, F.explode(F.array(*(F.struct(F.lit(c).alias("indicator"), F.col(c).cast("double").alias("v")) for c in columns))).alias("_x")).select(*by, "_x.*")
    return long.groupBy(*by, "indicator").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))


def tally(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: files and errors of the documents; sections, those without a warning, and documents of their feature rows."""
    files = docs.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("error").isNotNull()).alias("errors"))
    own = rows.agg(F.struct(F.count(F.lit(1)).alias("sections"), F.count_if(~F.col("has_warning")).alias("without_warning"), F.count_distinct("doc_id").alias("documents")).alias("_own"))
    return files.withColumn("_own", own.scalar()).select("files", "errors", "_own.*")


def run(spark: SparkSession, folders: Mapping[str, str], output: str | None = None, first: int | None = None, sources: DataFrame | None = None, root: str = "", tokens: DataFrame | None = None, y1: DataFrame | None = None, most_chars: int | None = 8000) -> DataFrame:
    """Feature rows of all corpora given, by corpus and folder of JSON documents; with `output`, COLUMNS also as CSV there (with a byte order mark), one folder for one corpus (indicators_corpus_a) or for all (indicators_all). The rows are made once."""
    out = None
    for corpus, folder in folders.items():
        one = section_features(documents(spark, folder, first, sources, root), corpus, tokens, y1, most_chars)
        out = one if out is None else out.unionByName(one)
    rows = written(out)
    if output:
        name = f"corpus_{next(iter(folders)).lower()}" if len(folders) == 1 else "all"
        sinks.delimited(rows.select(*COLUMNS), f"{output.rstrip('/')}/indicators_{name}", mark=True)
    return rows
