"""Sources: tables, text with an encoding fallback, JSON, CSV, diarization, annotations, file inventories."""

from __future__ import annotations

import hashlib
import io
import os
import re
import zipfile
from collections.abc import Callable, Iterator, Mapping, Sequence
from urllib.parse import quote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lexforum.functions.materialise import written


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def decoded(content: Column) -> Column:
    """UTF-8 where the bytes are that, else Latin-1; a byte order mark goes."""
    return F.regexp_replace(F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1")), "^﻿", "")


def binary_files(spark: SparkSession, folder: str, suffixes: Sequence[str]) -> DataFrame:
    """Binary files of these suffixes under a folder."""
    pattern = "*.{" + ",".join(x.lstrip(".") for x in suffixes) + "}"
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)


def text_files(spark: SparkSession, folder: str, suffixes: Sequence[str] = (".txt",)) -> DataFrame:
    """One row per file of these suffixes, in order of paths: path, length, modificationTime, text."""
    files = binary_files(spark, folder, suffixes)
    return files.select("path", "length", "modificationTime", decoded(F.col("content")).alias("text")).orderBy("path")


def json_documents(spark: SparkSession, folder: str, schema: StructType | str, defaults: Mapping[str, object] | None = None, first: int | None = None) -> DataFrame:
    """One document per file, in order of file names (only the `first` ones, if asked for).

    A file that cannot be parsed has its text in _corrupt_record, `json_read_error` as warning, and the defaults in its columns.
    """
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    read = spark.read.schema(StructType([*kind.fields, StructField("_corrupt_record", StringType())])).option("multiLine", True).option("mode", "PERMISSIVE").json(folder)
    out = read.withColumn("file", F.col("_metadata.file_name")).withColumn("warning", F.when(F.col("_corrupt_record").isNotNull(), "json_read_error"))
    for name, value in (defaults or {}).items():
        out = out.withColumn(name, F.when(F.col("warning").isNotNull(), F.coalesce(F.col(name), F.lit(value))).otherwise(F.col(name)))
    return out.orderBy("file").limit(first) if first is not None else out


def docx_text(content: bytes | None) -> str | None:
    """Paragraphs of a DOCX file that hold anything, one to a line; null for what is none."""
    if content is None:
        return None
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    read = {f"{w}t": lambda e: e.text or "", f"{w}tab": lambda e: "\t", f"{w}br": lambda e: "\n"}
    paragraphs = ("".join(read[e.tag](e) for e in p.iter() if e.tag in read) for p in root.iter(f"{w}p"))
    return "\n".join(x for x in paragraphs if x.strip())


def extracted(spark: SparkSession, folder: str, suffixes: Sequence[str], extractors: Sequence[Callable[[bytes | None], str | None]] = (docx_text,), least: int = 0) -> DataFrame:
    """path, length, text, extractor of binary documents: the text of the first extractor that gives `least` characters or more, and its place; null if none does.

    Extractors of other formats (PDF, DOC, images) are the caller's functions of a file's bytes.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts, places = [], []
            for content in frame["content"]:
                got = None, None
                for i, f in enumerate(extractors):
                    try:
                        text = f(content)
                    except Exception:  # the next one may read it
                        continue
                    if text is not None and len(text) >= least:
                        got = text, i
                        break
                texts.append(got[0]), places.append(got[1])
            yield pd.DataFrame({"path": frame["path"], "length": frame["length"], "text": texts, "extractor": pd.array(places, "Int32")})

    return binary_files(spark, folder, suffixes).select("path", "length", "content").mapInPandas(run, "path string, length long, text string, extractor int")


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header, quoted line breaks and perhaps a byte order mark."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    out = (reader.schema(schema) if schema else reader).csv(path)
    return out.withColumnsRenamed({c: c.lstrip("﻿") for c in out.columns})


def rttm(lines: DataFrame, column: str = "value") -> DataFrame:
    """Diarization lines of 8 fields or more: speaker, start, duration, end."""
    f = F.split(F.trim(column), r"\s+")
    parsed = lines.where(F.size(f) >= 8).select(f[7].alias("speaker"), f[3].try_cast("double").alias("start"), f[4].try_cast("double").alias("duration"))
    return parsed.where("start is not null and duration is not null").withColumn("end", F.col("start") + F.col("duration"))


def diarizations(spark: SparkSession, folder: str) -> DataFrame:
    """Segments of JSON files that hold a list of speaker, start, end, duration: hearing (the file's name without suffix), segment (place in the list), speaker, start, end, duration.

    A missing duration follows from start and end; a file that is no such list gives one row with nulls, so that it can be told.
    """
    kind = "array<struct<speaker:string,start:double,end:double,duracion:double>>"
    files = spark.read.text(folder, wholetext=True).select(_stem().alias("hearing"), F.from_json("value", kind).alias("_s"))
    rows = files.select("hearing", F.posexplode_outer("_s").alias("segment", "_one"))
    return rows.select("hearing", "segment", "_one.speaker", "_one.start", "_one.end", F.coalesce("_one.duracion", F.col("_one.end") - F.col("_one.start")).alias("duration"))


def transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of JSON files that map starts to texts: hearing (the file's name without suffix), key, text. Files that hold no map give none."""
    files = spark.read.text(folder, wholetext=True).select(_stem().alias("hearing"), F.from_json("value", "map<string,string>").alias("_t"))
    return files.select("hearing", F.explode("_t").alias("key", "text"))


def _stem() -> Column:
    return F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """Span annotations: one row per span, with its place in the list (later spans win)."""
    kind = "text string, label array<struct<start:int,end:int,labels:array<string>>>"
    tasks = spark.read.schema(kind).option("multiLine", True).json(path)
    return tasks.select(F.sha2("text", 256).alias("doc"), "text", F.posexplode_outer("label").alias("span_index", "span")).select("doc", "text", "span_index", "span.start", "span.end", F.explode_outer("span.labels").alias("label"))


def listing(spark: SparkSession, folder: str, pruned: Sequence[str] = ()) -> DataFrame:
    """Files under a folder: path, length, modificationTime. Folders of the pruned names are never entered, nor are links to folders.

    Tasks list folders, one level after the other; a level's folders are dealt over them, and its entries are written before the
    next one starts, so the driver holds none. The executors must see the folder (a shared file system or any that Arrow knows
    by its URI). What cannot be listed counts as empty.
    """

    def entries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for frame in frames:
            for place in frame["path"]:
                system, local = _file_system(place)
                head = place[: len(place) - len(local)] if place.endswith(local) else ""
                try:
                    found = system.get_file_info(fs.FileSelector(local))
                except OSError:
                    continue
                is_link = lambda x: isinstance(system, fs.LocalFileSystem) and os.path.islink(x.path)
                kept = [x for x in found if x.type == fs.FileType.File or (x.type == fs.FileType.Directory and x.base_name not in pruned and not is_link(x))]
                rows = [(head + x.path, x.type == fs.FileType.Directory, x.size, None if x.mtime_ns is None else pd.Timestamp(x.mtime_ns // 1000, unit="us", tz="UTC")) for x in kept]
                for i in range(0, len(rows), 10_000):
                    yield pd.DataFrame(rows[i : i + 10_000], columns=["path", "is_folder", "length", "modificationTime"])

    kind = "path string, is_folder boolean, length long, modificationTime timestamp"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files, folders = None, spark.createDataFrame([(folder.rstrip("/") or "/",)], "path string")
    while True:
        level = written(folders.mapInPandas(entries, kind))
        own = level.where("not is_folder").drop("is_folder")
        files = own if files is None else files.unionByName(own)
        if level.where("is_folder").isEmpty():
            return files
        folders = level.where("is_folder").select("path").repartition(parts)


def inventory(spark: SparkSession, folder: str, hash_below: int | None = None, pruned: Sequence[str] = (), by_tasks: bool = True) -> DataFrame:
    """Files under a folder, without those in folders of the pruned names: path, length, modificationTime, extension and, up to a size, sha256.

    Without hashes no file is opened: only the listing is read. Pruned folders are never entered (see listing). Without
    `by_tasks` Spark lists the whole tree, on any file system that it reads, and pruned folders go afterwards.
    """
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("extension")
    if not by_tasks:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        if pruned:
            files = files.where(~F.col("path").rlike("/(" + "|".join(map(re.escape, pruned)) + ")/"))
        sha = F.when(F.col("length") <= hash_below, F.sha2("content", 256)) if hash_below else F.lit(None).cast("string")
        return files.select("path", "length", "modificationTime", extension, sha.alias("sha256"))
    files = listing(spark, folder, pruned)
    if not hash_below:
        return files.select("path", "length", "modificationTime", extension, F.lit(None).cast("string").alias("sha256"))

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(sha256=[_sha256(p) if n <= hash_below else None for p, n in zip(frame["path"], frame["length"], strict=True)])

    dealt = files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return dealt.mapInPandas(hashed, "path string, length long, modificationTime timestamp, sha256 string").select("path", "length", "modificationTime", extension, "sha256")


def _file_system(place: str):
    """The file system of a path or URI (its path as it is, not percent-encoded), and the path there."""
    from pyarrow import fs

    scheme, mark, rest = place.partition("://")
    if not mark:
        return fs.LocalFileSystem(), place
    return fs.FileSystem.from_uri(f"{scheme}://{quote(rest, safe='/:@,')}")


def _sha256(place: str) -> str | None:
    """Digest of a file, read in pieces; null if it cannot be read."""
    system, local = _file_system(place)
    digest = hashlib.sha256()
    try:
        with system.open_input_stream(local) as f:
            while piece := f.read(1 << 20):
                digest.update(piece)
    except OSError:
        return None
    return digest.hexdigest()


def centroids(spark: SparkSession, path: str, name: str = "name", vector: str = "vector") -> DataFrame:
    """Pole vectors from Parquet: name, vector (of doubles); vectors with null entries are left out."""
    rows = spark.read.parquet(path).select(F.col(name).alias("name"), F.col(vector).cast("array<double>").alias("vector"))
    return rows.where(F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull()))


def named_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Text files named doc_SECTION_PARTS_017.txt: stem, doc, section, ordinal, text."""
    files = spark.read.text(folder, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]+$", 1).alias("stem"), F.col("value").alias("text"))
    parts = F.split("stem", "_")
    return files.select("stem", F.try_element_at(parts, F.lit(1)).alias("doc"), F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), "_").alias("section"), F.regexp_extract("stem", r"(\d+)$", 1).try_cast("int").alias("ordinal"), "text")
