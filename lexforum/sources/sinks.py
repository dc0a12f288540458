"""Sinks: write-once tables, delimited files, summaries and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append_new(df: DataFrame, path: str, key: list[str]) -> None:
    """Appends rows whose key is not there yet; what is there stays as it is."""
    spark = df.sparkSession
    fresh = df.drop_duplicates(key)
    try:
        there = spark.read.parquet(path).select(key)
    except Exception as e:  # no table yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    else:
        fresh = fresh.join(there, key, "left_anti")
    fresh.write.mode("append").parquet(path)


def document_pairs(df: DataFrame, folder: str, key: str = "doc_sha", text: str = "text", failed: Column | None = None) -> DataFrame:
    """The two tables a document is kept as, written once: `records` (all but the text, as JSON) and `texts`; name: 16 characters of the key, `error` for failed ones. Gives the rows that are new."""
    name = F.when(failed if failed is not None else F.lit(False), "error").otherwise(F.substring(key, 1, 16))
    others = [c for c in df.columns if c != text]
    rows = df.select(F.col(key).alias("key"), name.alias("name"), F.to_json(F.struct(*others)).alias("record"), F.col(text).alias("text"))
    append_new(rows.select("key", "name", "record"), f"{folder}/records", ["key"])
    append_new(rows.select("key", "name", "text"), f"{folder}/texts", ["key"])
    return df.sparkSession.read.parquet(f"{folder}/records")


def delimited(df: DataFrame, path: str, mark: bool = False) -> None:
    """CSV with a header; with `mark`, a byte order mark stands before the first column's name, as spreadsheets ask for."""
    if mark:
        df = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def batch_summary(df: DataFrame, success: Column, low_confidence: Column, name: str) -> DataFrame:
    """One row: total, success, failed, low_confidence, failed_files (in order)."""
    failed = F.array_sort(F.collect_list(F.when(~success, F.col(name))))
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(success).alias("success"), F.count_if(~success).alias("failed"), F.count_if(low_confidence).alias("low_confidence"), failed.alias("failed_files"))


def inventory_summary(files: DataFrame, by: str = "extension") -> DataFrame:
    """Number and bytes of files by a column, most bytes first."""
    return files.groupBy(by).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes")).orderBy(F.desc("bytes"), by)


def inventory_report(files: DataFrame, folder: str) -> str:
    """The inventory as CSV and JSON, and its summary as text."""
    delimited(files, f"{folder}/csv")
    files.write.mode("overwrite").json(f"{folder}/json")
    rows = inventory_summary(files).collect()  # a row for each extension
    return "\n".join([f"{'extension':<12}{'files':>8}{'bytes':>14}", *(f"{r[0] or '-':<12}{r.files:>8}{r.bytes:>14}" for r in rows), f"{'total':<12}{sum(r.files for r in rows):>8}{sum(r.bytes for r in rows):>14}"])


def descriptives(table: DataFrame, title: str) -> str:
    """A small result table as text with aligned columns; numbers have 4 places."""
    show = lambda v: "-" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    rows = [table.columns, *([show(v) for v in r] for r in table.collect())]
    width = [max(len(r[i]) for r in rows) for i in range(len(table.columns))]
    return "\n".join([title, "=" * len(title), *("  ".join(v.ljust(w) for v, w in zip(r, width)).rstrip() for r in rows)])


def governance(modules: DataFrame, module: str = "module", test: str = "test", score: str = "score") -> DataFrame:
    """One JSON text: scores by module and test, each module's mean, the mean of all and its level (from .75 HIGH, from .55 MEDIUM, else LOW)."""
    level = lambda x: F.when(x >= 0.75, "HIGH").when(x >= 0.55, "MEDIUM").otherwise("LOW")
    own = modules.groupBy(module).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(test), F.col(score))))).alias("tests"), F.round(F.avg(score), 4).alias("mean"), F.sum(score).alias("_s"), F.count(score).alias("_n"))
    all_ = own.agg(F.map_from_entries(F.collect_list(F.struct(F.col(module), F.struct("tests", "mean", level(F.col("mean")).alias("level"))))).alias("modules"), F.round(F.sum("_s") / F.sum("_n"), 4).alias("overall"))
    return all_.select(F.to_json(F.struct("modules", "overall", level(F.col("overall")).alias("level"))).alias("report"))


def markdown(findings: DataFrame, title: str) -> tuple[str, int]:
    """Report of findings (few rows by their nature) and an exit code: 2 with errors, 1 with warnings, else 0."""
    rows = findings.orderBy("check").collect()
    worst = {r.severity for r in rows}
    body = "\n".join(f"| {r.check} | {r.severity} | {r.n} |" for r in rows)
    return f"# {title}\n\n| check | severity | n |\n|---|---|---|\n{body}\n", 2 if "ERROR" in worst else 1 if "WARNING" in worst else 0
