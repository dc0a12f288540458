"""Structured Streaming: file ingestion without repeats, tumbling windows with late data, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 8) -> DataFrame:
    """A table's files as a stream, with the schema they have."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    # A table is a file or a folder of files; the stream reads folders.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet" if not _single(spark, path) else f"{name}.parquet").parquet(folder if _single(spark, path) else path)


def _single(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


def new_documents(docs: DataFrame, time: str, late: str = "1 hour") -> DataFrame:
    """Each document once, within the watermark."""
    return docs.withWatermark(time, late).dropDuplicatesWithinWatermark(["doc_id"])


def windows(events: DataFrame, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Tumbling windows by event type: start, event_type, n, mean."""
    per = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return per.select(F.col("w.start").alias("start"), "event_type", "n", "mean")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    per = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return per.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Reads all there is, writes Parquet, stops."""
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path, format="parquet")
