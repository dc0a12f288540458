"""Session settings and the shared folder that these operators rely on."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch: texts can be long, so batches are kept small.
ARROW_ROWS, ARROW_BYTES = 2048, 4 << 20


def prepare(spark: SparkSession) -> None:
    """Bounds Arrow batches, and sets a checkpoint folder where the cluster names none (as in tests)."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        spark.conf.set(key, str(value))
    checkpoint_dir(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only on a local master that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="lexforum-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written to the shared checkpoint folder: lineage is cut, and lost executors cost nothing."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def free_shuffles(spark: SparkSession) -> None:
    """Asks the JVM to collect what no DataFrame holds any more, so that Spark drops its shuffle files."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def hot_from(spark: SparkSession, rows: int) -> int:
    """Rows from which a key of a table with so many rows is hot: there are at most 4 x shuffle partitions of such keys."""
    return max(2, -(-rows // (2 * buckets(spark))))


def join_keyed(rows: DataFrame, keyed: DataFrame, keys: list[str], count: str, hot: int, left: bool = False) -> DataFrame:
    """Inner join (left: left join) with a table of one row per key that tells how many rows the key has (`count`).

    Keys with `hot` rows or more are few, so theirs are broadcast; the rows they take are spread over all tasks in the
    exchange that joins the others. No task holds all rows of a frequent key.
    """
    payload = [c for c in keyed.columns if c not in keys]
    own = keyed.select(*keys, F.struct(*payload).alias("_hot")).where(F.col(f"_hot.{count}") >= hot)
    others = keyed.select(*keys, F.lit(0).alias("_at"), F.struct(*payload).alias("_cold")).where(F.col(f"_cold.{count}") < hot)
    first = rows.join(F.broadcast(own), keys, "left").withColumn("_at", F.when(F.col("_hot").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 20))).cast("int"))
    both = first.join(others, [*keys, "_at"], "left").withColumn("_own", F.coalesce("_hot", "_cold"))
    both = both if left else both.where(F.col("_own").isNotNull())
    return both.select(*rows.columns, *(F.col(f"_own.{c}").alias(c) for c in payload if c not in rows.columns))


def buckets(spark: SparkSession) -> int:
    """Number of ranges that keys are dealt to: twice the shuffle partitions, which the cluster sets by its data."""
    return 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
