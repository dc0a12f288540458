"""Rows written once, where two branches of a plan must see the same partitions; small batches for Python."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


#: Rows and bytes of one Arrow batch at most: a task's Python holds a batch, however large its partition.
ARROW_ROWS, ARROW_BYTES = 2048, 4 << 20


def small_batches() -> None:
    """Bounds the Arrow batches of the session that plans now, as texts can be long; a smaller bound stays."""
    spark = SparkSession.getActiveSession()
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)) if spark else ():
        now = (spark.conf.get(key) or "").lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only on a local master that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="lexforum-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def written(df: DataFrame) -> DataFrame:
    """The rows, read from the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
