"""Tables that are made once and read often: written in buckets by batch, so that what is made of them stays together."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators import nesting


def folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, which all executors share; where it is unset, one of our own for a session on
    a single machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "local")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="heliograph-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Files that a task writes side by side; above it, its rows are sorted by their bucket first.
_WRITERS, _OPEN = "spark.sql.maxConcurrentOutputFileWriters", 8


def _buckets(df: DataFrame) -> int:
    """One bucket for each part that ``df`` comes in, if its batches lie together, else for each part of the session."""
    now = df._jdf.queryExecution().sparkPlan().outputPartitioning()
    if now.getClass().getSimpleName() == "HashPartitioning":
        return now.numPartitions()
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df(batch_id, ...)`` written once to the shared folder, in as many buckets as it has parts, and read again. Like rows
    of `nesting.by_batch`, it is grouped and joined within batches without a shuffle; nothing of it stays in memory.

    A part of whole batches is one bucket already and is written as it comes, without the sort that Spark puts before it.
    """
    spark = df.sparkSession
    nesting.local_joins(spark)
    own, before = f"{name}_{uuid.uuid4().hex}", spark.conf.get(_WRITERS)
    spark.conf.set(_WRITERS, str(_OPEN))
    try:
        df.write.format("parquet").option("compression", "zstd").option("path", f"{folder(spark)}/{own}").bucketBy(_buckets(df), "batch_id").saveAsTable(own)
    finally:
        spark.conf.set(_WRITERS, before)
    return spark.table(own)
