"""Streaming forms: batches routed, checked and written as they come."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.compare import route


def json_stream(spark: SparkSession, path: str, schema: str, files_a_trigger: int = 100) -> DataFrame:
    """Batches of JSON lines, as files land."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_a_trigger).text(path)
    return lines.where("value <> ''").select(F.from_json("value", schema).alias("batch")).select("batch.*")


def fan_out(stream: DataFrame, weights: dict[str, int], draw: str, sinks: dict[str, Callable[[DataFrame, int], None]], checkpoint: str) -> StreamingQuery:
    """Writes each batch to its route's sink; a micro-batch is computed once for all of them."""

    def write(df: DataFrame, epoch: int) -> None:
        routed = route(df, weights, draw).persist()
        try:
            for name, sink in sinks.items():
                sink(routed.where(F.col("route") == name).drop("route"), epoch)
        finally:
            routed.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay(stream: DataFrame, ts: str, throttle: float, sink: Callable[[DataFrame, int], None], checkpoint: str, wait: Callable[[float], None] = time.sleep) -> StreamingQuery:
    """Writes micro-batches at the pace of their events: before each, waits for the time from the earliest event of the
    one before to its own (nanoseconds in ``ts``), times ``throttle``; 0 doesn't wait.

    Only the earliest time comes to the driver. After a restart the first micro-batch isn't waited for. A micro-batch
    without times, or with one of 0, is written at once and leaves the clock as it is; time that runs backwards costs no wait.
    """
    if throttle < 0:
        raise ValueError("throttle must be 0 or more")
    last: list[int] = []

    def write(df: DataFrame, epoch: int) -> None:
        if throttle:
            first = df.agg(F.min(ts)).first()[0]
            if first:
                if last:
                    wait(max(first - last[0], 0) * throttle / 1e9)
                last[:] = [first]
        sink(df, epoch)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
