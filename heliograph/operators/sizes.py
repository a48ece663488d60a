"""Sizes of messages: batches as encoded tables in the Arrow stream format against JSON lines of the same rows."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import ipc
from . import encoding, stats

#: Codecs whose output can be measured.
CODECS = ("none", "zstd", "lz4")


def compress(data: Column, codec: str) -> Column:
    """Bytes under a codec: zstd and lz4 frames."""
    if codec not in CODECS:
        raise ValueError(f"unknown codec: {codec}")
    if codec == "none":
        return data

    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        import pyarrow as pa
        import zstandard

        pack = zstandard.ZstdCompressor().compress if codec == "zstd" else lambda v: _lz4(pa, v)
        return values.map(lambda v: None if v is None else pack(bytes(v)), na_action=None)

    return run(data)


def decompress(data: Column, codec: str) -> Column:
    """The inverse of `compress`."""
    if codec not in CODECS:
        raise ValueError(f"unknown codec: {codec}")
    if codec == "none":
        return data

    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        import pyarrow as pa
        import zstandard

        unpack = (lambda v: zstandard.ZstdDecompressor().decompressobj().decompress(v)) if codec == "zstd" else lambda v: pa.CompressedInputStream(pa.BufferReader(v), "lz4").read()
        return values.map(lambda v: None if v is None else unpack(bytes(v)), na_action=None)

    return run(data)


def _lz4(pa, value: bytes) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.CompressedOutputStream(sink, "lz4") as out:
        out.write(value)
    return sink.getvalue().to_pybytes()


def _measured(rows: DataFrame, system: str, codec: str) -> DataFrame:
    """(batch_id, system, raw, compressed) of ``rows(batch_id, data)``, summed over the messages of a batch."""
    packed = rows.select("batch_id", F.octet_length("data").alias("raw"), F.octet_length(compress(F.col("data"), codec)).alias("compressed"))
    return packed.groupBy("batch_id").agg(F.sum("raw").alias("raw"), F.sum("compressed").alias("compressed")).withColumn("system", F.lit(system)).select("batch_id", "system", "raw", "compressed")


def json_sizes(batches: DataFrame, signal: str, codec: str = "zstd") -> DataFrame:
    """The baseline: each batch as one line of JSON."""
    return _measured(batches.select("batch_id", F.to_json(F.struct(signal)).cast("binary").alias("data")), "json", codec)


def table_sizes(batches: DataFrame, signal: str, codec: str = "zstd", chosen: dict[str, str] | None = None, dictionaries: bool = True) -> DataFrame:
    """The same batches as encoded tables, each table of a batch one payload, with or without dictionaries.

    Encoding numbers rows by windows over a batch, so they lie together already, in as many parts as the batches came in.
    """
    parts = []
    for df in encoding.encode(batches, signal, chosen).values():
        whole = df.sortWithinPartitions("batch_id", "rn").drop("rn")
        parts.append(ipc.to_payloads(whole, None, dictionaries, in_order=True).select("batch_id", "data"))
    return _measured(reduce(DataFrame.unionByName, parts), "tables", codec)


def ratios(sizes: DataFrame, by: list[str], baseline: str = "json", warm_up: int = 0) -> DataFrame:
    """Mean sizes of a system's messages and their ratio to the baseline's: by, system, n, mean, total, ratio.

    Batches numbered below ``warm_up`` are left out, as dictionaries and schemas settle in them.
    """
    s = sizes.where(F.col("batch_id") >= warm_up).groupBy(*by, "system").agg(F.count("*").alias("n"), F.avg("compressed").alias("mean"), F.sum("compressed").alias("total"))
    base = s.where(F.col("system") == baseline).select(*by, F.col("mean").alias("base")) if by else s.where(F.col("system") == baseline).select(F.col("mean").alias("base"))
    joined = s.join(base, by, "left") if by else s.join(F.broadcast(base))
    return joined.withColumn("ratio", F.col("base") / F.col("mean")).drop("base")


def summarized(sizes: DataFrame, by: list[str]) -> DataFrame:
    """Exact summary of compressed sizes for each system; see `stats.summary`."""
    return stats.summary(sizes, [*by, "system"], "compressed")


def export_csv(table: DataFrame, path: str) -> None:
    """A small report as one CSV file with a header, rows in order."""
    table.orderBy(*table.columns).coalesce(1).write.option("header", True).csv(path)
