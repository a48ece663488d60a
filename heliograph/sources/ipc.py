"""Payloads in the Arrow stream format: tables of batches to binary payloads, and back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAYLOAD = "batch_id long, schema_id string, n_rows long, data binary"


def schema_id(schema: pa.Schema) -> str:
    """Names and types of all fields, in the order of names: equal for tables that differ in the order of columns only."""

    def text(kind: pa.DataType) -> str:
        if pa.types.is_struct(kind):
            return "{" + ",".join(sorted(f"{f.name}:{text(f.type)}" for f in kind)) + "}"
        if pa.types.is_list(kind):
            return f"[{text(kind.value_type)}]"
        if pa.types.is_map(kind):
            return f"<{text(kind.key_type)},{text(kind.item_type)}>"
        if pa.types.is_dictionary(kind):
            return f"dict<{kind.index_type},{text(kind.value_type)}>"
        return str(kind)

    return ",".join(sorted(f"{f.name}:{text(f.type)}" for f in schema))


def to_payloads(df: DataFrame, compression: str | None = "zstd", dictionaries: bool = True, in_order: bool = False) -> DataFrame:
    """One or more payloads for each batch of ``df(batch_id, ...)``: batch_id, schema_id, n_rows, data.

    With ``in_order``, rows of a batch stand together already, in the order to be kept.

    Works without a shuffle: a task makes a payload of each run of rows of one batch, so that no batch needs to fit in
    memory. Text columns are dictionary-encoded if asked. Rows with a null batch_id are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression=compression)
        for batch in batches:
            ids = batch.column("batch_id").to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1], [True]))) if len(ids) else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(a, b - a).drop_columns(["batch_id"])
                if dictionaries:
                    columns = [c.dictionary_encode() if pa.types.is_string(c.type) else c for c in part.columns]
                    part = pa.record_batch(columns, names=part.schema.names)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=options) as writer:
                    writer.write_batch(part)
                row = ([int(ids[a])], [schema_id(part.schema)], [part.num_rows], [sink.getvalue().to_pybytes()])
                yield pa.record_batch([pa.array(x, t) for x, t in zip(row, (pa.int64(), pa.string(), pa.int64(), pa.binary()), strict=True)], names=["batch_id", "schema_id", "n_rows", "data"])

    ordered = df.where("batch_id is not null").withColumn("batch_id", F.col("batch_id").cast("long"))
    return (ordered if in_order else ordered.sortWithinPartitions("batch_id")).mapInArrow(run, PAYLOAD)


def from_payloads(payloads: DataFrame, schema: str) -> DataFrame:
    """Rows of the payloads: batch_id and the columns of ``schema`` (DDL), which may come in any order; others are left out.

    A column that a payload doesn't have is null.
    """
    empty = payloads.sparkSession.createDataFrame([], f"batch_id long, {schema}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch.column("batch_id").to_pylist(), batch.column("data"), strict=True):
                for part in pa.ipc.open_stream(data.as_buffer()):
                    columns = {"batch_id": pa.array([number] * part.num_rows, pa.int64())}
                    for name in names:
                        at = part.schema.get_field_index(name)
                        c = part.column(at) if at >= 0 else pa.nulls(part.num_rows)
                        columns[name] = c.dictionary_decode() if pa.types.is_dictionary(c.type) else c
                    yield pa.record_batch([c.cast(t) for c, t in zip(columns.values(), types, strict=True)], names=list(columns))

    from pyspark.sql.pandas.types import to_arrow_schema

    names, types = empty.columns[1:], list(to_arrow_schema(empty.schema).types)
    return payloads.select("batch_id", "data").mapInArrow(run, empty.schema)
