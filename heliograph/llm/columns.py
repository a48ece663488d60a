"""Columnar text helpers shared by the training-data operators.

Everything here works on whole Arrow arrays: words are split and dictionary-encoded in Arrow's C++ kernels and the
rest is NumPy, so the cost per word is a few nanoseconds and Python only sees distinct words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text handled at once, in bytes; a longer single document is handled alone.
SLICE_BYTES = 1 << 20
#: Bytes of a batch that Spark hands to a Python worker; a longer single row is a batch of its own.
BATCH_BYTES = 8 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def release() -> None:
    """Gives freed memory back, so that a worker that waits for its next task doesn't hold its peak."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def arrow_map(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with bounded memory: batches are limited by their bytes (as a setting of the session, unless that is
    smaller already) and not only by their rows, and freed memory is given back when a task ends."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_CONF, None) in (None, "67108864", "64MB"):  # the default
        conf.set(_BATCH_CONF, str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            release()

    return df.mapInArrow(run, schema)


def numbered(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with columns named by their places, and the names that doc_id and text have then.

    Names are looked for as written first, then whatever the case of their letters; no column can clash with another.
    """
    own = [f"c{i}" for i in range(len(docs.columns))]

    def place(name: str) -> str:
        found = [i for i, c in enumerate(docs.columns) if c == name] or [i for i, c in enumerate(docs.columns) if c.lower() == name]
        if not found:
            raise ValueError(f"no column {name}")
        return own[found[0]]

    return docs.toDF(*own), place("doc_id"), place("text")


def documents(docs: DataFrame) -> DataFrame:
    """Only doc_id, as a long, and text, as a string; an integer doc_id may have any width."""
    df, key, text = numbered(docs)
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each part holds about ``limit`` bytes of ``column``, and one row at least."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def texts(array: pa.Array) -> pa.Array:
    """Strings without nulls: a missing text is an empty one."""
    return pc.fill_null(array.cast(pa.string()) if array.type != pa.string() else array, "")


def ragged(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Non-empty strings of each list: their number for each list, and all of them in one array."""
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    keep = full.to_numpy(zero_copy_only=False)
    ends = np.concatenate(([0], np.cumsum(keep, dtype=np.int64)))
    bounds = lists.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    return np.diff(ends[bounds]), flat if keep.all() else flat.filter(full)


def words(array: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text, with A-Z lower-cased if asked."""
    array = texts(array)
    return ragged(pc.ascii_split_whitespace(pc.ascii_lower(array) if lower else array))


def coded(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes of the words, and the distinct words they stand for."""
    packed = flat.dictionary_encode()
    return packed.indices.to_numpy(zero_copy_only=False), packed.dictionary


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hashes(dictionary: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each string, straight from the array's buffers."""
    if not len(dictionary):
        return np.zeros(0, np.uint64)
    kind = np.int64 if pa.types.is_large_string(dictionary.type) else np.int32
    ends = np.frombuffer(dictionary.buffers()[1], kind)[dictionary.offset : dictionary.offset + len(dictionary) + 1].tolist()
    data, digest = memoryview(dictionary.buffers()[2] or b""), xxhash.xxh3_64_intdigest
    return np.fromiter((digest(data[a:b], seed) for a, b in zip(ends[:-1], ends[1:], strict=True)), np.uint64, len(dictionary))


def starts(counts: np.ndarray) -> np.ndarray:
    """Where each list begins in the flat array, and the end of the last."""
    return np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
