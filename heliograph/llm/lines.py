"""Operator 3: reversible line deduplication with exact reference counts and sharded cuckoo filters.

The exact state is a table of reference counts: for each line key (128-bit hash) the number of documents that hold it.
For each shard of that table a cuckoo filter holds the keys that are to be dropped. Inserting or deleting documents
changes the counts, and the keys that thereby reach the threshold or fall below it are inserted into their shard's
filter or deleted from it, so the state after a deletion is the state in which the document never was.

A line that a filter knows is looked up in the shard's exact keys, so a false positive never drops a line. Filters and
keys are broadcast while there are at most ``bound`` keys; beyond that they stay where their shard is, and lines travel
to them, hot shards being dealt out by salts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .columns import arrow_map, documents, mix, numbered, slices, starts, texts
from .scratch import stash

#: Shards of the exact table; each has a filter of its own, and its keys have to fit in a task.
SHARDS = 64
#: Keys that may be broadcast: 16 bytes each, and about 4 in the filters.
BROADCAST_KEYS = 2_000_000
#: Ways that lines of one shard are dealt out, where they travel to it.
SALTS = 16
BLANK = " \t\n\v\f\r"


class CuckooFilter:
    """Set of 64-bit hashes with deletion: two buckets of four 16-bit fingerprints for each hash."""

    SLOTS, KICKS = 4, 500

    def __init__(self, capacity: int):
        self.buckets = 1 << max(1, int(capacity / 0.8 / self.SLOTS)).bit_length()
        self.table = np.zeros((self.buckets, self.SLOTS), np.uint16)

    @classmethod
    def of(cls, hashes: np.ndarray) -> CuckooFilter:
        """A filter of all the hashes; it grows until they fit."""
        size = len(hashes)
        while True:
            out = cls(size)
            if all(out.insert(int(h)) for h in hashes):
                return out
            size = 2 * size + 8

    @classmethod
    def read(cls, data: bytes) -> CuckooFilter:
        out = cls.__new__(cls)
        out.table = np.frombuffer(data, np.uint16).reshape(-1, cls.SLOTS).copy()
        out.buckets = len(out.table)
        return out

    def tobytes(self) -> bytes:
        return self.table.tobytes()

    @staticmethod
    def places(h: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints and both buckets of hashes; ``mask`` is the number of buckets less one."""
        mark = ((h >> np.uint64(48)) | np.uint64(1)).astype(np.uint16)
        one = h & mask
        return mark, one.astype(np.int64), (one ^ (mix(mark.astype(np.uint64)) & mask)).astype(np.int64)

    def _place(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.places(np.asarray(h, np.uint64), np.uint64(self.buckets - 1))

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(np.asarray(mark, np.uint64)) & np.uint64(self.buckets - 1)).astype(np.int64)

    def insert(self, h: int) -> bool:
        """False if there is no room; the filter must then be built anew from the exact table."""
        mark, one, two = (x[0] for x in self._place(np.array([h], np.uint64)))
        for b in (one, two):
            free = np.flatnonzero(self.table[b] == 0)
            if len(free):
                self.table[b, free[0]] = mark
                return True
        at = two
        for kick in range(self.KICKS):
            slot = kick % self.SLOTS
            mark, self.table[at, slot] = self.table[at, slot], mark
            at = self._other(np.array([at]), np.array([mark]))[0]
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return True
        return False

    def delete(self, h: int) -> bool:
        """Takes out one copy of a hash that was inserted."""
        mark, one, two = (x[0] for x in self._place(np.array([h], np.uint64)))
        for b in (one, two):
            found = np.flatnonzero(self.table[b] == mark)
            if len(found):
                self.table[b, found[0]] = 0
                return True
        return False

    def contains(self, h: np.ndarray) -> np.ndarray:
        mark, one, two = self._place(h)
        return ((self.table[one] == mark[:, None]) | (self.table[two] == mark[:, None])).any(axis=1)


def split_lines(array: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Lines of each text: their number, all of them, and their keys as pairs of longs (0, 0 for a blank line)."""
    lists = pc.split_pattern(texts(array), "\n")
    flat = lists.flatten()
    keys = pc.ascii_lower(pc.ascii_trim(flat, BLANK)).to_pylist()
    digest = xxhash.xxh3_128_digest
    zero = bytes(16)
    pairs = np.frombuffer(b"".join([digest(k) if k else zero for k in keys]), np.int64).reshape(-1, 2)
    return lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), flat, pairs


def count_references(docs: DataFrame) -> DataFrame:
    """The reference counts of ``docs(doc_id, text, ...)``: (k1, k2, n), n being the number of its rows with a line of that
    key. Null and empty texts and blank lines have no key; repeated rows count each for itself; an empty table has no rows."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                counts, _, pairs = split_lines(part.column("text"))
                doc = np.repeat(np.arange(len(counts)), counts)
                full = pairs.any(axis=1)
                doc, pairs = doc[full], pairs[full]
                order = np.lexsort((pairs[:, 1], pairs[:, 0], doc))
                doc, pairs = doc[order], pairs[order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (pairs[1:] != pairs[:-1]).any(axis=1)
                yield pa.record_batch({"k1": pa.array(pairs[new, 0]), "k2": pa.array(pairs[new, 1])})

    return arrow_map(documents(docs).select("text"), keys, "k1 long, k2 long").groupBy("k1", "k2").agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class LineIndex:
    """Reference counts (k1, k2, n), and for each shard with keys to be dropped (shard, filter, keys): the filter's
    table, and the exact keys in order."""

    counts: DataFrame
    shards: DataFrame
    least: int
    n_shards: int

    @classmethod
    def empty(cls, spark: SparkSession, least: int = 10, n_shards: int = SHARDS) -> LineIndex:
        """The index of no documents; choose ``n_shards`` so that a shard's keys fit in a task."""
        return cls(spark.createDataFrame([], "k1 long, k2 long, n long"), spark.createDataFrame([], "shard int, filter binary, keys binary"), least, n_shards)

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index after ``docs(doc_id, text, ...)`` came in; as for `count_references`, each row is a document."""
        return self._changed(count_references(docs))

    def delete(self, docs: DataFrame) -> LineIndex:
        """The index after ``docs``, which had come in before, went out; keys without references go too."""
        return self._changed(count_references(docs).withColumn("n", -F.col("n")))

    def write(self, path: str) -> None:
        """Writes both tables below ``path``."""
        self.counts.write.parquet(f"{path}/counts")
        self.shards.write.parquet(f"{path}/shards")

    @classmethod
    def read(cls, spark: SparkSession, path: str, least: int = 10, n_shards: int = SHARDS) -> LineIndex:
        """An index that `write` wrote, with the threshold and number of shards that it was made with."""
        return cls(spark.read.parquet(f"{path}/counts"), spark.read.parquet(f"{path}/shards"), least, n_shards)

    def _changed(self, delta: DataFrame) -> LineIndex:
        old = self.counts.select("k1", "k2", "n", F.col("n").alias("before"))
        both = old.unionByName(delta.select("k1", "k2", "n", F.lit(0).cast("long").alias("before")))
        both = both.groupBy("k1", "k2").agg(F.sum("n").alias("n"), F.sum("before").alias("before"))
        both = stash(both.where("n > 0 or before > 0"), "line-counts")
        shard = F.pmod("k2", F.lit(self.n_shards)).cast("int").alias("shard")
        moved = both.select(shard, "k1", "k2", (F.col("n") >= self.least).alias("now"), (F.col("before") >= self.least).alias("was")).where("now <> was")
        shards = moved.groupBy("shard").cogroup(self.shards.groupBy("shard")).applyInArrow(_moved, "shard int, filter binary, keys binary")
        return LineIndex(both.where("n > 0").select("k1", "k2", "n"), stash(shards.where("octet_length(keys) > 0"), "line-shards"), self.least, self.n_shards)


def _moved(moved: pa.Table, shard: pa.Table) -> pa.Table:
    """A shard after keys came in or went out: its filter is updated key by key, and only made anew if it is full."""
    known = np.frombuffer(shard.column("keys")[0].as_py(), np.int64).reshape(-1, 2) if shard.num_rows else np.zeros((0, 2), np.int64)
    number = (moved if moved.num_rows else shard).column("shard")[0].as_py()
    both = np.stack([moved.column(c).to_numpy().astype(np.int64) for c in ("k1", "k2")], axis=1) if moved.num_rows else np.zeros((0, 2), np.int64)
    comes = moved.column("now").to_numpy().astype(bool) if moved.num_rows else np.zeros(0, bool)
    gone = set(map(tuple, both[~comes].tolist()))
    kept = known[[tuple(k) not in gone for k in known.tolist()]] if gone else known
    keys = np.concatenate((kept, both[comes]))
    keys = keys[np.lexsort((keys[:, 1], keys[:, 0]))]
    own = CuckooFilter.read(shard.column("filter")[0].as_py()) if shard.num_rows else CuckooFilter(len(keys))
    fits = all(own.delete(k) for k in both[~comes, 0].view(np.uint64).tolist()) and all(own.insert(k) for k in both[comes, 0].view(np.uint64).tolist())
    if not fits:
        own = CuckooFilter.of(keys[:, 0].copy().view(np.uint64))
    return pa.table({"shard": pa.array([number], pa.int32()), "filter": pa.array([own.tobytes()], pa.binary()), "keys": pa.array([keys.tobytes()], pa.binary())})


class _Dropped:
    """Looks up keys: in their shards' filters first, in the exact keys then. ``rows`` are (shard, filter, keys)."""

    def __init__(self, rows: list[tuple[int, bytes, bytes]], n_shards: int):
        tables = [np.frombuffer(f, np.uint16).reshape(-1, CuckooFilter.SLOTS) for _, f, _ in rows]
        self.n_shards = n_shards
        self.table = np.concatenate([*tables, np.zeros((1, CuckooFilter.SLOTS), np.uint16)])
        self.first, self.mask = np.full(n_shards, len(self.table) - 1), np.zeros(n_shards, np.uint64)
        at = 0
        for (shard, _, _), table in zip(rows, tables, strict=True):
            self.first[shard], self.mask[shard] = at, len(table) - 1
            at += len(table)
        keys = np.frombuffer(b"".join(k for _, _, k in rows), np.int64).reshape(-1, 2)
        self.keys = keys[np.lexsort((keys[:, 1], keys[:, 0]))]
        self.most = int(np.unique(self.keys[:, 0], return_counts=True)[1].max()) if len(keys) else 0

    def __call__(self, pairs: np.ndarray) -> np.ndarray:
        out = np.zeros(len(pairs), bool)
        at = np.flatnonzero(pairs.any(axis=1))
        h, shard = pairs[at, 0].view(np.uint64), pairs[at, 1] % self.n_shards
        mark, one, two = CuckooFilter.places(h, self.mask[shard])
        known = (self.table[self.first[shard] + one] == mark[:, None]) | (self.table[self.first[shard] + two] == mark[:, None])
        at = at[known.any(axis=1)]
        if len(at):
            spot = np.searchsorted(self.keys[:, 0], pairs[at, 0])
            for i in range(self.most):
                out[at] |= (self.keys[np.minimum(spot + i, len(self.keys) - 1)] == pairs[at]).all(axis=1)
        return out


def _rewrite(part: pa.RecordBatch, text: str, dropped: np.ndarray, counts: np.ndarray, flat: pa.Array, report: bool) -> pa.RecordBatch:
    """Rows with their dropped lines taken out of the text; with ``report``, also their number of lines and of those."""
    lost = np.add.reduceat(dropped, starts(counts)[:-1]).astype(np.int64) if len(counts) else np.zeros(0, np.int64)
    ends = starts(counts - lost).astype(np.int32)
    kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), flat.filter(pa.array(~dropped))), "\n")
    names = part.schema.names
    columns = [kept if c == text else part.column(c) for c in names]
    if report:
        columns, names = [*columns, pa.array(counts), pa.array(lost)], [*names, "n_lines", "n_dropped"]
    return pa.record_batch(columns, names=names)


def dedup_lines(docs: DataFrame, index: LineIndex | None = None, least: int = 10, bound: int = BROADCAST_KEYS, report: bool = False) -> DataFrame:
    """Drops each line whose key at least ``least`` documents of the index hold, in every document.

    A key is the line without ASCII white space at both ends, A-Z lower-cased; blank lines have none and stay. Without an
    ``index`` it is that of ``docs``; with one, its threshold holds. Returns ``docs`` with its columns, text being the
    lines kept, joined by a newline; with ``report``: doc_id, text, n_lines, n_dropped. A null or empty text is one blank
    line and becomes an empty text; whole texts are taken, however long. Repeated rows are documents of their own, an
    empty table gives no rows; other columns, whatever their names, pass through, as does a null doc_id.
    """
    spark = docs.sparkSession
    index = LineIndex.empty(spark, least).insert(docs) if index is None else index
    names = ["doc_id", "text"] if report else docs.columns
    own, _, text = numbered(documents(docs) if report else docs)
    if not report:
        own = own.withColumn(text, F.col(text).cast("string"))
    schema = StructType([StructField(f.name, f.dataType) for f in own.schema] + [StructField(c, LongType()) for c in ("n_lines", "n_dropped") if report])
    n_keys = index.shards.agg(F.sum(F.octet_length("keys"))).first()[0] or 0
    if n_keys > 16 * bound:
        out = _travelling(own, text, index, schema, report)
    else:
        shared = spark.sparkContext.broadcast([(r.shard, bytes(r.filter), bytes(r["keys"])) for r in index.shards.collect()])

        def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = _Dropped(shared.value, index_shards)
            for batch in batches:
                for part in slices(batch, text):
                    lines, flat, pairs = split_lines(part.column(text))
                    yield _rewrite(part, text, known(pairs), lines, flat, report)

        index_shards = index.n_shards
        out = arrow_map(own, drop, schema)
    return out.toDF(*names, *(("n_lines", "n_dropped") if report else ()))


def _travelling(docs: DataFrame, text: str, index: LineIndex, schema: StructType, report: bool) -> DataFrame:
    """The same without a broadcast: lines travel to their shard, and the numbers of dropped lines to their documents.

    Documents are named by 128 bits of a hash of all they are; equal rows lose equal lines.
    """
    columns, n_shards = docs.columns, index.n_shards
    one, two = F.xxhash64(F.lit("one"), *columns), F.xxhash64(F.lit("two"), *columns)
    docs = docs.withColumn("row1", one).withColumn("row2", two)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                lines, _, pairs = split_lines(part.column(text))
                full = pairs.any(axis=1)
                number = (np.arange(len(pairs)) - np.repeat(starts(lines)[:-1], lines))[full]
                rows = [np.repeat(part.column(c).to_numpy(), lines)[full] for c in ("row1", "row2")]
                shard, salt = (pairs[full, 1] % n_shards).astype(np.int32), (rows[0] % SALTS).astype(np.int32)
                yield pa.record_batch({"shard": pa.array(shard), "salt": pa.array(salt), "kind": pa.array(np.ones(len(salt), np.int32)), "row1": pa.array(rows[0]), "row2": pa.array(rows[1]),
                                       "number": pa.array(number), "k1": pa.array(pairs[full, 0]), "k2": pa.array(pairs[full, 1])})

    lines = arrow_map(docs.select("row1", "row2", text), explode, "shard int, salt int, kind int, row1 long, row2 long, number long, k1 long, k2 long")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    state = index.shards.select("shard", salts, F.lit(0).alias("kind"), "filter", "keys")
    both = lines.unionByName(state, allowMissingColumns=True).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known = None, None
        for batch in batches:
            shard, kind = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], (shard[1:] != shard[:-1]) | (kind[1:] == 0), [True]))) if len(shard) else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(a, b - a)
                if kind[a] == 0:
                    now = int(shard[a])
                    known = _Dropped([(now, part.column("filter")[0].as_py(), part.column("keys")[0].as_py())], n_shards)
                    part = part.slice(1)
                if now == shard[a] and part.num_rows:
                    pairs = np.stack([part.column(c).to_numpy().astype(np.int64) for c in ("k1", "k2")], axis=1)
                    yield part.filter(pa.array(known(pairs))).select(["row1", "row2", "number"])

    gone = arrow_map(both, look_up, "row1 long, row2 long, number long").groupBy("row1", "row2").agg(F.collect_set("number").alias("gone"))
    both = docs.join(gone, ["row1", "row2"], "left").select(*columns, "gone")

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                lists = pc.split_pattern(texts(part.column(text)), "\n")
                counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                dropped = np.zeros(int(counts.sum()), bool)
                for first, gone in zip(starts(counts)[:-1], part.column("gone").to_pylist(), strict=True):
                    dropped[[first + g for g in gone or ()]] = True
                yield _rewrite(part.drop_columns(["gone"]), text, dropped, counts, lists.flatten(), report)

    return arrow_map(both, drop, schema)


def sha256(array: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(x.encode()).hexdigest() for x in array.to_pylist()], pa.string())
