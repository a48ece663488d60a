"""Operator 10: substring deduplication by super-k-mer partitioning.

A window is ``k`` consecutive words. Its minimiser is the smallest hash among its runs of ``m`` words; consecutive
windows that share it travel together, as one packed string (a super-k-mer), to the minimiser's bucket. There all equal
windows meet, and sorting them by 128 bits of hash finds which of them start earlier elsewhere. A bucket with very many
windows is sorted in several passes, each of them over one share of the hashes, so that equal windows stay together.

Windows that repeat within a slice of documents are known to be repeats at once: only the earliest of them travels, so
that a passage that a third of all documents share reaches its bucket once a slice and not once a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .columns import arrow_map, coded, documents, hashes, mix, numbered, slices, starts, words
from .lines import sha256

#: Words of a run whose hash may be the minimiser; k - m + 1 runs lie in a window.
RUN = 4
#: Text from which repeats are taken out before anything travels.
SLICE_BYTES = 4 << 20
#: Parts of a bucket; one at a time is in memory.
PARTS = 4
#: Windows that are sorted at once, about (40 bytes each, and as much again for sorting), and text unpacked at once.
PASS_WINDOWS, UNPACKED_BYTES = 1_500_000, 2 << 20
#: Compression of what travels.
LEVEL = 3
_LAST = np.iinfo(np.int64).max
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _rolled(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` values: a polynomial modulo 2**64, by prefix sums."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    powers = np.ones(len(h), np.uint64)
    powers[1:] = _FACTOR
    np.multiply.accumulate(powers, out=powers)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * powers, dtype=np.uint64)))
    back = np.ones(n, np.uint64)
    back[1:] = _INVERSE
    np.multiply.accumulate(back, out=back)
    return mix((sums[size:] - sums[:-size]) * back)


def _smallest(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` consecutive values."""
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[: len(x) - span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def _repeats(key: np.ndarray, codes: np.ndarray, at: np.ndarray, owner: np.ndarray, k: int) -> np.ndarray:
    """Which windows have an equal one that is earlier.

    ``at`` is where each window starts in ``codes``; windows stand in order, earliest first. Equal ``owner`` means the
    same place of a repeated row: such windows are no earlier than each other. Equal hashes are compared word by word.
    """
    order = np.argsort(key, kind="stable")
    later = np.zeros(len(key), bool)
    while len(order) > 1:
        same = key[order[1:]] == key[order[:-1]]
        group = np.concatenate(([0], np.cumsum(~same)))
        lone = np.bincount(group)[group] > 1
        order, group = order[lone], group[lone]
        if not len(order):
            break
        head = order[np.concatenate(([True], group[1:] != group[:-1]))]
        head = head[np.concatenate(([0], np.cumsum(group[1:] != group[:-1])))]
        equal = np.ones(len(order), bool)
        for i in range(k):
            equal &= codes[at[order] + i] == codes[at[head] + i]
        later[order[equal]] = owner[order[equal]] != owner[head[equal]]
        order = order[~equal]
    return later


def _runs(mask: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each run of true values; a run also ends before each true ``cut``."""
    at = np.flatnonzero(mask)
    if not len(at):
        return at, at
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | cut[at[1:]]
    first = at[new]
    return first, np.diff(np.concatenate((np.flatnonzero(new), [len(at)])))


def _places(spark, n: int) -> list[int]:
    """For each of n partitions, a number that Spark's hash partitioning sends there."""
    rows = spark.range(40 * n).selectExpr("id", f"pmod(hash(cast(id as int)), {n}) as p").groupBy("p").agg(F.min("id").alias("id")).collect()
    found = {r.p: r.id for r in rows}
    return [int(found.get(p, p)) for p in range(n)]


def _scatter(k: int, places: list[int]):
    import zstandard

    def pack(head: np.ndarray, text: bytes) -> bytes:
        return zstandard.ZstdCompressor(level=LEVEL).compress(np.int64(len(head)).tobytes() + np.ascontiguousarray(head.T).tobytes() + text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                ids = part.column("doc_id")
                doc = pc.fill_null(ids, _LAST).to_numpy(zero_copy_only=False)
                row = part.column("row").to_numpy()
                order = np.lexsort((row, doc))
                doc, row = doc[order], row[order]
                counts, flat = words(part.column("text").take(pa.array(order)))
                codes, distinct = coded(flat)
                n = len(codes) - k + 1
                if n <= 0:
                    continue
                h = hashes(distinct)[codes]
                first = starts(counts)
                owner = np.repeat(np.arange(len(counts)), counts)
                inside = owner[:n] == owner[k - 1 :]
                start = np.arange(n) - first[owner[:n]]
                at = np.flatnonzero(inside)
                if not len(at):
                    continue
                same_row = np.concatenate(([0], np.cumsum((doc[1:] != doc[:-1]) | (row[1:] != row[:-1]))))
                key = _rolled(h, k)
                places_ = (same_row[owner[at]].astype(np.int64) << 32) | start[at]
                late = _repeats(key[at], codes, at, places_, k)
                low = _smallest(_rolled(h, RUN), k - RUN + 1)
                known = np.zeros(n, bool)
                known[at[late]] = True
                edge = np.zeros(n, bool)
                edge[1:] = owner[1:n] != owner[: n - 1]
                out: list[tuple[int, int, int, bytes]] = []
                begin, size = _runs(known, edge)
                if len(begin):
                    head = np.stack([doc[owner[begin]], row[owner[begin]], start[begin], size], axis=1).astype(np.int64)
                    out.append((places[int(head[0, 1]) % len(places)], -1, int(size.sum()), pack(head, b"")))
                fresh = inside & ~known
                edge[1:] |= low[1:] != low[:-1]
                begin, size = _runs(fresh, edge)
                if len(begin):
                    spot = mix(low[begin] + np.uint64(1))
                    goal = (spot % np.uint64(len(places) * PARTS)).astype(np.int64)
                    order = np.argsort(goal, kind="stable")
                    begin, size, goal = begin[order], size[order], goal[order]
                    offsets = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + len(flat) + 1].astype(np.int64)
                    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat), " ")[0].as_buffer().to_pybytes()
                    offsets = offsets - offsets[0] + np.arange(len(offsets))
                    head = np.stack([doc[owner[begin]], row[owner[begin]], start[begin], size], axis=1).astype(np.int64)
                    pieces = [joined[a:b] for a, b in zip(offsets[begin].tolist(), (offsets[begin + size + k - 1] - 1).tolist(), strict=True)]
                    cuts = np.flatnonzero(np.concatenate(([True], goal[1:] != goal[:-1], [True])))
                    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                        out.append((places[int(goal[a]) // PARTS], int(goal[a]) % PARTS, int(size[a:b].sum()), pack(head[a:b], b"\n".join(pieces[a:b]))))
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["bucket", "part", "windows", "data"])

    return run


def _gather(k: int):
    import zstandard

    def spans(doc: np.ndarray, row: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((row, doc))
        doc, row, both = doc[order], row[order], np.stack([start[order], size[order]], axis=1).astype(np.int32)
        cuts = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (doc[1:] != doc[:-1]), [True])))
        return pa.record_batch({"doc": pa.array(doc[cuts[:-1]]), "row": pa.array(row[cuts[:-1]]), "spans": pa.array([both[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})

    def unpack(data: bytes) -> tuple[np.ndarray, bytes]:
        raw = zstandard.ZstdDecompressor().decompress(data)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        return np.frombuffer(raw, np.int64, 4 * n, 8).reshape(4, n), raw[8 * (1 + 4 * n) :]

    def windows(held: list[bytes]) -> Iterator[np.ndarray]:
        """Two hashes, doc, row and start of each window, for a few packed strings at a time."""
        heads, strings, size = [], [], 0
        for i, data in enumerate(held):
            head, text = unpack(data)
            heads.append(head)
            strings.append(text)
            size += len(text)
            if size < UNPACKED_BYTES and i + 1 < len(held):
                continue
            head = np.concatenate(heads, axis=1)
            packed = pc.split_pattern(pa.array([s.decode() for s in strings], pa.large_string()), "\n").flatten()
            codes, distinct = coded(pc.split_pattern(packed, " ").flatten())
            own = hashes(distinct)
            length = head[3]
            begin, string = starts(length + k - 1)[:-1], np.repeat(np.arange(head.shape[1]), length)
            step = np.arange(int(length.sum())) - np.repeat(starts(length)[:-1], length)
            at = begin[string] + step
            one, two = _rolled(own[codes], k)[at], _rolled(mix(own ^ _FACTOR)[codes], k)[at]
            yield np.stack([one.view(np.int64), two.view(np.int64), head[0, string], head[1, string], head[2, string] + step])
            heads, strings, size = [], [], 0

    def sort(held: list[bytes], total: int) -> Iterator[pa.RecordBatch]:
        passes = -(-total // PASS_WINDOWS)
        for p in range(passes):
            share = [w if passes == 1 else w[:, w[0].view(np.uint64) % np.uint64(passes) == np.uint64(p)] for w in windows(held)]
            one, two, doc, row, start = np.concatenate(share, axis=1)
            del share
            order = np.argsort(one, kind="stable")
            twice = one[order[1:]] == one[order[:-1]]
            order = order[np.concatenate((twice, [False])) | np.concatenate(([False], twice))]
            one, two, doc, row, start = (x[order] for x in (one, two, doc, row, start))
            order = np.lexsort((start, row, doc, two, one))
            one, two, doc, row, start = (x[order] for x in (one, two, doc, row, start))
            if not len(order):
                continue
            new = np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])))
            head = np.flatnonzero(new)[np.cumsum(new) - 1]
            late = (doc != doc[head]) | (row != row[head]) | (start != start[head])
            if not late.any():
                continue
            doc, row, start = doc[late], row[late], start[late]
            order = np.lexsort((start, row, doc))
            doc, row, start = doc[order], row[order], start[order]
            new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]) | (start[1:] > start[:-1] + 1)))
            first = np.flatnonzero(new)
            last = np.concatenate((first[1:], [len(row)])) - 1
            yield spans(doc[first], row[first], start[first], start[last] - start[first] + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, total = None, [], 0
        for batch in batches:
            for bucket, part, n, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "part", "windows", "data")), strict=True):
                if part < 0:
                    yield spans(*unpack(data)[0])
                    continue
                if (bucket, part) != now and held:
                    yield from sort(held, total)
                    held, total = [], 0
                now = (bucket, part)
                held.append(data)
                total += n
        if held:
            yield from sort(held, total)

    return run


def repeated_spans(docs: DataFrame, k: int = 20) -> DataFrame:
    """Windows of ``docs(doc_id, row, text)`` that start earlier elsewhere: (doc, row, spans), spans being (start, number
    of windows) as pairs of 32-bit integers; doc is doc_id, or the largest long for a null one."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = arrow_map(docs, _scatter(k, _places(spark, n)), "bucket int, part int, windows long, data binary")
    found = arrow_map(found.repartition(n, "bucket").sortWithinPartitions("bucket", "part"), _gather(k), "doc long, row long, spans binary")
    return found.groupBy("doc", "row").agg(F.collect_list("spans").alias("spans"))


def dedup_substrings(docs: DataFrame, k: int = 20, report: bool = False) -> DataFrame:
    """Removes each word that lies in a window of ``k`` words whose word sequence also starts earlier: in a document of
    smaller doc_id, or earlier in the same one. Windows are judged on the input, not on what is left.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; whole texts are taken, however long. Returns ``docs`` with its columns; a
    text that loses words becomes its kept words joined by one space, the others stay as they are. With ``report``: doc_id,
    n_words, n_removed, kept_sha256 (of the kept words joined by one space, for all texts). Null and empty texts have no
    words and stay. doc_id is an integer of any width; a null one counts as the largest. Rows of equal doc_id and text
    are one document that is judged alike each time; rows of equal doc_id and other text are ordered by a hash of it. Other
    columns, whatever their names, pass through; an empty table gives no rows. Windows are compared by 128 bits of hash.
    """
    names = docs.columns
    own, key, text = numbered(documents(docs) if report else docs)
    columns = own.columns
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" if report else StructType([StructField(f.name, f.dataType) for f in own.schema])
    own = own.withColumn("doc", F.coalesce(F.col(key).cast("long"), F.lit(_LAST))).withColumn("row", F.xxhash64(F.col(key).cast("long"), text))
    spans = repeated_spans(own.select(F.col(key).cast("long").alias("doc_id"), "row", F.col(text).cast("string").alias("text")), k)
    both = own.join(spans, ["doc", "row"], "left").select(*columns, "spans")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                counts, flat = words(part.column(text))
                at = starts(counts)
                change = np.zeros(len(flat) + 1, np.int64)
                touched = np.zeros(len(counts), bool)
                for i, spans in enumerate(part.column("spans").to_pylist()):
                    if spans:
                        both = np.frombuffer(b"".join(spans), np.int32).reshape(-1, 2).astype(np.int64)
                        np.add.at(change, at[i] + both[:, 0], 1)
                        np.add.at(change, at[i] + both[:, 0] + both[:, 1] + k - 1, -1)
                        touched[i] = True
                keep = np.cumsum(change[:-1]) == 0
                left = np.diff(np.concatenate(([0], np.cumsum(keep, dtype=np.int64)))[at])
                kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts(left).astype(np.int32)), flat.filter(pa.array(keep))), " ")
                if report:
                    yield pa.record_batch({"doc_id": part.column(key), "n_words": pa.array(counts), "n_removed": pa.array(counts - left), "kept_sha256": sha256(kept)})
                else:
                    changed = pc.if_else(pa.array(touched), kept, part.column(text))
                    yield pa.record_batch([changed if c == text else part.column(c) for c in columns], names=columns)

    out = arrow_map(both, remove, schema)
    return out if report else out.toDF(*names)
