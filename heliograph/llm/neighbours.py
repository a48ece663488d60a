"""Operator 6: approximate nearest neighbours by multi-index hashing.

Rotations are learned on a bounded sample (iterative quantization) and turn each vector into a long binary code, which is
cut into substrings of 16 bits. Each substring is indexed: an entry (substring, value) leads to the rows that hold it.
A query probes every value within ``reach`` bits of its own, in each substring, so that by the pigeonhole principle every
row whose code is within a Hamming radius of substrings * (reach + 1) - 1 is retrieved (and many beyond it). What is
retrieved is reranked by the exact cosine of the original vectors. Each task indexes the rows that it has; queries come to
the rows, block by block, so that nothing but the best few rows for each query is shuffled.

Number of substrings and reach are chosen by the true neighbours of a few sampled rows: enough of them have to be
retrieved, by as few candidates as possible. Equal vectors are indexed once, whatever the number of rows that hold them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import arrow_map
from .scratch import stash

#: Vectors that rotations and numbers are learned from, and queries among them.
SAMPLE, SAMPLE_QUERIES = 4096, 256
#: Bits of a substring, and of the part of a code that one rotation gives; rotations at most.
SUB, TURN, TURNS = 16, 64, 32
#: Substrings may differ in so many bits at most.
MOST_REACH = 4
#: Recall that is promised, and by how many standard deviations of what so many queries measure it has to be exceeded.
RECALL, MARGIN = 0.9, 3
#: Queries that are broadcast at once; rows that are indexed at once, about; pairs scored at once, about.
BLOCK, CHUNK, PAIRS = 8192, 16_384, 16_384
#: Vectors of a length that fewer rows have aren't indexed, but compared with all queries of that length.
INDEXED = 1000


def fit_rotation(x: np.ndarray, seed: int, bits: int = TURN, rounds: int = 10) -> np.ndarray:
    """A (dim, bits) matrix whose signs code unit vectors: directions, turned until they are nearest to signs.

    Seed 0 begins with the main directions of ``x``, others with random ones.
    """
    rng = np.random.default_rng(seed)
    dim = x.shape[1]
    if seed:
        axes, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
    else:
        axes = np.linalg.svd(x, full_matrices=True)[2].T
    base = axes[:, : min(bits, dim)]
    if bits > dim:
        base = np.hstack([base, rng.standard_normal((dim, bits - dim)) / np.sqrt(dim)])
    v = x @ base
    r, _ = np.linalg.qr(rng.standard_normal((bits, bits)))
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.sign(v @ r).T @ v)
        r = (u @ w).T
    return base @ r


@dataclass(frozen=True)
class Codes:
    """Learned codes: rotations side by side, how many substrings count, how many bits of one a probe may change; and,
    on the sample, the share of true neighbours and of all rows that this retrieves."""

    rotation: np.ndarray
    substrings: int
    reach: int
    recall: float
    candidates: float

    def of(self, x: np.ndarray) -> np.ndarray:
        """Values of the substrings of unit vectors, as (n, substrings)."""
        return substrings_of(x, self.rotation)[:, : self.substrings]

    def masks(self) -> np.ndarray:
        """What a probe changes: all values of up to ``reach`` bits."""
        return np.array([sum(1 << b for b in c) for r in range(self.reach + 1) for c in combinations(range(SUB), r)], np.uint16)


def substrings_of(x: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    return np.packbits(x @ rotation > 0, axis=1, bitorder="little").view(np.uint16)


def cover(k: int, queries: int) -> float:
    """The share of true neighbours to be retrieved so that the recall measured on so many queries is RECALL at least."""
    p = np.linspace(RECALL, 1, 1001)
    return float(p[np.argmax(p - MARGIN * np.sqrt(p * (1 - p) / (k * max(1, queries))) >= RECALL)])


def fit_codes(x: np.ndarray, query: np.ndarray, near: np.ndarray, enough: float) -> Codes:
    """Codes for unit vectors like the sample ``x``: of all numbers of substrings and reaches that retrieve a share
    ``enough`` of the pairs of a query and one of its true neighbours, those of fewest candidates; if there are none,
    those that retrieve most."""
    rotation = np.hstack([fit_rotation(x, seed) for seed in range(TURNS)])
    codes, asked = substrings_of(x, rotation), substrings_of(query, rotation)
    other = np.random.default_rng(1).integers(0, len(x), (len(query), 16))
    least = {"true": np.bitwise_count(asked ^ substrings_of(near, rotation)), "any": np.bitwise_count(asked[:, None] ^ codes[other]).reshape(-1, codes.shape[1])}
    found: list[tuple] = []
    for reach in range(MOST_REACH + 1):
        share = {name: np.logical_or.accumulate(far <= reach, axis=1).mean(axis=0) for name, far in least.items()}
        reached = np.flatnonzero(share["true"] >= enough)
        m = int(reached[0]) if len(reached) else codes.shape[1] - 1
        found.append((not len(reached), share["any"][m] if len(reached) else -share["true"][m], reach, m + 1, float(share["true"][m]), float(share["any"][m])))
    _, _, reach, m, recall, candidates = min(found)
    return Codes(rotation, m, reach, recall, candidates)


def usable(vector: Column) -> Column:
    """Neither null nor zero, and without null or non-finite components."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(good, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _unit(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    column = table.column("v")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])  # a power of two: nothing is rounded
    return x, np.sqrt((x * x).sum(axis=1))


def _numbers(column: pa.Array, kind) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind)


def _top(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query: highest score first, then smallest id."""
    order = np.lexsort((ids, -score, query))
    first = np.concatenate(([True], query[order][1:] != query[order][:-1])) if len(order) else np.zeros(0, bool)
    rank = np.arange(len(order)) - np.flatnonzero(first)[np.cumsum(first) - 1] if len(order) else np.zeros(0, int)
    return order[rank < k]


class _Best:
    """The k best rows so far of each query of a block, by the cosine of the original vectors."""

    def __init__(self, names: np.ndarray, vectors: np.ndarray, norms: np.ndarray, k: int):
        order = np.argsort(names, kind="stable")
        self.names, self.vectors, self.norms, self.k = names[order], vectors[order], norms[order], k
        self.held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def add(self, row: np.ndarray, query: np.ndarray, vectors: np.ndarray, norms: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Scores pairs (row, name of a query); a row has ``sizes`` ids."""
        at, begin = np.searchsorted(self.names, query), np.concatenate(([0], np.cumsum(sizes)))
        for a in range(0, len(row), PAIRS):
            r, q = row[a : a + PAIRS], at[a : a + PAIRS]
            # Row by row, so that equal vectors have equal scores.
            score = (vectors[r] * self.vectors[q]).sum(axis=1) / (norms[r] * self.norms[q])
            own = sizes[r]
            ends = np.cumsum(own)
            name = ids[np.arange(ends[-1]) + np.repeat(begin[r] - ends + own, own)]
            query_, score = np.repeat(self.names[q], own), np.repeat(score, own)
            other = name != query_
            new = [np.concatenate((h, x[other])) for h, x in zip(self.held, (query_, name, score), strict=True)]
            best = _top(*new, self.k)
            self.held = tuple(x[best] for x in new)

    def rows(self) -> pa.RecordBatch:
        query, name, score = self.held
        return pa.record_batch({"query_id": pa.array(query), "vec_id": pa.array(name), "score": pa.array(score)})


_FOUND = "query_id long, vec_id long, score double"


class MultiIndex:
    """Inverted tables of one chunk of rows: for each substring and value, the rows that hold it, found by address."""

    def __init__(self, values: np.ndarray, masks: np.ndarray):
        self.rows, self.masks = len(values), masks
        self.order = np.argsort(values, axis=0, kind="stable").T.astype(np.int32)
        counts = np.zeros((values.shape[1], (1 << SUB) + 1), np.int32)
        for s in range(values.shape[1]):
            counts[s, 1:] = np.bincount(values[:, s], minlength=1 << SUB)
        self.begin = np.cumsum(counts, axis=1, dtype=np.int32)

    def probe(self, value: np.ndarray) -> np.ndarray:
        """Every row that holds, in some substring, a value that differs from the query's in as many bits as masks allow."""
        near = value[:, None] ^ self.masks
        turn = np.arange(len(value))[:, None]
        first = self.begin[turn, near]
        size = self.begin[turn, near.astype(np.int64) + 1] - first
        first = (first + turn * self.rows)[size > 0]
        size = size[size > 0]
        ends = np.cumsum(size)
        seen = np.zeros(self.rows, bool)
        if len(ends):
            seen[self.order.ravel()[np.arange(ends[-1]) + np.repeat(first - ends + size, size)]] = True
        return np.flatnonzero(seen)


def _retrieved(vectors: DataFrame, asked: DataFrame, codes: Codes, k: int) -> DataFrame:
    """Best rows found by the index, for each query and task: (query_id, vec_id, score).

    A task indexes its rows, chunk by chunk, and probes them for a block of queries that is broadcast: rows don't move,
    and what does are k rows for each query and task.
    """
    out = vectors.sparkSession.createDataFrame([], _FOUND)
    blocks = -(-asked.count() // BLOCK)
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).select("query", "v").toArrow()
        if block.num_rows:
            x, norm = _unit(block)
            shared = vectors.sparkSession.sparkContext.broadcast((codes, block.column("query").to_numpy(), x, norm))

            def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                own, names, x, norm = shared.value
                masks, values = own.masks(), own.of(x / norm[:, None])
                best = _Best(names, x, norm, k)
                for chunk in _chunks(batches):
                    mine, mine_norm = _unit(chunk)
                    ids, sizes = _numbers(chunk.column("ids"), np.int64), pc.list_value_length(chunk.column("ids")).to_numpy()
                    index = MultiIndex(own.of(mine / mine_norm[:, None]), masks)
                    held, pairs = [], 0
                    for i in range(len(names)):
                        rows = index.probe(values[i])
                        held.append((rows, np.full(len(rows), names[i])))
                        pairs += len(rows)
                        if pairs >= PAIRS or i + 1 == len(names):
                            best.add(*(np.concatenate(x) for x in zip(*held, strict=True)), mine, mine_norm, ids, sizes)
                            held, pairs = [], 0
                yield best.rows()

            out = out.unionByName(arrow_map(vectors.select("v", "ids"), search, _FOUND))
    return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches brought together until a chunk is full."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= CHUNK:
            yield pa.Table.from_batches(held).combine_chunks()
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _fitted(vectors: DataFrame, sample: DataFrame, k: int, enough: float) -> Codes:
    """Codes for the vectors: rotations from the sample, numbers from the true neighbours, among all vectors, of a few of
    its rows. The sample and k * SAMPLE_QUERIES neighbours come to the driver."""
    sample = stash(sample, "sample")
    named = vectors.select("row", "v", F.array("row").alias("ids"))
    found = _compared(named, sample.limit(SAMPLE_QUERIES).select(F.col("row").alias("query"), "v"), k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    pairs = stash(found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "vec_id"), "pairs")
    pairs = pairs.join(vectors.select(F.col("row").alias("vec_id"), "v"), "vec_id").select("query_id", "v").toArrow()
    table = sample.toArrow()
    x, norm = _unit(table)
    x = x / norm[:, None]
    place = {r: i for i, r in enumerate(table.column("row").to_pylist())}
    near, norm = _unit(pairs)
    return fit_codes(x, x[[place[q] for q in pairs.column("query_id").to_pylist()]], near / norm[:, None], enough)


def _compared(vectors: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Best rows for each query and task by comparison with all rows; queries come in blocks of a fixed size."""
    out = vectors.sparkSession.createDataFrame([], _FOUND)
    blocks = -(-asked.count() // BLOCK)
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).select("query", "v").toArrow()
        if block.num_rows:
            shared = vectors.sparkSession.sparkContext.broadcast((block.column("query").to_numpy(), *_unit(block)))

            def compare(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                names, x, norm = shared.value
                best = _Best(names, x, norm, k)
                for batch in batches:
                    if batch.num_rows:
                        ids, sizes = _numbers(batch.column("ids"), np.int64), batch.column("ids").value_lengths().to_numpy()
                        mine = _unit(batch)
                        for r in range(0, batch.num_rows, 64):
                            row = np.arange(r, min(r + 64, batch.num_rows))
                            best.add(np.repeat(row, len(names)), np.tile(names, len(row)), *mine, ids, sizes)
                yield best.rows()

            out = out.unionByName(arrow_map(vectors.select("v", "ids"), compare, _FOUND))
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, chosen: list | None = None) -> DataFrame:
    """The ``k`` nearest rows of ``vectors(vec_id, v)`` by cosine for each row of ``queries(vec_id, v)``.

    Returns query_id, rank (from 1), vec_id, score (the cosine of the original vectors, in double precision); ties go to
    the smaller vec_id, and a row of the query's own vec_id is no candidate. Rows of a null vec_id and vectors that are
    null, empty, zero or hold null or non-finite components take no part; vectors of unlike length have no cosine, so a
    query meets those of its own length. Repeated rows are candidates each for itself; a vec_id that several queries have
    is answered once, for the smallest of their vectors. A query for which the index finds fewer than ``k`` rows is
    compared with all of them, so it has fewer only where there are no more. No queries or no rows give no rows.
    ``chosen``, if given, gets the `Codes` of each length that is indexed.
    """
    good = [t.where(F.col("vec_id").isNotNull() & usable(F.col("v"))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v")) for t in (vectors, queries)]
    # A vector's rows beyond the 2k of smallest id can't be among the k nearest of any query, whichever id that leaves out.
    rows = good[0].withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit("second"), "v"))
    for by in (["h1", "h2", "vec_id"], ["h1", "h2"]):
        rows = rows.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("vec_id"))).where(F.col("r") <= 2 * k)
    rows = rows.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    rows = stash(rows.select(F.monotonically_increasing_id().alias("row"), "h1", F.size("v").alias("n"), "v", "ids"), "vectors")
    asked = stash(good[1].groupBy(F.col("vec_id").alias("query")).agg(F.min("v").alias("v")).withColumn("n", F.size("v")), "queries")
    many = [r.n for r in rows.groupBy("n").count().where(F.col("count") >= INDEXED).join(asked.select("n").distinct(), "n").orderBy("n").collect()]
    parts = [_of_few(rows.where(~F.col("n").isin(many)), asked.where(~F.col("n").isin(many)), k)]
    for n in many:
        own, mine = rows.where(F.col("n") == n), asked.where(F.col("n") == n)
        share = SAMPLE / own.count()
        sample = own.where(F.abs(F.xxhash64("h1") / F.lit(float(1 << 63))) < share).select("row", "v").limit(2 * SAMPLE)
        codes = _fitted(own, sample, k, cover(k, mine.count()))
        if chosen is not None:
            chosen.append(codes)
        found = stash(_retrieved(own, mine, codes, k), "found")
        full = found.groupBy("query_id").agg(F.count("*").alias("m")).where(F.col("m") >= k).select("query_id")
        short = stash(mine.join(full.withColumnRenamed("query_id", "query"), "query", "left_anti"), "short")
        parts += [found.join(full, "query_id", "left_semi"), _compared(own, short, k)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _of_few(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """All pairs of equal length, for lengths that few rows have."""
    both = asked.join(rows.select("n", F.col("v").alias("w"), "ids"), "n")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for query, v, w, ids in zip(*(batch.column(c).to_pylist() for c in ("query", "v", "w", "ids")), strict=True):
                (x, y), (p, q) = _unit(pa.table({"v": pa.array([v, w])}))
                best = _Best(np.array([query]), x[None], np.array([p]), k)
                best.add(np.zeros(1, np.int64), np.array([query]), y[None], np.array([q]), np.array(ids), np.array([len(ids)]))
                yield best.rows()

    return arrow_map(both, score, _FOUND)
