"""Operator 1: n-gram Jaccard join by set-relation skipping.

Documents become sets of word shingles; two sets link when their Jaccard similarity reaches the threshold. The join is
exact and never lists the pairs of a group:

1. A sketch of shingle frequencies (a table of fixed size, summed over all documents) orders shingles, rare ones first.
2. Equal sets collapse into one. Each distinct set enters the index lists of its prefix: as many of its first shingles
   as two linked sets must share one of.
3. Index-level skipping: an entry knows its position and the set's size; entries whose positions leave too few shingles
   for the needed overlap are skipped before anything is compared (`_reach`).
4. Answer-level skipping: in each list the entry nearest to the front (the set with fewest rare shingles of its own)
   answers first. Sets that link with it take over its answers: they are known to be connected, so that only entries
   outside its component are compared with the list. A hot group of near copies costs one comparison a set this way.
5. Pairs that remain pass a parity sketch, whose Hamming distance never exceeds the size of the symmetric difference,
   and are then compared shingle by shingle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .columns import arrow_map, coded, documents, hashes, mix, numbered, slices, starts, words
from .components import connected
from .scratch import discard, stash

#: Counters of the frequency sketch as a power of two; it has 4 bytes for each, whatever the corpus.
SKETCH_BITS = 20
#: The sketch is summed in this many pieces, by at most so many tasks, of which so many groups are summed first.
PIECES, SUMMERS, GROUPS = 16, 16_384, 128
#: Bits of a shingle's hash that are compared; the bits above order shingles by frequency, in sixteenths of an octave.
HASH_BITS = 54
#: Bits of the parity sketch of a set, at least; large sets have about one for each two shingles.
PARITY_BITS = 512
#: Bits of a block of the Bloom filters that pick lists with two entries or more, and documents to be compared in full.
BLOCK_BITS = 1 << 21
#: Names that a filter is made for, at most (64 MB); beyond that nothing is filtered, and joins alone decide.
BLOOM_NAMES = 1 << 25

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingles(array: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles (A-Z lower-cased), with repeats: their number for each text, and all in one array.

    A text of fewer words than ``width`` has its whole sequence as one shingle, a text without words has none.
    """
    counts, flat = words(array, lower=True)
    codes, distinct = coded(flat)
    h = hashes(distinct)[codes]
    at = starts(counts)
    grams = np.maximum(counts - width + 1, np.minimum(counts, 1))
    out = np.zeros(int(grams.sum()), np.uint64)
    doc = np.repeat(np.arange(len(counts)), grams)
    first = at[:-1][doc] + (np.arange(len(out)) - starts(grams)[:-1][doc])
    length = np.minimum(counts, width)[doc]
    factors = np.resize(_ODD, width) * (np.arange(width, dtype=np.uint64) // np.uint64(len(_ODD)) * np.uint64(2) + np.uint64(1))
    for i in range(width):
        has = length > i
        if has.all():
            out += mix(h[first + i] + factors[i])
        else:
            out[has] += mix(h[first[has] + i] + factors[i])
    return grams, mix(out + length.astype(np.uint64))


def _buckets(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _frequencies(docs: DataFrame, width: int) -> np.ndarray:
    """How often shingles fall into each of 2**SKETCH_BITS counters, over all documents.

    A tree of sums: at most SUMMERS tasks make a sketch each (of the narrowest whole numbers that hold its counts), GROUPS
    of them are summed for each of the pieces, and those sums once more. No reducer reads more than its share of a
    fixed size, whatever the number of documents; 8 MB come to the driver.
    """
    size = (1 << SKETCH_BITS) // PIECES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.uint64)
        some = False
        for batch in batches:
            for part in slices(batch, "text"):
                some = True
                total += np.bincount(_buckets(shingles(part.column("text"), width)[1]), minlength=len(total)).astype(np.uint64)
        if some:
            group = TaskContext.get().partitionId() % GROUPS
            yield _pieces(dict(enumerate(total.reshape(PIECES, size))), group)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for piece, group, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = sums.setdefault((group, piece), np.zeros(size, np.uint64))
                own += np.frombuffer(counts, f"<u{len(counts) // size}")
        for (group, piece), counts in sums.items():
            yield _pieces({piece: counts}, group)

    schema = "piece int, part int, counts binary"
    rows = arrow_map(docs.select("text").coalesce(SUMMERS), count, schema)
    rows = arrow_map(rows.repartition("piece", "part"), add, schema)
    rows = arrow_map(rows.repartition("piece"), lambda batches: add(b.set_column(1, "part", pa.array([0] * b.num_rows, pa.int32())) for b in batches), schema).collect()
    total = np.zeros((PIECES, size), np.uint64)
    for r in rows:
        total[r.piece] += np.frombuffer(r.counts, f"<u{len(r.counts) // size}")
    return total.ravel()


def _pieces(counts: dict[int, np.ndarray], group: int) -> pa.RecordBatch:
    most = max(int(x.max()) for x in counts.values())
    kind = next(f"<u{w}" for w in (1, 2, 4, 8) if most < 1 << 8 * w)
    return pa.record_batch({"piece": pa.array(counts, pa.int32()), "part": pa.array([group] * len(counts), pa.int32()), "counts": pa.array([x.astype(kind).tobytes() for x in counts.values()], pa.binary())})


def _overlap(percent: int, total: np.ndarray | int) -> np.ndarray | int:
    """The least intersection of two linked sets whose sizes add up to ``total``: ceil(p * total / (100 + p))."""
    return (percent * total + 99 + percent) // (100 + percent)


def _sets(docs: DataFrame, width: int, percent: int, order: np.ndarray) -> DataFrame:
    """One row for each document: its columns but text, number of shingles, the set's name (128 bits), its prefix and its
    parity sketch.

    Prefix and sketch stand at the first row of each name in a task only.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_ranks(order))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    own_columns = [c for c in docs.columns if c != "text"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                out: tuple[list, ...] = ([], [], [], [], [])
                for own in _token_sets(part.column("text"), width, shared.value):
                    values = [len(own), None, None, None, None]
                    if len(own):
                        name = xxhash.xxh3_128_digest(own)
                        values[1:3] = np.frombuffer(name, np.int64).tolist()
                        if name not in seen:
                            seen.add(name)
                            size = max(PARITY_BITS, 1 << (len(own) // 2).bit_length())
                            bits = np.bincount((mix(own) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
                            values[3:] = own[: len(own) - (percent * len(own) + 99) // 100 + 1].tobytes(), np.packbits(bits.astype(np.uint8)).tobytes()
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
                columns = [pa.array(x, t) for x, t in zip(out, kinds, strict=True)]
                yield pa.record_batch([*map(part.column, own_columns), *columns], names=[*own_columns, "n_shingles", "k1", "k2", "tokens", "parity"])

    return arrow_map(docs, build, "".join(f"{c} long, " for c in own_columns) + "n_shingles long, k1 long, k2 long, tokens binary, parity binary")


def _whole(docs: DataFrame, width: int, order: np.ndarray, wanted: DataFrame) -> DataFrame:
    """All shingles (sid, tokens) of the sets in ``wanted(sid, k1, k2)``."""
    shared = docs.sparkSession.sparkContext.broadcast((_ranks(order), _bloom(wanted.select("k1"))))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, bloom = shared.value
        seen: set[bytes] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                sets = list(_token_sets(part.column("text"), width, ranks))
                all_names = [xxhash.xxh3_128_digest(own) for own in sets]
                first = np.frombuffer(b"".join(all_names), np.int64)[::2]
                asked = np.ones(len(sets), bool) if bloom is None else _has(bloom, first)
                names, tokens = [], []
                for own, name, wanted_here in zip(sets, all_names, asked.tolist(), strict=True):
                    if wanted_here and len(own) and name not in seen:
                        seen.add(name)
                        names.append(name)
                        tokens.append(own.tobytes())
                keys = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
                yield pa.record_batch({"k1": pa.array(keys[:, 0]), "k2": pa.array(keys[:, 1]), "tokens": pa.array(tokens, pa.binary())})

    found = arrow_map(docs.select("text"), build, "k1 long, k2 long, tokens binary")
    return found.join(wanted, ["k1", "k2"]).groupBy("sid").agg(F.first("tokens").alias("tokens"))


def _ranks(order: np.ndarray) -> np.ndarray:
    return np.floor(16 * np.log2(np.maximum(order, 1))).astype(np.uint64) << np.uint64(HASH_BITS)


def _token_sets(array: pa.Array, width: int, ranks: np.ndarray) -> Iterator[np.ndarray]:
    """The distinct shingles of each text, those of rare counters first."""
    counts, grams = shingles(array, width)
    tokens = ranks[_buckets(grams)] | (grams & np.uint64((1 << HASH_BITS) - 1))
    at = starts(counts).tolist()
    for a, b in zip(at[:-1], at[1:], strict=True):
        own = np.sort(tokens[a:b])
        yield own[np.concatenate(([True], own[1:] != own[:-1]))] if len(own) > 1 else own


def _spots(names: np.ndarray, bits: int) -> list[np.ndarray]:
    """Where a name is marked: in one block of the filter, at three places."""
    h = mix(names.astype(np.int64).view(np.uint64))
    block = (h >> np.uint64(40)).astype(np.int64) % (bits // BLOCK_BITS) * BLOCK_BITS
    g = mix(h + np.uint64(1))
    return [block + ((g >> np.uint64(s)) & np.uint64(BLOCK_BITS - 1)).astype(np.int64) for s in (0, 21, 42)]


def _has(bloom: np.ndarray, names: np.ndarray) -> np.ndarray:
    found = np.ones(len(names), bool)
    for spot in _spots(names, 8 * len(bloom)):
        found &= (bloom[spot >> 3] >> (spot & 7).astype(np.uint8) & 1).astype(bool)
    return found


def _bloom(names: DataFrame) -> np.ndarray | None:
    """A Bloom filter over a column of longs, of 16 bits a name; None for more than BLOOM_NAMES of them.

    Names are dealt out by their block, and each block is made where its names are: what moves is the names once, and
    the driver gets the filter alone.
    """
    n = names.count()
    if n > BLOOM_NAMES:
        return None
    blocks = max(1, -(-16 * n // BLOCK_BITS))
    bits = blocks * BLOCK_BITS

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for spot in _spots(batch.column("name").to_numpy(), bits):
                block = spot // BLOCK_BITS
                for b in np.unique(block).tolist():
                    own.setdefault(b, np.zeros(BLOCK_BITS, bool))[spot[block == b] % BLOCK_BITS] = True
        for b, seen in own.items():
            yield pa.record_batch({"block": pa.array([b], pa.int32()), "bits": pa.array([np.packbits(seen, bitorder="little").tobytes()], pa.binary())})

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.record_batch({"name": pa.array(name), "block": pa.array((_spots(name, bits)[0] // BLOCK_BITS).astype(np.int32))})

    out = np.zeros(bits // 8, np.uint8)
    dealt = arrow_map(names, placed, "name long, block int").repartition("block")
    for r in arrow_map(dealt, fill, "block int, bits binary").collect():
        out[r.block * BLOCK_BITS // 8 : (r.block + 1) * BLOCK_BITS // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def _reach(percent: int, n: str, i: str, m: str, j: str) -> str:
    """SQL: sets of n and m shingles that meet first at positions i and j (from 0) can still overlap enough."""
    return f"least({n} - {i}, {m} - {j}) * {100 + percent}L >= {percent}L * ({n} + {m})"


def _apart(p, q) -> int:
    """Hamming distance of two parity sketches; the longer one is folded, half upon half, to the other's length."""
    x, y = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def _links(pairs: DataFrame, docs: DataFrame, sets: DataFrame, width: int, percent: int, order: np.ndarray) -> DataFrame:
    """Those of the pairs (a, b) of sets that do link: parity sketches first, whole sets then."""
    parity = sets.select("sid", "n_shingles", "parity")
    for side in "ab":
        pairs = pairs.join(parity.select(F.col("sid").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("parity").alias(f"p_{side}")), side)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                apart = np.fromiter((_apart(x.as_buffer(), y.as_buffer()) for x, y in zip(batch.column("p_a"), batch.column("p_b"), strict=True)), np.int64, batch.num_rows)
                total = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
                yield batch.select(["a", "b"]).filter(pa.array(apart <= total - 2 * _overlap(percent, total)))

    pairs = stash(arrow_map(pairs, near, "a long, b long"), "pairs")
    names = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    wanted = stash(sets.select("sid", "k1", "k2").join(names, "sid", "left_semi"), "wanted")
    texts = stash(_whole(docs, width, order, wanted), "sets")
    both = pairs
    for side in "ab":
        both = both.join(texts.select(F.col("sid").alias(side), F.col("tokens").alias(f"t_{side}")), side)

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("t_a"), batch.column("t_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate((x, y)), kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * common >= percent * (len(both) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    out = stash(arrow_map(both, same, "a long, b long"), "answered")
    discard(pairs, wanted, texts)
    return out


def _grouped(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs(doc_id, text, ...)``, whose other columns are longs, without their text: with n_shingles and a set's
    name (k1, k2), null without shingles; and the sets: k1, k2, the root of their group, and the smallest doc_id in it."""
    order = _frequencies(docs, width)
    every = stash(_sets(docs, width, percent, order), "shingled")
    first = [F.first(c, ignorenulls=True).alias(c) for c in ("n_shingles", "tokens", "parity")]
    sets = every.where("k1 is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("least"), *first)
    sets = stash(sets.withColumn("sid", F.monotonically_increasing_id()), "distinct")

    def index(bloom: np.ndarray | None) -> DataFrame:
        """The entries of all lists; of those in the filter only, if there is one."""
        shared = docs.sparkSession.sparkContext.broadcast(bloom)

        def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column("tokens").to_pylist()
                counts = np.array([len(x) // 8 for x in lists], np.int64)
                token = np.frombuffer(b"".join(lists), np.int64)
                keep = np.ones(len(token), bool) if shared.value is None else _has(shared.value, token)
                pos = np.arange(counts.sum()) - np.repeat(starts(counts)[:-1], counts)
                yield pa.record_batch({
                    "token": pa.array(token[keep]), "pos": pa.array(pos[keep].astype(np.int32)),
                    "sid": pa.array(np.repeat(batch.column("sid").to_numpy(), counts)[keep]), "n": pa.array(np.repeat(batch.column("n_shingles").to_numpy(), counts)[keep].astype(np.int32)),
                })

        return arrow_map(sets.select("sid", "n_shingles", "tokens"), entries, "token long, pos int, sid long, n int")

    heads = index(None).groupBy("token").agg(F.count("*").alias("many"), F.min(F.struct("pos", "sid", "n")).alias("head")).where("many > 1")
    heads = stash(heads.select("token", F.col("head.pos").alias("h_pos"), F.col("head.sid").alias("h_sid"), F.col("head.n").alias("h_n")), "heads")
    # Most shingles stand in one list only; the filter keeps nearly all of those from travelling a second time.
    lists = stash(index(_bloom(heads.select("token"))).join(heads, "token"), "lists")
    near_head = lists.where("sid <> h_sid and " + _reach(percent, "n", "pos", "h_n", "h_pos"))
    links = _links(near_head.select(F.col("sid").alias("a"), F.col("h_sid").alias("b")).distinct(), docs, sets, width, percent, order)
    roots = connected(links)

    known = lists
    for name in ("sid", "h_sid"):
        known = known.join(roots.select(F.col("node").alias(name), F.col("root").alias(f"r_{name}")), name, "left")
    # Linked sets differ in size by one band at most, so a list falls apart into bands.
    known = known.select("token", "pos", "sid", "n", F.coalesce("r_sid", "sid").alias("root"), F.coalesce("r_h_sid", "h_sid").alias("h_root"), _band(percent, F.col("n")).alias("band"))
    open_lists = known.where("root <> h_root").withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    others = known.select("token", "band", *[F.col(c).alias(f"o_{c}") for c in ("pos", "sid", "n", "root")])
    rest = open_lists.join(others, ["token", "band"]).where("root <> o_root and (o_root = h_root or sid < o_sid) and " + _reach(percent, "n", "pos", "o_n", "o_pos"))
    rest = rest.select(F.least("sid", "o_sid").alias("a"), F.greatest("sid", "o_sid").alias("b")).distinct()
    more = _links(rest, docs, sets, width, percent, order)
    roots = connected(links.unionByName(more))

    named = sets.select("k1", "k2", "sid", "least").join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    named = named.join(named.groupBy("root").agg(F.min("least").alias("component")), "root").select("k1", "k2", "root", "component")
    return every.drop("tokens", "parity"), named


def jaccard_groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Groups of documents linked by a Jaccard similarity of ``percent`` / 100 or more of their word shingles.

    Takes ``docs(doc_id, text, ...)``, doc_id being an integer of any width; other columns, whatever their names, are left
    aside. Returns one row for each row of ``docs``: doc_id, n_shingles (size of its set), component_id (smallest doc_id
    reachable by links). Words are split at ASCII white space, with A-Z lower-cased; whole texts are taken, however long.
    Null, empty and blank texts have no shingles, link with nothing and are their own component. Repeated rows are equal
    sets and so linked; rows of one doc_id and unlike texts are sets of their own. Rows with a null doc_id take part, but
    name no component unless nothing else could (then it is null). An empty table gives no rows. Shingles are compared by
    54 bits of a hash, and sets are named by 128.
    """
    docs = documents(docs)
    every, named = _grouped(documents(docs), width, percent)
    component = F.when(F.col("k1").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return every.join(named, ["k1", "k2"], "left").select("doc_id", "n_shingles", component.alias("component_id"))


def dedup_groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with their columns, of which one stays of each group that `jaccard_groups` finds.

    It is the row of the smallest doc_id, a null one being the largest; among rows of one doc_id a hash decides, and of
    rows with equal doc_id and text any one stays. Rows are told apart by doc_id and text, so that a doc_id used twice
    loses no text. Texts without words are in no group, and all stay, repeated or not. Other columns, whatever their names,
    pass through; an empty table gives no rows.
    """
    names = docs.columns
    own, key, text = numbered(docs)
    columns = own.columns
    doc, said = F.col(key).cast("long"), F.col(text).cast("string")
    own = own.withColumn("h1", F.xxhash64(doc, said)).withColumn("h2", F.xxhash64(F.lit("second"), said, doc))
    bare = ~F.coalesce(said, F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    full = own.where(~bare)
    every, named = _grouped(full.select(doc.alias("doc_id"), said.alias("text"), "h1", "h2"), width, percent)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h1", "h2")).alias("first")
    # Of each set first, which is many rows, then of each group.
    of_set = every.groupBy("k1", "k2").agg(first).join(named.select("k1", "k2", "root"), ["k1", "k2"])
    kept = of_set.groupBy("root").agg(F.min("first").alias("first")).select("first.h1", "first.h2")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Repeated rows of a task go, so that they don't meet in one task later."""
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            keep = []
            for name in zip(batch.column("h1").to_pylist(), batch.column("h2").to_pylist(), strict=True):
                keep.append(name not in seen)
                seen.add(name)
            yield batch.filter(pa.array(keep, pa.bool_()))

    full = arrow_map(full, once, StructType([StructField(f.name, f.dataType) for f in full.schema]))
    rows = full.join(stash(kept, "kept"), ["h1", "h2"]).dropDuplicates(["h1", "h2"])
    return rows.select(columns).unionByName(own.where(bare).select(columns)).toDF(*names)


def _band(percent: int, n: Column) -> Column:
    """Sizes whose ratio is ``percent`` / 100 or more are in the same band or in neighbouring ones."""
    if percent >= 100:
        return n.cast("long")
    return F.floor(F.log(n) / F.lit(1.001 * math.log(100 / percent)))
