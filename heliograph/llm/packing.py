"""Operator 2: packing by concatenate and cut.

Pass one tokenizes each document once and keeps its ids with the place where they start in their partition; the totals
of the partitions, summed up, give each partition its global offset. Pass two cuts the stream at every multiple of the
sequence length. Only the windows that two partitions share (boundary records) have to be brought together.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import arrow_map, documents, slices, starts, texts
from .scratch import stash

#: Text whose distinct words are encoded together.
SLICE_BYTES = 4 << 20
#: Fixed value: how byte-level vocabularies of this family cut a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_INK = r"[^\s\x0b\x1c-\x1f\x{85}\p{Z}]"
#: Texts where a cut before a blank may change the outcome, and words without white space at either end.
ODD = rf"{_SPACE} ({_SPACE}|\z)"
CLEAN = rf"\A{_INK}(?:(?s:.*){_INK})?\z"


def _bytes_of(letters: str, table: dict[str, int]) -> bytes:
    return bytes(table[c] for c in letters)


def _letter_table() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _checked(model: dict, ranks: dict[bytes, int], table: dict[str, int]) -> None:
    """Raises for a file whose ids this module wouldn't reproduce: another model, another cut of texts, merges that
    aren't in the order of ids, or ids beyond 16 bits."""
    before = model.get("pre_tokenizer") or {}
    if model["model"].get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or model.get("normalizer") or not before.get("use_regex", True):
        raise ValueError("not a byte-level BPE file of the supported family")
    if any(model["model"].get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")):
        raise ValueError("options of this BPE file aren't supported")
    merges = [_bytes_of("".join(m if isinstance(m, list) else m.split(" ")), table) for m in model["model"]["merges"]]
    order = [ranks[m] for m in merges]
    if order != sorted(order) or len(set(ranks.values())) != len(ranks) or not all(bytes([b]) in ranks for b in range(256)) or {m for m in ranks if len(m) > 1} != set(merges):
        raise ValueError("merges and ids of this BPE file disagree")
    if max(ranks.values()) >= 1 << 16:
        raise ValueError("ids beyond 16 bits aren't supported")


class WordTokenizer:
    """Ids of a byte-level BPE file, by distinct words.

    A text may be cut before each blank that doesn't follow white space: no token reaches over such a place. The distinct
    words of a slice of texts are encoded in one call, joined by blanks; where each word's ids end follows from the bytes
    that its ids stand for. Texts with runs of white space around which a cut could change the outcome are encoded whole,
    and words with white space at an end by themselves. Control strings in texts are ordinary text.
    """

    def __init__(self, path: str):
        import tiktoken

        table = _letter_table()
        model = json.load(open(path, encoding="utf-8"))
        special = {x["content"] for x in model["added_tokens"]}
        ranks = {_bytes_of(k, table): v for k, v in model["model"]["vocab"].items() if k not in special}
        _checked(model, ranks, table)
        self.encoding = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for data, i in ranks.items():
            self.sizes[i] = len(data)

    def _whole(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype(np.uint16) if text else np.zeros(0, np.uint16)

    def _table(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each of the words with a blank before it: where they begin, with the end, and all of them."""
        clean = pc.fill_null(pc.match_substring_regex(distinct, CLEAN), False)
        flags = clean.to_numpy(zero_copy_only=False)
        plain = distinct if flags.all() else distinct.filter(clean)
        ids, ends = np.zeros(0, np.uint16), np.zeros(0, np.int64)
        if len(plain):
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(plain)], pa.int32()), plain), " ")[0].as_py()
            ids = self._whole(" " + joined)
            bytes_to = np.cumsum(self.sizes[ids])
            ends = np.searchsorted(bytes_to, np.cumsum(pc.binary_length(plain).to_numpy(zero_copy_only=False).astype(np.int64) + 1)) + 1
        counts = np.zeros(len(distinct), np.int64)
        counts[flags] = np.diff(ends, prepend=0)
        other = [self._whole(" " + w) for w in distinct.filter(pc.invert(clean)).to_pylist()] if not flags.all() else []
        counts[~flags] = [len(x) for x in other]
        if not other:
            return starts(counts), ids
        # Both kinds stand in the order of the words.
        at, out = starts(counts), np.zeros(int(counts.sum()), np.uint16)
        of_plain = np.repeat(flags, counts)
        out[of_plain], out[~of_plain] = ids, np.concatenate(other)
        return at, out

    def __call__(self, array: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts, each ended by ``end``: their number for each text, and all of them."""
        whole = np.flatnonzero(pc.match_substring_regex(array, ODD).to_numpy(zero_copy_only=False))
        lists = pc.split_pattern(array, " ")
        if len(whole):
            mask = np.zeros(len(array), bool)
            mask[whole] = True
            lists = pc.split_pattern(pc.if_else(pa.array(mask), "", array), " ")
        n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten()
        first = starts(n)[:-1]
        heads = [self._whole(w) for w in flat.take(pa.array(first)).to_pylist()]
        for i in whole.tolist():
            heads[i] = self._whole(array[i].as_py())
        packed = flat.dictionary_encode()
        codes = packed.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        at, ids = self._table(packed.dictionary)
        # After the table of words come the texts' first words, and the id that ends each text.
        more = np.fromiter(map(len, heads), np.int64, len(heads))
        ids = np.concatenate([ids, *heads, np.array([end], np.uint16)])
        sizes = np.concatenate((np.diff(at), more, [1]))
        codes[first] = len(at) - 1 + np.arange(len(n))
        codes = np.insert(codes, first + n, len(sizes) - 1)
        at, own = starts(sizes), sizes[codes]
        out = starts(own)
        return np.add.reduceat(own, first + np.arange(len(n))), ids[np.arange(out[-1]) - np.repeat(out[:-1] - at[codes], own)]


@cache
def load(path: str) -> WordTokenizer:
    """A worker's tokenizer of that file, kept over tasks."""
    return WordTokenizer(path)


def tokenize(docs: DataFrame, path: str, end: int = 0) -> DataFrame:
    """(doc_id, part, start, n, ids): each document's ids, ended by ``end``, and where they start in their partition."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, tokenizer = TaskContext.get().partitionId(), 0, load(path)
        for batch in batches:
            for rows in slices(batch, "text", SLICE_BYTES):
                counts, ids = tokenizer(texts(rows.column("text")), end)
                ends = starts(counts)
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer((2 * ends).astype(np.int64)), pa.py_buffer(ids.astype("<u2"))])
                yield pa.record_batch({"doc_id": rows.column("doc_id"), "part": pa.array(np.full(len(counts), part, np.int32)), "start": pa.array(at + ends[:-1]), "n": pa.array(counts), "ids": packed.cast(pa.binary())})
                at += int(ends[-1])

    return arrow_map(documents(docs), encode, "doc_id long, part int, start long, n long, ids binary")


def _offsets(tokens: DataFrame) -> dict[int, int]:
    """Global offset of each partition: one number for each task of pass one comes to the driver."""
    totals = sorted(map(tuple, tokens.groupBy("part").agg(F.sum("n")).collect()))
    ends = np.cumsum([t for _, t in totals])
    return {p: int(e) - t for (p, t), e in zip(totals, ends, strict=True)}


def pack(docs: DataFrame, path: str, length: int = 1024, end: int = 0) -> DataFrame:
    """Packs documents into sequences of ``length`` ids without gaps; only the last one is shorter.

    Returns one row for each piece of a document: doc_id, start (its document's ids before it), length, ids_crc32 (of
    its ids as unsigned little-endian 32-bit numbers), doc_tokens (of its document, with ``end``), sequence_id, offset
    (in the sequence), ids (unsigned 16-bit). A null or empty text is one id, ``end``. Repeated rows are packed each for
    itself; a null doc_id stays null. Other columns, whatever their names, are left aside; an empty table gives no rows.
    """
    tokens = stash(tokenize(docs, path, end), "tokens")
    shared = docs.sparkSession.sparkContext.broadcast(_offsets(tokens))
    kinds = [pa.int64()] * 7 + [pa.binary()]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, part, start, n, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "part", "start", "n", "ids")), strict=True):
                base, at = shared.value[part] + start, 0
                wide = np.frombuffer(ids, "<u2").astype("<u4").tobytes()
                while at < n:
                    window, offset = divmod(base + at, length)
                    size = min(n - at, length - offset)
                    rows.append((doc, at, size, zlib.crc32(wide[4 * at : 4 * (at + size)]), n, window, offset, ids[2 * at : 2 * (at + size)]))
                    at += size
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds], names=names)

    return arrow_map(tokens, cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def sequences(docs: DataFrame, path: str, length: int = 1024, end: int = 0) -> DataFrame:
    """The packed sequences themselves: (sequence_id, n, ids).

    Windows that lie within a partition are whole at once; the boundary records that are left, two a partition at most,
    are the only rows that are shuffled.
    """
    pieces = pack(docs, path, length, end)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window, offset, held = None, 0, []

        def out() -> pa.RecordBatch:
            return pa.record_batch({"sequence_id": pa.array([window]), "offset": pa.array([offset], pa.int64()), "ids": pa.array([b"".join(held)], pa.binary())})

        for batch in batches:
            for w, o, ids in zip(*(batch.column(c).to_pylist() for c in ("sequence_id", "offset", "ids")), strict=True):
                if w != window or o != offset + sum(map(len, held)) // 2:
                    if held:
                        yield out()
                    window, offset, held = w, o, []
                held.append(ids)
        if held:
            yield out()

    parts = arrow_map(pieces, fill, "sequence_id long, offset long, ids binary")
    whole = F.octet_length("ids") == 2 * length
    edge = parts.where(~whole).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    edge = edge.select("sequence_id", F.expr("aggregate(p, cast('' as binary), (a, x) -> a || x.ids)").alias("ids"))
    both = parts.where(whole).select("sequence_id", "ids").unionByName(edge)
    return both.select("sequence_id", (F.octet_length("ids") / 2).cast("long").alias("n"), "ids")
