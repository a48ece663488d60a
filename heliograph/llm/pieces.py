"""Operator 8: SentencePiece encoding and decoding by a shared-prefix forward pass.

Texts are cut into marked words (a word with the blanks before it). The distinct words of a slice are sorted, which
puts them in the order of a depth-first walk of their trie; the walk keeps the forward state of each character and goes
on from the longest prefix shared with the word before. For a unigram model the state is the Viterbi score and its last
piece. For a BPE model it is the last piece of the prefix's encoding: the only one that keeps its boundary when it is
merged with the piece before, which gives what merging by rank gives.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import arrow_map, documents, slices, starts, texts

MARK = "▁"
#: Pairs of pieces that a worker remembers.
CACHE_PAIRS = 400_000

#: Text whose distinct words are walked together.
SLICE_BYTES = 4 << 20


class PieceModel:
    """A model file's pieces; encodes words with shared prefixes, decodes ids."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        data = open(path, "rb").read()
        proto = sentencepiece_model_pb2.ModelProto.FromString(data)
        kind = proto.SentencePiece
        self.bpe = proto.trainer_spec.model_type == proto.trainer_spec.BPE
        spec = proto.normalizer_spec
        if spec.remove_extra_whitespaces or spec.precompiled_charsmap or not spec.escape_whitespaces:
            raise ValueError("models that normalize texts aren't supported")
        self.prefix = spec.add_dummy_prefix
        if any(p.type == kind.USER_DEFINED for p in proto.pieces):
            raise ValueError("models with user-defined pieces aren't supported")
        self.score = {p.piece: p.score for p in proto.pieces if p.type == kind.NORMAL}
        self.id = {p.piece: i for i, p in enumerate(proto.pieces) if p.piece in self.score}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == kind.UNKNOWN)
        byte = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kind.BYTE}
        self.byte = [byte[b] for b in range(256)] if len(byte) == 256 else None
        if self.byte is None and MARK not in self.score:
            raise ValueError("models without bytes and without a piece for a blank aren't supported")
        self.surface = [p.piece.replace(MARK, " ").encode() for p in proto.pieces]
        for b, i in byte.items():
            self.surface[i] = bytes([b])
        for i, p in enumerate(proto.pieces):
            if p.type in (kind.CONTROL,):
                self.surface[i] = b""
        self.surface[self.unknown] = " ⁇ ".encode()
        if any(MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError("pieces that reach over a blank aren't supported")
        #: Ends of pieces: nothing longer can be a piece where none of these stands.
        self.tails = set() if self.bpe else {p[i:] for p in self.score for i in range(len(p))}
        self.floor = array("f", [min(self.score.values()) - 10])[0]
        self.pairs: dict[tuple[str, str], bool] = {}
        #: One string object for each piece, which all pairs share.
        self.own = {p: p for p in self.score}

    def merged(self, text: str) -> list[str]:
        """Merges by rank, from the left: the plain way, for pairs of pieces."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _keeps(self, a: str, b: str) -> bool:
        """Whether the boundary between two pieces stays when both are merged."""
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        out = self.pairs[self.own.get(a, a), self.own.get(b, b)] = self.merged(a + b) == ([a, b] if a else [b])
        return out

    def walk(self, words: list[str]) -> Iterator[list[str]]:
        """Pieces of each of the words, which are sorted; states of shared prefixes are computed once."""
        last: list[str] = [""]  # for each length, the last piece of that prefix's encoding
        score = array("f", [0.0])  # sums are rounded to 32 bits, as the library's are
        sums = array("f", [0.0])
        pieces, tails, pairs, keeps, bpe, floor = self.score, self.tails, self.pairs, self._keeps, self.bpe, self.floor
        before = ""
        for word in words:
            shared = 0
            for x, y in zip(before, word, strict=False):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :], score[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                begin, piece = end - 1, word[end - 1]
                if bpe:  # exactly one piece keeps its boundary
                    while True:
                        if begin == end - 1 or piece in pieces:
                            known = pairs.get((last[begin], piece))
                            if keeps(last[begin], piece) if known is None else known:
                                break
                        begin -= 1
                        piece = word[begin:end]
                    last.append(piece)
                else:
                    sums[0] = score[begin] + pieces.get(piece, floor)
                    best, found = sums[0], piece
                    while begin and piece in tails:
                        begin -= 1
                        piece = word[begin:end]
                        s = pieces.get(piece)
                        if s is not None:
                            sums[0] = score[begin] + s
                            if sums[0] >= best:  # of equal sums, that of the longer last piece
                                best, found = sums[0], piece
                    last.append(found)
                    score.append(best)
            before, out, at = word, [], len(word)
            while at:
                out.append(last[at])
                at -= len(last[at])
            yield out[::-1]

    def ids(self, pieces: list[str]) -> bytes:
        """Ids of a word's pieces; what isn't a piece becomes bytes or, in a run of any length, one unknown piece."""
        out: list[int] = []
        run = False
        for p in pieces:
            i = self.id.get(p)
            if i is not None:
                out.append(i)
            elif self.byte is not None:
                out += [self.byte[b] for b in p.encode()]
            elif not run:
                out.append(self.unknown)
            run = i is None
        return array("i", out).tobytes()

    def table(self, words: list[str]) -> list[bytes]:
        """Ids, as 32-bit numbers, of distinct words."""
        new = sorted(words)
        found = dict(zip(new, map(self.ids, self.walk(new)), strict=True))
        return [found[w] for w in words]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without nulls: their number for each text, and all of them."""
        listed = column.to_pylist()
        odd = [i for i, t in enumerate(listed) if not t or t[0] == " " or "  " in t or MARK in t or not self.prefix]
        plain = pc.if_else(pa.array(np.isin(np.arange(len(column)), odd)), "", column)
        lists = pc.split_pattern(plain, " ")
        n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        packed = lists.flatten().dictionary_encode()
        codes = packed.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        chunks = {i: re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", (MARK if self.prefix else "") + listed[i].replace(" ", MARK)) if listed[i] else [] for i in odd}
        words = [MARK + w for w in packed.dictionary.to_pylist()]
        table = self.table([*words, *(more := sorted({w for c in chunks.values() for w in c} - set(words)))])
        at_more = {w: len(words) + i for i, w in enumerate(more)} | {w: i for i, w in enumerate(words)} if odd else {}
        first = starts(n)
        if odd:
            pieces, at = [], 0
            for i in odd:
                pieces += [codes[first[at] : first[i]], np.array([at_more[w] for w in chunks[i]], np.int64)]
                n[i], at = len(chunks[i]), i + 1
            codes = np.concatenate([*pieces, codes[first[at] :]])
        sizes = np.fromiter(map(len, table), np.int64, len(table)) // 4
        own, begin = sizes[codes], starts(sizes)
        out = starts(own)
        ids = np.frombuffer(b"".join(table), np.int32)[np.arange(out[-1]) - np.repeat(out[:-1] - begin[codes], own)]
        return np.diff(out[starts(n)]), ids

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        text = b"".join(map(self.surface.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


@cache
def load(path: str) -> PieceModel:
    """A worker's model of that file; its caches last over tasks."""
    return PieceModel(path)


def encode_pieces(docs: DataFrame, path: str) -> DataFrame:
    """Ids of each row of ``docs(doc_id, text, ...)``: (doc_id, n_ids, ids), ids as signed little-endian 32-bit numbers.

    A null or empty text has no ids. Repeated rows are encoded each for itself; other columns, whatever their names, are
    left aside; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                counts, ids = model.encode(texts(part.column("text")))
                at = starts(counts)
                raw = ids.astype("<i4").tobytes()
                yield pa.record_batch({"doc_id": part.column("doc_id"), "n_ids": pa.array(counts), "ids": pa.array([raw[4 * a : 4 * b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())})

    return arrow_map(documents(docs), run, "doc_id long, n_ids long, ids binary")


def decode_pieces(encoded: DataFrame, path: str) -> DataFrame:
    """Texts of ``encoded(doc_id, ids)``: (doc_id, n_ids, ids_crc32, text); null ids are none and give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            ids = [np.frombuffer(x or b"", "<i4") for x in batch.column("ids").to_pylist()]
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "n_ids": pa.array([len(x) for x in ids], pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()), "text": pa.array([model.decode(x) for x in ids], pa.string()),
            })

    return arrow_map(encoded.select("doc_id", "ids"), run, "doc_id long, n_ids long, ids_crc32 long, text string")
