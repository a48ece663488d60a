"""Scalar functions of the telemetry model."""

from __future__ import annotations

import hashlib
import struct
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import cbor

#: Severity numbers of level names, which are in lower case.
SEVERITY = {"trace": 1, "debug": 5, "info": 9, "warn": 13, "error": 17, "fatal": 21}


def severity_number(level: Column) -> Column:
    """The number of a level; 0 for any other text, upper case included."""
    out = F.when(level == "trace", SEVERITY["trace"])
    for name, number in list(SEVERITY.items())[1:]:
        out = out.when(level == name, number)
    return out.otherwise(0).cast("int")


def resource_id(attributes: Column, dropped: Column, schema_url: Column) -> Column:
    """``{k:v,...}|dropped|url`` with keys in order; ``attributes`` is a map of strings."""
    pairs = F.transform(F.array_sort(F.map_entries(attributes)), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}|"), dropped.cast("string"), F.lit("|"), schema_url)


def scope_id(name: Column, version: Column, attributes: Column, dropped: Column, schema_url: Column) -> Column:
    return F.concat(F.lit("name:"), name, F.lit("|version:"), version, F.lit("|"), resource_id(attributes, dropped, schema_url))


def typed_hash(*columns: Column) -> Column:
    """A hash of values with their types: equal texts of unlike types differ."""
    return F.xxhash64(*[F.struct(F.typeof(c), c) for c in columns])


def _bytes_of(value: object) -> bytes:
    if isinstance(value, bool):
        return b"\x01" if value else b"\x00"
    if isinstance(value, int):
        return struct.pack("<q", value)
    if isinstance(value, float):
        return struct.pack("<d", value)
    if isinstance(value, str):
        return value.encode()
    if isinstance(value, bytes):
        return value
    if isinstance(value, dict):
        return b"".join(k.encode() + _bytes_of(v) for k, v in sorted(value.items()))
    if isinstance(value, list):
        return b"".join(map(_bytes_of, value))
    return b""


def data_point_signature(start: int, time: int, attributes: dict, without: str) -> bytes:
    """Little-endian start and time, then keys in order with the bytes of their values; one key is left out."""
    return struct.pack("<QQ", start, time) + _bytes_of({k: v for k, v in attributes.items() if k != without})


def plain_value(v) -> object:
    """A tagged value as a Python value; serialized ones are decoded."""
    kind = v["type"]
    if kind in (5, 6):
        return cbor.decode(bytes(v["ser"]))
    x = v[("none", "str", "int", "double", "bool", "none", "none", "bytes")[kind]] if kind else None
    return bytes(x) if kind == 7 else int(x) if kind == 2 else bool(x) if kind == 4 else x


def signature(start: Column, time: Column, attributes: Column, without: str) -> Column:
    """`data_point_signature` of columns; ``attributes`` is a map of tagged values."""

    @F.pandas_udf("binary")
    def run(starts: pd.Series, times: pd.Series, maps: pd.Series) -> pd.Series:
        rows = zip(starts.fillna(0), times.fillna(0), maps, strict=True)
        return pd.Series([data_point_signature(int(s), int(t), {e["key"]: plain_value(e["value"]) for e in m}, without) for s, t, m in rows])

    return run(start, time, F.coalesce(F.map_entries(attributes), F.array()))


#: Printable ASCII characters are enciphered among themselves, and all others among the others.
_LOW, _HIGH, _SURROGATES = 0x20, 0x7F, (0xD800, 0xE000)
_ASCII = _HIGH - _LOW
_OTHERS = 0x110000 - (_SURROGATES[1] - _SURROGATES[0]) - _ASCII


def _digit(c: int) -> tuple[int, int]:
    """A code point as a number below the size of its alphabet, and that size."""
    if _LOW <= c < _HIGH:
        return c - _LOW, _ASCII
    c -= _SURROGATES[1] - _SURROGATES[0] if c >= _SURROGATES[1] else 0
    return c - (_ASCII if c >= _HIGH else 0), _OTHERS


def _point(digit: int, size: int) -> int:
    if size == _ASCII:
        return digit + _LOW
    c = digit + (_ASCII if digit >= _LOW else 0)
    return c + (_SURROGATES[1] - _SURROGATES[0] if c >= _SURROGATES[0] else 0)


@lru_cache(maxsize=64)
def _keyed(key: bytes) -> tuple:
    """The two hashes of an HMAC, with the key taken in; they are copied for each message."""
    own = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return hashlib.sha256(bytes(b ^ 0x36 for b in own)), hashlib.sha256(bytes(b ^ 0x5C for b in own))


def _pad(key: bytes, number: int, half: list[int], size: int) -> tuple[int, ...]:
    """Numbers, ``size`` at least, that one half, the round and the key determine."""
    inner, outer = _keyed(key)
    seed = struct.pack(f">{len(half)}I", *half)
    out = []
    for block in range(-(-size // 4)):
        h, o = inner.copy(), outer.copy()
        h.update(struct.pack(">II", number, block) + seed)
        o.update(h.digest())
        out.append(o.digest())
    return struct.unpack(f">{4 * len(out)}Q", b"".join(out))


def _feistel(digits: list[int], sizes: list[int], key: bytes, rounds: int, back: bool) -> list[int]:
    """A Feistel network over digits of given alphabets: in each round one half is shifted by a pad made of the other."""
    cut = len(digits) // 2
    halves, alphabets = [digits[:cut], digits[cut:]], [sizes[:cut], sizes[cut:]]
    for r in range(rounds - 1, -1, -1) if back else range(rounds):
        own, other = r % 2, 1 - r % 2
        pad = _pad(key, r, halves[other], len(halves[own]))
        halves[own] = [(d - p if back else d + p) % n for d, p, n in zip(halves[own], pad, alphabets[own])]  # noqa: B905  pads are whole blocks
    return halves[0] + halves[1]


def encipher(value: str | bytes, key: bytes, back: bool = False, rounds: int = 10) -> str | bytes:
    """Deterministic and keyed; a text keeps its number of characters and which of them are printable ASCII, bytes keep
    their number. ``back`` deciphers."""
    if isinstance(value, bytes):
        return bytes(_feistel(list(value), [256] * len(value), key, rounds, back))
    digits, sizes = [list(x) for x in zip(*(_digit(ord(c)) for c in value), strict=True)] if value else ([], [])
    return "".join(chr(_point(d, n)) for d, n in zip(_feistel(digits, sizes, key, rounds, back), sizes, strict=True))


def _each(values: pd.Series, function) -> pd.Series:
    """Distinct values are computed once for each batch."""
    known = {v: function(v) for v in values.dropna().unique()}
    return values.map(lambda v: None if v is None else known[v], na_action=None)


def obfuscate(column: Column, key: bytes, kind: str = "string") -> Column:
    """`encipher` of a column of strings or, with kind ``binary``, of bytes; nulls stay."""

    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        return _each(values.map(lambda v: bytes(v) if isinstance(v, bytearray) else v, na_action=None), lambda v: encipher(v, key))

    return run(column)


def reveal(column: Column, key: bytes, kind: str = "string") -> Column:
    """The inverse of `obfuscate` under the same key."""

    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        return _each(values.map(lambda v: bytes(v) if isinstance(v, bytearray) else v, na_action=None), lambda v: encipher(v, key, True))

    return run(column)


def _within(value: object, key: bytes, back: bool) -> object:
    if isinstance(value, str | bytes):
        return encipher(value, key, back)
    if isinstance(value, list):
        return [_within(v, key, back) for v in value]
    if isinstance(value, dict):
        return {encipher(k, key, back): _within(v, key, back) for k, v in value.items()}
    return value


def obfuscate_ser(column: Column, key: bytes, back: bool = False) -> Column:
    """Serialized maps and slices with every text, bytes value and key in them enciphered, on all levels."""

    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else cbor.encode(_within(cbor.decode(bytes(v)), key, back)), na_action=None)

    return run(column)
