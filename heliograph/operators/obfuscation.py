"""Obfuscation of whole batches: attributes on every level, and names of spans.

Attributes on all levels are rows of attribute tables, so one projection of these tables reaches all of them; nothing is
shuffled. The cipher keeps lengths and is reversible under its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import obfuscate, obfuscate_ser


def obfuscate_attributes(attrs: DataFrame, key: bytes, names: list[str] | None = None, drop_unlisted: bool = False) -> DataFrame:
    """An attribute table with keys, texts, bytes and what is within maps and slices enciphered; numbers and truth values
    stay. With ``names``, only attributes of these keys are; the others stay, or go with ``drop_unlisted``."""
    chosen = F.lit(True) if names is None else F.col("key").isin(names)
    rows = attrs.where(chosen) if drop_unlisted else attrs

    def when(c: str, value: Column) -> Column:
        return F.when(chosen, value).otherwise(F.col(c))

    new = {"key": obfuscate(F.when(chosen, F.col("key")), key), "str": obfuscate(F.when(chosen, F.col("str")), key)}
    if "bytes" in attrs.columns:
        new["bytes"] = obfuscate(F.when(chosen, F.col("bytes")), key, "binary")
    if "ser" in attrs.columns:
        new["ser"] = obfuscate_ser(F.when(chosen, F.col("ser")), key)
    return rows.withColumns({c: when(c, value) for c, value in new.items()})


def obfuscate_tables(tables: dict[str, DataFrame], key: bytes, names: list[str] | None = None, drop_unlisted: bool = False) -> dict[str, DataFrame]:
    """Tables of a signal with their attributes, and the names of spans, enciphered."""
    out = {n: obfuscate_attributes(df, key, names, drop_unlisted) if n.endswith("attrs") else df for n, df in tables.items()}
    if "spans" in out:
        out["spans"] = out["spans"].withColumn("name", obfuscate(F.col("name"), key))
    return out
