"""Canonical forms of JSON text: equality whatever the order of keys and elements, and paths to every leaf."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(value: object) -> object:
    """Keys in order, and elements of lists in the order of their text."""
    if isinstance(value, dict):
        return {k: canonical(value[k]) for k in sorted(value)}
    if isinstance(value, list):
        return sorted((canonical(v) for v in value), key=text_of)
    return value


def text_of(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def paths(value: object, at: str = "") -> set[str]:
    """``a.b[<md5>].c=leaf`` for each leaf; an element is named by the md5 of its canonical text, not by its place."""
    if isinstance(value, dict):
        return set().union(*(paths(v, f"{at}.{k}" if at else k) for k, v in value.items())) if value else {f"{at}={{}}"}
    if isinstance(value, list):
        named = ((hashlib.md5(text_of(canonical(v)).encode()).hexdigest(), v) for v in value)
        return set().union(*(paths(v, f"{at}[{name}]") for name, v in named)) if value else {f"{at}=[]"}
    return {f"{at}={text_of(value)}"}


def canonical_json(text: Column) -> Column:
    """JSON text in canonical form; null where it is null or no JSON."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: _parsed(v, lambda x: text_of(canonical(x))), na_action=None)

    return run(text)


def json_paths(text: Column) -> Column:
    """The distinct paths of JSON text, in order."""

    @F.pandas_udf("array<string>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: _parsed(v, lambda x: sorted(paths(x))), na_action=None)

    return run(text)


def _parsed(text: str | None, then) -> object:
    try:
        return None if text is None else then(json.loads(text))
    except ValueError:
        return None
