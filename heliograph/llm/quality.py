"""Operator 7: quality rules as one projection.

A table of thresholds is compiled into Spark SQL expressions over lengths, symbols, stop words and lines; no user
function takes part, nothing is shuffled, and each document is judged from its own row alone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "he", "her", "his", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with",
    "au", "aux", "ce", "dans", "de", "des", "du", "elle", "en", "est", "et", "il", "la", "le", "les", "ou", "par", "pour", "que", "qui", "sur", "un", "une",
    "auch", "auf", "das", "dem", "den", "der", "die", "ein", "eine", "einer", "für", "im", "ist", "mit", "nicht", "sich", "und", "von", "zu",
    "al", "con", "del", "el", "es", "ha", "las", "lo", "los", "no", "para", "por", "se", "su", "y",
)
BLANK = " \\t\\n\\u000B\\f\\r"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A document passes if ``low <= value <= high``; value is SQL over the measures, a null one passes."""

    name: str
    value: str
    low: float
    high: float


#: What any document has to meet.
BASE = (
    Rule("length", "n_words", 20, float("inf")),
    Rule("repeated words", "100 * n_repeat_words / n_words", 0, 30),
)
#: What running text meets besides.
PROSE = (
    Rule("word length", "word_chars / n_words", 2, 14),
    Rule("symbols for each word", "n_symbols / n_words", 0, 0.1),
    Rule("stop words", "n_stop / n_words", 0.02, 1),
    Rule("repeated lines", "n_dup_lines / n_lines", 0, 0.3),
    Rule("lines that begin as list items", "n_bullets / n_lines", 0, 0.9),
)


def _let(name: str, value: str, body: str) -> str:
    """SQL: ``body`` with ``name`` for ``value``, which is evaluated once however often the body mentions it.

    Columns of an earlier projection would be put in place of their names wherever a filter mentions them.
    """
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _measures(body: str) -> str:
    """SQL: ``body`` over the struct ``m`` of measures of the column text."""
    lines = f"filter(split(coalesce(text, ''), '\\n'), x -> ltrim('{BLANK}', x) <> '')"
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    fields = {
        "n_words": "size(w)",
        "word_chars": "length(array_join(w, ''))",
        "n_symbols": "size(split(t, '[#*$%&|<>]')) - 1",
        "n_dup_lines": "size(l) - size(array_distinct(transform(l, x -> xxhash64(x))))",
        "n_repeat_words": f"coalesce(aggregate(transform(p, (x, j) -> if(j = size(p) - 1, {WINDOW}, least({WINDOW}, get(p, j + 1) - x))), 0, (a, x) -> a + x), 0)",
        "n_lines": "size(l)",
        "n_stop": f"size(filter(w, x -> x in ({stop})))",
        "n_bullets": "size(filter(l, x -> substring(ltrim(x), 1, 1) in ('-', '*', '•', '‣')))",
    }
    out = _let("m", "named_struct(" + ", ".join(f"'{k}', cast({v} as bigint)" for k, v in fields.items()) + ")", body)
    out = _let("l", lines, out)
    # Windows whose hash occurs twice, by sorting (hash, start); then the words that they cover together.
    out = _let("p", "array_sort(transform(filter(transform(s, (x, j) -> named_struct('i', x.i, 'twice', coalesce(get(s, j - 1).h = x.h, false) or coalesce(get(s, j + 1).h = x.h, false))), y -> y.twice), y -> y.i))", out)
    out = _let("s", "if(size(array_distinct(v)) = size(v), null, array_sort(transform(v, (h, i) -> named_struct('h', h, 'i', i))))", out)
    out = _let("v", f"slice(v, 1, greatest(size(v) - {WINDOW - 1}, 0))", out)
    # A window's hash comes from its four pairs of words.
    pairs = ", ".join(f"get(v2, i + {j})" for j in range(2, WINDOW, 2))
    out = _let("v", f"transform(v2, (h, i) -> xxhash64(h, {pairs}))", out)
    out = _let("v2", "transform(w, (x, i) -> xxhash64(x, get(w, i + 1)))", out)
    out = _let("w", "slice(u, if(u[0] = '', 2, 1), size(u) - if(u[0] = '', 1, 0) - if(size(u) > 1 and u[size(u) - 1] = '', 1, 0))", out)
    out = _let("u", r"split(t, '[\\x20\\x09-\\x0D]+')", out)
    return _let("t", "coalesce(text, '')", out)


def _passes(rules: tuple[Rule, ...]) -> str:
    """SQL: the rules as one condition over the struct ``m``."""
    out = []
    for rule in rules:
        value = re.sub(r"\b([a-z]+_[a-z_]+)\b", r"m.\1", rule.value)
        value = re.sub(r"/ (\S+)", r"/ nullif(\1, 0)", value)
        high = "" if rule.high == float("inf") else f" and {value} <= {rule.high}"
        out.append(f"coalesce({value} >= {rule.low}{high}, true)")
    return " and ".join(out) or "true"


def quality_report(docs: DataFrame, base: tuple[Rule, ...] = BASE, rules: tuple[Rule, ...] = PROSE) -> DataFrame:
    """Measures and verdict of each row of ``docs(doc_id, text, ...)``.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and the measures of
    the other rules. A null, empty or blank text has no words and fails. Repeated rows are judged each for itself, other
    columns, whatever their names, are left aside, and an empty table gives no rows. Windows and lines are compared by
    64-bit hashes within their document; stop words count in lower case only.
    """
    report = _measures(f"struct(m, not ({_passes(base)}) as failed, {_passes(rules)} as good)")
    judged = docs.select("doc_id", F.expr(report).alias("r"))
    first = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rest = ["n_lines", "n_stop", "n_bullets"]
    return judged.select(
        "doc_id", *[F.col(f"r.m.{c}").alias(c) for c in first], F.col("r.failed").alias("base_failed"),
        F.expr("not r.failed and r.good").alias("kept"), *[F.col(f"r.m.{c}").alias(c) for c in rest],
    )


def quality_filter(docs: DataFrame, base: tuple[Rule, ...] = BASE, rules: tuple[Rule, ...] = PROSE) -> DataFrame:
    """The rows of ``docs`` that pass `quality_report`, with all their columns, whatever their names.

    Null, empty and blank texts go, repeated rows are judged each for itself, an empty table gives no rows.
    """
    return docs.where(F.expr(_measures(_passes(base + rules))))
