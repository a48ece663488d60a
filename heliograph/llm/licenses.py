"""Operator 5: license scans by template-markup matching.

A template is wording with two kinds of marked regions: ``<<optional>> ... <<end>>`` may be left out, and ``<<any 5>>``
stands for up to five words of any kind. Each template is compiled once into an automaton over words; a text is
accepted where the mandatory wording stands exactly. `scan_licenses` finds accepted wording anywhere in a text,
`identify_licenses` the texts that are a license as a whole. Words are compared as codes: a template whose words a slice
of documents doesn't hold costs nothing, and an automaton only runs where its first words stand.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .columns import arrow_map, coded, documents, ragged, slices, starts, texts
from .license_texts import HEADER, TEXTS

#: Phrases whose places are all counted, and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Wording that names public licenses; whole bodies and notices follow.
TEMPLATES = (
    ("apache license <<optional>> version <<end>> 2 0", "apache-2.0"),
    ("gnu <<optional>> lesser <<end>> general public license <<optional>> as published by the free software foundation <<end>> <<optional>> either <<end>> version 3", "gpl-3.0"),
    ("gnu <<optional>> lesser <<end>> general public license <<optional>> as published by the free software foundation <<end>> <<optional>> either <<end>> version 2", "gpl-2.0"),
    ("licensed under <<optional>> a <<end>> <<optional>> the <<end>> <<optional>> creative commons <<end>> <<optional>> license <<end>> cc by nc <<optional>> 4 0 <<end>>", "cc-by-nc"),
    ("licensed under <<optional>> a <<end>> <<optional>> the <<end>> <<optional>> creative commons <<end>> <<optional>> license <<end>> cc by sa <<optional>> 4 0 <<end>>", "cc-by-sa"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("copyright <<optional>> c <<end>> <<any 8>> all rights reserved", "all-rights-reserved"),
    *TEXTS,
)
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_MARKUP = r"<<optional>>|<<end>>|<<any \d+>>|[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Automaton:
    """States 0.. with edges by word or by any word; edges that read nothing are worked into both."""

    label: str
    lead: tuple[str, ...]
    by_word: tuple[dict[str, frozenset[int]], ...]
    by_any: tuple[frozenset[int], ...]
    accepting: frozenset[int]
    begin: frozenset[int] = frozenset([0])

    def longest(self, words: list[str]) -> int:
        """Words of the longest accepted text that ``words`` begin with; 0 if there is none."""
        now, best = self.begin, 0
        for n, word in enumerate(words, 1):
            now = frozenset().union(*(self.by_word[s].get(word, frozenset()) | self.by_any[s] for s in now))
            if not now:
                break
            if now & self.accepting:
                best = n
        return best

    @property
    def reach(self) -> int:
        """No accepted text has more words."""
        return len(self.by_any)


def items_of(markup: str) -> list[str]:
    """Marks and words of a template, in order."""
    return re.findall(_MARKUP, markup.lower())


def compile_template(markup: str, label: str, anywhere: bool = True) -> Automaton:
    """The automaton of a template; to be found ``anywhere`` it must begin with a word that is mandatory."""
    items = items_of(markup)
    free: list[set[int]] = [set()]
    word: list[dict[str, set[int]]] = [{}]
    wild: list[set[int]] = [set()]

    def state() -> int:
        free.append(set())
        word.append({})
        wild.append(set())
        return len(free) - 1

    at, opened, lead = 0, [], []
    for item in items:
        if item == "<<optional>>":
            opened.append(at)
        elif item == "<<end>>":
            free[opened.pop()].add(at)
        elif m := re.fullmatch(r"<<any (\d+)>>", item):
            steps = [at]
            for _ in range(int(m[1])):
                steps.append(state())
                wild[steps[-2]].add(steps[-1])
            at = state()
            for s in steps:
                free[s].add(at)
        else:
            new = state()
            word[at].setdefault(item, set()).add(new)
            at = new
    if opened or not items or anywhere and items[0].startswith("<<"):
        raise ValueError(f"not a template: {markup!r}")
    for item in items:
        if item.startswith("<<"):
            break
        lead.append(item)

    def closed(todo: set[int]) -> frozenset[int]:
        seen, todo = set(todo), list(todo)
        while todo:
            for s in free[todo.pop()] - seen:
                seen.add(s)
                todo.append(s)
        return frozenset(seen)

    accepting = frozenset(s for s in range(len(free)) if at in closed({s}))
    return Automaton(label, tuple(lead), tuple({w: closed(t) for w, t in x.items()} for x in word), tuple(closed(x) for x in wild), accepting, closed({0}))


def license_words(array: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words of digits, letters and characters beyond ASCII, with A-Z lower-cased."""
    return ragged(pc.split_pattern_regex(pc.ascii_lower(texts(array)), _GAP))


def scan_licenses(docs: DataFrame, phrases: tuple = PHRASES, templates: tuple = TEMPLATES) -> DataFrame:
    """License wording in each row of ``docs(doc_id, text, ...)``.

    Returns doc_id, n_words, n_base (places where a phrase stands), first_word and last_word (smallest and largest start
    of those, words from 0; null without one), base_labels (of phrases), labels (of phrases and templates; both
    distinct, sorted, joined by commas, empty without any) and score: the share of the words that lie in accepted
    wording. A null or empty text has no words and score 0. Repeated rows are scanned each for itself; other columns,
    whatever their names, are left aside; an empty table gives no rows.
    """
    compiled = [(compile_template(m, label), base) for base, group in ((True, phrases), (False, templates)) for m, label in group]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                counts, flat = license_words(part.column("text"))
                codes, distinct = coded(flat)
                at = starts(counts)
                owner = np.repeat(np.arange(len(counts)), counts)
                found: list[tuple[np.ndarray, np.ndarray, str, bool]] = []
                for a, base in compiled:
                    lead = pc.index_in(pa.array(a.lead), value_set=distinct)
                    n = len(codes) - len(a.lead) + 1
                    if lead.null_count or n <= 0:
                        continue
                    spots = np.flatnonzero(codes[:n] == lead[0].as_py())
                    for i in range(1, len(a.lead)):
                        spots = spots[codes[spots + i] == lead[i].as_py()]
                    ends = at[owner[spots] + 1] if len(spots) else spots
                    spots, ends = spots[spots + len(a.lead) <= ends], ends[spots + len(a.lead) <= ends]
                    if a.reach == len(a.lead) + 1:  # all of it is the lead
                        sizes = np.full(len(spots), len(a.lead))
                    else:
                        sizes = np.array([a.longest(flat[s : min(e, s + a.reach)].to_pylist()) for s, e in zip(spots.tolist(), ends.tolist(), strict=True)], np.int64)
                    found.append((spots[sizes > 0], sizes[sizes > 0], a.label, base))
                cover = np.zeros(len(codes) + 1, np.int64)
                n_base = np.zeros(len(counts), np.int64)
                first, last = np.full(len(counts), len(codes) + 1), np.full(len(counts), -1)
                labels: dict[int, tuple[set, set]] = {}
                for spots, sizes, label, base in found:
                    np.add.at(cover, spots, 1)
                    np.add.at(cover, spots + sizes, -1)
                    doc = owner[spots]
                    for d in np.unique(doc).tolist():
                        own = labels.setdefault(d, (set(), set()))
                        own[1].add(label)
                        if base:
                            own[0].add(label)
                    if base:
                        n_base += np.bincount(doc, minlength=len(counts))
                        np.minimum.at(first, doc, spots - at[doc])
                        np.maximum.at(last, doc, spots - at[doc])
                covered = np.diff(np.concatenate(([0], np.cumsum(np.cumsum(cover[:-1]) > 0)))[at])
                none = n_base == 0
                said = [[",".join(sorted(labels[d][i])) if d in labels else "" for d in range(len(counts))] for i in (0, 1)]
                columns = (part.column("doc_id"), counts, n_base, pa.array(first, mask=none), pa.array(last, mask=none), *said, covered / np.maximum(counts, 1))
                yield pa.record_batch([c.cast(t) if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return arrow_map(documents(docs), scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def identify_licenses(docs: DataFrame, templates: tuple = TEXTS) -> DataFrame:
    """(doc_id, license) for each row of ``docs(doc_id, text, ...)``: the label of the first template that accepts the
    whole text, with or without a title and copyright lines before it; null if none does.

    Null and empty texts are no license; repeated rows are judged each for itself, other columns are left aside, and an
    empty table gives no rows.
    """
    compiled = [compile_template(HEADER + markup, label, False) for markup, label in templates]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                counts, flat = license_words(part.column("text"))
                at = starts(counts).tolist()
                said = []
                for a, b in zip(at[:-1], at[1:], strict=True):
                    fits = [c for c in compiled if 0 < b - a <= c.reach]
                    own = flat[a:b].to_pylist() if fits else []
                    said.append(next((c.label for c in fits if c.longest(own) == len(own)), None))
                yield pa.record_batch({"doc_id": part.column("doc_id"), "license": pa.array(said, pa.string())})

    return arrow_map(documents(docs), judge, "doc_id long, license string")
