"""Operator 4: URL filters by a sort-merge range join.

A host with its labels reversed (``org.example.blog``) makes a rule's host and all its subdomains one interval of
canonical keys. Pages and rules are sorted together by that key; a sweep keeps the stack of rule hosts that are open,
each nested in the one below, and the deepest host with a rule whose path starts the page's path decides.

Ranges are cut at quantiles of the pages' keys and ids, so a host with a third of all pages is swept by many tasks; a
rule host goes to each range that its interval meets. The cuts only balance the work.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import arrow_map

#: Keys that the cuts are chosen from; they balance the work and decide nothing.
CUT_SAMPLE = 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _reversed(host: Column) -> Column:
    """Labels from the last to the first, each followed by the character before all that a host may hold."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "\x01"), F.lit("\x01"))


def _cuts(pages: DataFrame, n: int) -> list[tuple[str, int]]:
    """Bounds of n ranges of about equal size, from a sample thinned by hash where the pages are: what the driver gets
    doesn't grow with the pages or their partitions."""
    share = CUT_SAMPLE / max(1, pages.count())
    thin = pages.select("key", "tie").where(F.abs(F.xxhash64("tie", "key") / F.lit(float(1 << 63))) < share)
    found = sorted((r.key, r.tie) for r in thin.limit(2 * CUT_SAMPLE).collect())
    return sorted({found[len(found) * i // n] for i in range(1, n)}) if found else []


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Verdict for each row of ``pages(page_id, url)`` by ``rules(host, path, verdict)``.

    A rule fits its host and all subdomains if the url's path starts with the rule's path. Of those that fit, the one
    of the longest host wins, then of the longest path, then of the smaller verdict. Returns page_id, host, path, rule
    (host and path, or null) and verdict (``default`` where no rule fits). A null url, or one without ``://``, has an
    empty host and path. Whole urls are judged, however long. A rule of a null host or verdict is left out; a null path is an empty one. Repeated rows are judged each for
    itself; other columns, whatever their names, are left aside; an empty table gives no rows.
    """
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pages = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    pages = pages.withColumn("key", _reversed(F.col("host"))).withColumn("tie", F.xxhash64("page_id", "path"))
    cuts = pages.sparkSession.sparkContext.broadcast(_cuts(pages, n))
    kinds = {"range": pa.int32(), "key": pa.string(), "kind": pa.int32(), "page_id": pa.int64(), "host": pa.string(), "path": pa.string(), "verdict": pa.string()}
    schema = "range int, key string, kind int, page_id long, host string, path string, verdict string"

    def place_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            goal = [bisect_right(cuts.value, x) for x in zip(b.column("key").to_pylist(), b.column("tie").to_pylist(), strict=True)]
            yield pa.record_batch([pa.array(goal, pa.int32()), b.column("key"), pa.array([1] * len(goal), pa.int32()), b.column("page_id").cast(pa.int64()), b.column("host"), b.column("path"), pa.nulls(len(goal), pa.string())], names=list(kinds))

    def place_rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, host, path, verdict in zip(*(b.column(c).to_pylist() for c in ("key", "host", "path", "verdict")), strict=True):
                # Keys of the host and its subdomains begin with the rule's key.
                first, last = bisect_left(cuts.value, (key, -(1 << 63))), bisect_right(cuts.value, (key[:-1] + "\x02", -(1 << 63)))
                rows += [(g, key, 0, None, host, path, verdict) for g in range(first, last + 1)]
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], names=list(kinds))

    rules = rules.where("host is not null and verdict is not null").select("host", F.coalesce("path", F.lit("")).alias("path"), "verdict").distinct()
    rules = rules.withColumn("key", _reversed(F.col("host")))
    both = arrow_map(pages, place_pages, schema).unionByName(arrow_map(rules, place_rules, schema))
    both = both.repartition(n, "range").sortWithinPartitions("range", "key", "kind", F.length("path").desc(), "path", "verdict")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[str, str, list[tuple[str, str]]]] = []  # key, host, its rules (path, verdict), longest path first
        now = None
        for b in batches:
            rows = []
            for goal, key, kind, page, host, path, verdict in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if goal != now:
                    stack, now = [], goal
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if not kind:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, host, []))
                    stack[-1][2].append((path, verdict))
                    continue
                found = next(((f"{h}{p}", v) for _, h, own in reversed(stack) for p, v in own if path.startswith(p)), (None, default))
                rows.append((page, host, path, *found))
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), *[pa.string()] * 4))], names=["page_id", "host", "path", "rule", "verdict"])

    return arrow_map(both, sweep, "page_id long, host string, path string, rule string, verdict string")
