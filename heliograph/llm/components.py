"""Connected components of an edge table, without collecting edges anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, stash

#: Edges of a file, about; few edges make few files, whatever the number of shuffle partitions.
FILE_EDGES = 1_000_000


def connected(edges: DataFrame) -> DataFrame:
    """Components of undirected ``edges(a, b)`` of longs: one row (node, root) for each node; root is its smallest node.

    Alternates two contractions until nothing changes: every node hangs its larger neighbours on its smallest one, then
    its smaller neighbours. Both shuffle two longs an edge and take their minimum by partial aggregation, so a node with
    a third of all edges is no hot spot; the number of rounds grows with the logarithm of the longest chain. Nulls and
    loops are ignored, repeated edges count once, no edges give no rows.
    """
    links = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()
    links = stash(links, "links")
    files = -(-links.count() // FILE_EDGES)
    if not files:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    before = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        later = large.join(small, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        old, links = links, stash(later.where("a <> b").distinct().coalesce(files), "links")
        discard(old)
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
