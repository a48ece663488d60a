"""Profiles of tables: exact summaries, distinct counts, null profiles and advice on dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def summary(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """Count, extremes, mean, sample deviation (0 for one value) and interpolated percentiles, all exact."""
    at = (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))
    r = lambda c: F.round(c, 6)
    ranks = F.percentile(column, F.array(*[F.lit(p) for _, p in at])).alias("__ranks")
    out = df.groupBy(*by).agg(
        F.count(column).alias("n"), F.min(column).alias("min"), F.max(column).alias("max"), r(F.avg(column)).alias("mean"),
        r(F.coalesce(F.stddev_samp(column), F.lit(0.0))).alias("stddev"), ranks,
    )
    return out.withColumns({n: r(F.col("__ranks")[i]) for i, (n, _) in enumerate(at)}).drop("__ranks")


def attribute_stats(attrs: DataFrame, by: list[str]) -> DataFrame:
    """Rows, distinct keys and values, and rows of each kind."""
    kinds = {"str": 1, "int": 2, "double": 3, "bool": 4}
    value = F.coalesce("str", F.col("int").cast("string"), F.col("double").cast("string"), F.col("bool").cast("string"))
    return attrs.groupBy(*by).agg(
        F.count("*").alias("n"), F.countDistinct("key").alias("keys"), F.sum(F.octet_length("key")).alias("key_bytes"),
        F.countDistinct(F.struct("type", value)).alias("values"), *[F.count_if(F.col("type") == k).alias(f"n_{n}") for n, k in kinds.items()],
    )


def string_stats(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """Missing strings, and lengths in bytes and distinct values of the others."""
    there = F.when(F.col(column) != "", F.col(column))
    return df.groupBy(*by).agg(
        F.count_if(F.coalesce(F.col(column), F.lit("")) == "").alias("missing"), F.countDistinct(there).alias("distinct"),
        F.min(F.octet_length(there)).alias("min_bytes"), F.max(F.octet_length(there)).alias("max_bytes"), F.sum(F.octet_length(there)).alias("bytes"),
    )


def column_profile(df: DataFrame) -> DataFrame:
    """One row for each column: rows, values, distinct values, and what dictionary they need; one pass over ``df``."""
    cells = [F.struct(F.lit(c).alias("name"), F.count("*").alias("n"), F.count(c).alias("present"), F.countDistinct(c).alias("distinct")) for c in df.columns]
    out = df.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")
    return out.withColumn("used", F.col("present") > 0).withColumn("width", dictionary_width(F.col("distinct")))


def dictionary_width(distinct: Column, limit: int = 65535) -> Column:
    """The narrowest index for so many values; ``plain`` beyond the limit."""
    return F.when(distinct > limit, "plain").when(distinct <= 255, "u8").when(distinct <= 65535, "u16").otherwise("u32")


def cumulative_dictionary(df: DataFrame, batch: str, column: str) -> DataFrame:
    """Distinct values up to each batch, by the batch that each value is first seen in."""
    first = df.groupBy(column).agg(F.min(batch).alias(batch)).groupBy(batch).agg(F.count("*").alias("new"))
    batches = df.select(batch).distinct().join(first, batch, "left").select(batch, F.coalesce("new", F.lit(0)).alias("new"))
    total = F.sum("new").over(Window.orderBy(batch))  # one row for each batch, counted before
    return batches.withColumn("total", total).withColumn("width", dictionary_width(F.col("total")))


def approximate(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """Sketched distinct count and quantiles, for data that is too large for exact ones."""
    return df.groupBy(*by).agg(
        F.hll_sketch_estimate(F.hll_sketch_agg(F.col(column).cast("string"), 16)).alias("distinct"), F.min(column).alias("min"), F.max(column).alias("max"),
        F.avg(column).alias("mean"), F.stddev_pop(column).alias("stddev"), F.percentile_approx(column, [0.5, 0.99], 10_000).alias("quantiles"),
    )


def by_cardinality(df: DataFrame, columns: list[str]) -> list[str]:
    """The columns by ascending number of distinct values, ties as given; one row of counts comes to the driver."""
    if not columns:
        return []
    counts = df.agg(*[F.countDistinct(c).alias(str(i)) for i, c in enumerate(columns)]).first()
    return [columns[i] for i in sorted(range(len(columns)), key=lambda i: (counts[i], i))]
