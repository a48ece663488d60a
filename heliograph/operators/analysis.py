"""Analyzers of datasets: distributions and distinct values on each level of traces, logs and metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .attributes import KINDS
from .canonical import resource_key, scope_key


def distribution(df: DataFrame, by: list[str], value: Column, name: str) -> DataFrame:
    """Spread of a number: <name>_min, _max, _mean, _stddev (of the population), _p50 and _p99 (approximate by ranks)."""
    spread = F.percentile_approx(value, [0.5, 0.99], 10_000)
    out = df.groupBy(*by).agg(F.min(value).alias(f"{name}_min"), F.max(value).alias(f"{name}_max"), F.avg(value).alias(f"{name}_mean"), F.stddev_pop(value).alias(f"{name}_stddev"), spread.alias("p"))
    return out.withColumns({f"{name}_p50": F.col("p")[0], f"{name}_p99": F.col("p")[1]}).drop("p")


def texts(column: str) -> list[Column]:
    """Aggregates of a text: missing ones, distinct ones and the bytes of the others."""
    there = F.when(F.col(column) != "", F.col(column))
    return [
        F.count_if(F.coalesce(F.col(column), F.lit("")) == "").alias(f"{column}_missing"), F.countDistinct(there).alias(f"{column}_distinct"),
        F.min(F.octet_length(there)).alias(f"{column}_min_bytes"), F.max(F.octet_length(there)).alias(f"{column}_max_bytes"), F.avg(F.octet_length(there)).alias(f"{column}_mean_bytes"),
    ]


def attribute_report(attrs: DataFrame, parents: DataFrame, ids: list[str]) -> DataFrame:
    """One row on an attribute table and its parents: rows of each kind, distinct keys and values, spread of key lengths and
    of the number of attributes, and distinct dropped counts (of ``parents(dropped)``, if it has them)."""
    value = F.coalesce("str", F.col("int").cast("string"), F.col("double").cast("string"), F.col("bool").cast("string"), F.hex("bytes"), F.hex("ser"))
    kinds = [F.count_if(F.col("type") == k).alias(f"n_{n}") for n, k in KINDS.items()]
    length = F.octet_length("key")
    total = attrs.agg(
        F.count("*").alias("n"), *kinds, F.countDistinct("key").alias("keys"), F.countDistinct("type", value).alias("values"),
        F.min(length).alias("key_min_bytes"), F.max(length).alias("key_max_bytes"), F.avg(length).alias("key_mean_bytes"), F.stddev_pop(length).alias("key_stddev_bytes"),
    )
    each = parents.select(*ids).join(attrs.groupBy(*ids).agg(F.count("*").alias("own")), ids, "left").select(F.coalesce("own", F.lit(0)).alias("own"))
    spread = distribution(each, [], F.col("own"), "attributes")
    dropped = parents.agg(F.countDistinct("dropped").alias("dropped_distinct")) if "dropped" in parents.columns else parents.agg(F.lit(0).cast("long").alias("dropped_distinct"))
    return total.join(F.broadcast(spread)).join(F.broadcast(dropped))


def levels(flat: DataFrame, item: str) -> DataFrame:
    """Counts of each batch of a flattened signal: resources, scopes and items, and distinct canonical resources and scopes
    and schema urls (two metrics, one of each level)."""
    keyed = flat.select("batch_id", "r", "s", F.col(item).isNotNull().alias("has"), resource_key("resource", "resource_url").alias("rk"), scope_key("scope", "scope_url").alias("sk"), "resource_url", "scope_url")
    return keyed.groupBy("batch_id").agg(
        F.countDistinct("r").alias("resources"), F.countDistinct("r", "s").alias("scopes"), F.count_if("has").alias("items"), F.countDistinct(F.when(F.col("r").isNotNull(), F.col("rk"))).alias("distinct_resources"),
        F.countDistinct(F.when(F.col("s").isNotNull(), F.col("sk"))).alias("distinct_scopes"), F.countDistinct(F.when(F.col("resource_url") != "", F.col("resource_url"))).alias("resource_urls"),
        F.countDistinct(F.when(F.col("scope_url") != "", F.col("scope_url"))).alias("scope_urls"),
    )


def event_report(events: DataFrame, spans: DataFrame, ids: list[str]) -> DataFrame:
    """One row on events: their number, that for each span, their names, and distinct times and dropped counts."""
    own = spans.select(*ids).join(events.groupBy(*ids).agg(F.count("*").alias("own")), ids, "left").select(F.coalesce("own", F.lit(0)).alias("own"))
    total = events.agg(F.count("*").alias("n"), *texts("name"), F.countDistinct("time_ns").alias("times"), F.countDistinct("dropped").alias("dropped_distinct"))
    return total.join(F.broadcast(distribution(own, [], F.col("own"), "per_span")))


def link_report(links: DataFrame, spans: DataFrame, ids: list[str]) -> DataFrame:
    """One row on links: their number, that for each span, distinct traces, spans and dropped counts, and trace states."""
    own = spans.select(*ids).join(links.groupBy(*ids).agg(F.count("*").alias("own")), ids, "left").select(F.coalesce("own", F.lit(0)).alias("own"))
    total = links.agg(F.count("*").alias("n"), F.countDistinct("trace_id").alias("traces"), F.countDistinct("span_id").alias("spans"), *texts("trace_state"), F.countDistinct("dropped").alias("dropped_distinct"))
    return total.join(F.broadcast(distribution(own, [], F.col("own"), "per_span")))


def log_report(logs: DataFrame) -> DataFrame:
    """One row on log records: times, severities, traces, flags, kinds of bodies and texts of those that are text."""
    body = F.coalesce("body.type", F.lit(0))
    rows = logs.withColumn("body_text", F.col("body.str"))
    return rows.agg(
        F.count("*").alias("n"), F.countDistinct("time_ns").alias("times"), F.count_if(F.coalesce("time_ns", F.lit(0)) == 0).alias("times_missing"), F.countDistinct("observed_ns").alias("observed"),
        F.countDistinct("severity_number").alias("severities"), *texts("severity_text"), F.countDistinct("trace_id").alias("traces"), F.countDistinct("span_id").alias("spans"), F.countDistinct("flags").alias("flags"),
        *[F.count_if(body == k).alias(f"body_{n}") for n, k in KINDS.items()], *texts("body_text"),
    )


def metric_report(tables: dict[str, DataFrame]) -> DataFrame:
    """One row for each kind of points and one for exemplars: metrics that have some, points, distinct times and starts."""
    kinds = ("numbers", "summaries", "histograms", "exp_histograms")
    parts = [
        tables[k].agg(F.lit(k).alias("kind"), F.countDistinct("batch_id", "r", "s", "i").alias("metrics"), F.count("*").alias("n"), F.countDistinct("time_ns").alias("times"), F.countDistinct("start_ns").alias("starts"))
        for k in kinds
    ]
    e = tables["exemplars"].agg(F.lit("exemplars").alias("kind"), F.countDistinct("batch_id", "r", "s", "i").alias("metrics"), F.count("*").alias("n"), F.countDistinct("time_ns").alias("times"), F.lit(0).cast("long").alias("starts"))
    return reduce(DataFrame.unionByName, [*parts, e])


def totals(values: DataFrame, by: list[str], column: str, iterations: int) -> DataFrame:
    """Sum of a measure over iterations, for one of them."""
    return values.groupBy(*by).agg((F.sum(column) / F.lit(iterations)).alias("total"))


def add_summaries(a: Column, b: Column) -> Column:
    """Elementwise sum of two arrays of values, of the longer one's length."""
    return F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))
