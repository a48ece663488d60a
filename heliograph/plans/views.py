"""Telemetry views over the star-schema tables, as Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import severity_number
from ..operators.attributes import unpivot


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nanos(c: str) -> F.Column:
    return F.unix_micros(F.col(c).cast("timestamp")) * 1000


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log record for each event, in batches of a thousand; ids count within the batch."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.floor(F.col("event_id") / 1000).cast("long").alias("batch_id"), F.pmod("event_id", F.lit(1000)).cast("long").alias("id"), "event_id",
        nanos("ts").alias("time_unix_nano"), F.col("event_type").alias("severity_text"),
        severity_number(F.col("event_type")).alias("severity_number"), F.col("props").alias("body"), F.pmod("user_id", F.lit(16)).cast("long").alias("resource"),
        F.get_json_object("props", "$.k").cast("long").alias("k"), "value", (F.col("event_type") == "error").alias("is_error"),
    )


LOGS = """logs as (
  select event_id // 1000 as batch_id, event_id % 1000 as id, event_id, epoch_us(ts) * 1000 as time_unix_nano, event_type as severity_text,
         cast(case event_type when 'trace' then 1 when 'debug' then 5 when 'info' then 9 when 'warn' then 13 when 'error' then 17 when 'fatal' then 21 else 0 end as integer) as severity_number,
         props as body, user_id % 16 as resource, cast(json_extract(props, '$.k') as bigint) as k, value, event_type = 'error' as is_error
  from events)"""


def log_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Their attributes as typed rows, without the columns that none of them uses."""
    d = logs(spark, sf_dir)
    attrs = unpivot(d.withColumnRenamed("id", "parent_id"), ["batch_id", "parent_id"], {
        "k": ("int", F.col("k")), "value": ("double", F.col("value")), "event_type": ("str", F.col("severity_text")), "is_error": ("bool", F.when(F.col("is_error"), F.col("is_error"))),
    })
    return attrs.drop("bytes", "ser")


LOG_ATTRS = LOGS + """, attrs as (
  select batch_id, id as parent_id, 'k' as key, 2 as type, cast(null as varchar) as str, k as int, cast(null as double) as double, cast(null as boolean) as bool from logs where k is not null
  union all select batch_id, id, 'value', 3, null, null, value, null from logs where value is not null
  union all select batch_id, id, 'event_type', 1, severity_text, null, null, null from logs where severity_text is not null
  union all select batch_id, id, 'is_error', 4, null, null, null, true from logs where is_error)"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A root span for each order, and a child span for each of its lines; one batch for each 1000 orders."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("trace"), F.lit(0).cast("long").alias("n"), F.col("o_orderpriority").alias("name"), nanos("o_orderdate").alias("start"),
        F.lit(None).cast("double").alias("quantity"), F.pmod("o_custkey", F.lit(8)).cast("long").alias("resource"), F.col("o_orderstatus").alias("scope"),
    )
    line = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy(*line.columns)
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trace"), F.pmod("o_custkey", F.lit(8)).cast("long").alias("resource"), F.col("o_orderstatus").alias("scope"))
    children = line.withColumn("n", F.row_number().over(order).cast("long")).select(
        F.col("l_orderkey").alias("trace"), "n", F.concat("l_returnflag", "l_linestatus").alias("name"), nanos("l_shipdate").alias("start"), F.col("l_quantity").alias("quantity"),
    ).join(keys, "trace")
    both = o.unionByName(children)
    return both.select(
        F.floor(F.col("trace") / 1000).cast("long").alias("batch_id"), "trace", F.md5(F.concat(F.lit("o"), F.col("trace").cast("string"))).alias("trace_id"),
        "n", F.when(F.col("n") > 0, 0).cast("long").alias("parent"), "name", F.col("start").alias("start_nano"),
        F.coalesce(F.col("quantity") * 1_000_000, F.lit(0.0)).cast("long").alias("duration_nano"), "resource", "scope", "quantity",
    )


SPANS = """l as (
  select l_orderkey as trace, row_number() over (partition by l_orderkey order by l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as n,
         l_returnflag || l_linestatus as name, epoch_us(l_shipdate) * 1000 as start, l_quantity as quantity from lineitem),
both_ as (
  select o_orderkey as trace, 0 as n, o_orderpriority as name, epoch_us(o_orderdate) * 1000 as start, null as quantity, o_custkey % 8 as resource, o_orderstatus as scope from orders
  union all select l.trace, n, name, start, quantity, o_custkey % 8, o_orderstatus from l join orders on l.trace = o_orderkey),
spans as (
  select trace // 1000 as batch_id, trace, md5('o' || trace) as trace_id, n, case when n > 0 then 0 end as parent, name, start as start_nano,
         cast(coalesce(quantity * 1000000, 0) as bigint) as duration_nano, resource, scope, quantity from both_)"""
