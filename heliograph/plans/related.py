"""Registered queries over related tables: events, links, status, sort orders, and deltas within further groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import attributes, codec, stats
from . import views
from .queries import query
from .views import LOG_ATTRS, LOGS, SPANS, table


def _place(df: DataFrame, keys: list[str], ids: list[str]) -> DataFrame:
    return df.select(*ids, F.row_number().over(codec.window(["batch_id"], keys)).cast("long").alias("place"))


def _place_sql(source: str, keys: str, ids: str) -> str:
    return f"select {ids}, row_number() over (partition by batch_id order by {keys}) as place from {source}"


@query(f"with {LOGS} " + _place_sql("logs", "resource, severity_text, time_unix_nano, id", "batch_id, id"))
def sort_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _place(views.logs(spark, sf_dir), ["resource", "severity_text", "time_unix_nano", "id"], ["batch_id", "id"])


@query(f"with {LOG_ATTRS} " + _place_sql("attrs", "parent_id, key, type", "batch_id, parent_id, key"))
def sort_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _place(views.log_attrs(spark, sf_dir), ["parent_id", "key", "type"], ["batch_id", "parent_id", "key"])


@query(f"with {SPANS} " + _place_sql("spans", "start_nano, duration_nano, trace, n", "batch_id, trace, n"))
def sort_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points by time, then value, then parent."""
    return _place(views.spans(spark, sf_dir), ["start_nano", "duration_nano", "trace", "n"], ["batch_id", "trace", "n"])


_EVENTS = f"{SPANS}, events_ as (select batch_id, trace, n, name, start_nano as time_nano from spans where n > 0)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of an order is an event of its root span."""
    return views.spans(spark, sf_dir).where("n > 0").select("batch_id", "trace", "n", "name", F.col("start_nano").alias("time_nano"))


@query(f"with {_EVENTS} select *, row_number() over (partition by batch_id order by name, time_nano, trace, n) as place from events_")
def span_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _place(_events(spark, sf_dir), ["name", "time_nano", "trace", "n"], ["batch_id", "trace", "n", "name", "time_nano"])


@query(f"with {SPANS} select batch_id, trace_id, n, parent, row_number() over (partition by batch_id order by trace_id, n) as place from spans where parent is not null")
def span_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links from child spans to their parent."""
    links = views.spans(spark, sf_dir).where("parent is not null")
    return _place(links, ["trace_id", "n"], ["batch_id", "trace_id", "n", "parent"])


_STATUS = f"{SPANS}, status as (select batch_id, trace, n, case scope when 'F' then 1 when 'P' then 2 else 0 end as code, case when scope = 'P' then name else '' end as message from spans)"


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("scope") == "F", 1).when(F.col("scope") == "P", 2).otherwise(0)
    message = F.when(F.col("scope") == "P", F.col("name")).otherwise("")
    return views.spans(spark, sf_dir).select("batch_id", "trace", "n", code.alias("code"), message.alias("message"))


@query(f"with {_STATUS} select * from status")
def span_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _status(spark, sf_dir)


@query(f"with {_STATUS} select batch_id, count(*) as n, count(*) filter (code = 0) as unset, count(*) filter (code = 1) as ok, count(*) filter (code = 2) as error, count(distinct nullif(message, '')) as messages from status group by 1")
def status_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.col("code")
    kinds = [F.count_if(code == k).alias(n) for k, n in enumerate(("unset", "ok", "error"))]
    return _status(spark, sf_dir).groupBy("batch_id").agg(F.count("*").alias("n"), *kinds, F.countDistinct(F.when(F.col("message") != "", F.col("message"))).alias("messages"))


def _delta_sql(keys: str) -> str:
    differs = " or ".join(f"lag({k}) over w is distinct from {k}" for k in keys.split(", "))
    return f"""with {SPANS}, p as (select *, trace % 1000 as parent_id from spans)
select batch_id, trace, n, case when row_number() over w = 1 or {differs} then parent_id else (parent_id - lag(parent_id) over w) & 65535 end as delta
from p window w as (partition by batch_id order by {keys}, trace, n)"""


def _deltas(spark: SparkSession, sf_dir: str, keys: list[str]) -> DataFrame:
    s = views.spans(spark, sf_dir).withColumn("parent_id", F.pmod("trace", F.lit(1000)).cast("long"))
    return codec.group_delta_encode(s, ["batch_id"], [*keys, "trace", "n"], keys, "parent_id", "delta").select("batch_id", "trace", "n", "delta")


@query(_delta_sql("name"))
def delta_group_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deltas(spark, sf_dir, ["name"])


@query(_delta_sql("trace_id"))
def delta_group_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deltas(spark, sf_dir, ["trace_id"])


@query(_delta_sql("duration_nano"))
def delta_group_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deltas(spark, sf_dir, ["duration_nano"])


@query(_delta_sql("start_nano, duration_nano"))
def delta_group_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deltas(spark, sf_dir, ["start_nano", "duration_nano"])


@query(f"""with {LOGS}, c as (select *, (lag(severity_text) over w is distinct from severity_text or row_number() over w = 1)::int as new from logs window w as (partition by batch_id order by id))
select batch_id, id, cast(sum(new) over (partition by batch_id order by id) - 1 as bigint) as run from c""")
def row_change_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.run_ids(views.logs(spark, sf_dir), ["batch_id"], ["id"], ["severity_text"], "run").select("batch_id", "id", "run")


@query(f"""with {LOGS} select batch_id, count(distinct time_unix_nano) as times, count(*) filter (coalesce(time_unix_nano, 0) = 0) as missing, min(time_unix_nano) as first, max(time_unix_nano) as last from logs group by 1""")
def timestamp_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("time_unix_nano")
    return views.logs(spark, sf_dir).groupBy("batch_id").agg(F.countDistinct(t).alias("times"), F.count_if(F.coalesce(t, F.lit(0)) == 0).alias("missing"), F.min(t).alias("first"), F.max(t).alias("last"))


@query(f"""with {LOGS} select severity_text, count(*) filter (coalesce(body, '') = '') as missing, count(distinct nullif(body, '')) as distinct, min(strlen(nullif(body, ''))) as min_bytes, max(strlen(nullif(body, ''))) as max_bytes,
cast(sum(strlen(nullif(body, ''))) as bigint) as bytes from logs group by 1""")
def body_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.string_stats(views.logs(spark, sf_dir), ["severity_text"], "body")


_NULLS = ("doc_id", "text", "lang", "source", "n_chars")


@query(" union all ".join(f"select '{c}' as name, count(*) as n, count({c}) as present, count({c}) > 0 as used from documents" for c in _NULLS))
def column_null_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(*_NULLS)
    cells = [F.struct(F.lit(c).alias("name"), F.count("*").alias("n"), F.count(c).alias("present")) for c in _NULLS]
    return d.agg(F.explode(F.array(*cells)).alias("c")).select("c.*").withColumn("used", F.col("present") > 0)


@query("""with c as (select c_custkey // 100 as batch_id, c_custkey, c_mktsegment as a, cast(c_nationkey as varchar) as b from customer), d as (select count(distinct a) <= count(distinct b) as a_first from c)
select batch_id, c_custkey, row_number() over (partition by batch_id order by case when a_first then a else b end, case when a_first then b else a end, c_custkey) as place from c, d""")
def cardinality_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows sorted by their columns, those of fewest values first."""
    c = table(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / 100).cast("long").alias("batch_id"), "c_custkey", F.col("c_mktsegment").alias("a"), F.col("c_nationkey").cast("string").alias("b"))
    return _place(c, [*stats.by_cardinality(c, ["a", "b"]), "c_custkey"], ["batch_id", "c_custkey"])


@query("""select distinct o_custkey % 8 as resource, o_orderstatus as scope from orders""")
def distinct_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.pmod("o_custkey", F.lit(8)).cast("long").alias("resource"), F.col("o_orderstatus").alias("scope")).distinct()


@query(f"with {LOG_ATTRS} select batch_id, parent_id, key from attrs where key in ('k', 'event_type')")
def attribute_include_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only attributes of a list of names; the list reaches the unpivot, so that no other column is read."""
    d = views.logs(spark, sf_dir).withColumnRenamed("id", "parent_id")
    return attributes.unpivot(d, ["batch_id", "parent_id"], {"k": ("int", F.col("k")), "event_type": ("str", F.col("severity_text"))}).select("batch_id", "parent_id", "key")
