"""The registered telemetry queries: Spark plans and, for each that SQL can express, the DuckDB SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import obfuscate, resource_id
from ..operators import attributes, codec, compare, stats
from . import views
from .views import LOG_ATTRS, LOGS, SPANS, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


ATTR_ORDER = ["type", "key", "str", "int", "double", "bool", "parent_id"]
ATTR_VALUE = ["type", "key", "str", "int", "double", "bool"]
_ORDER = "type, key, str nulls first, int nulls first, double nulls first, bool nulls first, parent_id"


@query(f"""with {LOG_ATTRS}, r as (select *, row_number() over (partition by batch_id order by {_ORDER}) as rn from attrs)
select key, type, count(*) as n, cast(sum(parent_id) as bigint) as parents, cast(sum(rn) as bigint) as places from r group by key, type""")
def flagship_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes are unpivoted, sorted, encoded by runs of equal values, decoded, and summed up."""
    a = views.log_attrs(spark, sf_dir).withColumn("rn", F.row_number().over(codec.window(["batch_id"], ATTR_ORDER)).cast("long"))
    encoded = codec.group_delta_encode(a, ["batch_id"], ["rn"], ATTR_VALUE, "parent_id", "delta").drop("parent_id")
    decoded = codec.group_delta_decode(encoded, ["batch_id"], ["rn"], ATTR_VALUE, "delta", "parent_id")
    return decoded.groupBy("key", "type").agg(F.count("*").alias("n"), F.sum("parent_id").alias("parents"), F.sum("rn").alias("places"))


@query(f"with {LOGS} select batch_id, id, time_unix_nano, severity_text, severity_number, body, resource from logs")
def log_flat_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.logs(spark, sf_dir).select("batch_id", "id", "time_unix_nano", "severity_text", "severity_number", "body", "resource")


@query(f"with {LOG_ATTRS} select * from attrs")
def log_attrs_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.log_attrs(spark, sf_dir)


_TOKENS = "with t as (select distinct unnest(string_split(text, ' ')) as token from documents)"


@query(_TOKENS + r""", k as (
  select token, case when regexp_full_match(token, '[+-]?\d+') and try_cast(token as bigint) is not null then 2
                     when regexp_full_match(token, '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?') and isfinite(try_cast(token as double)) then 3
                     when regexp_full_match(lower(token), '[+-]?inf(inity)?|nan') or regexp_full_match(token, '[+-]?0[xX]([0-9a-fA-F]+\.?[0-9a-fA-F]*|\.[0-9a-fA-F]+)[pP][+-]?\d+') then 3
                     when token in ('t', 'T', 'true', 'TRUE', 'True', 'f', 'F', 'false', 'FALSE', 'False') then 4 else 1 end as type from t)
select type, count(*) as n, cast(sum(case when type = 2 then cast(try_cast(token as bigint) as decimal(38, 0)) end) as varchar) as ints, min(case when type = 1 then token end) as first_str from k group by type""")
def attr_value_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ", -1)).alias("token")).distinct()
    v = tokens.select(attributes.infer(F.col("token")).alias("v")).select("v.*")
    return v.groupBy("type").agg(F.count("*").alias("n"), F.sum(F.col("int").cast("decimal(38,0)")).cast("string").alias("ints"), F.min("str").alias("first_str"))


@query(f"""with {SPANS}, c as (select *, lag(resource) over w is distinct from resource or row_number() over w = 1 as nr,
  lag(resource) over w is distinct from resource or lag(scope) over w is distinct from scope or row_number() over w = 1 as ns
  from spans window w as (partition by batch_id order by resource, scope, name, trace_id, n))
select batch_id, trace, n, cast(sum(nr::int) over v - 1 as bigint) as resource_id, cast(sum(ns::int) over v - 1 as bigint) as scope_id
from c window v as (partition by batch_id order by resource, scope, name, trace_id, n)""")
def resource_scope_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["resource", "scope", "name", "trace_id", "n"]
    s = codec.run_ids(views.spans(spark, sf_dir), ["batch_id"], order, ["resource"], "resource_id")
    return codec.run_ids(s, ["batch_id"], order, ["resource", "scope"], "scope_id").select("batch_id", "trace", "n", "resource_id", "scope_id")


_ITEMS = f"""{SPANS}, ids as (select *, case when quantity > 25 then sum((quantity > 25)::int) over (partition by batch_id order by trace, n rows unbounded preceding) - 1 end as id from
  (select batch_id, trace, n, coalesce(quantity, 0) as quantity from spans))"""


@query(f"with {_ITEMS} select batch_id, trace, n, cast(id as bigint) as id from ids")
def item_ids_nullable(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.spans(spark, sf_dir)
    return codec.item_ids(s, ["batch_id"], ["trace", "n"], F.coalesce(F.col("quantity") > 25, F.lit(False)), "id").select("batch_id", "trace", "n", "id")


@query(f"""with {_ITEMS} select batch_id, trace, n, cast(id - coalesce(last_value(id ignore nulls) over (partition by batch_id order by trace, n rows between unbounded preceding and 1 preceding), 0) as bigint) as delta from ids""")
def delta_encode_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.delta_encode(item_ids_nullable(spark, sf_dir), ["batch_id"], ["trace", "n"], "id", "delta").drop("id")


@query(f"with {_ITEMS} select batch_id, trace, n, cast(id as bigint) as id from ids")
def delta_decode_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.delta_decode(delta_encode_id(spark, sf_dir), ["batch_id"], ["trace", "n"], "delta", "id").drop("delta")


def _grouped_sql(keys: str, order: str) -> str:
    differs = " or ".join(f"lag({k}) over w is distinct from {k}" for k in keys.split(", "))
    return f"""with {LOG_ATTRS} select batch_id, parent_id, key, case when row_number() over w = 1 or {differs} then parent_id else (parent_id - lag(parent_id) over w) & 65535 end as delta
from attrs window w as (partition by batch_id order by {order})"""


def _grouped(spark: SparkSession, sf_dir: str, keys: list[str], order: list[str]) -> DataFrame:
    a = codec.group_delta_encode(views.log_attrs(spark, sf_dir), ["batch_id"], order, keys, "parent_id", "delta")
    return a.select("batch_id", "parent_id", "key", "delta")


@query(_grouped_sql("type, key, str, int, double, bool", _ORDER))
def delta_group_key_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouped(spark, sf_dir, ATTR_VALUE, ATTR_ORDER)


@query(_grouped_sql("type, key", "type, key, parent_id"))
def delta_group_type_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouped(spark, sf_dir, ["type", "key"], ["type", "key", "parent_id"])


@query(_grouped_sql("type", "type, parent_id, key"))
def delta_group_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouped(spark, sf_dir, ["type"], ["type", "parent_id", "key"])


@query(f"with {LOG_ATTRS} select batch_id, parent_id, key from attrs")
def delta_group_decode_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = codec.group_delta_encode(views.log_attrs(spark, sf_dir), ["batch_id"], ATTR_ORDER, ATTR_VALUE, "parent_id", "delta")
    a = a.withColumn("rn", F.row_number().over(codec.window(["batch_id"], ATTR_ORDER))).drop("parent_id")
    return codec.group_delta_decode(a, ["batch_id"], ["rn"], ATTR_VALUE, "delta", "parent_id").select("batch_id", "parent_id", "key")


@query(f"with {SPANS} select batch_id, trace_id, n, parent, name, start_nano, start_nano + duration_nano as end_nano, duration_nano, resource, scope from spans")
def span_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.spans(spark, sf_dir).withColumn("end_nano", F.col("start_nano") + F.col("duration_nano"))
    return s.select("batch_id", "trace_id", "n", "parent", "name", "start_nano", "end_nano", "duration_nano", "resource", "scope")


@query(f"""with {LOG_ATTRS}, m as (select batch_id, parent_id, count(*) as n, string_agg(key, ',' order by key) as keys from attrs group by 1, 2)
select l.batch_id, l.id, coalesce(m.n, 0) as n_attrs, coalesce(keys, '') as keys from logs l left join m on l.batch_id = m.batch_id and l.id = m.parent_id""")
def log_attr_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = attributes.rebuild_maps(views.log_attrs(spark, sf_dir), ["batch_id", "parent_id"], ["type"])
    joined = views.logs(spark, sf_dir).join(maps.withColumnRenamed("parent_id", "id"), ["batch_id", "id"], "left")
    keys = F.array_sort(F.coalesce(F.map_keys("attributes"), F.array().cast("array<string>")))
    return joined.select("batch_id", "id", F.size(keys).cast("long").alias("n_attrs"), F.array_join(keys, ",").alias("keys"))


_DAY = "cast(l_shipdate as date)"


@query(f"""select 'sum' as kind, l_returnflag as flag, epoch_us(l_shipdate) * 1000 as time_nano, count(*) as n, round(sum(l_extendedprice), 2) as total from lineitem group by 2, 3
union all select 'gauge', l_returnflag, epoch_us(l_shipdate) * 1000, count(*), round(max(l_discount), 2) from lineitem group by 2, 3""")
def metric_by_type_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum and gauge points of one pass over the lines, in one table."""
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), views.nanos("l_shipdate").alias("time_nano"))
    g = g.agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("s"), F.round(F.max("l_discount"), 2).alias("g"))
    return g.select("flag", "time_nano", "n", F.expr("stack(2, 'sum', s, 'gauge', g) as (kind, total)"))


@query("""select l_returnflag as flag, count(*) as n, count(*) filter (l_quantity <= 10) as b0, count(*) filter (l_quantity > 10 and l_quantity <= 20) as b1, count(*) filter (l_quantity > 20 and l_quantity <= 30) as b2,
count(*) filter (l_quantity > 30 and l_quantity <= 40) as b3, count(*) filter (l_quantity > 40) as b4, min(l_quantity) as min, max(l_quantity) as max from lineitem group by 1""")
def histogram_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, bounds = F.col("l_quantity"), (10, 20, 30, 40)
    low, high = (None, *bounds), (*bounds, None)
    inside = [(q > a if a is not None else F.lit(True)) & (q <= b if b is not None else F.lit(True)) for a, b in zip(low, high, strict=True)]
    counts = [F.count_if(c).alias(f"b{i}") for i, c in enumerate(inside)]
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n"), *counts, F.min(q).alias("min"), F.max(q).alias("max"))


@query("select l_returnflag as flag, cast(floor(log2(l_extendedprice)) as bigint) as bucket, count(*) as n from lineitem where l_extendedprice > 0 group by 1, 2")
def exp_histogram_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").where("l_extendedprice > 0")
    return d.groupBy(F.col("l_returnflag").alias("flag"), F.floor(F.log2("l_extendedprice")).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


@query("select p_brand as brand, count(*) as n, round(quantile_cont(p_retailprice, 0.5), 6) as q50, round(quantile_cont(p_retailprice, 0.9), 6) as q90, round(sum(p_retailprice), 2) as total from part group by 1")
def summary_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_retailprice")
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(
        F.count("*").alias("n"), F.round(F.percentile(p, F.lit(0.5)), 6).alias("q50"), F.round(F.percentile(p, F.lit(0.9)), 6).alias("q90"), F.round(F.sum(p), 2).alias("total"))


@query(f"""with {SPANS} select name, trace, n, duration_nano from (select *, row_number() over (partition by name order by duration_nano desc, trace, n) as r from spans) where r <= 3""")
def exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("name").orderBy(F.desc("duration_nano"), "trace", "n")
    return views.spans(spark, sf_dir).withColumn("r", F.row_number().over(w)).where("r <= 3").select("name", "trace", "n", "duration_nano")


@query(f"with {SPANS} select batch_id, trace, n, row_number() over (partition by batch_id order by resource, scope, name, trace_id, n) as place from spans")
def sort_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = codec.window(["batch_id"], ["resource", "scope", "name", "trace_id", "n"])
    return views.spans(spark, sf_dir).select("batch_id", "trace", "n", F.row_number().over(w).cast("long").alias("place"))


@query(f"with {SPANS} select trace_id, n, name from spans order by trace_id, n limit 100")
def head_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.spans(spark, sf_dir).select("trace_id", "n", "name").orderBy("trace_id", "n").limit(100)


@query(f"""with {LOG_ATTRS} select batch_id, count(*) as n, count(distinct key) as keys, cast(sum(strlen(key)) as bigint) as key_bytes, count(distinct (type, str, int, double, bool)) as values,
count(*) filter (type = 1) as n_str, count(*) filter (type = 2) as n_int, count(*) filter (type = 3) as n_double, count(*) filter (type = 4) as n_bool from attrs group by 1""")
def attr_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.attribute_stats(views.log_attrs(spark, sf_dir), ["batch_id"])


@query("""select lang, count(*) filter (coalesce(text, '') = '') as missing, count(distinct nullif(text, '')) as distinct, min(strlen(nullif(text, ''))) as min_bytes, max(strlen(nullif(text, ''))) as max_bytes,
cast(sum(strlen(nullif(text, ''))) as bigint) as bytes from documents group by 1""")
def string_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.string_stats(table(spark, sf_dir, "documents"), ["lang"], "text")


@query(f"""with {SPANS}, d as (select batch_id, start_nano, start_nano + duration_nano as e, duration_nano, start_nano - lag(start_nano) over (partition by batch_id order by start_nano, trace, n) as sd from spans)
select batch_id, count(distinct start_nano) as starts, count(distinct e) as ends, count(distinct duration_nano) as durations, count(distinct sd) as start_deltas from d group by 1""")
def time_interval_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.spans(spark, sf_dir).withColumn("e", F.col("start_nano") + F.col("duration_nano"))
    s = s.withColumn("sd", F.col("start_nano") - F.lag("start_nano").over(codec.window(["batch_id"], ["start_nano", "trace", "n"])))
    # Rows of a batch lie together already: sets of one batch at a time, not every row once for each count.
    return s.groupBy("batch_id").agg(*[F.size(F.collect_set(c)).cast("long").alias(n) for c, n in (("start_nano", "starts"), ("e", "ends"), ("duration_nano", "durations"), ("sd", "start_deltas"))])


@query(f"with {SPANS}, b as (select batch_id, count(*) as spans, count(distinct resource) as resources, count(distinct (resource, scope)) as scopes from spans group by 1) select count(*) as batches, cast(sum(spans) as bigint) as spans, max(spans) as most, min(spans) as least, cast(sum(resources) as bigint) as resources, cast(sum(scopes) as bigint) as scopes from b")
def batch_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = views.spans(spark, sf_dir).groupBy("batch_id").agg(F.count("*").alias("spans"), F.countDistinct("resource").alias("resources"), F.countDistinct("resource", "scope").alias("scopes"))
    return b.agg(F.count("*").alias("batches"), F.sum("spans").alias("spans"), F.max("spans").alias("most"), F.min("spans").alias("least"), F.sum("resources").alias("resources"), F.sum("scopes").alias("scopes"))


@query("select event_type, count(value) as n, min(value) as min, max(value) as max, round(avg(value), 6) as mean, round(coalesce(stddev_samp(value), 0), 6) as stddev, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.9), 6) as p90, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99 from events group by 1")
def exact_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.summary(table(spark, sf_dir, "events"), ["event_type"], "value")


_COLUMNS = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query("with p as (" + " union all ".join(f"select '{c}' as name, count(*) as n, count({c}) as present, count(distinct {c}) as distinct_ from customer" for c in _COLUMNS) + ") select name, n, present, distinct_ as distinct, present > 0 as used, case when distinct_ > 65535 then 'plain' when distinct_ <= 255 then 'u8' else 'u16' end as width from p")
def dictionary_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.column_profile(table(spark, sf_dir, "customer").select(*_COLUMNS))


@query("""with e as (select event_id // 1000 as batch_id, user_id from events), f as (select user_id, min(batch_id) as batch_id from e group by 1), n as (select batch_id, count(*) as new from f group by 1),
t as (select b.batch_id, coalesce(new, 0) as new, cast(sum(coalesce(new, 0)) over (order by b.batch_id) as bigint) as total from (select distinct batch_id from e) b left join n using (batch_id))
select *, case when total <= 255 then 'u8' when total <= 65535 then 'u16' else 'plain' end as width from t""")
def dictionary_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 1000).cast("long").alias("batch_id"), "user_id")
    return stats.cumulative_dictionary(e, "batch_id", "user_id")


_WIDE = {"k": "int", "value": "double", "event_type": "str", "is_error": "bool"}


@query(f"with {LOG_ATTRS} select batch_id, parent_id, max(str) filter (key = 'event_type') as event_type_str, bool_or(bool) filter (key = 'is_error') as is_error_bool, max(int) filter (key = 'k') as k_int, max(double) filter (key = 'value') as value_double from attrs group by 1, 2")
def wide_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributes.pivot_wide(views.log_attrs(spark, sf_dir), ["batch_id", "parent_id"], _WIDE)


@query(f"with {LOG_ATTRS} select * from attrs")
def wide_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributes.unpivot_wide(wide_pivot(spark, sf_dir), ["batch_id", "parent_id"]).drop("bytes", "ser")


_PAIR = f"{LOGS}, a as (select batch_id, id, severity_text from logs where k < 90), b as (select batch_id, id, severity_text from logs where k > 10)"


def _pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = views.logs(spark, sf_dir)
    return tuple(d.where(c).select("batch_id", "id", "severity_text") for c in ("k < 90", "k > 10"))


@query(f"with {_PAIR} select *, 'missing' as side from (select * from a except select * from b) union all select *, 'unexpected' from (select * from b except select * from a)")
def equiv_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.difference(*_pair(spark, sf_dir))


@query(f"with {_PAIR}, c as (select batch_id, severity_text from a), d as (select batch_id, severity_text from b) select *, 'missing' as side from (select * from c except all select * from d) union all select *, 'unexpected' from (select * from d except all select * from c)")
def equiv_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.difference(*[x.drop("id") for x in _pair(spark, sf_dir)], strict=True)


_ROUTES = {"first": 1, "second": 9, "third": 90}


@query("select case when event_id % 100 < 1 then 'first' when event_id % 100 < 10 then 'second' else 'third' end as route, count(*) as n from events group by 1")
def route_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.route(table(spark, sf_dir, "events"), _ROUTES, "event_id").groupBy("route").agg(F.count("*").alias("n"))


_FIRST = "f as (select event_id // 100 as batch_id, user_id % 4 as stream, min(epoch_us(ts) * 1000) as ts from events group by 1, 2)"


@query(f"with {_FIRST} select batch_id, stream, ts, cast(coalesce(greatest(ts - lag(ts) over (partition by stream order by ts, batch_id), 0) * 0.5, 0) as bigint) as wait_nanos from f")
def replay_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 100).cast("long").alias("batch_id"), F.pmod("user_id", F.lit(4)).alias("stream")).agg(F.min(views.nanos("ts")).alias("ts"))
    return compare.replay_gaps(e, ["stream"], "ts", 0.5)


@query("""with x as (select event_id as sequence, md5(props) as digest from events where event_id % 10 <> 3), r as (select event_id as sequence, case when event_id % 7 = 0 then 'x' else md5(props) end as digest from events where event_id % 10 <> 4 union all select event_id, md5(props) from events where event_id % 50 = 1),
g as (select sequence, count(*) as n, min(digest) as got from r group by 1)
select coalesce(x.sequence, g.sequence) as sequence, case when x.digest is null then 'unexpected' when n is null then 'missing' when n > 1 then 'duplicate' when x.digest = got then 'matched' else 'different' end as state from x full join g on x.sequence = g.sequence""")
def validation_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("sequence"), F.md5("props").alias("digest"))
    spoiled = F.when(F.col("sequence") % 7 == 0, "x").otherwise(F.col("digest"))
    received = e.where("sequence % 10 <> 4").withColumn("digest", spoiled).unionByName(e.where("sequence % 50 = 1"))
    return compare.match_expected(e.where("sequence % 10 <> 3"), received)


@query("select c_custkey, case when c_acctbal < 0 then 'own' else 'stream' end as tenant, c_mktsegment as segment from customer")
def header_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of a stream, with those of a batch over them."""
    c = table(spark, sf_dir, "customer")
    own = F.when(F.col("c_acctbal") < 0, F.create_map(F.lit("tenant"), F.lit("own"))).otherwise(F.create_map().cast("map<string,string>"))
    stream = F.create_map(F.lit("tenant"), F.lit("stream"), F.lit("segment"), F.col("c_mktsegment"))
    merged = F.map_from_entries(F.concat(F.filter(F.map_entries(stream), lambda e: ~F.map_contains_key(own, e["key"])), F.map_entries(own)))
    return c.select("c_custkey", merged["tenant"].alias("tenant"), merged["segment"].alias("segment"))


@query("select event_type as method, case when user_id % 2 = 0 then 'sent' else 'received' end as direction, cast(sum(strlen(props)) as bigint) as bytes, count(*) as n from events group by 1, 2")
def bytes_by_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    direction = F.when(F.col("user_id") % 2 == 0, "sent").otherwise("received")
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("method"), direction.alias("direction")).agg(F.sum(F.octet_length("props")).alias("bytes"), F.count("*").alias("n"))


@query("with p as (select o_orderkey // 4 as batch_id, o_orderpriority as payload_type from orders), c as (select batch_id, payload_type, count(*) as n from p group by 1, 2) select *, case when payload_type in ('5-LOW') then 'unknown' else 'duplicate' end as fault from c where n > 1 or payload_type = '5-LOW'")
def payload_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 4).cast("long").alias("batch_id"), F.col("o_orderpriority").alias("payload_type"))
    return compare.repeated_payloads(p, ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"])


@query(f"with {SPANS} select trace % 7 <> 3 and n <> 2 as valid, count(*) as n from spans group by 1")
def id_length_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trace ids must have 16 bytes and span ids 8; some of each are cut here."""
    s = views.spans(spark, sf_dir)
    whole = F.unhex("trace_id")
    trace, span = F.when(F.col("trace") % 7 == 3, F.substring(whole, 1, 15)).otherwise(whole), F.when(F.col("n") == 2, F.substring(whole, 1, 9)).otherwise(F.substring(whole, 1, 8))
    return s.groupBy(attributes.valid_ids(trace, span).alias("valid")).agg(F.count("*").alias("n"))


@query("select distinct '{n:' || n_nationkey || ',r:' || n_regionkey || '}|0|' || n_name as id from nation")
def canonical_resource_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.create_map(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit("n"), F.col("n_nationkey").cast("string"))
    return table(spark, sf_dir, "nation").select(resource_id(m, F.lit(0), F.col("n_name")).alias("id")).distinct()


@query()
def obfuscate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", obfuscate(F.col("c_name"), b"key of the registered query").alias("c_name"))


@query()
def approximate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = stats.approximate(table(spark, sf_dir, "events"), ["event_type"], "value")
    return a.select("event_type", "distinct", "min", "max", "mean", "stddev", F.col("quantiles")[0].alias("p50"), F.col("quantiles")[1].alias("p99"))
