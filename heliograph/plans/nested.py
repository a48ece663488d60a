"""Nested batches made of the star-schema tables, and registered queries that take them through tables, codecs and back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cbor, json_forms
from ..functions.scalars import obfuscate, reveal
from ..operators import adaptive, analysis, attributes, canonical, encoding, metrics, nesting, orders, sizes
from ..operators.nesting import PLACE
from ..sources import buckets, files, wire
from . import views
from .queries import query
from .views import table


def _map(**values: tuple[str, Column]) -> Column:
    """A map of tagged values; nulls are left out."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), attributes.typed(kind, v).alias("value")) for k, (kind, v) in values.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"]["type"] != 0))


def _nest(rows: DataFrame, at: str, of_scopes: str, items: str, item: Callable[[Column], Column], kind: str, data: str) -> DataFrame:
    """Batches of ``rows(batch_id, resource, scope, <at>, ...)``, all levels in order; ``item`` makes an item of a row.

    Rows of a batch meet as they are, in one list; they grow into items only while their batch is built.
    """
    first = ["resource", "scope", at]
    row = F.struct(*first, *[c for c in rows.columns if c not in ("batch_id", *first)])
    lists = rows.groupBy("batch_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))

    def groups(of: Column | str, by: str) -> Column:
        own = F.col(of) if isinstance(of, str) else of
        keys = F.array_distinct(F.transform(own, lambda x: x[by]))
        return F.transform(keys, lambda k: F.struct(k.alias("key"), F.filter(own, lambda x: x[by].eqNullSafe(k)).alias("rows")))

    def scope(g: Column) -> Column:
        own = F.struct(g["key"].alias("name"), F.lit("1").alias("version"), _map(level=("str", g["key"])).alias("attributes"), F.lit(0).cast("long").alias("dropped"))
        return F.struct(own.alias("scope"), F.lit("s").alias("schema_url"), F.transform(g["rows"], item).alias(items))

    def resource(g: Column) -> Column:
        own = F.struct(_map(number=("int", g["key"]), even=("bool", g["key"] % 2 == 0)).alias("attributes"), g["key"].alias("dropped"))
        return F.struct(own.alias("resource"), F.concat(F.lit("u"), (g["key"] % 2).cast("string")).alias("schema_url"), F.transform(groups(g["rows"], "scope"), scope).alias(of_scopes))

    return lists.select("batch_id", F.transform(groups("rows", "resource"), resource).cast(nesting.nested_type(of_scopes, items, kind)).alias(data))


def _trace_id(prefix: str, c: Column | str) -> Column:
    return F.unhex(F.md5(F.concat(F.lit(prefix), (F.col(c) if isinstance(c, str) else c).cast("string"))))


def nested_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A span for each order, with an event for each of its lines and a link for each that was returned.

    Orders and lines meet by batch, in the one shuffle that there is.
    """
    batch = lambda c: F.floor(F.col(c) / 1000).cast("long").alias("batch_id")
    line = F.struct(views.nanos("l_shipdate").alias("time_ns"), F.concat("l_returnflag", "l_linestatus").alias("name"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("quantity"))
    lines = table(spark, sf_dir, "lineitem").where("l_orderkey is not null").select(batch("l_orderkey"), F.col("l_orderkey").alias("o_orderkey"), line.alias("line"))
    tags = cbor.to_ser(F.concat(F.lit("["), F.col("o_custkey").cast("string"), F.lit(',"x"]')))
    order = F.struct("o_custkey", "o_orderstatus", "o_totalprice", views.nanos("o_orderdate").alias("start_ns"), "o_orderpriority", tags.alias("tags"))
    orders_ = table(spark, sf_dir, "orders").select(batch("o_orderkey"), "o_orderkey", order.alias("order"))
    both = nesting.by_batch(orders_.unionByName(lines, allowMissingColumns=True))
    both = both.groupBy("batch_id", "o_orderkey").agg(F.collect_list("order").alias("orders"), F.sort_array(F.collect_list("line")).alias("lines"))
    rows = both.select("batch_id", "o_orderkey", F.explode("orders").alias("order"), "lines")
    rows = rows.select("batch_id", F.pmod("order.o_custkey", F.lit(8)).cast("long").alias("resource"), F.col("order.o_orderstatus").alias("scope"), "o_orderkey", "order.*", "lines")

    def link(x: Column) -> Column:
        own = _trace_id("p", x["part"])
        return F.struct(own.alias("trace_id"), F.substring(own, 1, 8).alias("span_id"), x["name"].alias("trace_state"), _map(part=("int", x["part"])).alias("attributes"), F.lit(0).cast("long").alias("dropped"))

    def span(o: Column) -> Column:
        own, start = _trace_id("o", o["o_orderkey"]), o["start_ns"]
        events = F.transform(o["lines"], lambda x: F.struct(x["time_ns"], x["name"], _map(quantity=("double", x["quantity"]), part=("int", x["part"])).alias("attributes"), (x["part"] % 2).alias("dropped")))
        links = F.transform(F.filter(o["lines"], lambda x: x["name"].startswith("R")), link)
        attrs = _map(
            priority=("str", o["o_orderpriority"]), customer=("int", o["o_custkey"]), price=("double", o["o_totalprice"]), open=("bool", o["o_orderstatus"] == "O"),
            raw=("bytes", o["o_orderpriority"].cast("binary")), tags=("slice", o["tags"]),
        )
        return F.struct(
            own.alias("trace_id"), F.substring(own, 1, 8).alias("span_id"), F.lit("").alias("trace_state"), F.lit(None).cast("binary").alias("parent_span_id"), o["o_orderpriority"].alias("name"), F.lit(1).alias("kind"),
            start.alias("start_ns"), (start + F.floor(o["o_totalprice"])).alias("end_ns"), attrs.alias("attributes"), (o["o_custkey"] % 3).alias("dropped"), events.alias("events"), F.lit(0).cast("long").alias("dropped_events"),
            links.alias("links"), F.lit(0).cast("long").alias("dropped_links"), F.struct(F.lit(1).alias("code"), o["o_orderstatus"].alias("message")).alias("status"),
        )

    return _nest(rows, "o_orderkey", "scope_spans", "spans", span, nesting.SPAN, "traces")


def _flat_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same batches flattened, made once."""
    return buckets.kept(nesting.flatten(nested_traces(spark, sf_dir)), "traces")


_TRACES = """o as (
  select o_orderkey // 1000 as batch_id, o_custkey % 8 as resource, o_orderstatus as scope, o_orderkey, md5('o' || o_orderkey) as trace_id, o_orderpriority as name, epoch_us(o_orderdate) * 1000 as start_ns,
         cast(floor(o_totalprice) as bigint) as duration, o_custkey, o_totalprice, o_orderstatus from orders),
e as (select l_orderkey, epoch_us(l_shipdate) * 1000 as time_ns, l_returnflag || l_linestatus as name, l_partkey, l_quantity from lineitem),
places as (
  select *, dense_rank() over (partition by batch_id order by resource) - 1 as r, dense_rank() over (partition by batch_id, resource order by scope) - 1 as s, row_number() over (partition by batch_id, resource, scope order by o_orderkey) - 1 as i from o)"""


@query(f"""with {_TRACES}, ev as (select l_orderkey, count(*) as n_events, cast(sum(l_partkey % 2) as bigint) as dropped_in, string_agg(time_ns || ' ' || name || ' ' || l_partkey || ' ' || cast(l_quantity as bigint), ',' order by time_ns, name, l_partkey, l_quantity) as events,
  count(*) filter (name like 'R%') as n_links, string_agg(md5('p' || l_partkey), ',' order by time_ns, name, l_partkey, l_quantity) filter (name like 'R%') as links from e group by 1)
select batch_id, r, s, i, resource, resource % 2 = 0 as even, scope, trace_id, name, start_ns, start_ns + duration as end_ns, o_custkey % 3 as dropped, o_custkey as customer, o_totalprice as price, o_orderstatus = 'O' as open, hex(encode(name)) as raw,
  '[' || o_custkey || ',"x"]' as tags, coalesce(n_events, 0) as n_events, coalesce(events, '') as events, coalesce(dropped_in, 0) as dropped_in, coalesce(n_links, 0) as n_links, coalesce(links, '') as links from places left join ev on l_orderkey = o_orderkey""")
def renest_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches become tables and, by joins, batches again; then every span is shown with all that it got back."""
    flat = nesting.flatten(nesting.renest(nesting.tables(_flat_traces(spark, sf_dir))))
    a = F.col("span.attributes")
    one = lambda e: F.concat_ws(" ", e["time_ns"].cast("string"), e["name"], e["attributes"]["part"]["int"].cast("string"), e["attributes"]["quantity"]["double"].cast("long").cast("string"))
    return flat.select(
        "batch_id", *[F.col(c).cast("long").alias(c) for c in "rsi"], F.col("resource.attributes")["number"]["int"].alias("resource"), F.col("resource.attributes")["even"]["bool"].alias("even"), F.col("scope.name").alias("scope"),
        F.lower(F.hex("span.trace_id")).alias("trace_id"), "span.name", "span.start_ns", "span.end_ns", "span.dropped", a["customer"]["int"].alias("customer"), a["price"]["double"].alias("price"), a["open"]["bool"].alias("open"),
        F.hex(a["raw"]["bytes"]).alias("raw"), cbor.from_ser(a["tags"]["ser"]).alias("tags"), F.size("span.events").cast("long").alias("n_events"), F.array_join(F.transform("span.events", one), ",").alias("events"),
        F.aggregate("span.events", F.lit(0).cast("long"), lambda x, e: x + e["dropped"]).alias("dropped_in"), F.size("span.links").cast("long").alias("n_links"),
        F.array_join(F.transform("span.links", lambda x: F.lower(F.hex(x["trace_id"]))), ",").alias("links"),
    )


def _decoded(batches: DataFrame, signal: str) -> DataFrame:
    """Batches encoded and decoded. Each table is made from the batches, each decoded from a few tables, and batches from all
    of these: all are kept on disk, so that none is made twice and no task holds the sorts of many."""
    s = encoding.SIGNALS[signal]
    flat = buckets.kept(nesting.flatten(batches, signal, s.scopes, s.items, s.item), signal)
    return encoding.decode({name: buckets.kept(df, name) for name, df in encoding.encode_flat(flat, signal).items()}, signal, keep=buckets.kept)


def _trace_summary(batches: DataFrame) -> DataFrame:
    flat = nesting.flatten(batches).where("span is not null")
    return flat.groupBy("batch_id", F.col("resource.attributes")["number"]["int"].alias("resource"), F.col("scope.name").alias("scope"), "resource_url").agg(
        F.count("*").alias("spans"), F.sum(F.size("span.events")).alias("events"), F.sum(F.size("span.links")).alias("links"), F.sum(F.size("span.attributes")).alias("attrs"),
        F.sum(F.aggregate("span.events", F.lit(0).cast("long"), lambda x, e: x + e["attributes"]["part"]["int"])).alias("parts"), F.sum(F.aggregate("span.links", F.lit(0).cast("long"), lambda x, e: x + e["attributes"]["part"]["int"])).alias("linked"),
        F.sum(F.col("span.end_ns") - F.col("span.start_ns")).alias("duration"), F.md5(F.array_join(F.array_sort(F.collect_list(F.lower(F.hex("span.trace_id")))), ",")).alias("digest"),
    )


@query(f"""with {_TRACES}, ev as (select l_orderkey, count(*) as n, sum(l_partkey) as parts, count(*) filter (name like 'R%') as links, sum(l_partkey) filter (name like 'R%') as linked from e group by 1)
select batch_id, resource, scope, 'u' || (resource % 2) as resource_url, count(*) as spans, cast(coalesce(sum(n), 0) as bigint) as events, cast(coalesce(sum(links), 0) as bigint) as links, count(*) * 6 as attrs, cast(coalesce(sum(parts), 0) as bigint) as parts,
  cast(coalesce(sum(linked), 0) as bigint) as linked, cast(sum(duration) as bigint) as duration, md5(string_agg(trace_id, ',' order by trace_id)) as digest from o left join ev on l_orderkey = o_orderkey group by 1, 2, 3""")
def roundtrip_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches are encoded, with ids and parent ids as deltas, and decoded again."""
    return _trace_summary(_decoded(nested_traces(spark, sf_dir), "traces"))


@query(f"with {_TRACES} select batch_id, r, s, i, 6 as n_attrs, o_custkey as customer, name as priority from places")
def span_attr_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Span rows joined with the maps of their attribute rows."""
    t = nesting.tables(_flat_traces(spark, sf_dir))
    full = nesting.with_attributes(t["spans"], t["span_attrs"], PLACE)
    return full.select("batch_id", *[F.col(c).cast("long").alias(c) for c in "rsi"], F.size("attributes").alias("n_attrs"), F.col("attributes")["customer"]["int"].alias("customer"), F.col("attributes")["priority"]["str"].alias("priority"))


@query(f"""with {_TRACES}, n as (select l_orderkey, time_ns, name, l_partkey, l_quantity, row_number() over (partition by l_orderkey order by time_ns, name, l_partkey, l_quantity) - 1 as n from e)
select batch_id, r, s, i, n.n, n.name, l_partkey as part, l_quantity as quantity from places join n on l_orderkey = o_orderkey""")
def event_attr_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event rows joined with the maps of their attribute rows."""
    t = nesting.tables(_flat_traces(spark, sf_dir))
    full = nesting.with_attributes(t["events"], t["event_attrs"], [*PLACE, "n"])
    return full.select("batch_id", *[F.col(c).cast("long").alias(c) for c in "rsin"], "name", F.col("attributes")["part"]["int"].alias("part"), F.col("attributes")["quantity"]["double"].alias("quantity"))


@query(f"""with {_TRACES}, ev as (select l_orderkey, count(*) as events, string_agg(name, ',' order by time_ns, name, l_partkey, l_quantity) as names from e group by 1)
select batch_id, r, s, i, coalesce(events, 0) as events, coalesce(names, '') as names from places left join ev on l_orderkey = o_orderkey""")
def span_event_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Span rows joined with the lists of their event rows."""
    t = nesting.tables(_flat_traces(spark, sf_dir))
    full = nesting.meet(t["spans"], nesting.listed(t["events"], PLACE, "n", F.col("name"), "names"), PLACE, "left")
    names = F.coalesce("names", F.array().cast("array<string>"))
    return full.select("batch_id", *[F.col(c).cast("long").alias(c) for c in "rsi"], F.size(names).cast("long").alias("events"), F.array_join(names, ",").alias("names"))


@query(f"with {_TRACES} select distinct batch_id, r, s, resource, scope, resource as dropped, 'u' || (resource % 2) as url from places")
def resource_attr_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resource and scope rows joined with the maps of their attribute rows."""
    t = nesting.tables(_flat_traces(spark, sf_dir))
    r = nesting.with_attributes(t["resources"], t["resource_attrs"], ["batch_id", "r"])
    s = nesting.with_attributes(t["scopes"], t["scope_attrs"], ["batch_id", "r", "s"]).select("batch_id", "r", "s", F.col("attributes")["level"]["str"].alias("scope"))
    both = nesting.meet(s, r.select("batch_id", "r", F.col("attributes")["number"]["int"].alias("resource"), "dropped", F.col("schema_url").alias("url")), ["batch_id", "r"])
    return both.select("batch_id", F.col("r").cast("long").alias("r"), F.col("s").cast("long").alias("s"), "resource", "scope", "dropped", "url")


_KINDS = ("str", "int", "double", "bool", "bytes", "map", "slice")


def nested_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each event; bodies are of all kinds in turn."""
    e = views.logs(spark, sf_dir).withColumn("kind", F.pmod("event_id", F.lit(8)).cast("int"))
    ser = F.when(F.col("kind") == _KINDS.index("map"), F.col("body")).when(F.col("kind") == _KINDS.index("slice"), F.concat(F.lit("["), F.col("k").cast("string"), F.lit("]")))
    rows = e.select("batch_id", "resource", F.col("severity_text").alias("scope"), "id", "event_id", "time_unix_nano", "severity_text", "severity_number", "k", "value", "is_error", "kind", F.when(F.col("kind") == 0, F.col("body")).alias("body"), cbor.to_ser(ser).alias("ser"))

    def log(x: Column) -> Column:
        said = {"str": x["body"], "int": x["k"], "double": x["value"], "bool": x["is_error"], "bytes": x["severity_text"].cast("binary"), "map": x["ser"], "slice": x["ser"]}
        body = None
        for i, k in enumerate(_KINDS):
            value = attributes.typed(k, said[k])
            body = F.when(x["kind"] == i, value) if body is None else body.when(x["kind"] == i, value)
        own = _map(k=("int", x["k"]), value=("double", x["value"]), event_type=("str", x["severity_text"]), is_error=("bool", F.when(x["is_error"], x["is_error"])))
        return F.struct(
            x["time_unix_nano"].alias("time_ns"), F.lit(None).cast("long").alias("observed_ns"), F.lit(None).cast("binary").alias("trace_id"), F.lit(None).cast("binary").alias("span_id"), x["severity_number"].alias("severity_number"),
            x["severity_text"].alias("severity_text"), body.alias("body"), own.alias("attributes"), F.lit(0).cast("long").alias("dropped"), (x["event_id"] % 2).alias("flags"),
        )

    return _nest(nesting.by_batch(rows), "id", "scope_logs", "logs", log, nesting.LOG, "logs")


_LOG_ROWS = views.LOGS + ", l as (select *, event_id % 8 as kind from logs)"
_BODY = "case kind when 0 then body when 1 then cast(k as varchar) when 3 then cast(is_error as varchar) when 4 then hex(encode(severity_text)) when 5 then '{\"k\":' || k || '}' when 6 then '[' || k || ']' end"


@query(f"""with {_LOG_ROWS} select batch_id, resource, severity_text as scope, time_unix_nano as time_ns, severity_number, event_id % 2 as flags, case kind when 5 then 5 when 6 then 6 when 4 then 7 when 7 then null else kind + 1 end as body_type,
  {_BODY} as body, case kind when 2 then value end as body_double, k, value, (is_error)::int + 3 as n_attrs from l""")
def renest_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested records become tables and batches again; bodies come back in their kind."""
    flat = nesting.flatten_logs(nesting.renest_logs(nesting.log_tables(buckets.kept(nesting.flatten_logs(nested_logs(spark, sf_dir)), "logs"))))
    return _log_rows(flat)


def _log_rows(flat: DataFrame) -> DataFrame:
    b, a = F.col("log.body"), F.col("log.attributes")
    text = F.coalesce(b["str"], b["int"].cast("string"), b["bool"].cast("string"), F.hex(b["bytes"]), cbor.from_ser(b["ser"]))
    return flat.select(
        "batch_id", F.col("resource.attributes")["number"]["int"].alias("resource"), F.col("scope.name").alias("scope"), "log.time_ns", "log.severity_number", "log.flags", b["type"].alias("body_type"), text.alias("body"),
        b["double"].alias("body_double"), a["k"]["int"].alias("k"), a["value"]["double"].alias("value"), F.size(a).alias("n_attrs"),
    )


@query(f"""with {_LOG_ROWS} select batch_id, resource, severity_text as scope, time_unix_nano as time_ns, severity_number, event_id % 2 as flags, case kind when 5 then 5 when 6 then 6 when 4 then 7 when 7 then null else kind + 1 end as body_type,
  {_BODY} as body, case kind when 2 then value end as body_double, k, value, (is_error)::int + 3 as n_attrs from l""")
def roundtrip_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records, encoded and decoded."""
    return _log_rows(nesting.flatten_logs(_decoded(nested_logs(spark, sf_dir), "logs")))


def nested_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four metrics for each customer with orders: a gauge with a point for each order, and a summary, a histogram and an
    exponential histogram of their prices. Urgent orders are exemplars."""
    order = F.struct("o_orderkey", views.nanos("o_orderdate").alias("time_ns"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    o = nesting.by_batch(table(spark, sf_dir, "orders").select(F.floor(F.col("o_custkey") / 50).cast("long").alias("batch_id"), "o_custkey", order.alias("x")))
    c = o.groupBy("batch_id", "o_custkey").agg(F.sort_array(F.collect_list("x")).alias("os"), F.count("*").alias("n"), F.sum(F.col("x.price")).alias("total"), F.min(F.col("x.price")).alias("low"), F.max(F.col("x.price")).alias("high"))
    none, kinds = F.lit(None), list(metrics.POINTS)
    urgent = lambda x: F.filter(F.array(x), lambda y: y["priority"].startswith("1"))
    exemplar = lambda x: F.struct(x["time_ns"], x["o_orderkey"].alias("int"), none.cast("double").alias("double"), none.cast("binary").alias("trace_id"), none.cast("binary").alias("span_id"), _map(priority=("str", x["priority"])).alias("attributes"))
    head = lambda t, **a: [F.lit(0).cast("long").alias("start_ns"), t.alias("time_ns"), F.lit(0).cast("long").alias("flags"), _map(**a).alias("attributes")]
    log2 = lambda x: F.floor(F.log2(x)).cast("int")

    def points(c: Column) -> dict[str, Column]:
        count = lambda f: F.size(F.filter(c["os"], f)).cast(metrics.COUNT)
        first, tagged, n = c["os"][0]["time_ns"], {"customer": ("int", c["o_custkey"])}, c["n"].cast(metrics.COUNT).alias("count")
        numbers = F.transform(c["os"], lambda x: F.struct(*head(x["time_ns"], status=("str", x["status"])), none.cast("long").alias("int"), x["price"].alias("double"), F.transform(urgent(x), exemplar).alias("exemplars")))
        quantiles = F.array(F.struct(F.lit(0.0).alias("quantile"), c["low"].alias("value")), F.struct(F.lit(1.0).alias("quantile"), c["high"].alias("value")))
        summary = F.struct(*head(first, **tagged), n, c["total"].alias("sum"), quantiles.alias("quantiles"))
        counts = F.array(count(lambda x: x["price"] <= 1e5), count(lambda x: (x["price"] > 1e5) & (x["price"] <= 2e5)), count(lambda x: x["price"] > 2e5))
        ends = [c["total"].alias("sum"), c["low"].alias("min"), c["high"].alias("max")]
        late = F.transform(F.flatten(F.transform(c["os"], urgent)), exemplar).alias("exemplars")
        histogram = F.struct(*head(first, **tagged), n, *ends, F.array(F.lit(1e5), F.lit(2e5)).alias("bounds"), counts.alias("counts"), late)
        filled = F.transform(F.sequence(log2(c["low"]), log2(c["high"])), lambda b: count(lambda x: log2(x["price"]) == b))
        exponential = F.struct(*head(first, **tagged), n, *ends, F.lit(0).alias("scale"), F.lit(0).cast(metrics.COUNT).alias("zero_count"), F.struct(log2(c["low"]).alias("offset"), filled.alias("counts")).alias("positive"), none.cast(metrics._BUCKETS).alias("negative"), late)
        return {"numbers": numbers, "summaries": F.array(summary), "histograms": F.array(histogram), "exp_histograms": F.array(exponential)}

    def metric(c: Column) -> Column:
        own, name, number = points(c), F.lit(None), F.lit(None)
        for i, k in enumerate(kinds):
            name, number = F.when(c["k"] == i, F.lit(f"{k} ")).otherwise(name), F.when(c["k"] == i, i + 1).otherwise(number)
        lists = [F.when(c["k"] == i, own[k].cast(f"array<{metrics.POINTS[k]}>")).otherwise(F.array().cast(f"array<{metrics.POINTS[k]}>")).alias(k) for i, k in enumerate(kinds)]
        return F.struct(F.concat(name, c["o_custkey"].cast("string")).alias("name"), F.lit("").alias("description"), F.lit("usd").alias("unit"), number.alias("type"), F.lit(2).alias("temporality"), F.lit(False).alias("monotonic"), *lists)

    rows = c.select("batch_id", F.pmod("o_custkey", F.lit(8)).cast("long").alias("resource"), F.lit("m").alias("scope"), F.explode(F.array(*[F.lit(i) for i in range(len(kinds))])).alias("k"), "o_custkey", "os", "n", "total", "low", "high")
    rows = rows.withColumn("at", F.col("o_custkey") * 4 + F.col("k"))
    return _nest(rows, "at", "scope_metrics", "metrics", metric, metrics.METRIC, "metrics")


def _flat_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same batches flattened, made once."""
    return buckets.kept(metrics.flatten_metrics(nested_metrics(spark, sf_dir)), "metrics")


_CUSTOMERS = """c as (
  select o_custkey, o_custkey // 50 as batch_id, o_custkey % 8 as resource, count(*) as n, sum(o_totalprice) as total, min(o_totalprice) as low, max(o_totalprice) as high, count(*) filter (o_orderpriority like '1%') as urgent,
         cast(sum(o_orderkey) filter (o_orderpriority like '1%') as bigint) as urgent_keys, count(*) filter (o_totalprice <= 100000) as h0, count(*) filter (o_totalprice > 100000 and o_totalprice <= 200000) as h1, count(*) filter (o_totalprice > 200000) as h2,
         cast(sum(floor(log2(o_totalprice))) as bigint) as logs, count(*) filter (o_orderstatus = 'F') as done from orders group by 1)"""
_METRIC_ROWS = f"""with {_CUSTOMERS} select batch_id, resource, o_custkey as customer, n, done, round(total, 2) as total, low, high, urgent, coalesce(urgent_keys, 0) as urgent_keys, 3 * urgent as exemplar_attrs, h0 || ',' || h1 || ',' || h2 as counts, logs from c"""


def _metric_rows(batches: DataFrame) -> DataFrame:
    """One row for each customer, from all four metrics of theirs."""
    flat = metrics.flatten_metrics(batches).where("metric is not null").select("batch_id", F.col("resource.attributes")["number"]["int"].alias("resource"), "metric.*").withColumn("customer", F.element_at(F.split("name", " "), 2).cast("long"))
    f = lambda kind, c: F.first(F.when(F.size(kind) > 0, c), ignorenulls=True)
    h, e, s = (F.get(k, F.lit(0)) for k in ("histograms", "exp_histograms", "summaries"))
    found = F.flatten(F.transform("numbers", lambda p: p["exemplars"]))
    keys = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, y: a + y["int"])
    attrs = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, y: a + F.size(y["attributes"]))
    logs = F.aggregate(F.transform(e["positive"]["counts"], lambda x, i: (x * (i + e["positive"]["offset"])).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return flat.groupBy("batch_id", "resource", "customer").agg(
        F.max(F.size("numbers")).cast("long").alias("n"), F.max(F.size(F.filter("numbers", lambda p: p["attributes"]["status"]["str"] == "F"))).cast("long").alias("done"), F.round(f("summaries", s["sum"]), 2).alias("total"),
        f("summaries", F.get(s["quantiles"], F.lit(0))["value"]).alias("low"), f("exp_histograms", e["max"]).alias("high"), F.max(F.size(found)).cast("long").alias("urgent"), F.max(keys(h["exemplars"])).alias("urgent_keys"),
        (F.max(attrs(found)) + F.max(F.coalesce(attrs(h["exemplars"]), F.lit(0))) + F.max(F.coalesce(attrs(e["exemplars"]), F.lit(0)))).alias("exemplar_attrs"), f("histograms", F.array_join(F.transform(h["counts"], lambda x: x.cast("string")), ",")).alias("counts"),
        f("exp_histograms", logs).alias("logs"),
    )


@query(_METRIC_ROWS)
def renest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested metrics become tables of points and exemplars, and batches again."""
    return _metric_rows(metrics.renest(metrics.flat_tables(_flat_metrics(spark, sf_dir))))


@query(_METRIC_ROWS)
def roundtrip_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same metrics, encoded and decoded."""
    return _metric_rows(_decoded(nested_metrics(spark, sf_dir), "metrics"))


@query("""select o_custkey // 50 as batch_id, o_orderstatus as status, count(*) as points, count(*) filter (o_orderpriority like '1%') as exemplars, cast(sum(o_orderkey) filter (o_orderpriority like '1%') as bigint) as keys, round(sum(o_totalprice), 2) as total from orders group by 1, 2""")
def dp_attr_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number points joined with their attributes and with the lists of their exemplars."""
    t = metrics.flat_tables(_flat_metrics(spark, sf_dir))
    own = [*PLACE, "n"]
    points = nesting.with_attributes(t["numbers"], t["numbers_attrs"], own)
    exemplars = nesting.listed(t["exemplars"].where("kind = 'numbers'"), own, "x", F.col("int"), "keys")
    full = nesting.meet(points, exemplars, own, "left")
    keys = F.aggregate("keys", F.lit(0).cast("long"), lambda a, x: a + x)
    return full.groupBy("batch_id", F.col("attributes")["status"]["str"].alias("status")).agg(F.count("*").alias("points"), F.sum(F.coalesce(F.array_size("keys"), F.lit(0))).cast("long").alias("exemplars"), F.sum(keys).alias("keys"), F.round(F.sum("double"), 2).alias("total"))


@query("""select o_custkey // 50 as batch_id, k.kind, o_orderpriority as priority, count(*) as n, cast(sum(o_orderkey) as bigint) as keys from orders, (values ('numbers'), ('histograms'), ('exp_histograms')) k(kind) where o_orderpriority like '1%' group by 1, 2, 3""")
def exemplar_attr_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exemplars of all kinds of points joined with their attributes."""
    t = metrics.flat_tables(_flat_metrics(spark, sf_dir))
    full = nesting.with_attributes(t["exemplars"], t["exemplar_attrs"], [*PLACE, "kind", "n", "x"])
    return full.groupBy("batch_id", "kind", F.col("attributes")["priority"]["str"].alias("priority")).agg(F.count("*").alias("n"), F.sum("int").alias("keys"))


@query(f"with {_TRACES} select batch_id, scope, count(*) as n from o where scope = 'P' group by 1, 2")
def equiv_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested batches against the same ones decoded, from which one scope was left out: what is missing is that scope."""
    whole = nested_traces(spark, sf_dir)
    part = whole.withColumn("traces", F.transform("traces", lambda r: r.withField("scope_spans", F.filter(r["scope_spans"], lambda s: s["scope"]["name"] != "P"))))
    decoded = _decoded(part, "traces")
    lost = canonical.difference(whole, decoded, "traces")
    span = F.get_json_object("item", "$.trace_id")
    o = table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 1000).cast("long").alias("batch_id"), F.base64(_trace_id("o", "o_orderkey")).alias("trace_id"))
    named = lost.select("side", F.get_json_object(F.split_part("scope", F.lit("|"), F.lit(1)), "$.name").alias("scope"), span.alias("trace_id")).where("side = 'missing'").join(o, "trace_id")
    return named.groupBy("batch_id", "scope").agg(F.count("*").alias("n"))


def _orders_sql(source: str, rows: str, table_: str, named: dict[str, str], tie: list[str], item: str) -> str:
    """Digests of rows in each order of a table; ``named`` are columns that the source names otherwise, '' if it has none."""
    parts = []
    for name, by in orders.ORDERS[table_].items():
        keys = [named.get(k, k) for k in by.keys]
        sort = ", ".join(f"{k} nulls first" for k in [*[k for k in keys if k], *[t for t in tie if t not in keys]])
        parts.append(f"select '{name}' as name, batch_id, md5(string_agg({item}, ',' order by {sort})) as digest from {rows} group by batch_id")
    return f"with {source} " + " union all ".join(parts)


def _in_orders(rows: DataFrame, table_: str, tie: list[str], item: Column) -> DataFrame:
    out = None
    for name, by in orders.ORDERS[table_].items():
        placed = orders.place(rows.withColumn("item", item), by, tie).groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("rn", "item"))).alias("x"))
        own = placed.select(F.lit(name).alias("name"), "batch_id", F.md5(F.array_join(F.transform("x", lambda y: y["item"]), ",")).alias("digest"))
        out = own if out is None else out.unionByName(own)
    return out


_TIMES = {"start_ns": "start_nano", "time_ns": "start_nano", "int": "duration_nano", "double": "", "parent_id": "n"}


@query(_orders_sql(views.SPANS, "spans", "spans", _TIMES, ["trace", "n"], "trace_id || ':' || n"))
def sort_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans in each of their orders, as a digest for each batch."""
    return _in_orders(views.spans(spark, sf_dir).withColumnRenamed("start_nano", "start_ns"), "spans", ["trace", "n"], F.concat("trace_id", F.lit(":"), F.col("n").cast("string")))


@query(_orders_sql(views.SPANS, "spans", "numbers", _TIMES, ["trace", "n"], "trace_id || ':' || n"))
def sort_point_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number points (durations of spans) in each of their orders."""
    points = views.spans(spark, sf_dir).withColumnsRenamed({"start_nano": "time_ns", "duration_nano": "int"}).withColumns({"double": F.lit(None).cast("double"), "parent_id": F.col("n")})
    return _in_orders(points, "numbers", ["trace", "n"], F.concat("trace_id", F.lit(":"), F.col("n").cast("string")))


@query(_orders_sql(views.LOG_ATTRS, "attrs", "attrs16", {"bytes": "", "ser": ""}, ["parent_id", "key"], "parent_id || ':' || key"))
def sort_attr_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes in each of their orders."""
    none = F.lit(None).cast("binary")
    a = views.log_attrs(spark, sf_dir).withColumns({"bytes": none, "ser": none})
    return _in_orders(a, "attrs16", ["parent_id", "key"], F.concat(F.col("parent_id").cast("string"), F.lit(":"), F.col("key")))


@query()
def message_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of batches of records as compressed JSON lines and as compressed encoded tables, and their ratio."""
    made = buckets.kept(nested_logs(spark, sf_dir), "logs")  # read once for each table
    both = sizes.json_sizes(made, "logs").unionByName(sizes.table_sizes(made, "logs"))
    return sizes.ratios(both, [])


@query(f"""with {_TRACES} select batch_id, count(distinct r) as resources, count(distinct (r, s)) as scopes, count(*) as items, count(distinct resource) as distinct_resources, count(distinct scope) as distinct_scopes,
  count(distinct resource % 2) as resource_urls, 1 as scope_urls from places group by 1""")
def batch_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resources, scopes and spans of each batch, and distinct ones and schema urls among them."""
    return analysis.levels(nesting.flatten(nested_traces(spark, sf_dir)), "span")


@query(f"""with {_TRACES}, p as (select *, (row_number() over (order by batch_id, r, s, i) - 1) // 300 as part from places)
select part as batch_id, count(*) as spans, count(distinct resource) as resources, count(distinct (resource, scope)) as scopes, cast(sum(duration) as bigint) as duration from p group by 1""")
def batch_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans dealt anew into batches of 300, under their resources and scopes."""
    cut = files.slice_items(_flat_traces(spark, sf_dir), "span", 300)
    return cut.groupBy("batch_id").agg(F.count("*").alias("spans"), F.countDistinct("r").alias("resources"), F.countDistinct("r", "s").alias("scopes"), F.sum(F.col("span.end_ns") - F.col("span.start_ns")).alias("duration"))


@query(f"""with {_LOG_ROWS} select batch_id, resource, severity_text as scope, time_unix_nano as time_ns, severity_number, event_id % 2 as flags, case kind when 5 then 5 when 6 then 6 when 4 then 7 when 7 then null else kind + 1 end as body_type,
  {_BODY} as body, case kind when 2 then value end as body_double, k, value, (is_error)::int + 3 as n_attrs from l""")
def wire_roundtrip_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested records written as messages, and read again."""
    back = _log_rows(nesting.flatten_logs(wire.read_messages(wire.write_messages(nested_logs(spark, sf_dir), "logs"), "logs")))
    zero = lambda c: F.coalesce(c, F.lit(0))  # noqa: E731  a message can't tell 0 from absent
    return back.withColumns({"severity_number": zero("severity_number"), "flags": zero("flags")})


@query("""select l_orderkey, '{"names":[' || string_agg('"' || l_returnflag || l_linestatus || '"', ',' order by l_returnflag || l_linestatus) || '],"order":' || l_orderkey || '}' as canonical from lineitem group by 1""")
def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON of the lines of an order, in whatever order, in its canonical form."""
    names = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.concat("l_returnflag", "l_linestatus")).alias("names"))
    return names.select("l_orderkey", json_forms.canonical_json(F.to_json(F.struct(F.col("l_orderkey").alias("order"), "names"))).alias("canonical"))


@query("select event_id, '{\"k\":' || cast(json_extract(props, '$.k') as bigint) || '}' as props from events")
def cbor_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested values serialized and read again."""
    return table(spark, sf_dir, "events").select("event_id", cbor.from_ser(cbor.to_ser(F.col("props"))).alias("props"))


@query("select c_custkey, c_name as revealed, length(c_name) as n, c_name <> '' as changed from customer")
def obfuscate_len_preserving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names enciphered, which keeps their length, and deciphered."""
    key = b"key of the registered query"
    names = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    c = names.repartition(nesting.parts(names)).withColumn("o", obfuscate(F.col("c_name"), key))  # one group of rows in a file is one task, of a million names
    return c.select("c_custkey", reveal(F.col("o"), key).alias("revealed"), F.length("o").cast("long").alias("n"), (F.col("o") != F.col("c_name")).alias("changed"))


@query("""with f as (select user_id, min(event_id // 1000) as batch_id from events group by 1), n as (select batch_id, count(*) as new from f group by 1), t as (select batch_id, sum(new) over (order by batch_id) as total from n),
w as (select *, row_number() over (order by batch_id) as i from t),
x as (select batch_id, cast(total as bigint) as total, case when total <= 255 then 'u8' when total <= 65535 then 'u16' else 'plain' end as width, lag(case when total <= 255 then 'u8' when total <= 65535 then 'u16' else 'plain' end) over (order by batch_id) as before, i from w)
select batch_id, 'user_id' as column, 'appears' as event, total as distinct from x where i = 1
union all select batch_id, 'user_id', case when width = 'plain' then 'overflows' else 'widens' end, total from x where before is not null and width <> before
union all select batch_id, 'user_id', case when width = 'plain' then 'overflows' else 'widens' end, total from x where i = 1 and width <> 'u8'""")
def dictionary_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What happens to the dictionary of a column over the batches of a stream."""
    e = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 1000).cast("long").alias("batch_id"), "user_id")
    return adaptive.events(e, "batch_id", ["user_id"])
