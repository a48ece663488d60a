"""Nested batches of traces and logs to flat tables, and back.

A batch is an array of resources, with scopes and items below them; flat tables carry batch_id, so that every join and
window stays within a batch. A row's parent is its place: r (resource), s (scope), i (item), n (event, link or point).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .attributes import ATTRS, VALUE, VALUE_FIELDS

EVENT = f"struct<time_ns:bigint,name:string,attributes:{ATTRS},dropped:bigint>"
LINK = f"struct<trace_id:binary,span_id:binary,trace_state:string,attributes:{ATTRS},dropped:bigint>"
SPAN = (
    f"struct<trace_id:binary,span_id:binary,trace_state:string,parent_span_id:binary,name:string,kind:int,start_ns:bigint,end_ns:bigint,attributes:{ATTRS},"
    f"dropped:bigint,events:array<{EVENT}>,dropped_events:bigint,links:array<{LINK}>,dropped_links:bigint,status:struct<code:int,message:string>>"
)
LOG = (
    "struct<time_ns:bigint,observed_ns:bigint,trace_id:binary,span_id:binary,severity_number:int,severity_text:string,"
    f"body:{VALUE},attributes:{ATTRS},dropped:bigint,flags:bigint>"
)
RESOURCE, SCOPE = f"struct<attributes:{ATTRS},dropped:bigint>", f"struct<name:string,version:string,attributes:{ATTRS},dropped:bigint>"


_LOCAL_JOINS = "spark.sql.requireAllClusterKeysForCoPartition"


def local_joins(spark: SparkSession) -> None:
    """Lets a join take rows that lie by one of its keys as they are, unless the session has the option set."""
    if spark.conf.get(_LOCAL_JOINS, None) is None:
        spark.conf.set(_LOCAL_JOINS, "false")


#: Bytes of a part, as Spark estimates them for rows of compressed files: some 80,000 lines of orders, whose nested forms a task holds in memory.
PART_BYTES = 2 << 20


def parts(df: DataFrame) -> int:
    """Parts for rows of this size: those of the session, or more where a task couldn't hold its share in memory."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    known = size < 1 << 50  # rows without statistics count as far larger
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES) if known else 1)


def by_batch(df: DataFrame) -> DataFrame:
    """Rows of a batch brought together, in parts of bounded size. Tables made of them are grouped and joined on places
    without another shuffle.

    A task writes its rows as they come for a limited number of parts only; for more, it holds and sorts all rows of its
    split first (1.4 GB for 128 MB of a file). Rows then go to so many parts first, whose tasks hold few.
    """
    local_joins(df.sparkSession)
    n, unsorted = parts(df), int(df.sparkSession.sparkContext.getConf().get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    if n > unsorted > 0:  # by a column of its own: shuffles that follow each other directly become one
        df = df.withColumn("__part", F.pmod(F.xxhash64("batch_id"), F.lit(unsorted))).repartition(unsorted, "__part").drop("__part")
    return df.repartition(n, "batch_id")


def meet(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join on places by merging. Estimates of rows within nested ones are far too small, so that Spark would send whole
    tables to the driver to broadcast them."""
    return a.hint("merge").join(b, on, how)


def nested_type(of_scopes: str, items: str, item: str) -> str:
    """The type of a batch whose scopes, listed as ``of_scopes``, list their items as ``items``."""
    return f"array<struct<resource:{RESOURCE},schema_url:string,{of_scopes}:array<struct<scope:{SCOPE},schema_url:string,{items}:array<{item}>>>>>"


TRACES, LOGS = nested_type("scope_spans", "spans", SPAN), nested_type("scope_logs", "logs", LOG)
PLACE = ["batch_id", "r", "s", "i"]
_SPAN_FIELDS = ["trace_id", "span_id", "trace_state", "parent_span_id", "name", "kind", "start_ns", "dropped", "dropped_events", "dropped_links", "status"]
_LOG_FIELDS = ["time_ns", "observed_ns", "trace_id", "span_id", "severity_number", "severity_text", "dropped", "flags"]


def flatten(batches: DataFrame, data: str = "traces", scopes: str = "scope_spans", items: str = "spans", item: str = "span") -> DataFrame:
    """One row for each span of ``batches(batch_id, traces)``: places r, s, i and the resource, scope and span.

    Resources without scopes and scopes without spans keep a row with a null span. The other names are those of the
    lists of another signal, such as metrics.
    """
    r = batches.select("batch_id", F.posexplode_outer(data).alias("r", "rs"))
    r = r.select("batch_id", "r", F.col("rs.resource").alias("resource"), F.col("rs.schema_url").alias("resource_url"), F.col(f"rs.{scopes}").alias("list"))
    s = r.select("batch_id", "r", "resource", "resource_url", F.posexplode_outer("list").alias("s", "ss"))
    # A list of its own leaves the row once it is exploded; as a field of a scope, each of its items would carry all others.
    s = s.select("batch_id", "r", "s", "resource", "resource_url", F.col("ss.scope").alias("scope"), F.col("ss.schema_url").alias("scope_url"), F.col(f"ss.{items}").alias("list"))
    return s.select("batch_id", "r", "s", "resource", "resource_url", "scope", "scope_url", F.posexplode_outer("list").alias("i", item))


def flatten_logs(batches: DataFrame) -> DataFrame:
    """The same for the records of ``batches(batch_id, logs)``."""
    return flatten(batches, "logs", "scope_logs", "logs", "log")


def by_field(name: str):
    """A comparison of structs by one field, for arrays of structs that have no order of their own."""
    return lambda a, b: F.when(a[name] < b[name], -1).when(a[name] > b[name], 1).otherwise(0)


def attribute_rows(df: DataFrame, ids: list[str], column: str) -> DataFrame:
    """One row for each attribute of a map: ids, key and the fields of its value; empty keys are left out, a value of
    kind 0 stays."""
    return df.select(*ids, F.explode(column).alias("key", "v")).where("key <> ''").select(*ids, "key", "v.*")


def attribute_maps(attrs: DataFrame, ids: list[str], name: str = "attributes") -> DataFrame:
    """The inverse: one map for each parent."""
    pair = F.struct("key", F.struct(*VALUE_FIELDS).alias("value"))
    return attrs.groupBy(*ids).agg(F.map_from_entries(F.array_sort(F.collect_list(pair), by_field("key"))).alias(name))


def filled(name: str = "attributes") -> Column:
    """Maps that a left join brought in; an empty one where there was none."""
    return F.coalesce(name, F.map_from_entries(F.array().cast(f"array<struct<key:string,value:{VALUE}>>"))).alias("attributes")


def with_attributes(rows: DataFrame, attrs: DataFrame, ids: list[str]) -> DataFrame:
    """Rows left-joined with the maps of their attributes."""
    return meet(rows, attribute_maps(attrs, ids, "__attributes"), ids, "left").withColumn("attributes", filled("__attributes")).drop("__attributes")


def scope_tables(flat: DataFrame) -> dict[str, DataFrame]:
    """Resources and scopes of a flattened batch, and their attributes: one row for each place, found in one pass.

    ``present`` tells a missing resource or scope from an empty one; a batch or resource without children has a row with
    a null place.
    """
    own = flat.where("i is null or i = 0")
    resources = own.where("s is null or s = 0").select("batch_id", "r", F.col("resource").isNotNull().alias("present"), "resource.dropped", F.col("resource_url").alias("schema_url"), "resource.attributes")
    scopes = own.select("batch_id", "r", "s", F.col("scope").isNotNull().alias("present"), "scope.name", "scope.version", "scope.dropped", F.col("scope_url").alias("schema_url"), "scope.attributes")
    return {
        "resources": resources.drop("attributes"), "resource_attrs": attribute_rows(resources, ["batch_id", "r"], "attributes"),
        "scopes": scopes.drop("attributes"), "scope_attrs": attribute_rows(scopes, ["batch_id", "r", "s"], "attributes"),
    }


def tables(flat: DataFrame) -> dict[str, DataFrame]:
    """Main and related tables of flattened traces; a child's parent is the place (r, s, i) of its span."""
    span = flat.where("span is not null")
    events = span.select(*PLACE, F.posexplode("span.events").alias("n", "e"))
    links = span.select(*PLACE, F.posexplode("span.links").alias("n", "l"))
    return scope_tables(flat) | {
        "spans": span.select(*PLACE, *[f"span.{c}" for c in _SPAN_FIELDS], (F.col("span.end_ns") - F.col("span.start_ns")).alias("duration_ns")),
        "span_attrs": attribute_rows(span, PLACE, "span.attributes"),
        "events": events.select(*PLACE, "n", "e.time_ns", "e.name", "e.dropped"),
        "event_attrs": attribute_rows(events, [*PLACE, "n"], "e.attributes"),
        "links": links.select(*PLACE, "n", "l.trace_id", "l.span_id", "l.trace_state", "l.dropped"),
        "link_attrs": attribute_rows(links, [*PLACE, "n"], "l.attributes"),
    }


def log_tables(flat: DataFrame) -> dict[str, DataFrame]:
    """The same for flattened logs; the body is split into a column for each kind of value (null for an empty body)."""
    log = flat.where("log is not null")
    body = F.when(F.col("log.body.type") != 0, F.col("log.body")).alias("body")
    return scope_tables(flat) | {
        "logs": log.select(*PLACE, *[f"log.{c}" for c in _LOG_FIELDS], body),
        "log_attrs": attribute_rows(log, PLACE, "log.attributes"),
    }


def listed(rows: DataFrame, by: list[str], at: str, value: Column, name: str) -> DataFrame:
    """One row for each parent: its children in the order of their places."""
    pair = F.struct(F.col(at).alias("at"), value.alias("x"))
    in_place = F.array_sort(F.collect_list(pair), by_field("at"))
    return rows.groupBy(*by).agg(F.transform(in_place, lambda c: c["x"]).alias(name))


def or_none(name: str, item: str) -> Column:
    return F.coalesce(name, F.array().cast(f"array<{item}>")).alias(name)


def renest(t: dict[str, DataFrame]) -> DataFrame:
    """The inverse of `flatten` and `tables`: left joins on the parent's place, then lists in order, from the inside."""

    def children(name: str, fields: list[str]) -> DataFrame:
        full = with_attributes(t[name], t[f"{name[:-1]}_attrs"], [*PLACE, "n"])
        return listed(full, PLACE, "n", F.struct(*fields, "attributes", "dropped"), name)

    spans = with_attributes(t["spans"], t["span_attrs"], PLACE)
    spans = meet(spans, children("events", ["time_ns", "name"]), PLACE, "left")
    spans = meet(spans, children("links", ["trace_id", "span_id", "trace_state"]), PLACE, "left")
    span = F.struct(
        "trace_id", "span_id", "trace_state", "parent_span_id", "name", "kind", "start_ns", (F.col("start_ns") + F.col("duration_ns")).alias("end_ns"), "attributes", "dropped",
        or_none("events", EVENT), "dropped_events", or_none("links", LINK), "dropped_links", "status",
    )
    return renest_scopes(spans.select(*PLACE, span.alias("span")), t, SPAN, "traces", "scope_spans", "spans", "span")


def renest_logs(t: dict[str, DataFrame]) -> DataFrame:
    """The inverse of `flatten_logs` and `log_tables`; an empty body comes back as null."""
    full = with_attributes(t["logs"], t["log_attrs"], PLACE)
    log = F.struct(*_LOG_FIELDS[:6], "body", "attributes", *_LOG_FIELDS[6:])
    return renest_scopes(full.select(*PLACE, log.alias("log")), t, LOG, "logs", "scope_logs", "logs", "log")


def renest_scopes(rows: DataFrame, t: dict[str, DataFrame], kind: str, data: str, of_scopes: str, items: str, item: str) -> DataFrame:
    """Batches (batch_id, ``data``) of the items in ``rows(batch_id, r, s, i, item)``, under their scopes and resources."""
    lists = listed(rows, ["batch_id", "r", "s"], "i", F.col(item), items)
    full = meet(with_attributes(t["scopes"].where("s is not null"), t["scope_attrs"], ["batch_id", "r", "s"]), lists, ["batch_id", "r", "s"], "left")
    own = F.when(F.col("present"), F.struct("name", "version", "attributes", "dropped")).alias("scope")
    of_resource = listed(full, ["batch_id", "r"], "s", F.struct(own, "schema_url", or_none(items, kind)), of_scopes)
    resources = meet(with_attributes(t["resources"].where("r is not null"), t["resource_attrs"], ["batch_id", "r"]), of_resource, ["batch_id", "r"], "left")
    own = F.when(F.col("present"), F.struct("attributes", "dropped")).alias("resource")
    scope = f"struct<scope:{SCOPE},schema_url:string,{items}:array<{kind}>>"
    batches = listed(resources, ["batch_id"], "r", F.struct(own, "schema_url", or_none(of_scopes, scope)), data)
    none = F.array().cast(nested_type(of_scopes, items, kind))
    return meet(t["resources"].select("batch_id").distinct(), batches, ["batch_id"], "left").select("batch_id", F.coalesce(data, none).alias(data))
