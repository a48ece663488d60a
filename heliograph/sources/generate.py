"""Seeded synthetic batches: every value is a hash of its place, so that a rerun of any task gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cbor
from ..functions.scalars import severity_number
from ..operators import metrics, nesting
from ..operators.attributes import ATTRS, VALUE, typed

#: First day of 2022 in nanoseconds; generated times follow it.
START_NS = 1_640_995_200_000_000_000
HOSTS = ("host-a", "host-b", "host-c", "host-d", "host-e")
LEVELS = ("debug", "info", "warn", "error")
STATUSES = (200, 300, 400, 404, 500, 503)
WORDS = ("alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa")
EVENTS = (*(f"event {w}" for w in WORDS), "empty")
STATES = ("", "state=1", "state=2")
STEPS = (("request", 1), ("account", 2), ("preferences", 1))


class Draw:
    """Numbers, texts and ids for a seed, by name and place."""

    def __init__(self, seed: int):
        self.seed = seed

    def number(self, what: str, n: int, *place: Column | str) -> Column:
        """From 0 below n."""
        return F.pmod(F.xxhash64(F.lit(self.seed), F.lit(what), *place), F.lit(n))

    def pick(self, values: tuple, what: str, *place: Column | str) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (self.number(what, len(values), *place) + 1).cast("int"))

    def id(self, what: str, size: int, *place: Column | str) -> Column:
        parts = [(F.col(p) if isinstance(p, str) else p).cast("string") for p in place]
        return F.substring(F.unhex(F.md5(F.concat_ws("|", F.lit(f"{self.seed} {what}"), *parts))), 1, size)

    def some(self, what: str, value: Column, *place: Column | str) -> Column:
        """The value in half of all places, null in the others."""
        return F.when(self.number(what, 2, *place) == 0, value)

    def attributes(self, *place: Column | str) -> Column:
        """Host, up, status, version and group of a place."""
        return attributes_of({
            "hostname": ("str", self.pick(HOSTS, "host", *place)), "up": ("bool", self.number("up", 2, *place) == 0), "status": ("int", self.pick(STATUSES, "status", *place).cast("bigint")),
            "version": ("double", self.number("version", 4, *place) / 2 + 1), "group_id": ("bytes", self.id("group", 1, self.number("group", 5, *place))),
        })

    def random_attributes(self, *place: Column | str) -> Column:
        """Up to nine attributes of texts, whole numbers and doubles."""
        kind = lambda i: self.number("kind", 3, F.lit(i), *place)
        n = self.number("attributes", 10, *place)
        out = {}
        for i in range(9):
            for k, (name, value) in enumerate((("str", self.pick(WORDS, "word", F.lit(i), *place)), ("int", self.number("int", 1000, F.lit(i), *place)), ("double", self.number("double", 1000, F.lit(i), *place) / 8))):
                out[f"attr {i} {name}"] = (name, F.when((n > i) & (kind(i) == k), value))
        return attributes_of(out)


def attributes_of(values: dict[str, tuple[str, Column]]) -> Column:
    """A map of tagged values; nulls are left out."""
    cells = F.array(*[F.struct(F.lit(k).alias("key"), typed(kind, v).alias("value")) for k, (kind, v) in values.items()])
    return F.map_from_entries(F.filter(cells, lambda e: e["value"]["type"] != 0)).cast(ATTRS)


def none() -> Column:
    return F.create_map().cast(ATTRS)


def resources(d: Draw) -> Column:
    """A pool of four, the first of them empty."""
    pool = [F.struct(none().alias("attributes"), F.lit(0).cast("bigint").alias("dropped"))]
    for i in range(1, 4):
        own = {"hostname": ("str", F.lit(HOSTS[i])), "ip": ("str", F.lit(f"192.168.0.{i}")), "up": ("bool", F.lit(i % 2 == 0)), "status": ("int", F.lit(STATUSES[i]).cast("bigint")), "version": ("double", F.lit(i / 2)), f"unique{i}": ("str", F.lit(f"value{i}"))}
        pool.append(F.struct(attributes_of(own).alias("attributes"), F.lit(i).cast("bigint").alias("dropped")))
    return F.array(*pool)


def scopes(d: Draw) -> Column:
    """A pool of three, the last of them empty."""
    pool = [F.struct(F.lit(name).alias("name"), F.lit(version).alias("version"), (attributes_of({"kind": ("str", F.lit(version))}) if name else none()).alias("attributes"), F.lit(0).cast("bigint").alias("dropped")) for name, version in (("generator", "1.0.0"), ("generator", "1.0.1"), ("", ""))]
    return F.array(*pool)


def _nested(rows: DataFrame, d: Draw, items: Column, names: tuple[str, str, str], kind: str, random: bool) -> DataFrame:
    """Batches whose resources and scopes are drawn (one of each, or all of the pools with the items dealt to them)."""
    of_scopes, own, data = names
    at = lambda pool, n: F.element_at(pool, (n + 1).cast("int"))

    def scope(k: Column, listed: Column) -> Column:
        return F.struct(at(scopes(d), k).alias("scope"), F.lit("").alias("schema_url"), listed.alias(own))

    def resource(k: Column, listed: Column) -> Column:
        return F.struct(at(resources(d), k).alias("resource"), F.lit("").alias("schema_url"), listed.alias(of_scopes))

    if random:
        each = F.sequence(F.lit(0), F.lit(3))
        out = F.transform(each, lambda r: resource(r, F.transform(F.sequence(F.lit(0), F.lit(2)), lambda s: scope(s, F.filter(items, lambda x, i: i % 12 == r * 3 + s)))))
    else:
        out = F.array(resource(d.number("resource", 4, "batch_id"), F.array(scope(d.number("scope", 3, "batch_id"), items))))
    return rows.select("batch_id", out.cast(nesting.nested_type(of_scopes, own, kind)).alias(data))


def _batches(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "batch_id")


def _count(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1)) if n else F.array().cast("array<int>")


def generate_traces(spark: SparkSession, batches: int, traces_a_batch: int, seed: int = 0, step_ns: int = 1_000_000, random: bool = False) -> DataFrame:
    """``(batch_id, traces)``: three spans a trace, two to nine events and links a span. ``random`` batches have all pairs of
    pooled resources and scopes, and each field of a span only half of the time."""
    d, b = Draw(seed), F.col("batch_id")

    def children(t: Column, k: Column, what: str, make) -> Column:
        return F.transform(F.sequence(F.lit(0).cast("bigint"), d.number(what, 8, b, t, k) + 1), make)

    def span(t: Column, k: Column) -> Column:
        start = F.lit(START_NS) + (b * traces_a_batch + t) * step_ns
        own = lambda i: d.id("span", 8, b, t, i)
        some = (lambda what, value: d.some(what, value, b, t, k)) if random else (lambda what, value: value)

        def event(e: Column) -> Column:
            name = d.pick(EVENTS, "event", b, t, k, e)
            return F.struct((start + e).alias("time_ns"), name.alias("name"), F.when(name == "empty", none()).otherwise(d.attributes(b, t, k, e)).alias("attributes"), F.lit(0).cast("bigint").alias("dropped"))

        def link(e: Column) -> Column:
            return F.struct(d.id("linked", 16, b, t, e).alias("trace_id"), d.id("linked", 8, b, t, k, e).alias("span_id"), d.pick(STATES, "state", b, t, k, e).alias("trace_state"), d.attributes(b, t, k, e, F.lit(1)).alias("attributes"), F.lit(0).cast("bigint").alias("dropped"))

        step = lambda i: F.element_at(F.array(*[F.lit(x[i]) for x in STEPS]), (k + 1).cast("int"))
        return F.struct(
            d.id("trace", 16, b, t).alias("trace_id"), own(k).alias("span_id"), some("trace state", d.pick(STATES, "trace state", b, t)).alias("trace_state"), F.when(k > 0, own(k - 1)).alias("parent_span_id"),
            F.concat(step(0), F.lit(" "), d.number("name", 4, b, t, k).cast("string")).alias("name"), some("kind", (k % 5 + 1).cast("int")).alias("kind"), start.alias("start_ns"),
            (start + d.number("duration", 1_000_000, b, t, k)).alias("end_ns"), (F.coalesce(some("attributes", d.attributes(b, t, k)), d.random_attributes(b, t, k)) if random else d.attributes(b, t, k)).alias("attributes"),
            some("dropped", d.number("dropped", 3, b, t, k)).alias("dropped"), children(t, k, "events", event).alias("events"), some("dropped events", d.number("dropped", 3, b, t)).alias("dropped_events"),
            children(t, k, "links", link).alias("links"), some("dropped links", d.number("dropped", 3, b, k)).alias("dropped_links"), some("status", F.struct(step(1).alias("code"), F.lit("").alias("message"))).alias("status"),
        )

    spans = F.flatten(F.transform(_count(traces_a_batch), lambda t: F.transform(F.array(*map(F.lit, range(3))), lambda k: span(t, k))))
    return _nested(_batches(spark, batches), d, spans, ("scope_spans", "spans", "traces"), nesting.SPAN, random)


def body_of(d: Draw, shape: Column, *place: Column | str) -> Column:
    """Eleven shapes: text, empty text, none, whole number, double, truth value, bytes, no bytes, map, empty map, slice."""
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: d.pick(WORDS, "body", i, *place)), " ")
    nested = cbor.to_ser(F.lit('{"a":1,"b":[true,"x"],"c":{"d":0.5}}'))
    shapes = (
        ("str", text), ("str", F.lit("")), None, ("int", d.number("int", 1000, *place)), ("double", d.number("double", 1000, *place) / 8), ("bool", d.number("bool", 2, *place) == 0), ("bytes", d.id("bytes", 4, *place)),
        ("bytes", F.lit(b"")), ("map", nested), ("map", cbor.to_ser(F.lit("{}"))), ("slice", cbor.to_ser(F.lit('["x",1,null]'))),
    )
    out = None
    for i, x in enumerate(shapes):
        value = typed(*x) if x else F.lit(None).cast(VALUE)
        out = F.when(shape == i, value) if out is None else out.when(shape == i, value)
    return out.cast(VALUE)


def generate_logs(spark: SparkSession, batches: int, logs_a_batch: int, seed: int = 0, step_ns: int = 1_000_000, random: bool = False) -> DataFrame:
    """``(batch_id, logs)``: four records of fixed levels in turn, then one of a drawn level and shape of body."""
    d, b = Draw(seed), F.col("batch_id")
    # Bodies come from a function that can't run within an array's transform, so records are made as rows.
    rows = spark.range(batches * logs_a_batch).select(F.floor(F.col("id") / max(logs_a_batch, 1)).cast("bigint").alias("batch_id"), F.pmod("id", F.lit(max(logs_a_batch, 1))).alias("n"))
    n = F.col("n")
    fixed = n % 5 < 4
    level = F.when(fixed, F.element_at(F.array(*map(F.lit, LEVELS)), (F.least(n % 5, F.lit(3)) + 1).cast("int"))).otherwise(d.pick(LEVELS, "level", b, n))
    time = F.lit(START_NS) + (b * logs_a_batch + n) * step_ns
    some = (lambda what, value: d.some(what, value, b, n)) if random else (lambda what, value: value)
    log = F.struct(
        time.alias("time_ns"), some("observed", time + 1).alias("observed_ns"), some("trace", d.id("trace", 16, b, n)).alias("trace_id"), some("span", d.id("span", 8, b, n)).alias("span_id"),
        severity_number(level).alias("severity_number"), level.alias("severity_text"), body_of(d, F.when(fixed, 0).otherwise(d.number("shape", 11, b, n)), b, n).alias("body"), d.attributes(b, n).alias("attributes"),
        some("dropped", d.number("dropped", 3, b, n)).alias("dropped"), some("flags", d.number("flags", 2, b, n)).alias("flags"),
    )
    lists = nesting.listed(rows.select("batch_id", "n", log.cast(nesting.LOG).alias("log")), ["batch_id"], "n", F.col("log"), "items")
    every = _batches(spark, batches).join(lists, "batch_id", "left")
    return _nested(every, d, F.coalesce("items", F.array().cast(f"array<{nesting.LOG}>")), ("scope_logs", "logs", "logs"), nesting.LOG, random)


def generate_metrics(spark: SparkSession, batches: int, points: int = 10, seed: int = 0, step_ns: int = 1_000_000, random: bool = False) -> DataFrame:
    """``(batch_id, metrics)``: a gauge, a sum that grows from batch to batch, a summary, a histogram and an exponential
    histogram, and edge cases: a metric without type, kinds without points, points without attributes, value or buckets."""
    d, b = Draw(seed), F.col("batch_id")
    time = F.lit(START_NS) + b * step_ns
    each = _count(points)

    def head(k: Column, attrs: bool = True) -> list[Column]:
        return [F.lit(START_NS).alias("start_ns"), time.alias("time_ns"), d.number("flags", 2, b, k).alias("flags"), (d.attributes(b, k) if attrs else none()).alias("attributes")]

    def exemplar(k: Column, whole: bool) -> Column:
        value = d.number("exemplar", 100, b, k)
        cells = (value, F.lit(None).cast("double")) if whole else (F.lit(None).cast("bigint"), value / 4)
        return F.struct(time.alias("time_ns"), cells[0].alias("int"), cells[1].alias("double"), d.id("trace", 16, b, k).alias("trace_id"), d.id("span", 8, b, k).alias("span_id"), d.attributes(b, k, F.lit(2)).alias("attributes"))

    def number(k: Column, kind: str, attrs: bool = True, value: bool = True, exemplars: bool = True) -> Column:
        drawn = d.number("value", 1000, b, k)
        double = drawn / 8 if kind == "gauge" and value else F.lit(None).cast("double")
        whole = b * 1000 + drawn if kind == "sum" and value else F.lit(None).cast("bigint")
        own = F.array(exemplar(k, kind == "sum")) if exemplars else F.array()
        return F.struct(*head(k, attrs), whole.alias("int"), double.alias("double"), own.cast(f"array<{metrics.EXEMPLAR}>").alias("exemplars"))

    counts = lambda k, n: F.transform(_count(n), lambda i: d.number("count", 50, b, k, i).cast(metrics.COUNT))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast(metrics.COUNT), lambda a, x: (a + x).cast(metrics.COUNT))

    def summary(k: Column, attrs: bool = True) -> Column:
        quantiles = F.array(*[F.struct(F.lit(q).alias("quantile"), (d.number("quantile", 1000, b, k) * q).alias("value")) for q in (0.5, 0.9)])
        return F.struct(*head(k, attrs), d.number("n", 100, b, k).cast(metrics.COUNT).alias("count"), (d.number("total", 1000, b, k) / 4).alias("sum"), quantiles.alias("quantiles"))

    def spread(k: Column) -> list[Column]:
        maybe = lambda what, value: d.some(what, value, b, k)
        low = d.number("low", 100, b, k) / 4
        return [maybe("sum", low * 10).alias("sum"), maybe("min", low).alias("min"), maybe("max", low + 100).alias("max")]

    def histogram(k: Column, attrs: bool = True, buckets: bool = True) -> Column:
        own = counts(k, 11) if buckets else F.array().cast(f"array<{metrics.COUNT}>")
        bounds = F.transform(_count(10), lambda i: i.cast("double") * 10) if buckets else F.array().cast("array<double>")
        return F.struct(*head(k, attrs), total(own).alias("count"), *spread(k), bounds.alias("bounds"), own.alias("counts"), F.array(exemplar(k, False)).alias("exemplars"))

    def exponential(k: Column, attrs: bool = True, buckets: bool = True) -> Column:
        scale = (d.number("scale", 21, b, k) - 10).cast("int")
        part = lambda i: F.struct((d.number("offset", 20, b, k, F.lit(i)) - 10).cast("int").alias("offset"), counts(k + i, 10).alias("counts")) if buckets else F.lit(None).cast(metrics._BUCKETS)
        own = F.transform(each, lambda i: exemplar(k * 100 + i, True))
        n = total(F.concat(counts(k, 10), counts(k + 1, 10))) if buckets else F.lit(0).cast(metrics.COUNT)
        return F.struct(*head(k, attrs), n.alias("count"), *spread(k), scale.alias("scale"), F.lit(0).cast(metrics.COUNT).alias("zero_count"), part(0).alias("positive"), part(1).alias("negative"), own.alias("exemplars"))

    def metric(name: str, number_: int, kind: str | None, make=None, temporality: int | None = None, monotonic: bool | None = None) -> Column:
        lists = [(F.transform(each, make) if k == kind and make else F.array()).cast(f"array<{of}>").alias(k) for k, of in metrics.POINTS.items()]
        return F.struct(F.lit(name).alias("name"), F.lit("" if name.startswith("empty") else f"what {name} is").alias("description"), F.lit("1").alias("unit"), F.lit(number_).alias("type"),
                        F.lit(temporality).cast("int").alias("temporality"), F.lit(monotonic).cast("boolean").alias("monotonic"), *lists).cast(metrics.METRIC)

    plain = [
        metric("gauge", 1, "numbers", lambda k: number(k, "gauge")), metric("sum", 2, "numbers", lambda k: number(k, "sum"), 2, True), metric("histogram", 3, "histograms", lambda k: histogram(k), 1),
        metric("exponential histogram", 4, "exp_histograms", lambda k: exponential(k), 1), metric("summary", 5, "summaries", lambda k: summary(k)),
    ]
    edges = [
        metric("empty", 0, None), *[metric(f"empty {k}", i, k) for i, k in ((1, "numbers"), (3, "histograms"), (4, "exp_histograms"), (5, "summaries"))], metric("gauge without attributes", 1, "numbers", lambda k: number(k, "gauge", attrs=False)),
        metric("gauge without value", 1, "numbers", lambda k: number(k, "gauge", value=False)), metric("sum without exemplars", 2, "numbers", lambda k: number(k, "sum", exemplars=False), 1, False),
        metric("summary without attributes", 5, "summaries", lambda k: summary(k, False)), metric("histogram without attributes", 3, "histograms", lambda k: histogram(k, False), 2),
        metric("histogram without buckets", 3, "histograms", lambda k: histogram(k, True, False), 2), metric("exponential histogram without attributes", 4, "exp_histograms", lambda k: exponential(k, False), 2),
        metric("exponential histogram without buckets", 4, "exp_histograms", lambda k: exponential(k, True, False), 2),
    ]
    return _nested(_batches(spark, batches), d, F.array(*plain, *edges), ("scope_metrics", "metrics", "metrics"), metrics.METRIC, random)
