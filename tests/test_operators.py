import json
import math
import os
import struct
from decimal import Decimal

import pytest
import zstandard
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from heliograph.functions import cbor, json_forms
from heliograph.functions.scalars import data_point_signature, encipher, obfuscate, reveal, severity_number, signature
from heliograph.operators import adaptive, analysis, attributes, canonical, codec, compare, encoding, metrics, nesting, obfuscation, orders, stats
from heliograph.operators import sizes as sizes_
from heliograph.plans.registry import QUERIES
from heliograph.sources import buckets, generate, ipc, wire
from heliograph.sources.files import FileConfig, data_model, first_time, multivariate, read_chunks, read_csv_logs, read_json_lines, read_requests, show_records, slice_items, write_json_lines, write_requests
from heliograph.streaming import replay


def _nodes(plan):
    """The operators of a physical plan, from the top."""
    yield plan
    for i in range(plan.children().size()):
        yield from _nodes(plan.children().apply(i))


def test_flattened_items_carry_no_lists(spark):
    """Rows wait for Python in queues that go to disk: none may hold the list that its item came from."""
    flat = nesting.flatten_logs(spark.createDataFrame([], f"batch_id long, logs {nesting.LOGS}"))
    rows = flat.select("batch_id", F.col("resource.attributes").alias("a"), "scope.name", cbor.from_ser(F.col("log.body.ser")).alias("x"))
    held = [n.child().schema().catalogString() for n in _nodes(rows._jdf.queryExecution().sparkPlan()) if n.nodeName() == "ArrowEvalPython"]
    assert len(held) == 1 and "logs:array" not in held[0]


def test_tables_are_measured_where_their_batches_are(spark):
    made = nesting.by_batch(generate.generate_traces(spark, 6, 5, 1, random=True))
    measured = sizes_.table_sizes(made, "traces")
    by_number = [n for n in _nodes(measured._jdf.queryExecution().sparkPlan()) if n.nodeName() == "Exchange" and "REPARTITION_BY_COL" in n.toString().split("\n")[0]]
    assert not by_number and measured.count() == 6


def test_rows_for_many_parts_go_to_few_first(spark, monkeypatch):
    """A shuffle to more than 200 parts sorts all rows of a task: only a second one may, after one that makes its tasks small."""
    rows = spark.range(3000).select((F.col("id") % 50).alias("batch_id"), "id")
    monkeypatch.setattr(nesting, "parts", lambda df: 300)
    got = nesting.by_batch(rows)
    exchanges = [n.outputPartitioning().numPartitions() for n in _nodes(got.groupBy("batch_id").count()._jdf.queryExecution().sparkPlan()) if n.nodeName() == "Exchange"]
    assert exchanges == [300, 200]
    own = got.withColumn("p", F.spark_partition_id()).groupBy("batch_id").agg(F.countDistinct("p").alias("parts"), F.count("*").alias("n")).collect()
    assert len(own) == 50 and all((r.parts, r.n) == (1, 60) for r in own) and got.columns == rows.columns


def test_group_delta_round_trip(spark):
    rows = [(b, k, (i * 37 + b * 11) % 70000) for b in range(3) for k in ("a", "b", None) for i in range(40)]
    df = spark.createDataFrame(rows, "batch int, key string, parent long").withColumn("rn", F.row_number().over(codec.window(["batch"], ["key", "parent"])))
    enc = codec.group_delta_encode(df, ["batch"], ["rn"], ["key"], "parent", "d", codec.U32)
    dec = codec.group_delta_decode(enc.drop("parent"), ["batch"], ["rn"], ["key"], "d", "parent", codec.U32)
    assert dec.select("batch", "key", "parent").exceptAll(df.select("batch", "key", "parent")).isEmpty()
    assert enc.where("d < 0").isEmpty()


def test_nan_starts_a_new_group(spark):
    df = spark.createDataFrame([(0, math.nan, 5), (1, math.nan, 7), (2, 1.0, 9), (3, 1.0, 11)], "rn int, v double, p long").withColumn("b", F.lit(0))
    got = codec.group_delta_encode(df, ["b"], ["rn"], ["v"], "p", "d").orderBy("rn").select("d").collect()
    assert [r.d for r in got] == [5, 7, 9, 2]


def test_delta_skips_nulls(spark):
    df = spark.createDataFrame([(0, None), (1, 0), (2, None), (3, 1), (4, 2)], "rn int, id long").withColumn("b", F.lit(0))
    enc = codec.delta_encode(df, ["b"], ["rn"], "id", "d")
    assert [r.d for r in enc.orderBy("rn").collect()] == [None, 0, None, 1, 1]
    dec = codec.delta_decode(enc.drop("id"), ["b"], ["rn"], "d", "id")
    assert [r.id for r in dec.orderBy("rn").collect()] == [None, 0, None, 1, 2]


def test_scope_runs_are_not_reset_by_resource(spark):
    rows = [(0, "A", "s1"), (1, "B", "s1"), (2, "B", "s2")]
    df = spark.createDataFrame(rows, "i int, r string, s string").withColumn("b", F.lit(0))
    assert [r.x for r in codec.run_ids(df, ["b"], ["i"], ["s"], "x").orderBy("i").collect()] == [0, 0, 1]


def test_inference(spark):
    texts = ["1", "-5", "1.5", "1e3", "true", "T", "f", "x", "", None, "99999999999999999999", "inf", "-Infinity", "NaN", "0x1p4", "-0x1.8p1", "1e999", "1_000", "0x10", ".5", "5.", "."]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(attributes.infer(F.col("t")).alias("v")).collect()
    assert [r.v.type for r in got] == [2, 2, 3, 3, 4, 4, 4, 1, 1, 0, 3, 3, 3, 3, 3, 3, 1, 1, 1, 3, 3, 1]
    assert got[11].v.double == math.inf and got[12].v.double == -math.inf and math.isnan(got[13].v.double) and (got[14].v.double, got[15].v.double) == (16.0, -3.0)


def test_values_compare(spark):
    values = [wire.tagged(v) for v in (None, "a", "b", 1, 2, 0.5, False, True, {"a": 1, "b": 2}, [1])]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {attributes.VALUE}")
    both = df.crossJoin(df.toDF("j", "w")).select("i", "j", attributes.compare_values(F.col("v"), F.col("w")).alias("c"), attributes.equal_values(F.col("v"), F.col("w")).alias("e"))
    assert all(r.c == (r.i > r.j) - (r.i < r.j) and r.e == (r.i == r.j) for r in both.collect())


def test_severity_of_lower_case_names(spark):
    names = ["trace", "debug", "info", "warn", "error", "fatal", "INFO", "Error", "", None]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(severity_number(F.col("n")).alias("s")).collect()
    assert [r.s for r in got] == [1, 5, 9, 13, 17, 21, 0, 0, 0, 0]


def test_exact_summary(spark):
    df = spark.createDataFrame([(float(x),) for x in (3, 2, 5, 1, 4)], "v double").withColumn("g", F.lit(1))
    r = stats.summary(df, ["g"], "v").first()
    assert (r.min, r.max, r["mean"], r.p50, r.p90, r.p95, r.p99) == (1, 5, 3, 3, 4.6, 4.8, 4.96) and r.stddev == 1.581139


def test_signature_bytes(spark):
    attrs = {"k4": 1.0, "k1": 2, "k3": False, "k5": "bla", "k2": bytes([1, 2, 3]), "k8": {"k4": 1.0, "k1": 2}, "k7": {"k4": 1.0, "k1": 2}}
    inner = b"k1" + struct.pack("<q", 2) + b"k4" + struct.pack("<d", 1.0)
    want = struct.pack("<QQ", 1, 2) + b"k1" + struct.pack("<q", 2) + b"k2" + bytes([1, 2, 3]) + b"k3\x00" + b"k4" + struct.pack("<d", 1.0) + b"k7" + inner + b"k8" + inner
    assert data_point_signature(1, 2, attrs, "k5") == want
    df = spark.createDataFrame([(1, 2, {k: wire.tagged(v) for k, v in attrs.items()}), (None, 3, None)], f"s long, t long, a {attributes.ATTRS}")
    got = df.select(signature(F.col("s"), F.col("t"), F.col("a"), "k5").alias("x")).collect()
    assert [bytes(r.x) for r in got] == [want, struct.pack("<QQ", 0, 3)]


@given(st.recursive(st.none() | st.booleans() | st.integers(-(2**63), 2**63 - 1) | st.floats(allow_nan=False) | st.text() | st.binary(min_size=1), lambda x: st.lists(x) | st.dictionaries(st.text(), x), max_leaves=10))
def test_cbor_round_trip(value):
    assert cbor.decode(cbor.encode(value)) == value


def test_cbor_rejects():
    with pytest.raises(OverflowError):
        cbor.decode(b"\x1b" + b"\xff" * 8)
    with pytest.raises(TypeError):
        cbor.decode(b"\xa1\x01\x02")


def test_serialized_columns(spark):
    texts = ['{"b":1,"a":[true,null,"x",0.5]}', "[]", "no json", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(cbor.from_ser(cbor.to_ser(F.col("t"))).alias("t")).collect()
    assert [r.t for r in got] == ['{"a":[true,null,"x",0.5],"b":1}', "[]", None, None]
    assert cbor.encode({"b": 1, "a": 2}) == cbor.encode({"a": 2, "b": 1})


@given(st.one_of(st.text(st.characters(exclude_categories=["Cs"])), st.binary()), st.binary(min_size=1))
def test_cipher_round_trip(data, key):
    out = encipher(data, key)
    assert len(out) == len(data) and encipher(out, key, True) == data and encipher(data, key) == out
    if isinstance(data, str):
        assert [" " <= c <= "~" for c in out] == [" " <= c <= "~" for c in data]
        out.encode()


def test_cipher_of_a_fixed_key():
    assert encipher("name", b"key") == "j32^" and encipher("name", b"other") != "j32^"


def test_obfuscation_is_reversible(spark):
    df = spark.createDataFrame([("name",), ("",), (None,), ("längerer Text",)], "v string")
    back = df.select("v", obfuscate(F.col("v"), b"k").alias("o")).withColumn("w", reveal(F.col("o"), b"k"))
    assert back.where("not (v <=> w) or length(v) <> length(o)").isEmpty() and back.where("v = o and v <> ''").isEmpty()


def test_obfuscation_on_every_level(spark):
    batches = generate.generate_traces(spark, 2, 3, random=True)
    tables = nesting.tables(nesting.flatten(batches))
    hidden = obfuscation.obfuscate_tables(tables, b"key")
    for name in ("resource_attrs", "scope_attrs", "span_attrs", "event_attrs", "link_attrs"):
        old = {(r.type, r.key, r.str, bytes(r.bytes or b"")) for r in tables[name].collect()}
        new = {(r.type, r.key, r.str, bytes(r.bytes or b"")) for r in hidden[name].collect()}
        hide = lambda v: None if v is None else encipher(v, b"key")
        assert new == {(t, hide(k), hide(s), hide(b)) for t, k, s, b in old}, name
    assert {r.name for r in hidden["spans"].collect()} == {encipher(r.name, b"key") for r in tables["spans"].collect()}
    part = obfuscation.obfuscate_attributes(tables["span_attrs"], b"key", ["hostname"])
    assert part.count() == tables["span_attrs"].count() and part.where("key = 'hostname'").isEmpty() and not part.where("key = 'version'").isEmpty()
    gone = obfuscation.obfuscate_attributes(tables["span_attrs"], b"key", ["hostname"], drop_unlisted=True)
    assert gone.count() == tables["span_attrs"].where("key = 'hostname'").count()
    deep = spark.createDataFrame([("k", 5, cbor.encode({"a": ["x", 1, {"b": b"y"}]}))], "key string, type int, ser binary").withColumn("str", F.lit(None).cast("string"))
    got = cbor.decode(bytes(obfuscation.obfuscate_attributes(deep, b"key").first().ser))
    assert got == {encipher("a", b"key"): [encipher("x", b"key"), 1, {encipher("b", b"key"): encipher(b"y", b"key")}]}


def test_set_and_strict_difference(spark):
    a, b = spark.createDataFrame([(1,), (1,)], "x int"), spark.createDataFrame([(1,)], "x int")
    assert compare.equivalent(a, b) and not compare.equivalent(a, b, strict=True)


def test_routes(spark):
    df = compare.route(spark.range(10_000), {"a": 0, "b": 50, "c": 50}, "id").groupBy("route").count()
    assert dict(map(tuple, df.collect())) == {"b": 5000, "c": 5000}
    with pytest.raises(ValueError):
        compare.validate_routes({"a": 0})


def test_replay_gaps(spark):
    df = spark.createDataFrame([(0, 10_000_000_000), (1, 20_000_000_000)], "batch_id long, ts long").withColumn("s", F.lit(0))
    assert [r.wait_nanos for r in compare.replay_gaps(df, ["s"], "ts", 0.5).orderBy("batch_id").collect()] == [0, 5_000_000_000]


def _value(**kind):
    (name, value), = kind.items()
    return wire.tagged(value) if name != "empty" else wire.tagged(None)


def _shown(df, column):
    plain = lambda x: {k: plain(v) for k, v in x.items()} if isinstance(x, dict) else [plain(v) for v in x] if isinstance(x, list) else x.hex() if isinstance(x, bytes | bytearray) else x
    return sorted((r.batch_id, json.dumps(plain(r.asDict(recursive=True)[column]), default=str, sort_keys=True)) for r in df.collect())


def _trace_batches():
    span = {"trace_id": b"t" * 16, "span_id": b"s" * 8, "trace_state": None, "parent_span_id": None, "name": "n", "kind": 1, "start_ns": 9, "end_ns": 4, "attributes": {"a": _value(int=1), "b": _value(str="x"), "c": _value(bytes=b"\x00z"), "d": _value(map={"k": [1]}), "e": _value(slice=[None, 2.5]), "f": _value(empty=None)},
            "dropped": 3, "events": [{"time_ns": 1, "name": "e", "attributes": {}, "dropped": 7}, {"time_ns": 0, "name": "", "attributes": {"k": _value(bool=True)}, "dropped": None}], "dropped_events": 2, "links": [], "dropped_links": None, "status": None}
    bare = span | {"events": [], "links": [{"trace_id": b"u" * 16, "span_id": None, "trace_state": "q", "attributes": {"l": _value(double=1.5)}, "dropped": 1}], "attributes": {}, "end_ns": 12}
    scope = {"name": "g", "version": "1", "attributes": {"s": _value(str="y")}, "dropped": 0}
    return [
        (0, [{"resource": {"attributes": {"h": _value(str="x")}, "dropped": 1}, "schema_url": "u", "scope_spans": [{"scope": scope, "schema_url": "", "spans": [span, bare]}, {"scope": None, "schema_url": "", "spans": []}]},
             {"resource": None, "schema_url": None, "scope_spans": []}]),
        (1, []), (2, [{"resource": {"attributes": {}, "dropped": None}, "schema_url": "v", "scope_spans": [{"scope": scope | {"name": None}, "schema_url": "w", "spans": [bare | {"name": None}, span, span]}]}]),
    ]


def test_nesting_round_trip(spark):
    df = spark.createDataFrame(_trace_batches(), f"batch_id long, traces {nesting.TRACES}")
    assert _shown(nesting.renest(nesting.tables(nesting.flatten(df))), "traces") == _shown(df, "traces")


def _log_batches():
    log = {"time_ns": 5, "observed_ns": 6, "trace_id": b"t" * 16, "span_id": b"s" * 8, "severity_number": 9, "severity_text": "info", "body": _value(str="said"), "attributes": {"a": _value(int=1)}, "dropped": 2, "flags": 1}
    logs = [log | {"body": b} for b in (_value(int=4), _value(double=0.5), _value(bool=False), _value(bytes=b"\xff"), _value(map={"a": {"b": 1}}), _value(slice=["x"]), None)]
    bare = dict.fromkeys(log) | {"attributes": {}}
    scope = {"name": "g", "version": "1", "attributes": {}, "dropped": 0}
    return [(0, [{"resource": {"attributes": {"h": _value(bool=True)}, "dropped": 1}, "schema_url": "u", "scope_logs": [{"scope": scope, "schema_url": "", "logs": [log, bare, *logs]}, {"scope": scope, "schema_url": "z", "logs": [log]}]}]), (1, [])]


def test_log_nesting_round_trip(spark):
    df = spark.createDataFrame(_log_batches(), f"batch_id long, logs {nesting.LOGS}")
    assert _shown(nesting.renest_logs(nesting.log_tables(nesting.flatten_logs(df))), "logs") == _shown(df, "logs")


SIGNALS = {"traces": (generate.generate_traces, _trace_batches, nesting.TRACES), "logs": (generate.generate_logs, _log_batches, nesting.LOGS), "metrics": (generate.generate_metrics, None, metrics.METRICS)}


def _stored(spark, df):
    return spark.createDataFrame(df.collect(), df.schema)


@pytest.mark.parametrize("signal", SIGNALS)
def test_encoding_round_trip(spark, signal):
    make, fixed, kind = SIGNALS[signal]
    made = make(spark, 3, 7, 5, random=True)
    if fixed:
        more = spark.createDataFrame([(100 + b, x) for b, x in fixed()], f"batch_id long, {signal} {kind}")
        made = made.unionByName(more)
    made = _stored(spark, made)
    tables = {n: _stored(spark, t) for n, t in encoding.encode(made, signal).items()}
    back = _stored(spark, encoding.decode(tables, signal))
    assert canonical.equivalent(made, back, signal, strict=True) and canonical.items(made, signal).count() > 20
    names = {"traces": 8, "logs": 4, "metrics": 1 + 2 + 2 * 4 + 2 * 3}[signal]
    assert len(tables) == names and all({"batch_id", "rn"} <= set(t.columns) for t in tables.values())
    broken = back.where("batch_id <> 0")
    assert not canonical.equivalent(made, broken, signal)


@pytest.mark.parametrize(("signal", "nth"), [("traces", 0), ("traces", 1), ("traces", 2), ("logs", 0)])
def test_other_orders_can_be_read_back(spark, signal, nth):
    """All tables in orders other than the default ones, several at once."""
    made = _stored(spark, SIGNALS[signal][0](spark, 2, 4, 3))
    others = {t: [o for o in of if o != orders.DEFAULT[t]] for t, of in orders.ORDERS.items()}
    chosen = {t: of[nth % len(of)] for t, of in others.items()}
    tables = {n: _stored(spark, t) for n, t in encoding.encode(made, signal, chosen).items()}
    assert canonical.equivalent(made, _stored(spark, encoding.decode(tables, signal, chosen)), signal, strict=True)


def test_orders_are_sorted_and_encoded(spark):
    rows = [(0, (i * 7) % 5, f"k{i % 3}", 1 if i % 2 else 2, "v" if i % 2 else None, None if i % 2 else i % 4) for i in range(30)]
    df = spark.createDataFrame(rows, "batch_id long, parent_id long, key string, type int, str string, int long").selectExpr("*", "cast(null as double) as double", "cast(null as boolean) as bool", "cast(null as binary) as bytes", "cast(null as binary) as ser")
    df = df.selectExpr("*", "int as time_ns", "key as name", "key as trace_id").coalesce(1)
    for table in ("attrs16", "attrs32", "events", "links", "numbers", "summaries", "exemplars"):
        for name, by in orders.ORDERS[table].items():
            placed = orders.place(df, by, ["parent_id", "key", "type", "str", "int"])
            back = orders.decode(orders.encode(placed, by, codec.U16), by, codec.U16)
            rows = [tuple(r) for r in placed.orderBy("rn").collect()]
            assert [tuple(r) for r in back.select(placed.columns).orderBy("rn").collect()] == rows, (table, name)
            seen = [tuple(r[placed.columns.index(k)] for k in by.keys) for r in rows]
            assert seen == sorted(seen, key=lambda t: tuple((x is not None, x if x is not None else 0) for x in t))
    with pytest.raises(ValueError):
        orders.SortSpec(("a",), orders.GROUP)


def test_canonical_equivalence(spark):
    kind = f"batch_id long, traces {nesting.TRACES}"
    rows = _trace_batches()
    a = spark.createDataFrame(rows, kind)
    twice = spark.createDataFrame([*rows, *rows], kind)
    assert canonical.equivalent(a, twice, "traces") and not canonical.equivalent(a, twice, "traces", strict=True)
    r = rows[0][1][0]
    s = r["scope_spans"][0]
    split = [(9, [r | {"scope_spans": [s | {"spans": [x]}]} for x in reversed(s["spans"])]), rows[2]]
    assert canonical.equivalent(a, spark.createDataFrame(split, kind), "traces", strict=True)
    typed = [(0, [r | {"resource": {"attributes": {"h": _value(bytes=b"x")}, "dropped": 1}, "scope_spans": [s]}]), rows[2]]
    assert not canonical.equivalent(a, spark.createDataFrame(typed, kind), "traces")


def test_json_forms(spark):
    texts = ['{"a":[1,2,{"c":true,"b":null}],"z":""}', '{"z":"","a":[{"b":null,"c":true},2,1]}', '{"a":[1,2],"z":""}', "{", None, "[]"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(json_forms.canonical_json(F.col("t")).alias("c"), json_forms.json_paths(F.col("t")).alias("p")).collect()
    assert got[0].c == got[1].c != got[2].c and got[0].p == got[1].p != got[2].p and got[3].c is None and got[4].p is None and got[5].c == "[]"
    assert 'z=""' in got[0].p and len(got[0].p) == 5 and sum(p.startswith("a[") for p in got[0].p) == 4


@pytest.mark.parametrize("form", ["proto", "json"])
@pytest.mark.parametrize("signal", SIGNALS)
def test_requests_round_trip(spark, tmp_path, signal, form):
    make, _, _ = SIGNALS[signal]
    made = make(spark, 3, 4, 2, random=True)
    made = spark.createDataFrame(made.collect(), made.schema)
    back = wire.read_messages(wire.write_messages(made, signal, form), signal, form)
    # A message can't tell an absent number or text from 0 or an empty one, so defaults are written and read twice.
    again = wire.read_messages(wire.write_messages(back, signal, form), signal, form)
    assert _shown(again, signal) == _shown(back, signal)
    drop = {"traces": lambda d: nesting.flatten(d).select("span.trace_id", "span.name", "span.start_ns", F.size("span.events"), F.size("span.links")), "logs": lambda d: nesting.flatten_logs(d).select("log.time_ns", "log.severity_text", "log.body.str", "log.body.int", "log.body.ser"),
            "metrics": lambda d: metrics.flatten_metrics(d).select("metric.name", "metric.type", F.size("metric.numbers"), F.size("metric.histograms"), F.size("metric.exp_histograms"), F.size("metric.summaries"))}[signal]
    assert drop(back).exceptAll(drop(made)).isEmpty() and drop(made).exceptAll(drop(back)).isEmpty()
    for compression in ("none", "zstd"):
        config = FileConfig(str(tmp_path / f"{signal}-{compression}"), form, compression)
        write_requests(made.coalesce(1), config, signal, rows_a_file=2)
        files = read_requests(spark, config, signal)
        assert files.count() == 3 and drop(files).exceptAll(drop(made)).isEmpty()
    if signal == "traces":
        first = {r.batch_id: r.time_ns for r in first_time(made, signal).collect()}
        assert len(first) == 3 and all(t >= generate.START_NS for t in first.values())


def test_wire_bytes():
    """Fields by hand: tag, length and value."""
    value = {"traces": [{"schema_url": "u", "scope_spans": [{"spans": [{"trace_id": b"\x01" * 2, "name": "n", "start_ns": 1, "kind": 2, "attributes": [("k", -1), ("m", {"x": [True]})]}]}]}]}
    span = b"\x0a\x02\x01\x01" + b"\x2a\x01n" + b"\x30\x02" + b"\x39" + struct.pack("<Q", 1) + b"\x4a\x10\x0a\x01k\x12\x0b\x18" + b"\xff" * 9 + b"\x01" + b"\x4a\x14\x0a\x01m\x12\x0f\x32\x0d\x0a\x0b\x0a\x01x\x12\x06\x2a\x04\x0a\x02\x10\x01"
    scope = b"\x12" + bytes([len(span)]) + span
    resource = b"\x12" + bytes([len(scope)]) + scope + b"\x1a\x01u"
    data = b"\x0a" + bytes([len(resource)]) + resource
    assert wire.write(value, "TRACES") == data and wire.parse(data, "TRACES") == value
    assert wire.parse_json(wire.write_json(value, "TRACES"), "TRACES") == value
    with pytest.raises(ValueError):
        wire.parse(data[:-3], "TRACES")


def test_sizes(spark):
    made = _stored(spark, generate.generate_traces(spark, 3, 100, 1))
    sizes = sizes_.json_sizes(made, "traces").unionByName(sizes_.table_sizes(made, "traces"))
    rows = {(r.system, r.n): r for r in sizes_.ratios(sizes, [], warm_up=1).collect()}
    assert rows["json", 2].ratio == 1 and rows["tables", 2].ratio > 0.8 and rows["tables", 2].total == 2 * rows["tables", 2]["mean"]
    data = spark.createDataFrame([(b"x" * 500,), (b"",), (None,)], "d binary")
    for codec_ in sizes_.CODECS:
        packed = data.select("d", sizes_.compress(F.col("d"), codec_).alias("p"))
        assert packed.where(~F.col("d").eqNullSafe(sizes_.decompress(F.col("p"), codec_))).isEmpty()
    with pytest.raises(ValueError):
        sizes_.compress(F.col("d"), "gzip")


def test_adaptive_schema(spark):
    df = spark.createDataFrame([(1, ("x", None), None, [1]), (2, ("y", None), None, [1])], "id int, s struct<a:string,b:string>, gone string, l array<int>")
    p = {r.name: r for r in adaptive.profile(df).collect()}
    assert (p["s.a"].distinct, p["s.a"].used, p["s.b"].used, p["gone"].present, p["l"].distinct, p["id"].width) == (2, True, False, 0, 1, "u8")
    assert adaptive.adapted(df).schema.simpleString() == "struct<id:int,s:struct<a:string>,l:array<int>>"
    assert adaptive.adapted(df, keep=("gone",)).columns == ["id", "s", "gone", "l"]
    # Ten batches of 128 new names each: the index widens once the running total passes 255.
    names = spark.range(1280).selectExpr("id div 128 as batch_id", "concat('name ', id) as name", "cast(null as string) as never")
    assert [tuple(r) for r in adaptive.events(names, "batch_id", ["name", "never"]).orderBy("batch_id").collect()] == [(0, "name", "appears", 128), (1, "name", "widens", 256)]
    small = adaptive.events(names, "batch_id", ["name"], adaptive.DictionaryConfig("u8", "u8")).orderBy("batch_id").collect()
    assert [(r.batch_id, r.event) for r in small] == [(0, "appears"), (1, "overflows")]
    with pytest.raises(ValueError):
        adaptive.DictionaryConfig("u16", "u8")


def test_reports(spark):
    t = nesting.tables(nesting.flatten(generate.generate_traces(spark, 2, 5, 1)))
    e = analysis.event_report(t["events"], t["spans"], nesting.PLACE).first()
    assert e.n == t["events"].count() and 2 <= e.per_span_min <= e.per_span_p50 <= e.per_span_max <= 9 and e.name_distinct <= len(generate.EVENTS)
    link = analysis.link_report(t["links"], t["spans"], nesting.PLACE).first()
    assert link.n == t["links"].count() and link.spans <= link.n and link.trace_state_distinct == 2
    a = analysis.attribute_report(t["span_attrs"], t["spans"], nesting.PLACE).first()
    assert (a.n, a.keys, a.n_bytes, a.attributes_min, a.attributes_max) == (150, 5, 30, 5, 5) and a.key_max_bytes == 8
    levels = analysis.levels(nesting.flatten(generate.generate_traces(spark, 2, 5, 1, random=True)), "span").collect()
    assert all((r.resources, r.scopes, r.items, r.distinct_resources, r.distinct_scopes) == (4, 12, 15, 4, 3) for r in levels)
    logs = nesting.log_tables(nesting.flatten_logs(generate.generate_logs(spark, 2, 40, 1)))["logs"]
    r = analysis.log_report(logs).first()
    assert r.n == 80 and r.severity_text_distinct == 4 and r.body_str >= 64 and r.body_empty + sum(r[f"body_{k}"] for k in ("str", "int", "double", "bool", "map", "slice", "bytes")) == 80
    m = {x.kind: x for x in analysis.metric_report(metrics.tables(generate.generate_metrics(spark, 2, 3, 1))).collect()}
    assert m["summaries"].n == 2 * 2 * 3 and m["numbers"].times == 2 and m["exemplars"].n > 0
    assert analysis.totals(spark.createDataFrame([(1.0,), (3.0,)], "x double").withColumn("g", F.lit(1)), ["g"], "x", 2).first().total == 2
    assert spark.range(1).select(analysis.add_summaries(F.array(F.lit(1.0)), F.array(F.lit(2.0), F.lit(3.0))).alias("x")).first().x == [3.0, 3.0]


def test_slices(spark):
    made = generate.generate_traces(spark, 3, 4, 2, random=True)
    made = _stored(spark, made)
    cut = _stored(spark, slice_items(nesting.flatten(made), "span", 10))
    n = [r["count"] for r in cut.groupBy("batch_id").count().orderBy("batch_id").collect()]
    assert n == [10, 10, 10, 6]
    back = nesting.renest(nesting.tables(cut))
    assert canonical.equivalent(made, back, "traces", strict=True)


def _shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("ENSURE_REQUIREMENTS")


@pytest.mark.parametrize("name", ["span_attr_join", "event_attr_join", "span_event_join", "resource_attr_join", "renest_logs"])
def test_batches_stay_together(spark, name):
    """Tables of a batch are nested, grouped and joined where the batch is."""
    assert _shuffles(QUERIES[name](spark, "/root/testdata/sf0.001")) == 0


@pytest.mark.parametrize("name", ["dp_attr_join", "exemplar_attr_join", "span_attr_join", "span_event_join", "renest_traces"])
def test_joins_on_places_send_nothing_to_the_driver(spark, name):
    assert "Broadcast" not in QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_decoded_tables_can_be_kept(spark):
    """A sort holds a page of memory at least, so that one stage can't hold those of all tables."""
    names = []
    encoding.decode(encoding.encode(generate.generate_traces(spark, 1, 2, 1), "traces"), "traces", keep=lambda df, name: names.append(name) or df)
    assert names == ["spans", "span_attrs", "events", "event_attrs", "links", "link_attrs"]


def test_parts_grow_with_the_rows(spark, monkeypatch):
    rows = spark.range(3000).select((F.col("id") % 50).alias("batch_id"), "id")
    monkeypatch.setattr(nesting, "PART_BYTES", 4096)
    own = nesting.by_batch(rows)
    parts = nesting.parts(rows)
    table_ = buckets.kept(own, "rows")
    own = nesting.meet(table_, table_.groupBy("batch_id").count(), ["batch_id"])
    assert parts > 4 and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
    assert f"SelectedBucketsCount: {parts} out of {parts}" in own._jdf.queryExecution().executedPlan().toString().replace("Bucketed: true, ", "") and _shuffles(own) == 0
    assert own.count() == 3000


def test_interval_counts_repeat_no_rows(spark):
    plan = QUERIES["time_interval_stats"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan


def test_names_are_enciphered_in_all_parts(spark):
    """However few groups of rows the file has."""
    assert QUERIES["obfuscate_len_preserving"](spark, "/root/testdata/sf0.001").select("revealed").rdd.getNumPartitions() == 4


def test_difference_makes_each_side_once(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x"), (4, "y")], "k int, v string")
    b = spark.createDataFrame([(1, None), (3, "x"), (4, "y"), (4, "y")], "k int, v string")
    plain, strict = compare.difference(a, b), compare.difference(a, b, strict=True)
    assert sorted(map(tuple, plain.collect())) == [(2, "x", "missing"), (3, "x", "unexpected")]
    assert sorted(map(str, map(tuple, strict.collect()))) == sorted(map(str, [(1, None, "missing"), (2, "x", "missing"), (3, "x", "unexpected"), (4, "y", "unexpected")]))
    assert _shuffles(plain) == _shuffles(strict) == 1


def test_multivariate(spark, tmp_path):
    entries = [{"Ts": 1, "source_id": "a", "Evt": {"Timestamp": 5, "Tags": {"h": "x", "metric": "no"}, "Fields": {"f": 1, "e": 2}}}, {"Ts": 2, "source_id": "a", "Evt": {"Timestamp": 6, "Tags": {}, "Fields": {"f": 3}}}, {"Ts": 2, "source_id": "b", "Evt": {"Timestamp": 6, "Tags": None, "Fields": {}}}]
    (tmp_path / "m.json").write_text(json.dumps(entries, indent=1))
    got = multivariate(spark, str(tmp_path / "m.json")).orderBy("entry").collect()
    assert [(r.source_id, r.entry, [(p.field, p.time_ns, p.int, p.attributes) for p in r.points]) for r in got] == [("a", 0, [("e", 5, 2, {"h": "x", "metric": "e"}), ("f", 5, 1, {"h": "x", "metric": "f"})]), ("a", 1, [("f", 6, 3, {"metric": "f"})])]


def test_shown_records_and_model(spark):
    df = spark.createDataFrame([(i, ("x" * 30, i)) for i in range(3)], "id int, s struct<a:string,b:int>")
    assert show_records(df, 2)[0] == "id\ts.a\ts.b" and len(show_records(df, 2)) == 3 and all(len(c) <= 20 for line in show_records(df) for c in line.split("\t"))
    text = data_model({"spans": df, "events": df}, {"events": "spans"})
    assert text.startswith("erDiagram") and "SPANS ||--o{ EVENTS : has" in text


def test_json_lines_and_zstd(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    write_json_lines(rows.coalesce(1), str(tmp_path / "plain"))
    text = b"".join(p.read_bytes() for p in (tmp_path / "plain").glob("part-*")).rstrip(b"\n")
    (tmp_path / "packed.zst").write_bytes(zstandard.compress(text))
    for config in (FileConfig(str(tmp_path / "plain")), FileConfig(str(tmp_path / "packed.zst"), compression="zstd")):
        assert sorted(map(tuple, read_json_lines(spark, config, "id long, name string").collect())) == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError):
        FileConfig("x", throttle=-1)


def test_chunks(spark, tmp_path):
    messages = [b"one", b"", b"three" * 100]
    (tmp_path / "c.bin").write_bytes(b"".join(struct.pack(">i", len(m)) + m for m in messages))
    got = read_chunks(spark, FileConfig(str(tmp_path / "c.bin"), "proto")).orderBy("number").collect()
    assert [bytes(r.data) for r in got] == messages
    (tmp_path / "d.bin").write_bytes(b"\x00\x00\x00\x09ab")
    with pytest.raises(Exception, match="ends within"):
        read_chunks(spark, FileConfig(str(tmp_path / "d.bin"), "proto")).collect()
    with pytest.raises(Exception, match="no such|nothing|FileNotFound"):
        read_chunks(spark, FileConfig(str(tmp_path / "no such"), "proto")).collect()


def test_csv_logs(spark, tmp_path):
    head = "ts,level,source-host,log-method,log-url,log-status,body,log-duration,log-content-size,source-type,log-valid\n"
    (tmp_path / "l.csv").write_text(head + "1,info,host,GET,/a,200,OK,1.5,7,web,true\n2,error,host,,/b,404,Not Found,0.5,,web,false\n")
    a, b = read_csv_logs(spark, str(tmp_path / "l.csv")).orderBy("time_ns").collect()
    assert (a.severity_number, b.severity_number, a.host_name, a.body, b.source) == (9, 17, "host", "OK", {"host": "host", "type": "web"})
    assert a.attributes["status"].int == 200 and a.attributes["duration"].double == 1.5 and a.attributes["valid"].bool is True and a.attributes["content-size"].int == 7 and "method" not in b.attributes
    for bad in ("ts,level\n", "ts,level,body,more\n"):
        (tmp_path / "bad.csv").write_text(bad + "1,info" + ",x" * (bad.count(",") - 1) + "\n")
        with pytest.raises(ValueError):
            read_csv_logs(spark, str(tmp_path / "bad.csv"))


def test_metric_nesting_round_trip(spark):
    head = {"start_ns": 1, "time_ns": 2, "flags": 0, "attributes": {"a": _value(int=1)}}
    exemplar = {"time_ns": 3, "int": None, "double": 1.5, "trace_id": b"t" * 16, "span_id": None, "attributes": {}}
    number = head | {"int": 7, "double": None, "exemplars": [exemplar, exemplar | {"time_ns": 1}]}
    summary = head | {"count": Decimal(2), "sum": 3.0, "quantiles": [{"quantile": 0.5, "value": 1.0}]}
    histogram = head | {"count": Decimal(2), "sum": 3.0, "min": None, "max": 2.0, "bounds": [1.0], "counts": [Decimal(2**64 - 1), Decimal(1)], "exemplars": []}
    exponential = head | {"count": Decimal(2), "sum": None, "min": None, "max": 2.0, "scale": 1, "zero_count": Decimal(0), "positive": {"offset": -1, "counts": [Decimal(2)]}, "negative": None, "exemplars": [exemplar]}
    bare = {"name": "m", "description": "", "unit": "s", "type": 1, "temporality": 0, "monotonic": None, "numbers": [], "summaries": [], "histograms": [], "exp_histograms": []}
    listed = [bare | {"numbers": [number, number | {"exemplars": []}]}, bare | {"summaries": [summary]}, bare | {"histograms": [histogram], "exp_histograms": [exponential]}, bare]
    scope = {"name": "g", "version": "1", "attributes": {}, "dropped": 0}
    resource = {"resource": {"attributes": {"h": _value(str="x")}, "dropped": 1}, "schema_url": "u", "scope_metrics": [{"scope": scope, "schema_url": "", "metrics": listed}, {"scope": None, "schema_url": "", "metrics": []}]}
    df = spark.createDataFrame([(0, [resource]), (1, []), (2, [resource, resource])], f"batch_id long, metrics {metrics.METRICS}")
    assert _shown(metrics.renest(metrics.tables(df)), "metrics") == _shown(df, "metrics")


@pytest.mark.parametrize("dictionaries", [True, False])
def test_ipc_payloads(spark, dictionaries):
    df = spark.createDataFrame([(1, "a", 1.5), (1, None, None), (2, "a", 2.5), (None, "x", 0.0)], "batch_id long, name string, v double")
    payloads = ipc.to_payloads(df.coalesce(1), dictionaries=dictionaries)
    assert sorted((r.batch_id, r.n_rows) for r in payloads.collect()) == [(1, 2), (2, 1)]
    back = ipc.from_payloads(payloads, "v double, name string, more long")
    assert back.columns == ["batch_id", "v", "name", "more"] and back.where("more is not null").isEmpty()
    assert compare.equivalent(back.select(df.columns), df.where("batch_id is not null"), strict=True)
    assert ipc.to_payloads(df.limit(0)).isEmpty()


def test_generated_batches(spark):
    a, b = (generate.generate_traces(spark, 3, 4, seed) for seed in (1, 1))
    assert compare.equivalent(a.select(F.to_json("traces")), b.select(F.to_json("traces")), strict=True)
    assert not compare.equivalent(a.select(F.to_json("traces")), generate.generate_traces(spark, 3, 4, 2).select(F.to_json("traces")))
    t = nesting.tables(nesting.flatten(a))
    assert t["spans"].count() == 3 * 4 * 3 and t["spans"].where("octet_length(trace_id) <> 16 or octet_length(span_id) <> 8 or duration_ns < 0").isEmpty()
    for name in ("events", "links"):
        n = [r["count"] for r in t[name].groupBy("batch_id", "r", "s", "i").count().collect()]
        assert len(n) == 36 and min(n) >= 2 and max(n) <= 9
    logs = nesting.log_tables(nesting.flatten_logs(generate.generate_logs(spark, 2, 400, 3)))["logs"]
    assert [r.severity_text for r in logs.where("batch_id = 0").orderBy("time_ns").limit(4).collect()] == list(generate.LEVELS)
    shapes = {(r.type, None if r.str is None else r.str == "", None if r.bytes is None else len(r.bytes), None if r.ser is None else bytes(r.ser)) for r in logs.select(F.coalesce("body.type", F.lit(0)).alias("type"), "body.str", "body.bytes", "body.ser").collect()}
    assert len(shapes) == 11
    made = metrics.tables(generate.generate_metrics(spark, 5, 6, 3))
    assert made["metrics"].where("batch_id = 0").count() == 18 and made["numbers"].where("batch_id = 0").count() == 6 * 5 and made["numbers"].where("int is not null and double is not null").isEmpty()
    assert not made["exp_histograms"].where("positive is null").isEmpty() and not made["histograms"].where("size(counts) = 11").isEmpty()
    assert generate.generate_logs(spark, 0, 10).isEmpty() and nesting.tables(nesting.flatten(generate.generate_traces(spark, 1, 0)))["spans"].isEmpty()
    wide = nesting.flatten(generate.generate_traces(spark, 1, 8, 4, random=True))
    assert not wide.where("span.kind is null").isEmpty() and not wide.where("span.kind is not null").isEmpty() and wide.select("r", "s").distinct().count() == 12


def test_replay_keeps_the_pace(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, ts in enumerate((10, 30, 20, 25)):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"ts": ts * 10**9, "i": i}) + "\n")
        os.utime(tmp_path / "in" / f"{i}.json", (i + 1, i + 1))
    waits, seen = [], []
    stream = replay.json_stream(spark, str(tmp_path / "in"), "ts long, i long", 1)
    query = replay.replay(stream, "ts", 0.5, lambda df, _: seen.extend(r.i for r in df.collect()), str(tmp_path / "c"), waits.append)
    assert query.awaitTermination(60) and query.exception() is None
    assert seen == [0, 1, 2, 3] and waits == [10, 0, 2.5]
    with pytest.raises(ValueError):
        replay.replay(stream, "ts", -1, print, "c")


def test_fan_out(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("".join(json.dumps({"id": i}) + "\n" for i in range(10)))
    got = {"x": [], "y": []}
    sinks = {n: (lambda df, _, n=n: got[n].extend(r.id for r in df.collect())) for n in got}
    query = replay.fan_out(replay.json_stream(spark, str(tmp_path / "in"), "id long"), {"x": 1, "y": 4}, "id", sinks, str(tmp_path / "c"))
    assert query.awaitTermination(60) and query.exception() is None
    assert sorted(got["x"]) == [0, 5] and len(got["y"]) == 8
