"""File sources and sinks of telemetry batches.

JSON lines and CSV are Spark's own readers; compressed lines and length-prefixed chunks, which have no splittable form,
come from the data source in `chunks`, which reads them on as rows are taken.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import severity_number
from ..operators import metrics, nesting
from ..operators.attributes import ATTRS, infer
from ..operators.canonical import resource_key, scope_key
from . import chunks, wire


@dataclass(frozen=True)
class FileConfig:
    """Options of a file source: format ``json`` or ``proto``, compression ``none`` or ``zstd``, throttle of 0 or more."""

    path: str
    format: str = "json"
    compression: str = "none"
    throttle: float = 1.0

    def __post_init__(self):
        if not self.path:
            raise ValueError("path must not be empty")
        if self.throttle < 0:
            raise ValueError("throttle must be 0 or more")
        if self.format not in ("json", "proto") or self.compression not in ("none", "zstd"):
            raise ValueError(f"unknown format or compression: {self.format}, {self.compression}")


def read_json_lines(spark: SparkSession, config: FileConfig, schema: str) -> DataFrame:
    """One batch for each line, the last one with or without a newline; lines that don't parse become null."""
    if config.compression == "none":
        lines = spark.read.text(config.path)
    else:
        lines = _chunks(spark, config, "line").select(F.col("data").cast("string").alias("value"))
    return lines.where("value <> ''").select(F.from_json("value", schema).alias("batch")).select("batch.*")


def read_chunks(spark: SparkSession, config: FileConfig) -> DataFrame:
    """Messages with a big-endian 32-bit length before each: (path, number, data)."""
    return _chunks(spark, config, "length")


def _chunks(spark: SparkSession, config: FileConfig, framing: str) -> DataFrame:
    chunks.register(spark)
    return spark.read.format("chunks").option("compression", config.compression).option("framing", framing).load(config.path)


def read_requests(spark: SparkSession, config: FileConfig, signal: str) -> DataFrame:
    """Nested batches (batch_id, <signal>) of a file of requests: one in each line for format ``json``, messages with their
    length for ``proto``. batch_id is the place in the file."""
    framing = "line" if config.format == "json" else "length"
    rows = _chunks(spark, config, framing).where("octet_length(data) > 0").select(F.col("number").alias("batch_id"), "data")
    if config.format == "json":
        rows = rows.withColumn("data", F.col("data").cast("string"))
    return wire.read_messages(rows, signal, config.format)


def write_requests(batches: DataFrame, config: FileConfig, signal: str, rows_a_file: int = 0) -> None:
    """The inverse: files of requests in a new folder, cut after so many."""
    chunks.register(batches.sparkSession)
    framing = "line" if config.format == "json" else "length"
    out = wire.write_messages(batches, signal, config.format).select("data").write.format("chunks").mode("append")
    out.option("compression", config.compression).option("framing", framing).option("rows_a_file", rows_a_file).save(config.path)


def first_time(batches: DataFrame, signal: str) -> DataFrame:
    """The time of a batch's first event: (batch_id, time_ns); null for a batch without events. Spans have start times,
    points of metrics times."""
    flat, item = {"traces": (nesting.flatten, "span"), "logs": (nesting.flatten_logs, "log"), "metrics": (metrics.flatten_metrics, "metric")}[signal]
    rows = flat(batches)
    if signal == "metrics":
        lists = [F.transform(f"metric.{k}", lambda p: p["time_ns"]) for k in metrics.POINTS]
        time = F.get(F.concat(*[F.coalesce(x, F.array().cast("array<bigint>")) for x in lists]), F.lit(0))
    else:
        time = F.col(f"{item}.start_ns" if signal == "traces" else f"{item}.time_ns")
    place = F.struct("r", "s", "i")
    return rows.groupBy("batch_id").agg(F.min_by(F.when(F.col(item).isNotNull(), time), F.when(F.col(item).isNotNull() & time.isNotNull(), place)).alias("time_ns"))


def write_json_lines(batches: DataFrame, path: str, rows_a_file: int = 0) -> None:
    """One line for each row; files are cut after so many rows."""
    writer = batches.select(F.to_json(F.struct(*batches.columns)).alias("value")).write.mode("error")
    (writer.option("maxRecordsPerFile", rows_a_file) if rows_a_file else writer).text(path)


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """One Parquet folder for each payload type, sorted within files by the batch for long runs."""
    for name, df in tables.items():
        df.sortWithinPartitions("batch_id").write.mode("error").option("compression", "zstd").parquet(f"{path}/payload_type={name}")


def read_csv_logs(spark: SparkSession, path: str) -> DataFrame:
    """Log records of a CSV file: ``ts`` (nanoseconds), ``level``, ``body``, and columns ``source-*`` and ``log-*``.

    Each ``log-`` column is an attribute of that name, typed by its text; empty cells have none. ``source-`` columns are
    collected in ``source``, a map of texts. Raises for a header without ts, level or body, and for other columns.
    """
    d = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    missing = {"ts", "level", "body"} - set(d.columns)
    other = [c for c in d.columns if c not in ("ts", "level", "body") and not c.startswith(("log-", "source-"))]
    if missing or other:
        raise ValueError(f"not a header of logs: without {sorted(missing)}, with {other}")

    def map_of(prefix: str, value) -> Column:
        cells = [F.struct(F.lit(c.removeprefix(prefix)).alias("key"), value(F.col(f"`{c}`")).alias("value")) for c in d.columns if c.startswith(prefix)]
        return F.array(*cells) if cells else None

    attributes = map_of("log-", infer)
    source = map_of("source-", lambda c: c)
    host = F.col("`source-host`") if "source-host" in d.columns else F.lit(None).cast("string")
    return d.select(
        F.col("ts").cast("bigint").alias("time_ns"), F.col("level").alias("severity_text"), severity_number(F.col("level")).alias("severity_number"), "body", host.alias("host_name"),
        (F.map_from_entries(F.filter(source, lambda e: e["value"].isNotNull())) if source is not None else F.create_map().cast("map<string,string>")).alias("source"),
        (F.map_from_entries(F.filter(attributes, lambda e: e["value"]["type"] != 0)) if attributes is not None else F.create_map().cast(ATTRS)).alias("attributes"),
    )


def slice_items(flat: DataFrame, item: str, size: int) -> DataFrame:
    """Items of a flattened signal dealt anew into batches of ``size``, in the order of their batches and places: the same
    columns, with batch_id and places of the new batches, resources and scopes being grouped again.

    Numbers of rows before each batch come from one count for each batch; no window spans all rows.
    """
    rows = flat.where(F.col(item).isNotNull())
    counts = rows.groupBy("batch_id").agg(F.count("*").alias("n"))
    edges = Window.partitionBy("part").orderBy("batch_id")
    part = F.floor(F.col("batch_id") / 10_000)
    counts = counts.withColumn("part", part).withColumn("inside", F.sum("n").over(edges.rowsBetween(Window.unboundedPreceding, -1)))
    parts = counts.groupBy("part").agg(F.sum("n").alias("m"))
    parts = parts.withColumn("before", F.sum("m").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    counts = counts.join(F.broadcast(parts), "part").select("batch_id", (F.coalesce("before", F.lit(0)) + F.coalesce("inside", F.lit(0))).alias("before"))
    own = Window.partitionBy("batch_id").orderBy("r", "s", "i")
    rows = rows.withColumn("k", F.row_number().over(own) - 1).join(counts, "batch_id").withColumn("place", F.col("before") + F.col("k"))
    rows = nesting.by_batch(rows.withColumn("batch_id", F.floor(F.col("place") / size).cast("long")))
    rows = rows.withColumns({"rk": resource_key("resource", "resource_url"), "sk": scope_key("scope", "scope_url")})
    # Resources and scopes are numbered by their first item.
    of_r, of_s = Window.partitionBy("batch_id", "rk"), Window.partitionBy("batch_id", "rk", "sk")
    rows = rows.withColumn("fr", F.min("place").over(of_r)).withColumn("fs", F.min("place").over(of_s))
    rows = rows.withColumn("r", F.dense_rank().over(Window.partitionBy("batch_id").orderBy("fr")) - 1).withColumn("s", F.dense_rank().over(Window.partitionBy("batch_id", "r").orderBy("fs")) - 1)
    rows = rows.withColumn("i", F.row_number().over(Window.partitionBy("batch_id", "r", "s").orderBy("place")) - 1)
    return rows.select(flat.columns)


def multivariate(spark: SparkSession, path: str) -> DataFrame:
    """Sum metrics of a JSON array of entries ``{Ts, source_id, Evt: {Timestamp, Tags, Fields}}``: one row for each source
    and entry, with one point for each field, whose attributes are the tags and ``metric``, the name of the field."""
    kind = "array<struct<Ts:bigint,source_id:string,Evt:struct<Timestamp:bigint,Tags:map<string,string>,Fields:map<string,bigint>>>>"
    text = spark.read.text(path, wholetext=True)
    entries = text.select(F.posexplode(F.from_json("value", kind)).alias("entry", "e")).select("entry", "e.source_id", "e.Evt.*")
    points = entries.select("entry", "source_id", F.col("Timestamp").alias("time_ns"), "Tags", F.explode("Fields").alias("field", "int"))
    tags = F.map_concat(F.map_filter(F.coalesce("Tags", F.create_map().cast("map<string,string>")), lambda k, v: k != "metric"), F.create_map(F.lit("metric"), F.col("field")))
    point = F.struct("field", "time_ns", "int", tags.alias("attributes"))
    out = points.groupBy("source_id", "entry").agg(F.collect_list(point).alias("points"))
    return out.select("source_id", "entry", F.lit("sum").alias("kind"), F.array_sort("points", nesting.by_field("field")).alias("points"))


def show_records(df: DataFrame, rows: int = 500, width: int = 20) -> list[str]:
    """A table as lines of text: structs as ``a.b`` columns, at most ``rows`` rows, cells cut to ``width`` characters."""

    def flat(schema, at: str = "") -> list[Column]:
        out = []
        for f in schema:
            path = f"{at}`{f.name}`"
            out += flat(f.dataType, f"{path}.") if f.dataType.typeName() == "struct" else [F.substring(F.col(path).cast("string"), 1, width).alias(path.replace("`", ""))]
        return out

    shown = df.select(*flat(df.schema))
    return ["\t".join(shown.columns), *("\t".join("" if v is None else v for v in r) for r in shown.limit(rows).collect())]


def data_model(tables: dict[str, DataFrame], parents: dict[str, str]) -> str:
    """The tables and their parents as an entity diagram in Mermaid's notation."""
    lines = ["erDiagram"]
    for name, df in tables.items():
        lines.append(f"    {name.upper()} {{")
        lines += [f"        {f.dataType.typeName()} {f.name}" for f in df.schema]
        lines.append("    }")
    lines += [f"    {parent.upper()} ||--o{{ {name.upper()} : has" for name, parent in parents.items() if name in tables]
    return "\n".join(lines)
