"""Adaptive schemas as statistics: which columns a table needs, and which dictionary each of them.

Tables have fixed schemas with nullable columns; what a stream's schema would have become is a query over its values.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructField, StructType

#: Widths of an index, and how many values each can tell apart.
WIDTHS = (("u8", 1 << 8), ("u16", 1 << 16), ("u32", 1 << 32))


@dataclass(frozen=True)
class DictionaryConfig:
    """Widths that a dictionary starts with and may grow to; no dictionaries at all with ``limit`` none."""

    start: str = "u8"
    limit: str = "u16"

    def __post_init__(self):
        names = [w for w, _ in WIDTHS]
        if self.limit != "none" and (self.start not in names or self.limit not in names or names.index(self.start) > names.index(self.limit)):
            raise ValueError(f"not a range of widths: {self.start} to {self.limit}")

    def width(self, distinct: Column) -> Column:
        """The index that so many values need; ``plain`` beyond the limit."""
        if self.limit == "none":
            return F.lit("plain")
        names = [w for w, _ in WIDTHS]
        out = None
        for name, size in WIDTHS[names.index(self.start) : names.index(self.limit) + 1]:
            out = F.when(distinct <= size - 1, name) if out is None else out.when(distinct <= size - 1, name)
        return out.otherwise("plain")


def leaves(schema: StructType, at: str = "") -> list[tuple[str, DataType]]:
    """Paths of all columns that aren't structs, with those within structs as ``a.b``."""
    out: list[tuple[str, DataType]] = []
    for f in schema:
        path = f"{at}{f.name}"
        out += leaves(f.dataType, f"{path}.") if isinstance(f.dataType, StructType) else [(path, f.dataType)]
    return out


def _value(path: str, kind: DataType) -> Column:
    c = F.col(path)
    return F.to_json(c) if isinstance(kind, ArrayType | MapType) else c


def profile(df: DataFrame, config: DictionaryConfig = DictionaryConfig()) -> DataFrame:
    """One row for each leaf: name, n, present, used, distinct, width. Distinct values are counted by (leaf, value) pairs,
    which one shuffle brings together with partial counts, so no row is copied once for each leaf after it."""
    cells = [F.struct(F.lit(path).alias("name"), _value(path, kind).cast("string").alias("value")) for path, kind in leaves(df.schema)]
    long = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    of_value = long.groupBy("name", "value").agg(F.count("*").alias("n"))
    out = of_value.groupBy("name").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("present"), F.count("value").alias("distinct"))
    return out.select("name", "n", "present", (F.col("present") > 0).alias("used"), "distinct", config.width(F.col("distinct")).alias("width"))


def pruned_schema(schema: StructType, used: set[str], at: str = "") -> StructType:
    """The schema without leaves that aren't used, and without structs that have none left."""
    fields = []
    for f in schema:
        path = f"{at}{f.name}"
        if isinstance(f.dataType, StructType):
            inner = pruned_schema(f.dataType, used, f"{path}.")
            fields += [StructField(f.name, inner, f.nullable)] if len(inner) else []
        elif path in used:
            fields.append(f)
    return StructType(fields)


def adapted(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``df`` without the optional columns that hold nothing; one row for each leaf comes to the driver."""
    used = {r.name for r in profile(df).where("used").select("name").collect()} | set(keep)

    def pick(c: Column, old: StructType, at: str) -> list[Column]:
        out = []
        for f in pruned_schema(old, used, at):
            inner = c[f.name] if c is not None else F.col(f"`{f.name}`")
            if isinstance(f.dataType, StructType):
                inner = F.when(inner.isNotNull(), F.struct(*pick(inner, old[f.name].dataType, f"{at}{f.name}.")))
            out.append(inner.alias(f.name))
        return out

    return df.select(*pick(None, df.schema, ""))


def events(df: DataFrame, batch: str, columns: list[str], config: DictionaryConfig = DictionaryConfig()) -> DataFrame:
    """What a stream's schema goes through: (batch, column, event, distinct), event being ``appears`` where a column gets
    its first value, ``widens`` where its cumulative dictionary needs a wider index, ``overflows`` where it passes the limit.

    A value counts in the batch that it is first seen in; what is summed up then is one row for each batch and column.
    """
    parts = [df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("value")).agg(F.min(batch).alias(batch)).withColumn("column", F.lit(c)) for c in columns]
    new = reduce(DataFrame.unionByName, parts).groupBy(batch, "column").agg(F.count("*").alias("new"))
    over = Window.partitionBy("column").orderBy(batch)
    total = new.withColumn("distinct", F.sum("new").over(over.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    width = total.withColumn("width", config.width(F.col("distinct"))).withColumn("before", F.lag("width").over(over))
    event = F.when(F.col("before").isNull(), "appears").when(F.col("width") == F.col("before"), None).when(F.col("width") == "plain", "overflows").otherwise("widens")
    first = width.where(F.col("before").isNull() & (F.col("width") != config.start)) if config.limit != "none" else width.limit(0)
    late = first.withColumn("event", F.when(F.col("width") == "plain", "overflows").otherwise("widens"))
    both = width.withColumn("event", event).where("event is not null").unionByName(late)
    return both.select(batch, "column", "event", "distinct")
