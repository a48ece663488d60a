"""Attribute tables: maps or columns to typed rows, rows to wide columns, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Value kinds of the public telemetry data model, and their columns.
KINDS = {"empty": 0, "str": 1, "int": 2, "double": 3, "bool": 4, "map": 5, "slice": 6, "bytes": 7}
#: Columns of a tagged value; maps and slices are serialized (``functions.cbor``), both in the last.
_TYPES = {"str": "string", "int": "bigint", "double": "double", "bool": "boolean", "bytes": "binary", "ser": "binary"}
VALUE_FIELDS = ("type", *_TYPES)
VALUE = "struct<type:int," + ",".join(f"{k}:{t}" for k, t in _TYPES.items()) + ">"
ATTRS = f"map<string,{VALUE}>"


def typed(kind: str, value: Column) -> Column:
    """A tagged value: its kind, and the one column that holds it; maps and slices are given serialized."""
    own = "ser" if kind in ("map", "slice") else kind
    cells = [(value if k == own else F.lit(None)).cast(t).alias(k) for k, t in _TYPES.items()]
    return F.struct(F.when(value.isNull(), 0).otherwise(KINDS[kind]).cast("int").alias("type"), *cells)


def equal_values(a: Column, b: Column) -> Column:
    """Whether two tagged values are equal, deeply: equal maps and slices are equal bytes, and two missing values are equal."""
    return a.eqNullSafe(b)


def compare_values(a: Column, b: Column) -> Column:
    """-1, 0 or 1: values by kind, then by what they hold (false before true, bytes and serialized values by their bytes)."""
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def valid_ids(trace: Column, span: Column) -> Column:
    """Trace ids of 16 bytes and span ids of 8; missing ones are valid."""
    return (F.coalesce(F.octet_length(trace), F.lit(16)) == 16) & (F.coalesce(F.octet_length(span), F.lit(8)) == 8)


def unpivot(df: DataFrame, ids: list[str], columns: dict[str, tuple[str, Column]]) -> DataFrame:
    """One row for each attribute: ids, key and the fields of its value. Empty keys and null values are left out."""
    cells = [F.struct(F.lit(key).alias("key"), typed(kind, value).alias("v")) for key, (kind, value) in columns.items() if key]
    long = df.select(*ids, F.explode(F.array(*cells)).alias("a")).where("a.v.type <> 0")
    return long.select(*ids, "a.key", "a.v.*")


def pivot_wide(attrs: DataFrame, ids: list[str], columns: dict[str, str]) -> DataFrame:
    """One row for each parent, one column ``key_kind`` for each attribute, in the order of names."""
    cells = [F.max(F.when((F.col("key") == k) & (F.col("type") == KINDS[kind]), F.col("ser" if kind in ("map", "slice") else kind))).alias(f"{k}_{kind}") for k, kind in sorted(columns.items())]
    return attrs.groupBy(*ids).agg(*cells)


def unpivot_wide(wide: DataFrame, ids: list[str]) -> DataFrame:
    """The inverse: the suffix of each column names its kind."""
    columns = {}
    for c in wide.columns:
        name, _, kind = c.rpartition("_")
        if c not in ids and kind in KINDS:
            columns[name] = (kind, F.col(c))
    return unpivot(wide, ids, columns)


def rebuild_maps(attrs: DataFrame, ids: list[str], order: list[str]) -> DataFrame:
    """One map of tagged values for each parent; of a repeated key the last in order stays. A column that ``attrs`` lacks,
    as no value needs it, is null."""
    fields = [F.col(c) if c in attrs.columns else F.lit(None).cast(_TYPES[c]).alias(c) for c in VALUE_FIELDS]
    entry = F.struct(*order, "key", F.struct(*fields).alias("value"))
    last = attrs.groupBy(*ids, "key").agg(F.max(entry).alias("e"))
    return last.groupBy(*ids).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("e.key").alias("key"), F.col("e.value").alias("value"))))).alias("attributes"))


#: What a text may be to be a truth value or a special number.
TRUE, FALSE = ("t", "T", "true", "TRUE", "True"), ("f", "F", "false", "FALSE", "False")
_DECIMAL = r"^[+-]?(\d(_?\d)*\.?(\d(_?\d)*)?|\.\d(_?\d)*)([eE][+-]?\d(_?\d)*)?$"
_SPECIAL = r"^(?i)([+-]?inf(inity)?|nan)$"
_HEX = r"^[+-]?0[xX]([0-9a-fA-F]*)\.?([0-9a-fA-F]*)[pP]([+-]?\d+)$"


def real(text: Column) -> Column:
    """A text as a double, or null: decimal with or without exponent, infinite, not a number, or hexadecimal with a binary
    exponent. Underscores aren't taken."""
    plain = F.when(text.rlike(_DECIMAL) & ~text.contains("_"), text.try_cast("double"))
    sign = F.when(text.startswith("-"), -1.0).otherwise(1.0)
    special = F.when(F.lower(text).contains("nan"), F.lit(float("nan"))).otherwise(sign * F.lit(float("inf")))
    whole, part, power = (F.regexp_extract(text, _HEX, i) for i in (1, 2, 3))
    digits = F.conv(F.concat(whole, part), 16, 10).try_cast("double")
    short = (F.length(whole) + F.length(part) > 0) & (F.length(F.ltrim(F.concat(whole, part), F.lit("0"))) <= 13)
    scaled = sign * digits * F.pow(F.lit(2.0), power.try_cast("double") - 4 * F.length(part))
    return F.coalesce(plain, F.when(text.rlike(_SPECIAL), special), F.when(text.rlike(_HEX) & short, scaled))


def infer(text: Column) -> Column:
    """A text as int, double, bool or string, whichever takes it first; as a tagged value.

    A decimal too large for a double is a string, as it is out of range.
    """
    i, d = text.try_cast("bigint"), real(text)
    number = text.rlike(r"^[+-]?\d+$") & i.isNotNull()
    finite = d.isNotNull() & (text.rlike(_SPECIAL) | (F.abs(d) < float("inf")))
    kind = F.when(number, 2).when(finite, 3).when(text.isin(*TRUE, *FALSE), 4).when(text.isNull(), 0).otherwise(1)
    cells = {"str": F.when(kind == 1, text), "int": F.when(kind == 2, i), "double": F.when(kind == 3, d), "bool": F.when(kind == 4, text.isin(*TRUE))}
    return F.struct(kind.cast("int").alias("type"), *[cells.get(c, F.lit(None)).cast(t).alias(c) for c, t in _TYPES.items()])
