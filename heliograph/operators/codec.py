"""Order-aware encodings of ids: running ids, deltas, and deltas within groups of equal neighbours.

Every function takes ``part`` (columns of a batch, so that no window is global) and ``order`` (a total order within it).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

U16, U32 = 0xFFFF, 0xFFFFFFFF


def window(part: list[str], order: list) -> WindowSpec:
    return Window.partitionBy(*part).orderBy(*order)


def prefix(part: list[str], order: list) -> WindowSpec:
    return window(part, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def changed(keys: list, over: WindowSpec) -> Column:
    """Whether any of the keys differs from the row before, or there is none; a NaN differs from everything."""

    def differs(key) -> Column:
        c = F.col(key) if isinstance(key, str) else key
        return ~c.eqNullSafe(F.lag(c).over(over)) | F.coalesce(F.expr("false") if not isinstance(key, str) else F.col(key).cast("string") == "NaN", F.lit(False))

    first = F.row_number().over(over) == 1
    return reduce(lambda a, b: a | b, [differs(k) for k in keys], first)


def run_ids(df: DataFrame, part: list[str], order: list, keys: list, name: str) -> DataFrame:
    """Ids of runs of equal keys in sorted order, from 0."""
    flag = changed(keys, window(part, order)).cast("long")
    return df.withColumn("__new", flag).withColumn(name, F.sum("__new").over(prefix(part, order)) - 1).drop("__new")


def item_ids(df: DataFrame, part: list[str], order: list, has: Column, name: str) -> DataFrame:
    """Consecutive ids for the rows that have related rows; null for the others."""
    count = F.sum(has.cast("long")).over(prefix(part, order))
    return df.withColumn(name, F.when(has, count - 1))


def delta_encode(df: DataFrame, part: list[str], order: list, column: str, name: str) -> DataFrame:
    """Difference from the last id before that isn't null; the first is absolute, nulls stay."""
    before = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    last = F.coalesce(F.last(column, ignorenulls=True).over(before), F.lit(0))
    return df.withColumn(name, F.col(column) - last)


def delta_decode(df: DataFrame, part: list[str], order: list, column: str, name: str, mask: int = U32) -> DataFrame:
    """The inverse: a running sum that skips nulls and wraps as unsigned numbers do."""
    total = F.sum(F.coalesce(column, F.lit(0))).over(prefix(part, order)).bitwiseAND(F.lit(mask).cast("long"))
    return df.withColumn(name, F.when(F.col(column).isNotNull(), total))


def group_delta_encode(df: DataFrame, part: list[str], order: list, keys: list, column: str, name: str, mask: int = U16) -> DataFrame:
    """Difference from the row before within a run of equal keys; absolute at the start of a run."""
    over = window(part, order)
    delta = (F.col(column) - F.lag(column).over(over)).bitwiseAND(F.lit(mask).cast("long"))
    return df.withColumn(name, F.when(changed(keys, over), F.col(column)).otherwise(delta))


def group_delta_decode(df: DataFrame, part: list[str], order: list, keys: list, column: str, name: str, mask: int = U16) -> DataFrame:
    """The inverse: runs by gaps and islands, then a running sum within each run."""
    runs = run_ids(df, part, order, keys, "__run")
    total = F.sum(column).over(prefix([*part, "__run"], order)).bitwiseAND(F.lit(mask).cast("long"))
    return runs.withColumn(name, total).drop("__run")
