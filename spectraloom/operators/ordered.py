"""Running totals and row numbers over groups of any size.

A window over a whole group runs in one task. Where a group is larger than
``MAX_GROUP_ROWS`` the rows are range-partitioned instead: every slice gets its
own window, and the slices' totals, one row each, are carried over.
Orders are lists of columns, ascending with nulls last, and must be total.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.session import materialize

#: Rows of one group that one task may order.
MAX_GROUP_ROWS = 4_000_000
#: Rows of a slice, about.
SLICE_ROWS = 1_000_000


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    counts = df.groupBy(*keys).count() if keys else df.select(F.count(F.lit(1)).alias("count"))
    return counts.agg(F.max("count")).first()[0] or 0


def forwards(order: Sequence[str]) -> list[Column]:
    return [F.asc_nulls_last(c) for c in order]


def backwards(order: Sequence[str]) -> list[Column]:
    return [F.desc_nulls_first(c) for c in order]


def in_slices(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int, slice_rows: int | None = None) -> DataFrame:
    """``df`` with ``__slice``: within a group, rows of a later slice follow all rows of an earlier one."""
    parts = max(2, -(-rows // (slice_rows or SLICE_ROWS)))
    ranged = df.repartitionByRange(parts, *[F.col(k) for k in keys], *forwards(order))
    return materialize(ranged.withColumn("__slice", F.spark_partition_id()), "slices")


def _carried(sliced: DataFrame, keys: Sequence[str], totals: DataFrame, carry: dict[str, Column]) -> DataFrame:
    """Joins to every row what its slice inherits; ``totals`` has one row per group and slice."""
    renamed = totals.select(*[F.col(k).alias(f"__k{n}") for n, k in enumerate(keys)], F.col("__slice").alias("__s"), *[c.alias(name) for name, c in carry.items()])
    same = F.col("__slice") == F.col("__s")
    for n, key in enumerate(keys):
        same = same & F.col(key).eqNullSafe(F.col(f"__k{n}"))
    return sliced.join(renamed, same)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, Column], large: bool) -> DataFrame:
    """Adds running sums, this row included, of the ``sums`` within ``keys``; ``large`` where a group does not fit one task."""
    if not large:
        window = Window.partitionBy(*keys).orderBy(*forwards(order)).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({name: F.sum(value).over(window) for name, value in sums.items()})
    sliced = df if "__slice" in df.columns else in_slices(df, keys, order, df.count())
    inner = Window.partitionBy(*keys, "__slice").orderBy(*forwards(order)).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = sliced.groupBy(*keys, "__slice").agg(*[F.sum(value).alias(f"__{name}") for name, value in sums.items()])
    own = sliced.withColumns({name: F.sum(value).over(inner) for name, value in sums.items()})
    joined = _carried(own, keys, totals, {f"__{name}": F.coalesce(F.sum(f"__{name}").over(before), F.lit(0)) for name in sums})
    return joined.withColumns({name: F.col(name) + F.col(f"__{name}") for name in sums}).select(*sliced.columns, *sums)


def least_from_here(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, large: bool) -> DataFrame:
    """Adds the least ``value`` of this row and all later ones within ``keys``.

    The window runs backwards, so that its frame only grows.
    """
    if not large:
        window = Window.partitionBy(*keys).orderBy(*backwards(order)).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, F.min(value).over(window))
    sliced = df if "__slice" in df.columns else in_slices(df, keys, order, df.count())
    inner = Window.partitionBy(*keys, "__slice").orderBy(*backwards(order)).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy(*keys).orderBy(F.desc("__slice")).rowsBetween(Window.unboundedPreceding, -1)
    totals = sliced.groupBy(*keys, "__slice").agg(F.min(value).alias("__least"))
    joined = _carried(sliced.withColumn(name, F.min(value).over(inner)), keys, totals, {"__later": F.min("__least").over(later)})
    return joined.withColumn(name, F.least(name, "__later")).select(*sliced.columns, name)


def _place(order: Sequence[str]) -> Column:
    """A row's place in ``order`` as one comparable value, nulls last."""
    return F.struct(*[c for name in order for c in (F.col(name).isNull(), F.col(name))])


def following(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: dict[str, str], large: bool, slice_rows: int | None = None) -> DataFrame:
    """Adds, under the names in ``columns``, the columns' values in the next row within ``keys``; null in the last row."""
    if not large:
        window = Window.partitionBy(*keys).orderBy(*forwards(order))
        return df.withColumns({name: F.lead(column).over(window) for name, column in columns.items()})
    sliced = in_slices(df, keys, order, df.count(), slice_rows)
    inner = Window.partitionBy(*keys, "__slice").orderBy(*forwards(order))
    next_slice = Window.partitionBy(*keys).orderBy("__slice")
    values = F.struct(*[F.col(column).alias(name) for name, column in columns.items()])
    totals = sliced.groupBy(*keys, "__slice").agg(F.min_by(values, _place(order)).alias("__first"))
    joined = _carried(sliced.withColumn("__next", F.lead(values).over(inner)), keys, totals, {"__first": F.lead("__first").over(next_slice)})
    return joined.withColumn("__next", F.coalesce("__next", "__first")).select(*df.columns, *[F.col(f"__next.{name}").alias(name) for name in columns])


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, large: bool, slice_rows: int | None = None) -> DataFrame:
    """Adds the last ``value`` that is not null up to and including each row within ``keys``."""
    if not large:
        window = Window.partitionBy(*keys).orderBy(*forwards(order)).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, F.last(value, True).over(window))
    sliced = in_slices(df, keys, order, df.count(), slice_rows)
    inner = Window.partitionBy(*keys, "__slice").orderBy(*forwards(order)).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    known = F.when(F.col(value).isNotNull(), _place(order))
    totals = sliced.groupBy(*keys, "__slice").agg(F.max_by(value, known).alias("__last"))
    joined = _carried(sliced.withColumn(name, F.last(value, True).over(inner)), keys, totals, {"__before": F.last("__last", True).over(before)})
    return joined.withColumn(name, F.coalesce(name, "__before")).select(*df.columns, name)
