"""Operators within the cells of jagged columns. All are expressions, so they stay in the JVM and fuse with their stage."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nest(df: DataFrame, key: str, values: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """One row per key with an array for each of values, all in the order of order_by (a unique order within a key)."""
    every = list(dict.fromkeys([*order_by, *values]))
    g = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*every))).alias("__rows"))
    return g.select(key, *[F.col(f"__rows.{v}").alias(v) for v in values])


def lengths(c: str) -> Column:
    return F.size(c).cast("long")


def total(c: str) -> Column:
    """Sum within a cell; 0 if empty."""
    return F.aggregate(c, F.lit(0.0), lambda t, x: t + x)


def count_if(c: str, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(c, test)).cast("long")


def apply(c: str, f: Callable[[Column], Column]) -> Column:
    return F.transform(c, f)


def keep(c: str, test: Callable[[Column], Column]) -> Column:
    return F.filter(c, test)


def any_of(c: str, test: Callable[[Column], Column]) -> Column:
    return F.exists(c, test)


def all_of(c: str, test: Callable[[Column], Column]) -> Column:
    return F.forall(c, test)


def element(c: str | Column, i: int) -> Column:
    """Element i, from 1; outside of the cell is an error."""
    return F.element_at(c, i)


def element_or_null(c: str | Column, i: int) -> Column:
    return F.try_element_at(F.col(c) if isinstance(c, str) else c, F.lit(i))


def part(c: str, first: int, n: int) -> Column:
    return F.slice(c, first, n)


def flat(df: DataFrame, c: str, *keep_columns: str) -> DataFrame:
    """All elements of all cells, a row each, with their place in the cell (from 0)."""
    return df.select(*keep_columns, F.posexplode(c).alias("pos", "value"))


def flat_outer(df: DataFrame, c: str, *keep_columns: str) -> DataFrame:
    """As `flat`; an empty cell gives a row without a value."""
    return df.select(*keep_columns, F.posexplode_outer(c).alias("pos", "value"))


def zipped(**columns: str) -> Column:
    """Parallel arrays as one array of structs."""
    return F.arrays_zip(*[F.col(c).alias(n) for n, c in columns.items()])


def zip_map(a: str, b: str, f: Callable[[Column, Column], Column]) -> Column:
    return F.zip_with(a, b, f)


def member(c: str, name: str) -> Column:
    """One field of an array of structs, as an array."""
    return F.col(f"{c}.{name}")


def offsets(df: DataFrame, count: str, order_by: str, name: str = "offset", partition_by: Sequence[str] = ()) -> DataFrame:
    """df with the running sum of a count up to each row: the ends of its cells in a flat column. Pages are numbered apart."""
    w = Window.partitionBy(*partition_by).orderBy(order_by).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(count).over(w).cast("long"))


def counts(df: DataFrame, offset: str, order_by: str, name: str = "count", partition_by: Sequence[str] = ()) -> DataFrame:
    """df with the length of each cell, from the ends of the cells."""
    w = Window.partitionBy(*partition_by).orderBy(order_by)
    return df.withColumn(name, (F.col(offset) - F.lag(offset, 1, 0).over(w)).cast("long"))


def regroup(df: DataFrame, key: str, place: str, value: str, name: str) -> DataFrame:
    """Cells from a flat column: its values by key, in the order of place."""
    rows = F.sort_array(F.collect_list(F.struct(place, value)))
    return df.groupBy(key).agg(F.transform(rows, lambda r: r[value]).alias(name))


def fixed(c: str, n: int) -> Column:
    """An array cut into arrays of n; a rest that doesn't fill one is left out."""
    return F.expr(f"transform(filter(sequence(0, size(`{c}`) div {n}), i -> (i + 1) * {n} <= size(`{c}`)), i -> slice(`{c}`, int(i * {n} + 1), {n}))")
