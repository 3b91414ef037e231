"""Tables one after another, and lookups by key and by place."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from .entries import ENTRY, ROWS_PER_RANGE, with_entry

SOURCE = "src"


def chain(tables: Sequence[DataFrame], strict: bool = False, source: str = SOURCE) -> DataFrame:
    """Rows of all tables with the number (from 0) of their table. Columns are those of the first: what others have
    besides is left out (an error if strict), and what they lack is an error."""
    names = tables[0].columns
    for t in tables[1:]:
        if strict and set(t.columns) != set(names):
            raise ValueError(f"other columns: {sorted(set(t.columns) ^ set(names))}")
        if missing := [c for c in names if c not in t.columns]:
            raise KeyError(missing)
    return reduce(DataFrame.unionByName, [t.select(*names).withColumn(source, F.lit(i)) for i, t in enumerate(tables)])


def chain_entries(tables: Sequence[DataFrame], entry: str = ENTRY, source: str = SOURCE) -> DataFrame:
    """A chain of tables that have entry numbers, numbered on from table to table. Only a count per table is needed, not a sort."""
    chained = chain(tables, source=source)
    counts = chained.groupBy(source).agg(F.max(entry).alias("__n"))
    before = Window.orderBy(source).rowsBetween(Window.unboundedPreceding, -1)  # a row per table
    starts = counts.select(source, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return chained.join(F.broadcast(starts), source).withColumn(entry, F.col(entry) + F.col("__before")).drop("__before")


def build_index(df: DataFrame, major: str, minor: str, entry: str = ENTRY, per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """The sorted keys and where their rows are: place (from 0), major, minor, row0 (entry number from 0)."""
    keys = df.select(major, minor, (F.col(entry) - 1).alias("row0"))
    return with_entry(keys, major, minor, "row0", name="place", per_range=per_range).withColumn("place", F.col("place") - 1)


def look_up(df: DataFrame, index: DataFrame, keys: DataFrame, major: str, minor: str, entry: str = ENTRY) -> DataFrame:
    """The rows of df that keys (major, minor) name."""
    found = index.join(keys, [major, minor]).select((F.col("row0") + 1).alias(entry)).distinct()
    return df.join(found, entry)


def friend_join(a: DataFrame, b: DataFrame, entry: str = ENTRY, prefix: str = "friend_") -> DataFrame:
    """Columns of two tables side by side, row by row of equal entry; names that clash get the prefix."""
    new = [c if c == entry or c not in a.columns else f"{prefix}{c}" for c in b.columns]
    return a.join(b.toDF(*new), entry)


def only(df: DataFrame, name: str, value) -> Row:
    """The one row that has this value; an error if there are none or several."""
    rows = df.where(F.col(name) == value).limit(2).collect()
    if len(rows) != 1:
        raise LookupError(f"{'no' if not rows else 'several'} rows with {name} = {value!r}")
    return rows[0]
