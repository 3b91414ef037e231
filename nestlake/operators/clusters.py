"""Chunk boundaries of columns, the ranges of rows that all columns share, and the bytes in them.

These run on metadata: a row per chunk and column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Rows of the table whose boundaries one window holds, so that no task has those of a whole large table.
BLOCK = 1 << 24


def common_ranges(boundaries: DataFrame, column: str = "name", boundary: str = "boundary", block: int = BLOCK) -> DataFrame:
    """Ranges (first, last), rows counted from 1, between the boundaries (rows before them) that every column has.

    The end of the table is the last boundary of each column.
    """
    columns = boundaries.select(F.count_distinct(column)).scalar()
    both = boundaries.select(column, boundary).distinct().groupBy(boundary).agg(F.count("*").alias("n")).where(F.col("n") == columns)
    both = both.select(F.col(boundary).alias("__b"), F.expr(f"`{boundary}` div {block}").alias("__block"))
    following = Window.orderBy("__block").rowsBetween(1, Window.unboundedFollowing)  # a row per block
    after = both.groupBy("__block").agg(F.min("__b").alias("__b")).select("__block", F.min("__b").over(following).alias("__next"))
    w = Window.partitionBy("__block").orderBy("__b")
    last = F.coalesce(F.lead("__b").over(w), F.col("__next"))
    return both.join(F.broadcast(after), "__block").select((F.col("__b") + 1).alias("first"), last.alias("last")).where("last is not null")


def range_of(chunks: DataFrame, ranges: DataFrame, start: str = "start", block: int = BLOCK) -> DataFrame:
    """chunks with the first row of the range that each begins in. Both are merged by their starts, so nothing is paired; each block of
    rows begins with the last range before it."""
    marks = ranges.select(F.col("first").alias("__at"), F.col("first").alias("__first"), F.lit(0).alias("__kind"))
    rows = chunks.select(F.col(start).alias("__at"), F.lit(None).cast("long").alias("__first"), F.lit(1).alias("__kind"), F.struct("*").alias("__row"))
    every = marks.unionByName(rows, allowMissingColumns=True).withColumn("__block", F.expr(f"__at div {block}"))
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    carried = every.groupBy("__block").agg(F.max("__first").alias("__last")).select("__block", F.max("__last").over(before).alias("__carried"))
    w = Window.partitionBy("__block").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    found = every.withColumn("__seen", F.max("__first").over(w)).where("__kind = 1").join(F.broadcast(carried), "__block")
    return found.select("__row.*", F.coalesce("__seen", "__carried").alias("range_first"))


def range_bytes(chunks: DataFrame, ranges: DataFrame, start: str = "start", zipped: str = "zip_bytes", ratio: str = "ratio") -> DataFrame:
    """Per range, bytes of all columns as stored, and uncompressed by each column's ratio."""
    c = range_of(chunks, ranges, start)
    return c.groupBy("range_first").agg(F.sum(zipped).cast("long").alias("zip_bytes"), F.round(F.sum(F.col(zipped) * F.col(ratio)), 3).alias("raw_bytes"))


def row_chunks(df: DataFrame, size: int, entry: str = "entry") -> DataFrame:
    """First and last row of each chunk of `size` rows."""
    return df.groupBy(F.expr(f"(`{entry}` - 1) div {size}").alias("chunk")).agg(F.min(entry).alias("first"), F.max(entry).alias("last"))
