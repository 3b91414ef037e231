"""Row identity and access by position. Entry numbers start at 1, as rows are counted in event tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import checkpoint_folder

ENTRY = "entry"
#: Rows that one window sorts; larger tables are sorted in ranges of all keys, side by side.
ROWS_PER_RANGE = 2_000_000
_WITHIN = (1 << 33) - 1  # of a row's number that Spark makes from its partition and its place in it


def with_entry(df: DataFrame, *order_by: str, name: str = ENTRY, per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """df with the place of each row (from 1) in the order of unique keys, nulls first.

    A table of more than per_range rows isn't sorted by one task: it is dealt into ranges of all keys, which are sorted and written to the
    checkpoint folder, so that they stay as they are; a row's place is the number of rows in the ranges before plus its place in its own.
    """
    order = [F.col(c).asc_nulls_first() for c in order_by]
    rows = df.count()
    if rows <= per_range:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_folder(spark))
    ranged = df.repartitionByRange(-(-rows // per_range), *order).sortWithinPartitions(*order).checkpoint()
    own = F.monotonically_increasing_id()
    ranged = ranged.withColumns({"__range": F.shiftright(own, 33), "__nth": own.bitwiseAND(F.lit(_WITHIN)) + 1})
    counts = ranged.groupBy("__range").agg(F.max("__nth").alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    starts = counts.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return ranged.join(F.broadcast(starts), "__range").withColumn(name, (F.col("__nth") + F.col("__before")).cast("long")).drop("__range", "__before", "__nth")


def in_parts(df: DataFrame, rows: int, *order_by: str, per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """df in the order of unique keys, nulls first, in partitions of exactly `rows` rows, of which the last may have fewer."""
    n = max(1, -(-df.count() // rows))
    e = with_entry(df, *order_by, name="__in_order", per_range=per_range)
    part = F.floor((F.col("__in_order") - 1) / rows).cast("int")
    return e.repartitionById(n, part).sortWithinPartitions("__in_order").select(*df.columns)


def length(df: DataFrame) -> int:
    return df.count()


def row_at(df: DataFrame, i: int, entry: str = ENTRY) -> DataFrame:
    """Row i. A place outside of the table is an error, as it is for an index into a list."""
    if i < 1 or df.where(F.col(entry) == i).isEmpty():
        raise IndexError(i)
    return df.where(F.col(entry) == i)


def slice_rows(df: DataFrame, first: int, last: int, entry: str = ENTRY) -> DataFrame:
    """Rows first to last, both included; none if last is smaller."""
    return df.where(F.col(entry).between(first, last))


def gather(df: DataFrame, places: Sequence[int], entry: str = ENTRY, at: str = "pos") -> DataFrame:
    """Rows at the given places, with `at` counting from 0; repeats are kept and an order other than the table's is, too."""
    picks = df.sparkSession.createDataFrame([(k, int(i)) for k, i in enumerate(places)], f"`{at}` long, `{entry}` long")
    return df.join(F.broadcast(picks), entry)


class View:
    """A lazy choice of rows; views of views compose."""

    def __init__(self, df: DataFrame, places: range | Sequence[int], entry: str = ENTRY):
        self.df, self.places, self.entry = df, places, entry

    def __len__(self) -> int:
        return len(self.places)

    def view(self, places: range | Sequence[int]) -> View:
        """places count from 1 within this view."""
        return View(self.df, [self.places[i - 1] for i in places], self.entry)

    def rows(self) -> DataFrame:
        p = self.places
        if isinstance(p, range) and p.step == 1:
            return slice_rows(self.df, p.start, p.stop - 1, self.entry)
        return gather(self.df, p, self.entry)


def cell(df: DataFrame, i: int, column: str | int, entry: str = ENTRY) -> DataFrame:
    return row_at(df, i, entry).select(column_name(df, column))


def cells(df: DataFrame, first: int, last: int, column: str | int, entry: str = ENTRY) -> DataFrame:
    return slice_rows(df, first, last, entry).select(entry, column_name(df, column))


def column_name(df: DataFrame, column: str | int) -> str:
    """A column's name, or that of the column at a place counted from 1."""
    return df.columns[column - 1] if isinstance(column, int) else column


def first_rows(df: DataFrame, n: int, entry: str = ENTRY) -> DataFrame:
    return df.where(F.col(entry) <= n)


def last_rows(df: DataFrame, n: int, entry: str = ENTRY) -> DataFrame:
    return df.orderBy(F.col(entry).desc()).limit(n)


def mask_index(df: DataFrame, mask: Column, entry: str = ENTRY) -> DataFrame:
    """Places of the rows for which mask holds."""
    return df.where(mask).select(entry)


def chunk_of(size: int, entry: str = ENTRY) -> Column:
    """The number, from 0, of the chunk of `size` rows that a row falls into."""
    return F.expr(f"(`{entry}` - 1) div {size}")


def first_seen(df: DataFrame, column: str, entry: str = ENTRY) -> DataFrame:
    """Distinct values with the place at which each comes first."""
    return df.groupBy(column).agg(F.min(entry).alias("first_entry"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows as often."""
    return a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def row_hash(*columns: str) -> Column:
    """A number that equal rows share."""
    return F.xxhash64(*columns)
