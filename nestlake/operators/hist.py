"""Weighted histograms of one, two and three dimensions as DataFrames of bins.

A bin's place on an axis is 0 below the range, 1 to n within, n + 1 from the upper end on; NaN and null fall into none. Filling is one
aggregation with partial sums, so what is shuffled is a row per bin and task, however many rows are filled.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACES = ("ix", "iy", "iz")


@dataclass(frozen=True)
class Axis:
    """n equal bins from low to high, or bins between edges."""

    column: str
    n: int = 0
    low: float = 0.0
    high: float = 1.0
    edges: tuple[float, ...] = ()
    labels: tuple[str, ...] = ()

    @property
    def bins(self) -> int:
        return len(self.edges) - 1 if self.edges else self.n

    def edge_list(self) -> list[float]:
        return list(self.edges) if self.edges else [self.low + (self.high - self.low) * i / self.n for i in range(self.n + 1)]

    def place(self) -> Column:
        x = F.col(self.column).cast("double")
        x = F.when(~F.isnan(x), x)
        if self.edges:
            cuts = F.array(*[F.lit(float(e)) for e in self.edges])
            return F.when(x.isNotNull(), F.size(F.filter(cuts, lambda e: e <= x)))
        return F.width_bucket(x, F.lit(float(self.low)), F.lit(float(self.high)), F.lit(self.n)).cast("int")


def fill(df: DataFrame, axes: Sequence[Axis], weight: str | Column | None = None) -> DataFrame:
    """Bins that are filled, flow included: places, entries, content (sum of weights), sumw2 (sum of their squares)."""
    w = F.lit(1.0) if weight is None else (F.col(weight) if isinstance(weight, str) else weight).cast("double")
    names = PLACES[: len(axes)]
    d = df.select(*[a.place().alias(n) for a, n in zip(axes, names, strict=True)], w.alias("__w")).where(" and ".join(f"{n} is not null" for n in names))
    return d.groupBy(*names).agg(F.count("*").alias("entries"), F.sum("__w").alias("content"), F.sum(F.col("__w") * F.col("__w")).alias("sumw2"))


def inner(bins: DataFrame, axes: Sequence[Axis]) -> DataFrame:
    """Without under- and overflow."""
    return reduce(lambda d, x: d.where(F.col(x[0]).between(1, x[1].bins)), zip(PLACES, axes, strict=False), bins)


def with_edges(bins: DataFrame, axes: Sequence[Axis]) -> DataFrame:
    """With the lower and upper end of each bin; open ends are null."""
    for n, a in zip(PLACES, axes, strict=False):
        cuts = F.array(*[F.lit(float(e)) for e in a.edge_list()])
        bins = bins.withColumns({f"{n[1]}_low": F.get(cuts, F.col(n) - 1), f"{n[1]}_high": F.get(cuts, F.col(n))})
    return bins


def unweighted(bins: DataFrame) -> DataFrame:
    """Where no squares of weights are kept, they are the counts."""
    return bins.withColumn("sumw2", F.coalesce("sumw2", "content"))


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("entries", "content", "sumw2")]


def project(bins: DataFrame, *onto: str) -> DataFrame:
    """Sums over all places but `onto`."""
    return bins.groupBy(*onto).agg(*_sums())


def rebin(bins: DataFrame, by: int, axis: Axis, place: str = "ix") -> DataFrame:
    """`by` neighbouring bins become one; flow stays flow. Bins that don't fill a last group join the overflow."""
    n = axis.bins // by
    new = F.when(F.col(place) < 1, 0).when(F.col(place) > n * by, n + 1).otherwise(F.expr(f"({place} - 1) div {by} + 1"))
    others = [p for p in PLACES if p in bins.columns and p != place]
    return bins.withColumn(place, new.cast("int")).groupBy(place, *others).agg(*_sums())


def merge(*histograms: DataFrame) -> DataFrame:
    """The sum of histograms over the same axes."""
    every = reduce(DataFrame.unionByName, histograms)
    return every.groupBy(*[p for p in PLACES if p in every.columns]).agg(*_sums())


def integral(bins: DataFrame, axes: Sequence[Axis]) -> DataFrame:
    return inner(bins, axes).agg(F.coalesce(F.sum("content"), F.lit(0.0)).alias("integral"), F.coalesce(F.sum("entries"), F.lit(0)).alias("entries"))


def moments(df: DataFrame, axes: Sequence[Axis], weight: str | Column | None = None) -> DataFrame:
    """The running sums that histograms carry, over what falls within all axes: tsumw, tsumw2, and of each axis tsumwx, tsumwx2 ..."""
    w = F.lit(1.0) if weight is None else (F.col(weight) if isinstance(weight, str) else weight).cast("double")
    d = df
    for a in axes:
        d = d.where(a.place().between(1, a.bins))
    letters = "xyz"[: len(axes)]
    x = {n: F.col(a.column).cast("double") for n, a in zip(letters, axes, strict=True)}
    sums = [F.sum(w).alias("tsumw"), F.sum(w * w).alias("tsumw2")]
    for n in letters:
        sums += [F.sum(w * x[n]).alias(f"tsumw{n}"), F.sum(w * x[n] * x[n]).alias(f"tsumw{n}2")]
    sums += [F.sum(w * x[a] * x[b]).alias(f"tsumw{a}{b}") for i, a in enumerate(letters) for b in letters[i + 1 :]]
    return d.agg(*sums)


def dense(bins: DataFrame, axes: Sequence[Axis], flow: bool = False) -> tuple[list[float], list[float]]:
    """(contents, sumw2) as flat lists, the first axis running fastest. A histogram has as many bins as its axes say."""
    extra = 2 if flow else 0
    sizes = [a.bins + extra for a in axes]
    total = reduce(lambda a, b: a * b, sizes, 1)
    content, squares = [0.0] * total, [0.0] * total
    for r in (bins if flow else inner(bins, axes)).collect():
        at, step = 0, 1
        for n, size in zip(PLACES, sizes, strict=False):
            at += (r[n] - (0 if flow else 1)) * step
            step *= size
        content[at], squares[at] = r["content"], r["sumw2"]
    return content, squares


@dataclass(frozen=True)
class Hist:
    """A histogram: its bins with their axes, flow included, and what it says of itself. Each operation gives another."""

    bins: DataFrame
    axes: tuple[Axis, ...]
    name: str = ""
    title: str = ""
    entries: float | None = None
    sums: dict[str, float] | None = None

    @classmethod
    def filled(cls, df: DataFrame, axes: Sequence[Axis], weight: str | Column | None = None, name: str = "") -> Hist:
        return cls(fill(df, axes, weight), tuple(axes), name)

    def inner(self) -> DataFrame:
        """Bins within the axes, with their edges and the labels of those that have one."""
        out = with_edges(inner(self.bins, self.axes), self.axes)
        for n, a in zip(PLACES, self.axes, strict=False):
            if a.labels:
                out = out.withColumn(f"{n[1]}_label", F.get(F.array(*[F.lit(x) for x in a.labels]), F.col(n) - 1))
        return out

    def project(self, *onto: str) -> Hist:
        kept = tuple(a for n, a in zip(PLACES, self.axes, strict=False) if n in onto)
        new = {n: PLACES[i] for i, n in enumerate(n for n in PLACES if n in onto)}
        return Hist(project(self.bins, *new).withColumnsRenamed(new), kept, self.name)

    def rebin(self, by: int, place: str = "ix") -> Hist:
        at = PLACES.index(place)
        old = self.axes[at]
        cuts = old.edge_list()[: old.bins // by * by + 1 : by]
        new = Axis(old.column, edges=tuple(cuts)) if old.edges else Axis(old.column, old.bins // by, cuts[0], cuts[-1])
        return Hist(rebin(self.bins, by, old, place), (*self.axes[:at], new, *self.axes[at + 1 :]), self.name)

    def __add__(self, other: Hist) -> Hist:
        if [a.edge_list() for a in self.axes] != [a.edge_list() for a in other.axes]:
            raise ValueError("other axes")
        return Hist(merge(self.bins, other.bins), self.axes, self.name)

    def integral(self) -> float:
        return integral(self.bins, self.axes).first()["integral"]

    def dense(self, flow: bool = False) -> tuple[list[float], list[float]]:
        return dense(self.bins, self.axes, flow)
