"""Histograms over a stream of events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.hist import PLACES, Axis


def fill_windows(events: DataFrame, time: str, axes: Sequence[Axis], window: str, late: str) -> DataFrame:
    """Filled bins of each time window: window, places, entries. State is a row per bin and open window; rows that come
    later than `late` behind the newest are left out, as the window may be closed by then."""
    names = PLACES[: len(axes)]
    placed = events.withColumns({n: a.place() for n, a in zip(names, axes, strict=True)}).where(" and ".join(f"{n} is not null" for n in names))
    return placed.withWatermark(time, late).groupBy(F.window(time, window).alias("window"), *names).agg(F.count("*").alias("entries"))
