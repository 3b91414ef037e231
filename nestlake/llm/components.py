"""Connected components of a graph that no single machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) for every id in edges (a long, b long), component being the smallest id that it reaches.

    Large-star and small-star steps by turns: each hangs neighbours on the least id of a neighbourhood, until all
    hang on the least of their component. Both find minima by aggregation, so a node with very many links gathers no list; minima are
    written before they are joined, as adaptive execution splits a skewed join only of two plain shuffles. Every round is written to the shared folder. Loops, repeated edges and either direction are allowed; nulls are left out.
    """
    e = edges.where("a <> b").select(F.least("a", "b").cast("long").alias("b"), F.greatest("a", "b").cast("long").alias("a")).distinct().select("a", "b")
    e = materialize(e, "edges")
    state = _state(e)
    for _ in range(most_rounds):
        if not state[0]:
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        large = both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "edges")  # every edge now goes from a larger to a smaller id
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(low, "a")
        new = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        e = materialize(new, "edges")
        after = _state(e)
        if after == state:
            break
        state = after
    else:
        raise RuntimeError(f"no end after {most_rounds} rounds")
    stars = e.groupBy("a").agg(F.min("b").alias("component"))
    return stars.select(F.col("a").alias("id"), "component").unionByName(stars.select(F.col("component").alias("id"), "component").distinct())
