"""Exact nearest neighbours by a block matrix join with int8 product tiles.

Every vector is rounded to int8 steps of its own, and the length of what that leaves out is kept. A tile of products of
rounded vectors gives the distance of each pair up to the two lengths. Pairs whose least possible distance is over what the
query's k-th best can be are dropped; the rest are computed again from the original vectors in double precision.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, quoted, trimmed

#: Bytes of query vectors that one pass broadcasts; further queries take further passes over the candidates.
PASS_BYTES = 8 << 20
#: Candidates and queries of one tile; survivors that are computed at once.
TILE, QUERIES, EXACT = 2048, 1024, 65_536


def valid(ids: pa.Array, vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By number of components: ids and vectors as float64, without rows that are null, zero or hold null or non-finite parts."""
    n = pc.list_value_length(vectors).fill_null(0).to_numpy(zero_copy_only=False)
    out = {}
    for dim in np.unique(n[n > 0]).tolist():
        keep = pa.array(n == dim)
        own, v = ids.filter(keep), vectors.filter(keep)
        flat = v.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, dim)
        good = np.isfinite(flat).all(1) & flat.any(1) & ~own.is_null().to_numpy(zero_copy_only=False)
        out[dim] = own.filter(pa.array(good)).to_numpy(zero_copy_only=False).astype(np.int64), np.ascontiguousarray(flat[good])
    return out


def rounded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 steps, the size of a step, the squared length of the rounded vector and the length of the rest, by row."""
    step = np.abs(x).max(1) / 127
    step = np.where(step > 0, step, 1.0)
    q = np.rint(x / step[:, None]).astype(np.int8)
    near = q * step[:, None]
    return q, step, (near * near).sum(1), np.sqrt(((x - near) ** 2).sum(1))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, summed from the first component to the last. Where squares leave the range of doubles, they're scaled."""
    total = np.zeros(len(a))
    with np.errstate(over="ignore"):
        for j in range(a.shape[1]):
            d = a[:, j] - b[:, j]
            total += d * d
    odd = np.flatnonzero(~np.isfinite(total))
    out = np.sqrt(total)
    if len(odd):
        d = np.abs(a[odd] / 4 - b[odd] / 4)
        most = d.max(1)
        with np.errstate(over="ignore"):
            out[odd] = most * np.sqrt(((d / most[:, None]) ** 2).sum(1)) * 4
    return out


class Nearest:
    """The k nearest candidates so far of each query, by (distance, id): a heap for each, with the worst on top."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        self.q, self.step, self.sq, self.rest = rounded(x)
        self.q = self.q.astype(np.float32)  # products of int8 steps are whole numbers that float32 holds exactly for 1000 parts
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in ids]
        self.limit = np.full(len(ids), np.inf)

    def see(self, ids: np.ndarray, x: np.ndarray) -> None:
        for at in range(0, len(ids), TILE):
            for q in range(0, len(self.ids), QUERIES):
                self._tile(slice(q, q + QUERIES), ids[at : at + TILE], x[at : at + TILE])

    def _tile(self, own: slice, ids: np.ndarray, x: np.ndarray) -> None:
        q, step, sq, rest = rounded(x)
        products = self.q[own] @ q.astype(np.float32).T if x.shape[1] <= 1000 else self.q[own].astype(np.float64) @ q.astype(np.float64).T
        with np.errstate(over="ignore", invalid="ignore"):  # a bound that isn't a number keeps its pair
            near = np.sqrt(np.maximum(self.sq[own][:, None] + sq - 2.0 * (self.step[own][:, None] * step) * products, 0.0))
            slack = (self.rest[own][:, None] + rest) * (1 + 1e-9) + 1e-6 * (np.sqrt(self.sq[own])[:, None] + np.sqrt(sq))  # the second part is for the arithmetic itself
            other = self.ids[own][:, None] != ids
            limit = self.limit[own]
            if len(ids) > self.k:
                most = np.where(other, near + slack, np.inf)
                limit = np.fmin(limit, np.partition(np.where(np.isnan(most), np.inf, most), self.k - 1, axis=1)[:, self.k - 1])
            qi, ci = np.nonzero(~(near - slack > limit[:, None]) & other)
        for at in range(0, len(qi), EXACT):
            a, b = qi[at : at + EXACT] + own.start, ci[at : at + EXACT]
            self._merge(a, ids[b], distances(self.x[a], x[b]))

    def _merge(self, q: np.ndarray, ids: np.ndarray, d: np.ndarray) -> None:
        """Merge new pairs with the heaps of their queries."""
        sure = d <= self.limit[q]
        for i, j, x in zip(q[sure].tolist(), ids[sure].tolist(), d[sure].tolist(), strict=True):
            heap = self.heaps[i]
            if len(heap) < self.k:
                heapq.heappush(heap, (-x, -j))
            elif (-x, -j) > heap[0]:
                heapq.heapreplace(heap, (-x, -j))
            if len(heap) == self.k:
                self.limit[i] = -heap[0][0]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, candidate and distance of what is held."""
        rows = [(i, -j, -x) for i, heap in zip(self.ids.tolist(), self.heaps, strict=True) for x, j in heap]
        q, c, d = zip(*rows, strict=True) if rows else ((), (), ())
        return np.array(q, np.int64), np.array(c, np.int64), np.array(d, np.float64)


def nearest(queries: DataFrame, candidates: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The k nearest candidates of every query, exactly: query_id, rank (from 1), vec_id, score (Euclidean distance).

    A candidate with the query's own key is left out; ties go to the smaller key. Vectors that are null, zero or
    hold null or non-finite parts, and rows of null key, take no part; vectors only meet those of as many components.
    Fewer candidates than k are all returned; repeated rows are candidates of their own. A key among the queries counts once,
    with its least vector. Each pass broadcasts about `pass_bytes` of queries and reads the candidates once; a task
    sends on no more than k pairs for each query. With several passes each one's pairs are written to the shared folder and its queries
    dropped before the next, so the driver holds one pass. Other columns aren't read.
    """
    spark = queries.sparkSession
    own, v = quoted([key, vector])
    q = queries.select(own.cast("long").alias("vec_id"), v.alias("embedding")).where("vec_id is not null and embedding is not null")
    q = q.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    size = q.agg(F.sum(F.size("embedding")).alias("n")).first()["n"] or 0
    passes = max(1, -(-size * 8 // pass_bytes))
    c = candidates.select(own.cast("long").alias("vec_id"), v.alias("embedding"))
    parts = None
    for i in range(passes):
        block = (q if passes == 1 else q.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == i)).toArrow().combine_chunks()
        held = {} if not len(block) else valid(block.column(0).combine_chunks(), block.column(1).combine_chunks())
        shared = spark.sparkContext.broadcast(held)

        def search(batches, shared=shared):
            lists = {dim: Nearest(ids, x, k) for dim, (ids, x) in shared.value.items() if len(ids)}
            for b in batches:
                for dim, (ids, x) in valid(b.column(0), b.column(1)).items():
                    if dim in lists and len(ids):
                        lists[dim].see(ids, x)
            for near in lists.values():
                yield pa.record_batch([pa.array(x) for x in near.found()], ["query_id", "vec_id", "score"])

        part = c.mapInArrow(trimmed(search), "query_id long, vec_id long, score double")
        if passes > 1:
            part = materialize(part, "nearest")
            shared.destroy()
        parts = part if parts is None else parts.unionByName(part)
    by = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = parts.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
