"""Mixing sources to target weights by Pfair scheduling.

A source of weight w (of a sum of 1) has had w * t blocks' worth after t slots. Its j-th block is released at floor((j - 1) / w) and due
at ceil(j / w); taking the earliest deadline among the released blocks meets all deadlines, so no source is ever a block or
more away from its weight. All times are whole numbers, worked out from exact weights.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Mapping, Sequence
from fractions import Fraction
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialize, others, quoted

#: Documents of a block at least, and blocks of a schedule at most, about: with more documents, blocks get larger.
BLOCK, MOST_BLOCKS = 8, 1 << 20
#: Sources whose names the driver sees. Names of more stay on the executors; each has a weight and slots of its own all the same.
OWN_SOURCES = 1 << 16
#: Documents of a source that one task puts in order, about.
PER_BUCKET, LEAST_BUCKETS = 10_000, 256
ADDED = ["block_no", "slot", "place", "mixed"]


def _exact(w: float | Fraction) -> int | Fraction:
    return w if isinstance(w, (int, Fraction)) else Fraction(str(float(w)))


def _tempered(n: int, temperature: float) -> Fraction:
    """The weight of a source of n documents if none is given."""
    return Fraction(max(1, round(n**temperature * 1000)), 1000)


def whole_weights(weights: Mapping[str, float | Fraction]) -> dict[str, int]:
    """The weights times their common denominator; a float counts as the decimal number that it prints as."""
    exact = {k: _exact(w) for k, w in weights.items()}
    if any(w <= 0 for w in exact.values()):
        raise ValueError("weights must be above 0")
    times = lcm(*(Fraction(w).denominator for w in exact.values()))
    return {k: int(w * times) for k, w in exact.items()}


def _slots(left: Sequence[int], weights: Sequence[int]) -> tuple[np.ndarray, int]:
    """`schedule` for sources given by rank: greater weights first, of equal ones the smaller name. All have blocks left.

    Of equal deadlines the smaller rank goes first. First blocks of a phase are due in the order of ranks, so a pointer
    walks over them, and a phase costs what its slots do, however many sources wait.
    """
    n, left, out = len(left), array("q", left), array("i")
    after, before = array("q", [*range(1, n + 1), 0]), array("q", [n, *range(n)])  # those with blocks left; n stands before the first
    total, alive = sum(weights), n
    while alive > 1:
        first, waiting, ready, t = after[n], [], [], 0
        while True:
            while waiting and waiting[0][0] <= t:
                _, k, j = heapq.heappop(waiting)
                heapq.heappush(ready, (-(-j * total // weights[k]), k, j))
            if first < n and (not ready or (-(-total // weights[first]), first) < ready[0][:2]):
                due, k, j = -(-total // weights[first]), first, 1
                first = after[first]
            else:
                due, k, j = heapq.heappop(ready)
            assert t < due, "a deadline was missed"
            out.append(k)
            t += 1
            left[k] -= 1
            if not left[k]:
                break
            heapq.heappush(waiting, (j * total // weights[k], k, j + 1))
        total, alive = total - weights[k], alive - 1
        after[before[k]], before[after[k]] = after[k], before[k]
    rest = np.full(left[after[n]], after[n], np.int32) if n else np.zeros(0, np.int32)
    return np.concatenate([np.array(out, np.int32), rest]), len(rest) if n == 1 else len(out)


def schedule(blocks: Mapping[str, int], weights: Mapping[str, float | Fraction]) -> tuple[list[str], int]:
    """The source of each slot until all blocks are used, and the number of slots before one source is left alone with nothing to mix with.

    When a source has no block left, a new phase begins in which the others share its weight in proportion. Of equal deadlines
    the greater weight goes first, then the smaller name.
    """
    own = whole_weights(weights)
    names = sorted((k for k, n in blocks.items() if n), key=lambda k: (-own[k], k))
    order, mixed = _slots([blocks[k] for k in names], [own[k] for k in names])
    return [names[k] for k in order.tolist()], mixed


def _sources(d: DataFrame, weights: Mapping | None, temperature: float, own_sources: int) -> tuple[DataFrame | list[str], np.ndarray, np.ndarray, list[int]]:
    """The sources with a weight; then, greater weights first and of equal ones the smaller name: at, documents and whole weight of each.

    Up to `own_sources` sources are names on the driver, and `at` their place in the list. More stay a DataFrame of (at, src), sorted by range
    in the same order, and the driver sees two numbers and a rank of weight for each.
    """
    spark = d.sparkSession
    counts = d.groupBy("src").agg(F.count("*").alias("n"))
    if weights is not None:
        exact = {k: _exact(w) for k, w in weights.items()}
        ranked = sorted(set(exact.values()), reverse=True)
        rank = {w: i for i, w in enumerate(ranked)}
        counts = counts.join(_frame(spark, "src string, level long", list(exact), [rank[w] for w in exact.values()]), "src")
    found = counts.limit(own_sources + 1).collect()
    if len(found) <= own_sources:
        n = {r["src"]: r["n"] for r in found}
        own = whole_weights({k: weights[k] for k in n} if weights is not None else {k: _tempered(v, temperature) for k, v in n.items()})
        names = sorted(n, key=lambda k: (-own[k], k))
        return names, np.arange(len(names)), np.array([n[k] for k in names], np.int64), [own[k] for k in names]
    counts = materialize(counts, "sources")
    if weights is None:  # different counts are few: their sum is at most that of all documents
        exact = {r["n"]: _tempered(r["n"], temperature) for r in counts.select("n").distinct().collect()}
        ranked = sorted(set(exact.values()), reverse=True)
        rank = {w: i for i, w in enumerate(ranked)}
        counts = counts.join(F.broadcast(_frame(spark, "n long, level long", list(exact), [rank[w] for w in exact.values()])), "n")
    counts = counts.repartitionByRange("level", "src").sortWithinPartitions("level", "src")
    counts = materialize(counts.select(F.monotonically_increasing_id().alias("at"), "src", "n", "level"), "source_order")
    t = counts.select("at", "n", "level").toArrow()
    at, n, level = (t.column(c).to_numpy() for c in ("at", "n", "level"))
    by = np.argsort(at)
    whole = whole_weights({i: ranked[i] for i in np.unique(level).tolist()})
    return counts.select("at", "src"), at[by], n[by], [whole[i] for i in level[by].tolist()]


def _frame(spark: SparkSession, schema: str, *columns) -> DataFrame:
    if not len(columns[0]):
        return spark.createDataFrame([], schema)
    return spark.createDataFrame(pa.table(list(columns), [c.split()[0] for c in schema.split(", ")]), schema)


def _ranked(d: DataFrame, plan: DataFrame, most: int, block: int) -> DataFrame:
    """(row, nth, block_no, slot): nth is the place within src from 0, in an order by hash of id; most: documents of the largest src.

    Each source is dealt over buckets of the hash, so no task has all of a hot one; a bucket's rows come after those of the buckets before it.
    plan has the slots of a src's blocks. Of them each bucket gets those of its own rows.
    """
    buckets = max(LEAST_BUCKETS, -(-most // PER_BUCKET))
    d = d.withColumn("hash", F.xxhash64("id")).withColumn("bucket", F.pmod(F.shiftright("hash", 20), F.lit(buckets)).cast("int"))
    sizes = d.groupBy("src", "bucket").agg(F.count("*").alias("n"))
    w = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("src", "bucket", "n", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("start"))
    first, last = F.expr(f"start div {block}").cast("int"), F.expr(f"(start + n - 1) div {block}").cast("int")
    starts = starts.join(plan, "src", "left").select("src", "bucket", "start", F.slice("slots", first + 1, last - first + 1).alias("slots"))
    inner = Window.partitionBy("src", "bucket").orderBy("hash", F.col("id").asc_nulls_first())
    d = d.withColumn("nth", F.row_number().over(inner) - 1).join(starts, ["src", "bucket"])
    d = d.withColumn("nth", F.col("nth") + F.col("start")).withColumn("block_no", F.expr(f"nth div {block}").cast("long"))
    return d.select("row", "nth", "block_no", F.get("slots", (F.col("block_no") - F.expr(f"start div {block}")).cast("int")).alias("slot"))


def scheduled(docs: DataFrame, weights: Mapping[str, float | Fraction] | None = None, source: str = "source", key: str = "doc_id", block: int = BLOCK, temperature: float = 0.7, most_blocks: int = MOST_BLOCKS, own_sources: int = OWN_SOURCES) -> tuple[DataFrame, int]:
    """`pfair_mix` with the row of docs kept as one struct `row`, so that no name clashes; and a bound of places."""
    spark = docs.sparkSession
    d = docs.select(F.struct(*quoted(docs.columns)).alias("row"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("src"), F.col(key).alias("id"))
    sources, at, n, own = _sources(d, weights, temperature, own_sources)
    block = max(block, -(-int(n.sum()) // most_blocks))
    which, mixed = _slots((-(-n // block)).tolist(), own)
    by = np.argsort(which, kind="stable")
    begins = np.searchsorted(which[by], np.arange(len(at) + 1))
    # a row per source with the slots of its blocks: eight bytes a block, MOST_BLOCKS and one per source at most
    slots = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(by.astype(np.int64)))
    if isinstance(sources, list):
        plan = _frame(spark, "src string, slots array<long>", sources, slots)
    else:
        plan = sources.join(_frame(spark, "at long, slots array<long>", at, slots), "at").select("src", "slots")
    b = _ranked(d, plan, int(n.max(initial=0)), block)
    return b.select("row", "block_no", "slot", (F.col("slot") * block + F.pmod(F.col("nth"), F.lit(block))).alias("place"), F.coalesce(F.col("slot") < mixed, F.lit(False)).alias("mixed")), len(which) * block


def pfair_mix(docs: DataFrame, weights: Mapping[str, float | Fraction] | None = None, **options) -> DataFrame:
    """docs with block_no (within the source), slot (of the block), place (of the document in the mixture) and mixed.

    A block is `block` documents of one source, in an order by hash of key, or more where that would make over `most_blocks` blocks. Blocks are
    interleaved by Pfair scheduling to exact `weights` (None: the number of the source's documents to the power of `temperature`, to three decimals). At
    every slot each source is less than one block from its weight, counted from the phase's beginning: when a source has run out,
    the others share its weight in a new phase. mixed turns false once one source is alone, as nothing is left to mix it with.
    A source without a weight gets no slot: slot and place are null and mixed false. Repeated rows are documents of their
    own; those of one source and key come one after another, in no set order; null keys are allowed. A null source counts as ''. An empty table gives none. The four columns replace any of the same name in docs.
    Every source has a weight and slots of its own, however many there are. The driver sees a slot for each block and a count and a rank of weight for each
    source; names of over `own_sources` sources stay on the executors.
    """
    s, _ = scheduled(docs, weights, **options)
    return s.select(*[F.col("row")[n].alias(n) for n in others(docs.columns, ADDED)], *ADDED)


def in_order(docs: DataFrame, weights: Mapping[str, float | Fraction] | None = None, per_part: int = 20_000, **options) -> DataFrame:
    """Every row of docs, and its columns alone, in the order of the mixture: by part, and by row within it. Rows without a place come last."""
    s, places = scheduled(docs, weights, **options)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-places // per_part)) + 1
    part = F.coalesce(F.expr(f"place div {max(1, -(-places // (parts - 1)))}"), F.lit(parts - 1)).cast("int")
    s = s.select("row", "place").repartitionById(parts, part).sortWithinPartitions(F.col("place").asc_nulls_last())
    return s.select(*[F.col("row")[n].alias(n) for n in docs.columns])
