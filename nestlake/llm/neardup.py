"""Near-duplicate documents by a multi-index Hamming join of MinHash signatures.

A document's signature has SYMBOLS symbols of 16 bits, each from the least hash of its shingles under one permutation. Two
sets of similarity s differ in a symbol with a chance of 1 - s. The signature is cut into chunks of four symbols: two signatures
that differ in up to MOST_ERRORS symbols have, by the pigeonhole principle, a chunk with at most one error, so they share one of
the chunk's four keys in which one symbol is left out. At a similarity of 0.8 a pair of documents differs in more symbols about
once in a million.

Pairs that share a key must then pass two tests that need no text: the signatures' distance, and a bound that never errs,
as bits of parity sketches that differ each stand for at least one shingle that only one side has. What passes is confirmed on the
full sets. Within a key every document is first held against the least only; keys whose documents turn out to hang together
are done, and in the others all pairs of documents that don't hang together yet are tried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import materialize, mix, pieces, prefix_hash, quoted, span_hash, trimmed, without_keys

SYMBOLS, CHUNKS, MOST_ERRORS = 64, 16, 31
SKETCH_BITS = 1024
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_random = np.random.Generator(np.random.PCG64(6))
_FLIP = _random.integers(0, 1 << 32, (SYMBOLS, 1), dtype=np.uint32)
_TIMES = _random.integers(0, 1 << 31, (SYMBOLS, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_PLACE = _random.integers(0, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts one after another, A-Z taken as a-z, and the number of the first word of each text."""
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    begins = np.flatnonzero(~space & (np.concatenate([[True], space[:-1]]) | edge[:-1]))
    ends = np.flatnonzero(~space & (np.concatenate([space[1:], [True]]) | edge[1:])) + 1
    return span_hash(prefix_hash(_LOWER[data]), begins, ends), np.searchsorted(begins, off)


def shingle_sets(texts: pa.Array, words: int):
    """For each text the sorted distinct hashes of its shingles of `words` words; of fewer words, one hash of all; of none, none."""
    for _, _, data, off in pieces(texts):
        if not len(data):
            yield from (np.zeros(0, np.uint64) for _ in range(len(off) - 1))
            continue
        h, first = word_hashes(data, off)
        n = max(0, len(h) - words + 1)
        mixed = np.zeros(n, np.uint64)
        for i in range(words):
            mixed += h[i : n + i] * _PLACE[i]
        mixed = mix(mixed)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= words:
                yield np.unique(mixed[a : b - words + 1])
            elif b > a:
                yield mix((h[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def signature(s: np.ndarray) -> np.ndarray:
    """16 words of 64 bits with SYMBOLS symbols."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    least = np.full((SYMBOLS, 1), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 4096):
        least = np.minimum(least, ((x[at : at + 4096] ^ _FLIP) * _TIMES).min(1, keepdims=True))
    least = least.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (least >> np.uint64(48)).astype("<u2").reshape(-1).view("<u8")


def parity_sketch(s: np.ndarray) -> np.ndarray:
    """16 words of 64 bits: bit i is the parity of the number of shingles that fall on it."""
    odd = np.bincount((s & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view("<u8")


def _long_lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel().view(np.int64)))


def _summaries(docs: DataFrame, words: int) -> DataFrame:
    """For rows (doc_id, text): doc_id, n (shingles), d1, d2 (digest of the set), s (signature), o (parity sketch)."""

    def run(batches):
        for b in batches:
            for at in range(0, len(b), 2000):
                part = b.slice(at, 2000)
                m = len(part)
                n, d, s, o = np.zeros(m, np.int64), np.zeros((2, m), np.uint64), np.zeros((m, CHUNKS), np.uint64), np.zeros((m, SKETCH_BITS // 64), np.uint64)
                for i, x in enumerate(shingle_sets(part.column(1), words)):
                    n[i] = len(x)
                    if len(x):
                        d[0, i], d[1, i] = x.sum(dtype=np.uint64), mix(x ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
                        s[i], o[i] = signature(x), parity_sketch(x)
                yield pa.record_batch([part.column(0), pa.array(n), pa.array(d[0].view(np.int64)), pa.array(d[1].view(np.int64)), _long_lists(s), _long_lists(o)], ["doc_id", "n", "d1", "d2", "s", "o"])

    return docs.mapInArrow(trimmed(run), "doc_id long, n long, d1 long, d2 long, s array<long>, o array<long>")


def _may_link(a: str, b: str, percent: int) -> Column:
    """SQL test of two rows (n, s, o): false only if they can't be as similar or their signatures are too far apart."""
    differ = " + ".join(f"bit_count({a}.o[{i}] ^ {b}.o[{i}])" for i in range(SKETCH_BITS // 64))

    far = "aggregate(zip_with(%s.s, %s.s, (x, y) -> x ^ y), 0, (t, x) -> t + int((x & 65535L) <> 0) + int((x & 4294901760L) <> 0) + int((x & 281470681743360L) <> 0) + int(shiftrightunsigned(x, 48) <> 0))" % (a, b)
    return F.expr(f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n) and {100 + percent} * ({differ}) <= {100 - percent} * ({a}.n + {b}.n) and {far} <= {MOST_ERRORS}")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar enough by their full sets (id, h)."""
    x, y = sets.select(F.col("id").alias("a"), F.col("h").alias("ha")), sets.select(F.col("id").alias("b"), F.col("h").alias("hb"))
    both = pairs.join(x, "a").join(y, "b").withColumn("i", F.size(F.array_intersect("ha", "hb")))
    return both.where(100 * F.col("i") >= percent * (F.size("ha") + F.size("hb") - F.col("i"))).select("a", "b")


def _sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(id, h): full sets of the documents whose doc_id is in ids (id). Texts of one doc_id count as one document each."""

    def run(batches):
        for b in batches:
            for at in range(0, len(b), 2000):
                part = b.slice(at, 2000)
                x = [s.view(np.int64) for s in shingle_sets(part.column(1), words)]
                off = np.concatenate([[0], np.cumsum([len(s) for s in x])]).astype(np.int32)
                yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)))], ["id", "h"])

    picked = docs.join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "text")
    return picked.mapInArrow(trimmed(run), "id long, h array<long>").where(F.size("h") > 0)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id it reaches by links), kept.

    Two documents are linked if 100 * shared shingles >= percent * all shingles of both, as sets of hashes of 64 bits. Documents of
    one set are one class, however many; only a class's least doc_id is compared with others. Null, empty and blank texts
    have no shingles and no links. Rows that share a doc_id are one document: what any of them reaches, all do. Rows of
    null doc_id are never linked: component_id is null and kept true. Other columns aren't read.
    """
    k, t = quoted([key, text])
    d = docs.select(k.cast("long").alias("doc_id"), t.alias("text"))
    rows = materialize(_summaries(d, words), "summaries")
    full = rows.where("n > 0 and doc_id is not null")
    classes = full.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("id"))
    classes = materialize(classes, "classes")
    reps = full.withColumnRenamed("doc_id", "id").join(classes, ["n", "d1", "d2", "id"]).dropDuplicates(["id", "n", "d1", "d2"]).select("id", "n", "s", "o")
    reps = materialize(reps, "representatives")
    member = full.select("doc_id", "n", "d1", "d2").join(classes, ["n", "d1", "d2"]).select("doc_id", "id")
    several = member.groupBy("doc_id").agg(F.min("id").alias("b"), F.max("id").alias("c")).where("b <> c").select("doc_id", "b")
    same = member.join(several, "doc_id").where("id <> b").select(F.col("id").alias("a"), "b")

    lane = "16 * (i % 4)"
    keys = reps.select("id", F.explode(F.expr(f"transform(sequence(0, {4 * CHUNKS - 1}), i -> (s[i div 4] & ~shiftleft(65535L, {lane})) | shiftleft(bigint(i), {lane}))")).alias("key"))
    met = keys.groupBy("key").agg(F.count("*").alias("c"), F.min("id").alias("b")).where("c > 1").select("key", "b")
    shared = materialize(keys.join(met, "key").select("key", "id", "b"), "shared-keys")

    def passed(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that may be links."""
        x, y = (reps.withColumnRenamed("id", name).select(name, F.struct("n", "s", "o").alias(f"r{name}")) for name in "ab")
        return pairs.join(x, "a").join(y, "b").where(_may_link("ra", "rb", percent)).select("a", "b", F.expr("aggregate(zip_with(ra.s, rb.s, (x, y) -> bit_count(x ^ y)), 0, (t, x) -> t + x)").alias("far"))

    stars = shared.where("id <> b").select(F.col("id").alias("a"), "b").distinct()
    # not made distinct again: that would tie the last join to its partitions, so that a skewed one couldn't be split
    stars = materialize(passed(stars), "stars")
    some = stars.select(F.col("a").alias("id")).unionByName(stars.select(F.col("b").alias("id"))).distinct()
    sets = materialize(_sets(d, some, words), "sets")
    nearest = stars.groupBy("a").agg(F.min_by("b", F.struct("far", "b")).alias("b"))
    labels = materialize(components(_confirmed(nearest, sets, percent).unionByName(same)), "labels")
    labels = _joined(labels, _confirmed(_across(stars, labels), sets, percent))

    of = shared.join(labels, "id", "left").select("key", "id", F.coalesce("component", "id").alias("label"))
    of = materialize(of, "labelled-keys")
    count = of.groupBy("key", "label").agg(F.count("*").alias("c"))
    split = count.groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count("*").alias("c")).where("c > 1").select("key", "main")
    left = of.join(split, "key").join(reps.select("id", F.struct("n", "s", "o").alias("r")), "id")
    left = materialize(left, "open-keys")
    x = left.where("label <> main").select("key", F.col("id").alias("a"), F.col("label").alias("la"), F.col("r").alias("ra"))
    y = left.select("key", F.col("id").alias("b"), F.col("label").alias("lb"), F.col("r").alias("rb"), (F.col("label") == F.col("main")).alias("inmain"))
    pairs = x.join(y, (x["key"] == y["key"]) & F.expr("la <> lb and (inmain or a < b)") & _may_link("ra", "rb", percent)).select("a", "b").distinct()
    pairs = materialize(pairs, "pairs")
    some = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    labels = _joined(labels, _confirmed(pairs, materialize(_sets(d, some, words), "sets"), percent))

    to = classes.join(labels, "id", "left").select("n", "d1", "d2", F.coalesce("component", "id").alias("component_id"))
    out = full.select("doc_id", "n", "d1", "d2").join(to, ["n", "d1", "d2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    single = rows.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(single).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) whose labels differ."""
    x, y = (labels.select(F.col("id").alias(n), F.col("component").alias(f"l{n}")) for n in "ab")
    p = pairs.select("a", "b").join(x, "a", "left").join(y, "b", "left")
    return p.where("coalesce(la, a) <> coalesce(lb, b)").select("a", "b")


def _joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels (id, component) after more edges (a, b)."""
    edges = materialize(edges, "links")
    x, y = (labels.select(F.col("id").alias(n), F.col("component").alias(f"l{n}")) for n in "ab")
    up = edges.join(x, "a", "left").join(y, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    to = materialize(components(up), "joined")
    ends = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id"))).distinct()
    known = labels.unionByName(ends.join(labels, "id", "left_anti").select("id", F.col("id").alias("component")))
    out = known.join(to.select(F.col("id").alias("component"), F.col("component").alias("least")), "component", "left").select("id", F.coalesce("least", "component").alias("component"))
    return materialize(out, "labels")


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each group of near-duplicates, that of the least key; rows of null key all stay, as do those without words.

    Rows that repeat a key stay or go together. The columns may have any names; an empty table gives none.
    """
    lost = near_duplicates(docs, words, percent, key, text).where(~F.col("kept")).select("doc_id")
    return without_keys(docs, key, lost, "lost")
