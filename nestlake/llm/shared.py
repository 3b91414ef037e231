"""What several operators need: shared storage, Arrow text buffers and row identity."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where checkpoints go when the session names no folder (tests on one machine).
LOCAL_CHECKPOINTS = "/tmp/checkpoints"
_mine: list = []


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; LOCAL_CHECKPOINTS where that is unset and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that every executor reaches")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(LOCAL_CHECKPOINTS)
    return f"file://{LOCAL_CHECKPOINTS}"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session may be gone; the folder is then the cluster's to clear
        pass


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the checkpoint folder, removed when the driver ends."""
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _mine:
        atexit.register(lambda: [_remove(*x) for x in _mine])
    _mine.append((spark, path))
    return path


#: Rows of an Arrow batch while something is written: texts of ten times as many take some 250 MB more of an executor with two tasks.
BATCH_ROWS = 1000


@contextmanager
def small_batches(spark: SparkSession):
    """Hand at most BATCH_ROWS rows at once to Python workers, for what runs within."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, min(int(old), BATCH_ROWS) if int(old) > 0 else BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(name, old)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: its lineage ends there and survives lost executors."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Of a place, the bits for the row within its part.
PLACE_BITS = 40


def placed(df: DataFrame, names: list[str]) -> tuple[DataFrame, int]:
    """These columns of df with `place`, which grows by part and by row within it; and the number of parts. place holds the part above PLACE_BITS bits.

    A reader of Parquet deals files out by size, so the order that they were written in is taken from their names and row numbers. What isn't read
    straight from files of Spark's writers is written first.
    """

    def files(d: DataFrame) -> list[str]:
        return [f.rsplit("/", 1)[-1] for f in d.inputFiles()]

    part = re.compile(r"part-(\d+)-[\w.-]+")
    found = files(df) if df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation" else [""]
    if len(set(found)) < len(found) or not all(part.fullmatch(f) for f in found):
        df = materialize(df, "in_order")
        found = files(df)
    found.sort(key=lambda f: (int(part.fullmatch(f)[1]), f))
    at = df.metadataColumn("_metadata")
    d = df.select(*quoted(names), at["file_name"].alias("file_name"), at["row_index"].alias("row_index"))
    order = df.sparkSession.createDataFrame(list(enumerate(found)), "part long, file_name string")
    d = d.join(F.broadcast(order), "file_name")
    return d.select(*quoted(names), (F.shiftleft("part", PLACE_BITS) + F.col("row_index")).alias("place")), max(1, len(found))


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def quoted(names: list[str]) -> list:
    """Columns of these names, whatever characters are in them."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def others(names: list[str], added: list[str]) -> list[str]:
    """The names that are none of those added. An operator's own columns replace the input's of the same name, in any case of letters."""
    own = {a.casefold() for a in added}
    return [n for n in names if n.casefold() not in own]


def without_keys(docs: DataFrame, key: str, gone: DataFrame, name: str) -> DataFrame:
    """docs without the rows whose key is in gone (one column); null keys stay. gone is written first, so that Spark knows its size before it plans the join."""
    own = "gone"
    while own in [c.casefold() for c in docs.columns]:
        own += "_"
    gone = materialize(gone.toDF(own).distinct(), name)
    return docs.join(gone, quoted([key])[0] == F.col(own), "left_anti")


def row_tag(key: str = "doc_id", text: str = "text"):
    """Tells rows of one key with different texts apart; whole-row repeats share it."""
    return F.xxhash64(F.col(key), F.col(text))


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows in a row, and len(col) + 1 offsets into them. Null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.fill_null("") if col.null_count else col
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


#: What a Python worker keeps from task to task, such as ids of pieces of text. Workers outlive stages.
worker_caches: list[dict] = []


def drop_caches() -> None:
    """Give back what an earlier stage has left in this worker, so that it doesn't add to what this one needs."""
    if not any(worker_caches):
        return
    for c in worker_caches:
        c.clear()
    give_back()


def give_back() -> None:
    """Return freed memory to the system. Python workers wait for further tasks, and what they keep counts against their executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def trimmed(run):
    """A function for mapInArrow that gives memory back when its task ends."""

    def work(batches):
        yield from run(batches)
        give_back()

    return work


def trimmed_group(run):
    """A function for applyInArrow that gives memory back after each group."""

    def work(table):
        out = run(table)
        give_back()
        return out

    return work


def pieces(col: pa.Array, most: int = 500_000):
    """(first row, row after the last, bytes, offsets) for runs of rows with about `most` bytes; a longer row comes alone."""
    drop_caches()
    data, off = text_buffers(col)
    at, n = 0, len(off) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield at, to, data[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


_U = np.uint64
_BASE, _MASK = 0x9E3779B97F4A7C15 | 1, (1 << 64) - 1
_INV = pow(_BASE, -1, 1 << 64)
#: A random 64-bit word for each byte value.
BYTE_WORDS = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_tables: dict = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base of rolling hashes and of its inverse, modulo 2^64."""
    if _tables.get("n", -1) < n:
        m = max(n, 1 << 20)
        for key, b in (("p", _BASE), ("q", _INV)):
            t = np.full(m + 1, _U(b), np.uint64)
            t[0] = 1
            _tables[key] = np.multiply.accumulate(t)
        _tables["n"] = m
    return _tables["p"][: n + 1], _tables["q"][: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every bit."""
    x = x ^ (x >> _U(33))
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """len(data) + 1 prefix sums; span(prefix, i, j) hashes data[i:j]."""
    p, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_WORDS[data] * p[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    _, q = powers(len(prefix))
    return mix((prefix[j] - prefix[i]) * q[i] + (j - i).astype(np.uint64))


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files that nothing refers to any more; they'd stay until the driver's next full collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
