"""Token ids in Arrow files of fixed-size-list batches, and reading them back.

Every file of ids holds record batches of two columns, `ids` (fixed-size list of uint16 or uint32) and `mask`
(fixed-size list of bool, false in the padding at a file's end), so sequence i is a slice of a mapped buffer: nothing is copied
or decoded. Beside it lies a file of the documents in it: doc_id, first id (within the file), number of ids and, where
the documents have an order of their own, place in it.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import PLACE_BITS, materialize, new_folder, placed, trimmed
from .tokens import encode_text, pieces_of

#: Ids in a sequence, sequences in a record batch.
SEQUENCE, BATCH = 2048, 128
INDEX = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("n", pa.int64())])
MANIFEST = "part int, path string, n_docs long, n_tokens long"


def _fs(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)


def _open(path: str) -> pa.ipc.RecordBatchFileReader:
    fs, p = _fs(path)
    return pa.ipc.open_file(pa.memory_map(p) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(p))


class _Sequences:
    """Gathers ids and writes them a record batch at a time."""

    def __init__(self, sink, dtype: np.dtype, length: int):
        self.dtype, self.length, self.rest, self.held, self.n = dtype, length, [], 0, 0
        item = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
        self.schema = pa.schema([("ids", pa.list_(item, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.writer = pa.ipc.new_file(sink, self.schema)

    def add(self, ids: bytes) -> None:
        self.rest.append(ids)
        self.held += len(ids)
        self.n += len(ids) // self.dtype.itemsize
        if self.held >= self.length * BATCH * self.dtype.itemsize:
            self._write(False)

    def _write(self, last: bool) -> None:
        x = np.frombuffer(b"".join(self.rest), self.dtype)
        step = self.length * BATCH
        whole = len(x) // step * step
        for at in range(0, whole, step):
            self._batch(x[at : at + step], step)
        x = x[whole:]
        if last and len(x):
            pad = np.zeros(-(-len(x) // self.length) * self.length, self.dtype)
            pad[: len(x)] = x
            self._batch(pad, len(x))
            x = x[:0]
        self.rest, self.held = [x.tobytes()], x.nbytes

    def _batch(self, x: np.ndarray, used: int) -> None:
        mask = pa.array(np.arange(len(x)) < used)
        self.writer.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(v, self.length) for v in (pa.array(x), mask)], schema=self.schema))

    def close(self) -> None:
        self._write(True)
        self.writer.close()


def write_token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 2, length: int = SEQUENCE, key: str = "doc_id", text: str = "text", place: str | None = None) -> DataFrame:
    """Encode every whole text, append end_id, and write the ids in ascending order of key; returns the manifest.

    The manifest has a row per file, in the order of the ids: part, path, n_docs, n_tokens. Ids of a file run
    on from sequence to sequence; the last one is padded and masked. `folder` (None: a fresh one in the shared checkpoint
    folder) must be a URI that every executor reaches. A file's name has its task attempt in it, and only the attempt that
    Spark takes is in the manifest, so lost executors and repeated tasks do no harm.
    A null text is empty; null keys come first; rows of equal key go by text; other columns aren't read. `place` (None: there is none) names
    a column of whole numbers, by which documents are to be read: it goes into the files' lists of documents.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    own = [docs[place].cast("long").alias("place")] if place else []
    index_schema = INDEX.append(pa.field("place", pa.int64())) if place else INDEX
    d = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"), *own)
    d = d.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    d = d.sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in d.columns])

    def write(batches):
        pieces = pieces_of(tokenizer)
        end = np.array([end_id], pieces.dtype).tobytes()
        part = TaskContext.get().partitionId()
        out, docs_n = None, 0
        for b in batches:
            if not len(b):
                continue
            if out is None:
                fs, top = _fs(folder)
                fs.create_dir(top, recursive=True)
                name = f"part-{part:06d}-{uuid.uuid4().hex[:12]}"
                sinks = [fs.open_output_stream(f"{top}/{name}.{kind}.arrow") for kind in ("ids", "docs")]
                out, index = _Sequences(sinks[0], pieces.dtype, length), pa.ipc.new_file(sinks[1], index_schema)
            first = out.n
            n = np.empty(len(b), np.int64)
            for i, t in enumerate(b.column(1)):
                ids = encode_text(pieces, t.as_py() or "") + end
                n[i] = len(ids) // pieces.dtype.itemsize
                out.add(ids)
            at = first + np.concatenate([[0], np.cumsum(n)[:-1]])
            index.write_batch(pa.record_batch([b.column(0), pa.array(at), pa.array(n), *b.columns[2:]], schema=index_schema))
            docs_n += len(b)
        if out is not None:
            out.close()
            index.close()
            for s in sinks:
                s.close()
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([docs_n]), pa.array([out.n])], ["part", "path", "n_docs", "n_tokens"])

    return materialize(d.mapInArrow(trimmed(write), MANIFEST), "manifest")


class TokenFile:
    """Random access to one file: len(f) sequences; f[i] is (ids, mask), where ids is a view of the mapped file."""

    def __init__(self, path: str):
        self.reader = _open(f"{path}.ids.arrow")
        sizes = [self.reader.get_batch(i).num_rows for i in range(self.reader.num_record_batches)]
        self.ends = np.cumsum(sizes, dtype=np.int64) if sizes else np.zeros(0, np.int64)

    def __len__(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if not 0 <= i < len(self):
            raise IndexError(i)
        b = int(np.searchsorted(self.ends, i, "right"))
        batch = self.reader.get_batch(b)
        at = i - (int(self.ends[b - 1]) if b else 0)
        return batch.column(0)[at].values.to_numpy(), batch.column(1)[at].values.to_numpy(zero_copy_only=False)


def _documents(path: str):
    """(the columns of the list of documents, ids of each document) for the batches of that list."""
    ids, index = _open(f"{path}.ids.arrow"), _open(f"{path}.docs.arrow")
    held, held_at, b = np.zeros(0, np.uint16), 0, 0
    for k in range(index.num_record_batches):
        batch = index.get_batch(k)
        first, n = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        own = []
        for at, m in zip(first.tolist(), n.tolist(), strict=True):
            parts, have = [held[at - held_at :]], len(held) - (at - held_at)
            while have < m:
                parts.append(ids.get_batch(b).column(0).values.to_numpy())
                have += len(parts[-1])
                b += 1
            if len(parts) > 1:
                held, held_at = np.concatenate(parts), at
            own.append(held[at - held_at : at - held_at + m])
        yield batch.columns, own


def read_token_files(manifest: DataFrame, with_place: bool = False) -> DataFrame:
    """One row per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32; place too if it was written and is asked for.

    ids_crc32 is the unsigned CRC-32 of its ids as little-endian unsigned 32-bit integers. An empty manifest gives no row.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    m = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).select("part", "path", "base")
    m = m.repartition(max(1, manifest.count()))  # a task per file; without a number, adaptive execution puts all in one
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "place"][: 5 if with_place else 4]

    def read(batches):
        for b in batches:
            for path, base in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                for (doc, first, n, *place), own in _documents(path):
                    crc = np.fromiter((zlib.crc32(x.astype("<u4").tobytes()) for x in own), np.int64, len(own))
                    yield pa.record_batch([doc, pa.array(first.to_numpy() + base), n, pa.array(crc), *place[: len(names) - 4]], names)

    return m.mapInArrow(trimmed(read), ", ".join(f"{c} long" for c in names))


def token_files(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write docs with `write_token_files` and read the files back."""
    return read_token_files(write_token_files(docs, tokenizer, **options))


def token_files_in_order(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """`token_files`, whose rows come in the order of docs: by part, and by row within it (`shared.placed`). The files list each document's place in that order.

    The ids themselves lie in ascending order of key; start and n_tokens of one row after another give them in the order of docs.
    """
    d, parts = placed(docs, [key, text])
    rows = read_token_files(write_token_files(d, tokenizer, key=key, text=text, place="place", **options), with_place=True)
    rows = rows.repartitionById(parts, F.shiftright("place", PLACE_BITS).cast("int")).sortWithinPartitions("place")
    return rows.drop("place")
