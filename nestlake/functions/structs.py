"""Structures that users define: a registry of decoders, records cut from bytes, and four-vectors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: numpy kinds of record fields and the Spark types they widen to (Spark has no unsigned numbers).
SPARK_OF = {"i1": "byte", "i2": "short", "i4": "int", "i8": "long", "u1": "short", "u2": "int", "u4": "long", "u8": "decimal(20,0)", "f4": "float", "f8": "double", "b1": "boolean"}
_ARROW = {"byte": pa.int8(), "short": pa.int16(), "int": pa.int32(), "long": pa.int64(), "float": pa.float32(), "double": pa.float64(), "boolean": pa.bool_()}


def _widened(x: np.ndarray, kind: str) -> pa.Array:
    x = np.ascontiguousarray(x).astype(x.dtype.newbyteorder("="))
    if kind != "u8":
        return pa.array(x).cast(_ARROW[SPARK_OF[kind]])
    halves = np.zeros((len(x), 2), "<u8")  # Arrow doesn't cast these to decimals itself
    halves[:, 0] = x
    return pa.Array.from_buffers(pa.decimal128(20, 0), len(x), [None, pa.py_buffer(halves.tobytes())])


@dataclass(frozen=True)
class Record:
    """A record of fixed size: names and numpy kinds, big-endian as stored. Names that begin with an underscore are left out, whatever
    their kind (V4 is four bytes). `skip` bytes come before the records of a cell; `order` is that of the names in the struct, if another."""

    name: str
    fields: tuple[tuple[str, str], ...]
    skip: int = 0
    order: tuple[str, ...] = ()

    @property
    def dtype(self) -> np.dtype:
        return np.dtype([(n, f">{k}" if k[1:] != "1" and k[0] != "V" else k) for n, k in self.fields])

    @property
    def shown(self) -> list[tuple[str, str]]:
        kinds = dict(self.fields)
        return [(n, kinds[n]) for n in self.order or [n for n, _ in self.fields if not n.startswith("_")]]

    @property
    def spark_type(self) -> str:
        return f"struct<{','.join(f'{n}:{SPARK_OF[k]}' for n, k in self.shown)}>"

    def structs(self, raw: np.ndarray) -> pa.StructArray:
        """Bytes of records one after another to structs."""
        flat = raw.view(self.dtype)
        return pa.StructArray.from_arrays([_widened(flat[n], k) for n, k in self.shown], [n for n, _ in self.shown])

    def cut(self, data: np.ndarray, off: np.ndarray) -> pa.ListArray:
        """Cells of bytes, one after another from off[i] to off[i + 1], to lists of structs: what follows the last whole record is left."""
        n = np.maximum(np.diff(off) - self.skip, 0) // self.dtype.itemsize
        size = n * self.dtype.itemsize
        at = np.repeat(off[:-1] + self.skip - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), self.structs(data[at]))

    def decode(self, cells: pa.Array) -> pa.ListArray:
        """Cells of bytes to lists of structs; a null cell gives an empty list."""
        cells = cells.combine_chunks() if isinstance(cells, pa.ChunkedArray) else cells
        cells = cells.fill_null(b"").cast(pa.large_binary())
        _, off, data = cells.buffers()
        off = np.frombuffer(off, np.int64)[cells.offset : cells.offset + len(cells) + 1] if len(cells) else np.zeros(1, np.int64)
        return self.cut(np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), off)


#: Fixed layouts of known records: a detector hit (10 bytes), a triggered hit (24 bytes) and an event header (76 bytes). Ten bytes come before the hits of a cell.
HIT = Record("hit", (("dom_id", "i4"), ("channel_id", "u1"), ("tdc", "i4"), ("tot", "u1")), skip=10)
TRIGGERED_HIT = Record("triggered_hit", (("dom_id", "i4"), ("channel_id", "u1"), ("tdc", "i4"), ("tot", "u1"), ("_head", "V6"), ("trigger_mask", "u8")), skip=10)
EVENT_HEADER = Record(
    "event_header",
    (("_a", "V18"), ("detector_id", "i4"), ("run", "i4"), ("frame_index", "i4"), ("_b", "V6"), ("utc_seconds", "u4"), ("utc_16nanosecondcycles", "u4"),
     ("_c", "V6"), ("trigger_counter", "u8"), ("_d", "V6"), ("trigger_mask", "u8"), ("overlays", "u4")),
)
#: A four-vector: 32 bytes of heads, then x, y, z, t.
FOUR_VECTOR = Record("four_vector", (("_head", "V32"), ("x", "f8"), ("y", "f8"), ("z", "f8"), ("t", "f8")), order=("t", "x", "y", "z"))


class Registry(dict[str, Record]):
    """Class names, or Class.member, to the records that their cells hold, as `datasource.read` takes them."""

    def add(self, name: str, record: Record) -> Registry:
        self[name] = record
        return self


def split_records(c: str | Column, record: Record) -> Column:
    """Bytes to an array of structs, in Arrow batches: bits can't be read as floats by built-in expressions."""

    @F.arrow_udf(f"array<{record.spark_type}>")
    def cut(cells: pa.Array) -> pa.Array:
        return record.decode(cells)

    return cut(c)


def four_vector(x: Column, y: Column, z: Column, t: Column) -> Column:
    """Stored in the order x, y, z, t; shown as t, x, y, z."""
    return F.struct(t.alias("t"), x.alias("x"), y.alias("y"), z.alias("z"))


def transverse(v: str) -> Column:
    return F.sqrt(F.col(f"{v}.x") * F.col(f"{v}.x") + F.col(f"{v}.y") * F.col(f"{v}.y"))


def mass(v: str) -> Column:
    """Signed root of t^2 - x^2 - y^2 - z^2."""
    m2 = F.col(f"{v}.t") * F.col(f"{v}.t") - F.col(f"{v}.x") * F.col(f"{v}.x") - F.col(f"{v}.y") * F.col(f"{v}.y") - F.col(f"{v}.z") * F.col(f"{v}.z")
    return F.signum(m2) * F.sqrt(F.abs(m2))


def symmetric(packed: str, n: int) -> Column:
    """A symmetric matrix from its upper triangle, row by row, as an array of rows."""
    at = lambda i, j: (i * (2 * n - i - 1)) // 2 + j if i <= j else (j * (2 * n - j - 1)) // 2 + i
    return F.array(*[F.array(*[F.col(packed)[at(i, j)] for j in range(n)]) for i in range(n)])


def variant(tag: Column, members: dict[str, Column]) -> Column:
    """A tagged union: tag k keeps the k-th member (from 1) and nulls the rest; 0 is the empty one."""
    return F.struct(tag.alias("tag"), *[F.when(tag == k + 1, c).alias(n) for k, (n, c) in enumerate(members.items())])


def stacked(*types: T.StructType) -> T.StructType:
    """The fields of several structures, one after another."""
    return T.StructType([f for t in types for f in t.fields])
