"""Columnar ntuples: fields over columns, columns over pages, pages in clusters. Clusters are decoded straight into Arrow arrays."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import types as T

from nestlake.functions import codecs

from .framing import decompress


@dataclass(frozen=True)
class ColumnType:
    """How the elements of a column are stored: numpy kind (None: not a number of whole bytes) and encodings."""

    kind: str | None
    split: bool = False
    delta: bool = False
    zigzag: bool = False
    special: str = ""


#: The codes of column types.
COLUMN_TYPES = {
    0x00: ColumnType(None, special="bit"), 0x01: ColumnType("u1"), 0x02: ColumnType("u1"), 0x03: ColumnType("i1"), 0x04: ColumnType("u1"), 0x05: ColumnType("i2"), 0x06: ColumnType("u2"),
    0x07: ColumnType("i4"), 0x08: ColumnType("u4"), 0x09: ColumnType("i8"), 0x0A: ColumnType("u8"), 0x0B: ColumnType("f2"), 0x0C: ColumnType("f4"), 0x0D: ColumnType("f8"),
    0x0E: ColumnType("u4", special="index"), 0x0F: ColumnType("u8", special="index"), 0x10: ColumnType(None, special="switch"),
    0x11: ColumnType("i2", split=True, zigzag=True), 0x12: ColumnType("u2", split=True), 0x13: ColumnType("i4", split=True, zigzag=True), 0x14: ColumnType("u4", split=True),
    0x15: ColumnType("i8", split=True, zigzag=True), 0x16: ColumnType("u8", split=True), 0x17: ColumnType("f2", split=True), 0x18: ColumnType("f4", split=True), 0x19: ColumnType("f8", split=True),
    0x1A: ColumnType("u4", split=True, delta=True, special="index"), 0x1B: ColumnType("u8", split=True, delta=True, special="index"),
    0x1C: ColumnType("f4", special="trunc"), 0x1D: ColumnType("f4", special="quant"),
}
#: Roles of fields.
LEAF, VECTOR, STRUCT, UNION = 0, 1, 2, 3
#: numpy kinds to Spark and Arrow; unsigned numbers widen, as Spark has none.
WIDE = {
    "i1": (T.ByteType(), pa.int8()), "i2": (T.ShortType(), pa.int16()), "i4": (T.IntegerType(), pa.int32()), "i8": (T.LongType(), pa.int64()),
    "u1": (T.ShortType(), pa.int16()), "u2": (T.IntegerType(), pa.int32()), "u4": (T.LongType(), pa.int64()), "u8": (T.DecimalType(20, 0), pa.decimal128(20, 0)),
    "f2": (T.FloatType(), pa.float32()), "f4": (T.FloatType(), pa.float32()), "f8": (T.DoubleType(), pa.float64()), "?": (T.BooleanType(), pa.bool_()),
}


def wide(x: np.ndarray) -> pa.Array:
    """Numbers as Arrow numbers of a type that Spark has."""
    kind = "?" if x.dtype == bool else x.dtype.str[1:]
    to = WIDE[kind][1]
    if kind == "f2":
        x = x.astype(np.float32)
    if kind == "u8":  # decimals by halves: Arrow doesn't cast them itself
        out = np.zeros((len(x), 2), "<u8")
        out[:, 0] = x
        return pa.Array.from_buffers(to, len(x), [None, pa.py_buffer(out.tobytes())])
    return pa.array(x).cast(to)


@dataclass
class Column:
    type: int
    bits: int
    field: int
    representation: int = 0
    first: int = 0
    low: float = 0.0
    high: float = 0.0


@dataclass
class Field:
    id: int
    parent: int
    role: int
    name: str
    type_name: str
    repetition: int = 0
    children: list[Field] = field(default_factory=list)
    columns: list[int] = field(default_factory=list)


@dataclass(frozen=True)
class Page:
    n: int
    seek: int
    nbytes: int
    checked: bool


@dataclass(frozen=True)
class Cluster:
    first: int
    n: int
    pages: tuple[tuple[Page, ...], ...]
    group: int = 0


class _In:
    """Little-endian bytes with frames."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, form: str):
        s = struct.Struct("<" + form)
        out = s.unpack_from(self.data, self.at)
        self.at += s.size
        return out[0] if len(out) == 1 else out

    def string(self) -> str:
        n = self.take("I")
        self.at += n
        return self.data[self.at - n : self.at].decode()

    def list(self, item) -> list:
        """A list frame; `item` reads one and may leave bytes unread if items are record frames."""
        begin = self.at
        size, n = self.take("qI")
        if size >= 0:
            raise ValueError("a record where a list should be")
        out = [item(self) for _ in range(n)]
        self.at = begin - size
        return out

    def record(self, item):
        begin = self.at
        size = self.take("q")
        out = item(self)
        self.at = begin + size
        return out

    def records(self, item) -> list:
        return self.list(lambda c: c.record(item))


def envelope(data: bytes, kind: int) -> tuple[_In, int]:
    """The content of an envelope and its checksum, which is checked."""
    head, (own,) = struct.unpack_from("<Q", data)[0], struct.unpack("<Q", data[-8:])
    if head & 0xFFFF != kind or head >> 16 != len(data):
        raise ValueError(f"no envelope of kind {kind}")
    if xxhash.xxh3_64_intdigest(data[:-8]) != own:
        raise ValueError("an envelope's checksum is wrong")
    c = _In(data)
    c.at = 8
    return c, own


def _flags(c: _In) -> int:
    out, shift = 0, 0
    while True:
        x = c.take("Q")
        out |= (x & ((1 << 63) - 1)) << shift
        shift += 63
        if not x >> 63:
            return out


def _field(c: _In) -> Field:
    _, _, parent, role, flags = c.take("IIIHH")
    name, type_name, _, _ = (c.string() for _ in range(4))
    return Field(-1, parent, role, name, type_name, c.take("q") if flags & 1 else 0)


def _column(c: _In) -> Column:
    kind, bits, own, flags, representation = c.take("HHIHH")
    first = c.take("q") if flags & 1 else 0
    low, high = c.take("dd") if flags & 2 else (0.0, 0.0)
    return Column(kind, bits, own, representation, first, low, high)


def _locator(c: _In) -> tuple[int, int]:
    """Bytes and place."""
    size = c.take("i")
    if size >= 0:
        return size, c.take("Q")
    if -size >> 24 == 1:  # a wide one
        return c.take("QQ")
    raise NotImplementedError("a locator of an unknown kind")


@dataclass
class _Schema:
    fields: list[Field] = field(default_factory=list)
    columns: list[Column] = field(default_factory=list)
    aliases: list[tuple[int, int]] = field(default_factory=list)

    def extend(self, c: _In) -> None:
        self.fields += c.records(_field)
        self.columns += c.records(_column)
        self.aliases += c.records(lambda c: c.take("II"))
        c.records(lambda c: None)

    def tree(self) -> list[Field]:
        """Top fields with their children and columns; what has neither data nor children with data is left out."""
        for i, f in enumerate(self.fields):
            f.id, f.children, f.columns = i, [], []
        for i, c in enumerate(self.columns):
            if c.representation == 0:
                self.fields[c.field].columns.append(i)
        for physical, own in self.aliases:
            self.fields[own].columns.append(physical)
        top = []
        for f in self.fields:
            (top if f.parent == f.id else self.fields[f.parent].children).append(f)

        def full(f: Field) -> bool:
            f.children = [c for c in f.children if full(c)]
            return bool(f.columns or f.children)

        return [f for f in top if full(f)]


class Ntuple:
    """What a file says of an ntuple: `fields`, `columns`, `clusters()`, `entries`; `schema()` and `cluster_arrays()` for Spark."""

    def __init__(self, container, anchor: bytes):
        epoch, major = struct.unpack_from(">HH", anchor, 6)
        if (epoch, major) not in ((0, 3), (1, 0)):
            raise NotImplementedError(f"ntuples of version {epoch}.{major}")
        seek_h, n_h, len_h, seek_f, n_f, len_f, _, checksum = struct.unpack_from(">8Q", anchor, 14)
        if xxhash.xxh3_64_intdigest(anchor[6:70]) != checksum:
            raise ValueError("the anchor's checksum is wrong")
        self.bytes = container.bytes
        head, own = envelope(self._stored(seek_h, n_h, len_h), 1)
        _flags(head)
        self.name, self.description, self.writer = (head.string() for _ in range(3))
        s = _Schema()
        s.extend(head)
        foot, _ = envelope(self._stored(seek_f, n_f, len_f), 2)
        _flags(foot)
        if foot.take("Q") != own:
            raise ValueError("head and foot don't belong together")
        foot.record(s.extend)
        self.groups = foot.records(lambda c: (*c.take("qqI"), c.take("Q"), _locator(c)))
        self.columns, self.fields = s.columns, s.tree()
        self.entries = sum(g[1] for g in self.groups)
        self._clusters: list[Cluster] | None = None

    def _stored(self, seek: int, n: int, length: int) -> bytes:
        return decompress(self.bytes.read(seek, n), length)

    def clusters(self) -> list[Cluster]:
        """Every cluster of every group, in order of entries."""
        if self._clusters is None:
            out = []
            for i, (_, _, _, length, (n, seek)) in enumerate(self.groups):
                c, _ = envelope(self._stored(seek, n, length), 3)
                c.take("Q")
                spans = c.records(lambda c: c.take("qQ"))

                def pages(c: _In) -> tuple[Page, ...]:
                    def page(c: _In) -> Page:
                        count = c.take("i")
                        nbytes, at = _locator(c)
                        return Page(abs(count), at, nbytes, count < 0)

                    return tuple(c.list(page))

                nested = c.list(lambda c: tuple(c.list(pages)))
                out += [Cluster(first, n & ((1 << 56) - 1), p, i) for (first, n), p in zip(spans, nested, strict=True)]
            self._clusters = sorted(out, key=lambda x: x.first)
        return self._clusters

    def spark_type(self, f: Field) -> T.DataType:
        if f.role == VECTOR:
            return T.ArrayType(self.spark_type(f.children[0]), False)
        if f.role == STRUCT:
            return T.StructType([T.StructField(c.name, self.spark_type(c), False) for c in f.children])
        if f.role == UNION:
            return T.StructType([T.StructField("tag", T.IntegerType(), False), *[T.StructField(f"_{i}", self.spark_type(c)) for i, c in enumerate(f.children)]])
        if f.role != LEAF:
            raise NotImplementedError(f"field {f.name} of role {f.role}")
        if f.repetition:
            return T.ArrayType(self.spark_type(f.children[0]), False)
        if not f.columns:
            return self.spark_type(f.children[0])
        if len(f.columns) == 2:
            return T.StringType()
        t = COLUMN_TYPES[self.columns[f.columns[0]].type]
        return T.LongType() if t.special == "index" else T.BooleanType() if t.special == "bit" else WIDE[t.kind][0]

    def schema(self, names: list[str] | None = None) -> T.StructType:
        """Fields of the ntuple by name, in the order asked for. Fixed lengths and unsigned types are told in the metadata."""
        by = {f.name: f for f in self.fields}
        out = []
        for n in names if names is not None else by:
            f = by[n]
            more = {"stored_type": f.type_name} | ({"fixed_len": f.repetition} if f.repetition else {})
            out.append(T.StructField(n, self.spark_type(f), False, more))
        return T.StructType(out)

    def needed(self, names: list[str]) -> set[int]:
        """Numbers of the columns of some fields and all below them."""
        def below(f: Field) -> set[int]:
            return set(f.columns).union(*[below(c) for c in f.children])

        by = {f.name: f for f in self.fields}
        return set().union(*[below(by[n]) for n in names])


class ClusterReader:
    """Decodes one cluster: `read(field)` gives an Arrow array of its entries."""

    def __init__(self, source, columns: list[Column], cluster: Cluster):
        self.source, self.columns, self.cluster = source, columns, cluster

    def page(self, p: Page, c: Column) -> bytes:
        size = -(-p.n * c.bits // 8)
        stored = self.source.read(p.seek, p.nbytes + 8 * p.checked)
        if p.checked:
            stored, own = stored[:-8], stored[-8:]
            if xxhash.xxh3_64_intdigest(stored) != int.from_bytes(own, "little"):
                raise ValueError("a page's checksum is wrong")
        return decompress(stored, size)

    def column(self, i: int) -> np.ndarray:
        """All elements of a column in this cluster; none if the cluster is older than the column."""
        c = self.columns[i]
        t = COLUMN_TYPES[c.type]
        pages = self.cluster.pages[i] if i < len(self.cluster.pages) else ()
        parts = [self._elements(self.page(p, c), p.n, c, t) for p in pages]
        if parts:
            return np.concatenate(parts)
        return np.zeros(0, bool if t.special == "bit" else [("index", "<u8"), ("tag", "<u4")] if t.special == "switch" else t.kind)

    @staticmethod
    def _elements(raw: bytes, n: int, c: Column, t: ColumnType) -> np.ndarray:
        if t.special == "bit":
            return codecs.np_unpack_bools(raw, n)
        if t.special == "switch":
            return np.frombuffer(raw, np.dtype([("index", "<u8"), ("tag", "<u4")]), n)
        if t.special == "trunc":
            return codecs.np_untruncate(codecs.np_unpack(raw, c.bits, n), c.bits)
        if t.special == "quant":
            return codecs.np_unquantize(codecs.np_unpack(raw, c.bits, n), c.bits, c.low, c.high)
        x = codecs.np_unsplit(raw, f"<{t.kind}") if t.split else np.frombuffer(raw, f"<{t.kind}", n)
        if t.delta:
            return np.cumsum(x, dtype=x.dtype)
        return codecs.np_unzigzag(x) if t.zigzag else x

    def _padded(self, x: np.ndarray, n: int | None) -> np.ndarray:
        """With zeros before it for entries older than the column."""
        return x if n is None or len(x) >= n else np.concatenate([np.zeros(n - len(x), x.dtype), x])

    def read(self, f: Field, n: int | None) -> pa.Array:
        """n elements of a field (None: as many as there are)."""
        if f.role == STRUCT:
            parts = [self.read(c, n) for c in f.children]
            return pa.StructArray.from_arrays(parts, [c.name for c in f.children])
        if f.role == UNION:
            return self._union(f, n)
        if f.role == VECTOR:
            off = self._offsets(f, n)
            return pa.ListArray.from_arrays(pa.array(off, pa.int32()), self.read(f.children[0], int(off[-1])))
        if f.repetition:
            items = self.read(f.children[0], None if n is None else n * f.repetition)
            return pa.ListArray.from_arrays(pa.array(np.arange(0, len(items) + 1, f.repetition), pa.int32()), items)
        if not f.columns:
            return self.read(f.children[0], n)
        if len(f.columns) == 2:
            off, text = self._offsets(f, n), self.column(f.columns[1])
            return pa.StringArray.from_buffers(len(off) - 1, pa.py_buffer(off.astype(np.int32).tobytes()), pa.py_buffer(text.tobytes()))
        x = self._padded(self.column(f.columns[0]), n)
        if COLUMN_TYPES[self.columns[f.columns[0]].type].special == "index":  # how many another collection has
            return pa.array(np.diff(x.astype(np.int64), prepend=0))
        return wide(x)

    def _offsets(self, f: Field, n: int | None) -> np.ndarray:
        return np.concatenate([[0], self._padded(self.column(f.columns[0]), n).astype(np.int64)])

    def _union(self, f: Field, n: int | None) -> pa.Array:
        x = self._padded(self.column(f.columns[0]), n)
        tag, at = x["tag"].astype(np.int32), x["index"].astype(np.int64)
        parts = []
        for i, c in enumerate(f.children):
            parts.append(self.read(c, None).take(pa.array(np.where(tag == i + 1, at, 0), mask=tag != i + 1)))
        return pa.StructArray.from_arrays([pa.array(tag), *parts], ["tag", *[f"_{i}" for i in range(len(parts))]])


def cluster_table(source, columns: list[Column], fields: list[Field], cluster: Cluster) -> pa.Table:
    r = ClusterReader(source, columns, cluster)
    return pa.table([r.read(f, cluster.n) for f in fields], [f.name for f in fields])
