"""Trees: branches cut into baskets. A branch's layout is found from its leaf and class, and baskets are decoded into Arrow arrays."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from nestlake.functions.structs import FOUR_VECTOR, Record

from .framing import decompress
from .ntuple import WIDE, wide
from .objects import BASIC, CPP, Cursor, Obj, parse_type, strings

#: Leaf classes and how their numbers are stored: signed and unsigned.
LEAVES = {
    "TLeafB": ("i1", "u1"), "TLeafS": (">i2", ">u2"), "TLeafI": (">i4", ">u4"), "TLeafL": (">i8", ">u8"), "TLeafG": (">i8", ">u8"),
    "TLeafF": (">f4", ">f4"), "TLeafD": (">f8", ">f8"), "TLeafO": ("?", "?"), "TLeafD32": (">f4", ">f4"), "TLeafF16": (">f2", ">f2"),
}
#: The branch type of members of a collection, and bytes before the items of cells of each kind.
STL_MEMBER, VECTOR_HEAD, STRING_HEAD = 41, 10, 6
_DIMS = re.compile(r"\[([^\]]*)\]")


@dataclass(frozen=True)
class Layout:
    """How the cells of a branch are stored: flat numbers, lists of them, lists of lists, strings, records of several leaves, or records of a user."""

    kind: str
    dtype: str = ""
    skip: int = 0
    fixed: int = 1
    leaves: tuple[tuple[str, str, int], ...] = ()
    record: Record | None = None

    @property
    def item(self) -> T.DataType:
        return WIDE["?" if self.dtype == "?" else self.dtype[-2:]][0]

    def spark_type(self) -> T.DataType:
        if self.kind in ("flat", "jagged", "nested"):
            t = T.ArrayType(self.item, False) if self.fixed > 1 else self.item
            return {"flat": t, "jagged": T.ArrayType(t, False), "nested": T.ArrayType(T.ArrayType(t, False), False)}[self.kind]
        if self.kind == "string":
            return T.StringType()
        if self.kind == "strings":
            return T.ArrayType(T.StringType(), False)
        if self.kind == "leaves":
            return T.StructType([T.StructField(n, Layout("flat", d, fixed=k).spark_type(), False) for n, d, k in self.leaves])
        if self.kind == "raw":
            return T.BinaryType()
        item = T.StructType([T.StructField(n, WIDE["?" if k == "b1" else k][0]) for n, k in self.record.shown])
        return item if self.kind == "record" else T.ArrayType(item)


@dataclass(frozen=True)
class Chunk:
    """Entries [first, last) of a branch and where their basket lies; one that was never flushed brings its bytes."""

    first: int
    last: int
    seek: int = 0
    nbytes: int = 0
    data: bytes | None = None
    offsets: tuple[int, ...] | None = None


@dataclass(frozen=True)
class Plan:
    """What a task must know of a branch to read some of its entries."""

    name: str
    layout: Layout
    chunks: tuple[Chunk, ...]

    def within(self, first: int, last: int) -> Plan:
        return replace(self, chunks=tuple(c for c in self.chunks if c.first < last and c.last > first))


class Tree:
    """A tree of a container: `branches` by path, `entries`, `aliases`, `friends`, `index`."""

    def __init__(self, container, obj: Obj):
        self.container, self.obj = container, obj
        self.name, self.title, self.entries = obj["fName"], obj["fTitle"], int(obj["fEntries"])
        self.branches: dict[str, Branch] = {}
        self._gather(obj["fBranches"], "")

    def _gather(self, items: list, prefix: str) -> None:
        for b in items:
            path = prefix + b["fName"].rstrip(".") if not prefix else f"{prefix}/{b['fName']}"
            own = Branch(self, b, path)
            if b.get("fBranches"):
                self._gather(b["fBranches"], path)
            else:
                self.branches[path] = own

    def branch(self, path: str) -> Branch | None:
        return self.branches.get(path)

    @property
    def aliases(self) -> dict[str, str]:
        """Names that stand for expressions."""
        return {a["fName"]: a["fTitle"] for a in self.obj.get("fAliases") or ()}

    @property
    def friends(self) -> list[tuple[str, str, bool]]:
        """(name, tree, whether it is in this file) of the trees whose columns go with this one's."""
        return [(f["fName"], f["fTreeName"], bool(f["fOwnFile"])) for f in self.obj.get("fFriends") or ()]

    @property
    def index(self) -> Obj | None:
        """The index of the tree; one of the old form has no names of its keys."""
        if found := self.obj.get("fTreeIndex"):
            return found
        values, order = self.obj.get("fIndexValues"), self.obj.get("fIndex")
        values, order = (x["[base]"] if isinstance(x, Obj) else x for x in (values, order))
        if order is None or not len(order):
            return None
        return Obj("TTreeIndex", 0, {"fMajorName": "", "fMinorName": "", "fN": len(order), "fIndexValues": values, "fIndexValuesMinor": np.zeros(0, np.int64), "fIndex": order})

    def ranges(self, names: list[str]) -> list[tuple[int, int]]:
        """Ranges of entries at whose ends baskets of all these branches end."""
        common: set[int] | None = None
        for n in names:
            own = {c.last for c in self.branches[n].chunks()}
            common = own if common is None else common & own
        ends = sorted({e for e in common or () if 0 < e < self.entries} | ({self.entries} if self.entries else set()))
        return list(zip([0, *ends[:-1]], ends, strict=True))

    def chunk_bytes(self, names: list[str]) -> list[tuple[int, int, int, int]]:
        """(first entry, last entry, stored bytes, bytes as they are) of each common range, the second by the ratio of the whole branch."""
        out = []
        for first, last in self.ranges(names):
            zipped = raw = 0.0
            for n in names:
                b = self.branches[n]
                own = sum(c.nbytes for c in b.chunks() if first <= c.first < last)
                zipped += own
                raw += own * (b.obj["fTotBytes"] / b.obj["fZipBytes"] if b.obj["fZipBytes"] else 1)
            out.append((first, last, int(zipped), round(raw)))
        return out


@dataclass
class Branch:
    tree: Tree
    obj: Obj
    path: str
    _layout: Layout | None = field(default=None, repr=False)

    @property
    def entries(self) -> int:
        return int(self.obj["fEntries"])

    def chunks(self) -> list[Chunk]:
        """The baskets in order; the last may be one that was never flushed."""
        seeks, sizes, begins = self.obj["fBasketSeek"], self.obj["fBasketBytes"], self.obj["fBasketEntry"]
        own = [b for b in self.obj.get("fBaskets") or () if isinstance(b, Obj) and b.cls == "TBasket" and "data" in b.members]
        n = int(self.obj["fWriteBasket"])
        out = []
        for i in range(n):
            if not int(seeks[i]):
                break
            last = int(begins[i + 1]) if i + 1 < len(begins) and int(begins[i + 1]) > int(begins[i]) else self.entries
            out.append(Chunk(int(begins[i]), last, int(seeks[i]), int(sizes[i])))
        for b in own:
            first = out[-1].last if out else 0
            if first < self.entries:
                off = None if b["offsets"] is None else tuple(int(x) for x in b["offsets"])
                out.append(Chunk(first, min(self.entries, first + b["n"]) if b["n"] else self.entries, data=b["data"], offsets=off))
        return out

    @property
    def streamer(self):
        """The member of its class that this branch holds, if the file says."""
        if "fClassName" not in self.obj.members or self.obj["fID"] < 0:
            return None
        known = self.tree.container.layouts.get(self.obj["fClassName"])
        if not known:
            return None
        elements = known.get(self.obj["fClassVersion"]) or known[max(known)]
        return elements[self.obj["fID"]] if self.obj["fID"] < len(elements) else None

    def layout(self, custom: dict[str, Record] | None = None) -> Layout:
        """How cells are stored. `custom` maps class names, or Class.member, to records of users; they come before what the file says."""
        leaves, custom = self.obj["fLeaves"], custom or {}
        leaf = leaves[0]
        dims = _DIMS.findall(leaf["fTitle"])
        if "fClassName" not in self.obj.members:
            if len(leaves) > 1:
                return Layout("leaves", leaves=tuple((x["fName"], self._number(x), max(1, x["fLen"])) for x in leaves))
            if leaf.cls == "TLeafC":
                return Layout("string")
            fixed = max(1, leaf["fLen"])
            varying = any(not d.isdigit() for d in dims) or (dims and fixed == 1 and dims != ["1"])
            return Layout("jagged" if varying else "flat", self._number(leaf), 0, fixed)
        cls, element = self.obj["fClassName"], self.streamer
        own = custom.get(f"{cls}.{self.obj['fTitle']}") or (custom.get(cls) if cls != self.obj["fParentName"] else None)
        if own is not None:
            return Layout("records" if own.skip else "record", record=own)
        kind, spelling = (element.kind, element.type_name) if element else ("", "")
        if kind == "TStreamerString":
            return Layout("string")
        if spelling.replace("std::", "") == "string":
            return Layout("strings", skip=STRING_HEAD)
        for s in (spelling, cls):
            found = self._vector(s, bool(dims), custom)
            if found:
                return found
        if cls == "TLorentzVector" or spelling == "TLorentzVector":
            return Layout("record", record=FOUR_VECTOR)
        code = leaf["fType"]
        code -= 20 if 20 < code < 40 else 40 if 40 < code < 60 else 0
        if code not in BASIC:
            raise NotImplementedError(f"branch {self.path} of class {cls or spelling}")
        if self.obj["fType"] == STL_MEMBER or dims and any(not d.isdigit() for d in dims):
            return Layout("jagged", BASIC[code], 0)
        if leaf["fLenType"] == 0 and kind not in ("TStreamerBasicType", ""):
            return Layout("jagged", BASIC[code], VECTOR_HEAD)
        return Layout("flat", BASIC[code], 0, max(1, leaf["fLen"]))

    def _number(self, leaf: Obj) -> str:
        if leaf.cls == "TLeafElement":
            return BASIC[leaf["fType"] % 20 if leaf["fType"] > 20 else leaf["fType"]]
        return LEAVES[leaf.cls][bool(leaf["fIsUnsigned"])]

    def _vector(self, spelling: str, dims: bool, custom: dict[str, Record]) -> Layout | None:
        """The layout of vector<T> and vector<vector<T>>; a member of split collections has its cells without heads."""
        name, args = parse_type(spelling)
        if name != "vector":
            return None
        inner, inner_args = parse_type(args[0])
        if inner == "vector" and inner_args[0] in CPP:
            return Layout("nested", CPP[inner_args[0]], VECTOR_HEAD)
        if args[0] in custom:
            return Layout("records", record=replace(custom[args[0]], skip=VECTOR_HEAD))
        if args[0] in ("TLorentzVector",):
            return Layout("records", record=replace(FOUR_VECTOR, skip=VECTOR_HEAD))
        if inner == "string":
            return Layout("strings", skip=VECTOR_HEAD)
        if inner in CPP:
            return Layout("nested", CPP[inner], STRING_HEAD) if dims else Layout("jagged", CPP[inner], VECTOR_HEAD)
        return None

    def plan(self, name: str, custom: dict[str, Record] | None = None, raw: bool = False) -> Plan:
        return Plan(name, Layout("raw") if raw else self.layout(custom), tuple(self.chunks()))


# ---- reading ----


def read_chunk(source, c: Chunk) -> tuple[bytes, np.ndarray | None]:
    """The content of a basket, and where its cells begin and the last ends, if it says so."""
    if c.data is not None:
        return c.data, None if c.offsets is None else np.array(c.offsets, np.int64)
    stored = source.read(c.seek, c.nbytes)
    k = Cursor(stored)
    nbytes, version, objlen, _, keylen, _ = k.take("ihiIhh")
    k.take("qq" if version > 1000 else "ii")
    for _ in range(3):
        k.string()
    _, _, _, _, last = k.take("hiiii")
    raw = stored[keylen:nbytes]
    if objlen != nbytes - keylen:
        raw = decompress(raw, objlen)
    size = last - keylen
    if objlen - size - 8 > 0:
        off = np.frombuffer(raw[size + 4 : objlen - 4], ">i4").astype(np.int64) - keylen
        return raw[:size], np.append(off, size)
    return raw[:size], None


def _lists(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def _even(n: int, size: int) -> np.ndarray:
    return np.arange(n + 1, dtype=np.int64) * size


def decode(layout: Layout, data: bytes, off: np.ndarray | None, n: int) -> pa.Array:
    """n cells from the content of a basket."""
    raw = np.frombuffer(data, np.uint8)
    if layout.kind == "flat":
        x = np.frombuffer(data, layout.dtype, n * layout.fixed)
        values = wide(x.astype(x.dtype.newbyteorder("=")))
        return _lists(values, np.full(n, layout.fixed)) if layout.fixed > 1 else values
    if layout.kind == "leaves":
        x = np.frombuffer(data, np.dtype([(m, d, (k,)) for m, d, k in layout.leaves]), n)
        parts = [wide(np.ascontiguousarray(x[m]).ravel().astype(np.dtype(d).newbyteorder("="))) for m, d, _ in layout.leaves]
        parts = [_lists(p, np.full(n, k)) if k > 1 else p for p, (_, _, k) in zip(parts, layout.leaves, strict=True)]
        return pa.StructArray.from_arrays(parts, [m for m, _, _ in layout.leaves])
    if layout.kind == "record":
        return layout.record.structs(raw[: n * layout.record.dtype.itemsize])
    off = _even(n, len(data) // n if n else 0) if off is None and layout.kind != "string" else off
    if layout.kind == "raw":
        return pa.array([data[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], pa.binary())
    if layout.kind == "string":
        if off is None:
            return pa.array(strings(data)[:n], pa.string())
        return pa.array([Cursor(data, a).string() if b > a else "" for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], pa.string())
    if layout.kind == "strings":
        return pa.array([strings(data[a + layout.skip : b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], pa.list_(pa.string()))
    if layout.kind == "records":
        return layout.record.cut(raw, off)
    if layout.kind == "nested":
        return _nested(layout, data, off)
    size = np.dtype(layout.dtype).itemsize * layout.fixed
    count = np.maximum(np.diff(off) - layout.skip, 0) // size
    length = count * size
    at = np.repeat(off[:-1] + layout.skip - (np.cumsum(length) - length), length) + np.arange(length.sum())
    x = np.ascontiguousarray(raw[at]).view(layout.dtype)
    values = wide(x.astype(x.dtype.newbyteorder("=")))
    if layout.fixed > 1:
        values = _lists(values, np.full(count.sum(), layout.fixed))
    return _lists(values, count)


def _nested(layout: Layout, data: bytes, off: np.ndarray) -> pa.Array:
    """Cells of counted runs: a count of four bytes, then so many numbers."""
    size, outer, inner, spans = np.dtype(layout.dtype).itemsize, [], [], []
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        at, runs = a + layout.skip, 0
        while at + 4 <= b:
            n = int.from_bytes(data[at : at + 4], "big")
            spans.append(data[at + 4 : at + 4 + n * size])
            inner.append(n)
            at += 4 + n * size
            runs += 1
        outer.append(runs)
    x = np.frombuffer(b"".join(spans), layout.dtype)
    values = wide(x.astype(x.dtype.newbyteorder("=")))
    return _lists(_lists(values, np.array(inner, np.int64)), np.array(outer, np.int64))


def read_entries(source, plan: Plan, first: int, last: int) -> pa.ChunkedArray:
    """Entries [first, last) of a branch; only baskets with some of them are read."""
    out = []
    for c in plan.within(first, last).chunks:
        data, off = read_chunk(source, c)
        a, b = max(first, c.first) - c.first, min(last, c.last) - c.first
        out.append(decode(plan.layout, data, off, c.last - c.first).slice(a, b - a))
    return pa.chunked_array(out) if out else pa.chunked_array([decode(plan.layout, b"", None if plan.layout.kind in ("flat", "leaves", "record") else np.zeros(1, np.int64), 0)])


def rebased(parts: list[tuple[bytes, np.ndarray]]) -> tuple[bytes, np.ndarray]:
    """Contents one after another, and offsets into the whole."""
    off, at = [np.zeros(1, np.int64)], 0
    for data, own in parts:
        off.append(own[1:] + at)
        at += len(data)
    return b"".join(d for d, _ in parts), np.concatenate(off)
