"""Writes files of trees and other objects: keys, baskets and objects by layouts that are given with them.

The readers are held against these files; they hold just those members of a class that readers look at.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .describe import Out, layout_list
from .framing import compress
from .ntuple_write import _short, key
from .objects import CPP

TIME = 0x76DB5093
#: Classes of trees with just the members that readers look at.
LEAF = [("base", "TNamed", 1), ("basic", "fLen", "int"), ("basic", "fLenType", "int"), ("basic", "fOffset", "int"), ("basic", "fIsRange", "bool"), ("basic", "fIsUnsigned", "bool"), ("pointer", "fLeafCount", "TLeaf")]
BRANCH = [
    ("base", "TNamed", 1), ("base", "TAttFill", 1), ("basic", "fCompress", "int"), ("basic", "fBasketSize", "int"), ("basic", "fEntryOffsetLen", "int"), ("basic", "fWriteBasket", "int"),
    ("basic", "fEntryNumber", "Long64_t"), ("basic", "fOffset", "int"), ("basic", "fMaxBaskets", "int"), ("basic", "fSplitLevel", "int"), ("basic", "fEntries", "Long64_t"), ("basic", "fTotBytes", "Long64_t"),
    ("basic", "fZipBytes", "Long64_t"), ("object", "fBranches", "TObjArray"), ("object", "fLeaves", "TObjArray"), ("object", "fBaskets", "TObjArray"),
    ("counted", "fBasketBytes", "int", "fMaxBaskets"), ("counted", "fBasketEntry", "Long64_t", "fMaxBaskets"), ("counted", "fBasketSeek", "Long64_t", "fMaxBaskets"), ("string", "fFileName"),
]
ELEMENT_BRANCH = [
    ("base", "TBranch", 13), ("string", "fClassName"), ("string", "fParentName"), ("string", "fClonesName"), ("basic", "fCheckSum", "unsigned int"), ("basic", "fClassVersion", "short"),
    ("basic", "fID", "int"), ("basic", "fType", "int"), ("basic", "fStreamerType", "int"), ("basic", "fMaximum", "int"), ("pointer", "fBranchCount", "TBranchElement"), ("pointer", "fBranchCount2", "TBranchElement"),
]
TREE = [
    ("base", "TNamed", 1), ("base", "TAttFill", 1), ("basic", "fEntries", "Long64_t"), ("object", "fBranches", "TObjArray"), ("object", "fLeaves", "TObjArray"),
    ("pointer", "fAliases", "TList"), ("pointer", "fTreeIndex", "TVirtualIndex"), ("pointer", "fFriends", "TList"),
]
FRIEND = [("base", "TNamed", 1), ("string", "fTreeName"), ("basic", "fOwnFile", "bool")]
LAYOUTS = [
    ("TAttFill", 2, [("basic", "fFillColor", "short"), ("basic", "fFillStyle", "short")]),
    ("TLeaf", 2, LEAF),
    *[(f"TLeaf{k}", 1, [("base", "TLeaf", 2), ("basic", "fMinimum", c), ("basic", "fMaximum", c)]) for k, c in (("B", "char"), ("S", "short"), ("I", "int"), ("L", "Long64_t"), ("F", "float"), ("D", "double"), ("O", "bool"), ("C", "int"))],
    ("TLeafElement", 1, [("base", "TLeaf", 2), ("basic", "fID", "int"), ("basic", "fType", "int")]),
    ("TBranch", 13, BRANCH), ("TBranchElement", 10, ELEMENT_BRANCH), ("TTree", 20, TREE), ("TFriendElement", 2, FRIEND),
    ("TNtuple", 2, [("base", "TTree", 20), ("basic", "fNvar", "int")]),
]


def encode(out: Out, layouts: dict, cls: str, m: dict) -> None:
    """An object of class `cls` with members m, as its layout has it; missing numbers are 0, missing strings empty, missing pointers null."""
    version, members = layouts[cls]

    def body():
        for e in members:
            kind, name, *more = e
            if kind == "base":
                if name == "TObject":
                    out.tobject()
                elif name == "TNamed":
                    out.named(m.get("fName", ""), m.get("fTitle", ""))
                elif name.startswith("TArray"):
                    x = np.asarray(m["array"], {"D": ">f8", "F": ">f4", "I": ">i4"}[name[-1]])
                    out.put("i", len(x)).data.extend(x.tobytes())
                else:
                    encode(out, layouts, name, m)
            elif kind in ("basic", "counted"):
                x = np.atleast_1d(np.asarray(m.get(name, () if kind == "counted" else 0))).astype(CPP[more[0]])
                if kind == "counted":
                    out.put("b", 1)
                out.data.extend(x.tobytes())
            elif kind == "string":
                out.string(m.get(name, ""))
            elif kind == "pointer":
                v = m.get(name)
                out.pointer(*((None,) if v is None else v))
            else:
                v = m.get(name)
                if callable(v):
                    v()
                elif more[0] in ("TObjArray", "TList", "THashList"):
                    out.objects(v or [], "TObjArray" if more[0] == "TObjArray" else "TList")
                else:
                    encode(out, layouts, more[0], v or {})

    out.counted(version, body)


class Builder:
    """A file with objects; `layouts` are those of the file beside LAYOUTS."""

    def __init__(self, layouts: list[tuple] = (), setting: int = 101, name: str = "built.root"):
        self.list = [*LAYOUTS, *layouts]
        self.layouts = {c: (v, m) for c, v, m in self.list}
        self.setting, self.name, self.keys = setting, name, []
        self.name_bytes = len(key("TFile", name, "", 0, 0, 100, 0, TIME)) + len(_short(name)) + 1
        self.data = bytearray(b"\0" * (100 + self.name_bytes + 60))

    def stored(self, cls: str, name: str, payload: bytes, title: str = "", cycle: int = 1) -> bytes:
        """Write a key and its payload; gives the key."""
        z = compress(payload, self.setting)
        k = bytearray(key(cls, name, title, len(z), len(payload), len(self.data), 100, TIME))
        struct.pack_into(">h", k, 16, cycle)
        self.data += k + z
        return bytes(k)

    def add(self, cls: str, name: str, write, title: str = "", cycle: int = 1, into: list | None = None) -> None:
        """An object of the top directory, or of `into`: write(out) puts its bytes."""
        out = Out(len(key(cls, name, title, 0, 0, 0, 0, 0)))
        write(out)
        (self.keys if into is None else into).append(self.stored(cls, name, bytes(out.data), title, cycle))

    def object(self, cls: str, name: str, members: dict, **more) -> None:
        self.add(cls, name, lambda out: encode(out, self.layouts, cls, members(out) if callable(members) else members), **more)

    def directory(self, name: str, keys: list[bytes], into: list | None = None) -> None:
        listed = struct.pack(">i", len(keys)) + b"".join(keys)
        at = len(self.data)
        self.data += key("TDirectory", name, "", len(listed), len(listed), at, 100, TIME) + listed
        size = len(self.data) - at
        self.add("TDirectory", name, lambda out: out.put("hIIiiiii", 5, TIME, TIME, size, 0, 100, 100, at), into=into)

    def basket(self, branch: str, data: bytes, offsets: list[int] | None, n: int) -> tuple[int, int]:
        """Place and size of a basket: offsets of cells are from the beginning of data."""
        head = key("TBasket", branch, "tree", 0, 0, 0, 0, TIME)
        keylen = len(head) + 19
        tail = b"" if offsets is None else struct.pack(">i", n + 1) + np.array([o + keylen for o in offsets], ">i4").tobytes() + b"\0" * 4
        raw = data + tail
        z = compress(raw, self.setting)
        at = len(self.data)
        k = bytearray(key("TBasket", branch, "tree", len(z), len(raw), at, 100, TIME))
        struct.pack_into(">i", k, 0, keylen + len(z))
        struct.pack_into(">h", k, 14, keylen)
        self.data += k + struct.pack(">hiiii", 3, 32000, 1000 if offsets else 0, n, keylen + len(data)) + b"\0" + z
        return at, keylen + len(z)

    def branch(self, out: Out, name: str, leaves: list, chunks: list, *, element: dict | None = None, inner: list = (), title: str = "", recovered=None):
        """(class, writer) of a branch. leaves: (class, members); chunks: (data, offsets, cells); recovered: such a chunk that was never flushed."""
        placed = [(*self.basket(name, *c), c[2], len(c[0])) for c in chunks]
        counts = [p[2] for p in placed]
        first = np.concatenate([[0], np.cumsum(counts)]).astype(int)
        entries = int(first[-1]) + (recovered[2] if recovered else 0)
        m = {
            "fName": name, "fTitle": title or name, "fWriteBasket": len(placed), "fMaxBaskets": len(first) + 1, "fEntries": entries, "fTotBytes": sum(p[3] for p in placed) + 100, "fZipBytes": sum(p[1] for p in placed) or 1,
            "fBasketBytes": [p[1] for p in placed] + [0, 0], "fBasketEntry": [*first, 0], "fBasketSeek": [p[0] for p in placed] + [0, 0],
            "fBranches": list(inner), "fLeaves": [(c, lambda c=c, x=x: encode(out, self.layouts, c, x)) for c, x in leaves],
            "fBaskets": [("TBasket", lambda: self.embedded(out, name, *recovered))] if recovered else [],
        } | (element or {})
        cls = "TBranch" if element is None else "TBranchElement"
        return cls, lambda: encode(out, self.layouts, cls, m)

    def embedded(self, out: Out, name: str, data: bytes, offsets: list[int] | None, n: int) -> None:
        head = key("TBasket", name, "tree", 0, 0, 0, 0, TIME)
        keylen = len(head) + 19
        k = bytearray(head)
        struct.pack_into(">h", k, 14, keylen)
        out.data.extend(k)
        out.put("hiiii", 3, 32000, 1000 if offsets else 0, n, keylen + len(data)).put("b", 0)
        if offsets is not None:
            out.put("i", n).data.extend(np.array([o + keylen for o in offsets], ">i4").tobytes())
        out.data.extend(b"\0" * keylen + data)

    def tree(self, name: str, branches, entries: int, cls: str = "TTree", extra=None, **more) -> None:
        """branches(out) gives what `branch` gives; extra(out) further members."""
        self.object(cls, name, lambda out: {"fName": name, "fTitle": name, "fEntries": entries, "fBranches": branches(out), **(extra(out) if extra else {})}, **more)

    def finish(self) -> bytes:
        listed = struct.pack(">i", len(self.keys)) + b"".join(self.keys)
        keys_at = len(self.data)
        self.data += key("", self.name, "", len(listed), len(listed), keys_at, 100, TIME) + listed
        size = len(self.data) - keys_at
        info_at = len(self.data)
        info = layout_list(self.list)
        z = compress(info, self.setting)
        self.data += key("TList", "StreamerInfo", "Doubly linked list", len(z), len(info), info_at, 100, TIME) + z
        info_size = len(self.data) - info_at
        head = b"root" + struct.pack(">iiiiiiiBiii", 63000, 100, len(self.data), 0, 0, 0, self.name_bytes, 4, self.setting, info_at, info_size)
        self.data[: len(head)] = head
        top = key("TFile", self.name, "", 0, 0, 100, 0, TIME) + _short(self.name) + b"\0"
        top += struct.pack(">hIIiiiii", 5, TIME, TIME, size, self.name_bytes, 100, 0, keys_at)
        self.data[100 : 100 + len(top)] = top
        return bytes(self.data)



#: Spark types and how trees store them.
KINDS = {T.ByteType(): "i1", T.ShortType(): ">i2", T.IntegerType(): ">i4", T.LongType(): ">i8", T.FloatType(): ">f4", T.DoubleType(): ">f8", T.BooleanType(): "?", T.StringType(): "string"}


def write_trees(df: DataFrame, folder: str, name: str = "tree", rows: int = 100_000, basket: int = 1000) -> int:
    """df as trees in a folder, a file for each `rows` rows of a partition; gives the number of files. Numbers, booleans, strings and lists of numbers.

    Names of files go by partition and place in it. Nulls become zeros, empty texts and empty lists. A repeated task writes the same name anew.
    """
    kinds = {}
    for f in df.schema.fields:
        t = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
        if t not in KINDS:
            raise TypeError(f"no branch for {f.name} of type {f.dataType.simpleString()}")
        kinds[f.name] = KINDS[t]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, top = pa.fs.FileSystem.from_uri(folder) if re.match(r"[a-z0-9+.-]+:", folder) else (pa.fs.LocalFileSystem(), folder)
        fs.create_dir(top, recursive=True)
        part, held, n, files = TaskContext.get().partitionId(), [], 0, 0

        def flush() -> None:
            nonlocal held, n, files
            table = pa.Table.from_batches(held)
            columns = {c: (k, _plain(table[c].combine_chunks(), k)) for c, k in kinds.items()}
            hidden, shown = f"{top}/.{uuid.uuid4().hex}", f"{top}/part-{part:06d}-{files:04d}.root"
            with fs.open_output_stream(hidden) as s:
                s.write(write_tree(columns, name, basket))
            fs.move(hidden, shown)
            held, n, files = [], 0, files + 1

        for b in batches:
            while len(b):
                held.append(b.slice(0, rows - n))
                n += len(held[-1])
                b = b.slice(len(held[-1]))
                if n == rows:
                    flush()
        if n:
            flush()
        yield pa.record_batch([pa.array([files])], ["files"])

    return df.mapInArrow(put, "files long").agg({"files": "sum"}).first()[0] or 0


class Lists:
    """Lists of numbers, one after another, with where each begins."""

    def __init__(self, x: pa.Array, kind: str):
        flat = x.flatten()
        if flat.null_count and not pa.types.is_floating(flat.type):
            raise TypeError("a null within a list")
        self.numbers = flat.to_numpy(zero_copy_only=False).astype(kind)
        self.begins = np.concatenate([[0], np.cumsum(pc.list_value_length(x).fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)

    def __len__(self) -> int:
        return len(self.begins) - 1

    def basket(self, first: int, last: int) -> tuple[bytes, list[int], int]:
        """Content, offsets and number of the cells [first, last)."""
        at = self.begins[first : last + 1]
        return self.numbers[at[0] : at[-1]].tobytes(), ((at[:-1] - at[0]) * self.numbers.itemsize).tolist(), last - first


def _plain(x: pa.Array, kind: str):
    if pa.types.is_list(x.type):
        return Lists(x, kind)
    return x.fill_null("").to_pylist() if kind == "string" else x.fill_null(False if kind == "?" else 0).to_numpy(zero_copy_only=False)


def flat_leaf(name: str, dtype: str, counted: str = "") -> tuple[str, dict]:
    """The leaf of numbers of a big-endian numpy kind; `counted` names the branch that says how many there are in a cell."""
    cls = {"i1": "B", "i2": "S", "i4": "I", "i8": "L", "f4": "F", "f8": "D", "?": "O"}[dtype.lstrip(">")]
    return f"TLeaf{cls}", {"fName": name, "fTitle": f"{name}[{counted}]" if counted else name, "fLen": 1, "fLenType": np.dtype(dtype).itemsize}


def write_tree(columns: dict[str, tuple[str, list]], name: str = "tree", basket: int = 1000, setting: int = 101) -> bytes:
    """A file with one tree. columns: name to (numpy kind, numbers), ("string", texts), (kind, lists of numbers) or (kind, Lists), of one length; baskets of `basket` entries."""
    b = Builder(setting=setting)
    n = len(next(iter(columns.values()))[1]) if columns else 0

    def one(out, column):
        kind, values = columns[column]
        chunks, lists = [], isinstance(values, Lists) or n and kind != "string" and isinstance(values[0], (list, np.ndarray))
        for at in range(0, n, basket):
            if isinstance(values, Lists):
                chunks.append(values.basket(at, min(at + basket, n)))
                continue
            part = values[at : at + basket]
            if kind == "string":
                cells = [_short(x) for x in part]
            elif lists:
                cells = [np.asarray(x, kind).tobytes() for x in part]
            else:
                chunks.append((np.asarray(part, kind).tobytes(), None, len(part)))
                continue
            off = np.cumsum([0, *map(len, cells)])[:-1]
            chunks.append((b"".join(cells), off.tolist(), len(cells)))
        if kind == "string":
            leaf = "TLeafC", {"fName": column, "fTitle": column, "fLen": 1, "fLenType": 1}
        else:
            leaf = flat_leaf(column, kind, "n" if lists else "")
        return b.branch(out, column, [leaf], chunks)

    b.tree(name, lambda out: [one(out, c) for c in columns], n)
    return b.finish()
