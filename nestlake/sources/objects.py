"""Objects of the container: a cursor over big-endian bytes, and a reader of any class by the layout that the file describes.

A file lists the layout of each class version in it as streamer elements: base classes, numbers, fixed and counted arrays, strings,
inline objects and pointers. `Reader` follows them, so no class is written out here but those that describe the layouts, the
collections and a few with rules of their own.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

#: Fixed values of the format: flags of byte counts and class tags, and what is added to places in the map of references.
BYTE_COUNT, NEW_CLASS, CLASS_MASK, MAP_OFFSET = 0x40000000, 0xFFFFFFFF, 0x80000000, 2
IS_REFERENCED, STREAMED_MEMBERWISE = 1 << 4, 1 << 14
#: Codes of basic types and how they are stored.
BASIC = {1: "i1", 2: ">i2", 3: ">i4", 4: ">i8", 5: ">f4", 6: ">i4", 8: ">f8", 9: ">f4", 10: "i1", 11: "u1", 12: ">u2", 13: ">u4", 14: ">u8", 15: ">u4", 16: ">i8", 17: ">u8", 18: "?", 19: ">f2"}
#: Names of basic types in C++ and how they are stored.
CPP = {
    "bool": "?", "Bool_t": "?", "char": "i1", "Char_t": "i1", "signed char": "i1", "int8_t": "i1", "unsigned char": "u1", "UChar_t": "u1", "uint8_t": "u1",
    "short": ">i2", "Short_t": ">i2", "int16_t": ">i2", "unsigned short": ">u2", "UShort_t": ">u2", "uint16_t": ">u2",
    "int": ">i4", "Int_t": ">i4", "int32_t": ">i4", "unsigned int": ">u4", "unsigned": ">u4", "UInt_t": ">u4", "uint32_t": ">u4",
    "long": ">i8", "Long_t": ">i8", "long long": ">i8", "Long64_t": ">i8", "int64_t": ">i8", "unsigned long": ">u8", "ULong_t": ">u8", "unsigned long long": ">u8", "ULong64_t": ">u8", "uint64_t": ">u8",
    "float": ">f4", "Float_t": ">f4", "Double32_t": ">f4", "Float16_t": ">f2", "double": ">f8", "Double_t": ">f8",
}
_ARRAYS = {"TArrayD": ">f8", "TArrayF": ">f4", "TArrayI": ">i4"}
#: Classes that are known and left unread.
UNSUPPORTED = ("TRef", "TArray", "TArrayC", "TArrayS", "TArrayL", "TArrayL64", "TRefArray")


def safe_name(name: str) -> str:
    """A class name that is an identifier."""
    return name.replace("::", "_3a3a_")


class Cursor:
    """A place in bytes. `origin` is what is added to places for the map of references: the length of the key before them."""

    def __init__(self, data: bytes, at: int = 0, origin: int = 0):
        self.data, self.at, self.origin = data, at, origin

    def take(self, form: str):
        s = struct.Struct(">" + form)
        out = s.unpack_from(self.data, self.at)
        self.at += s.size
        return out[0] if len(out) == 1 else out

    def bytes(self, n: int) -> bytes:
        self.at += n
        return self.data[self.at - n : self.at]

    def array(self, dtype: str, n: int) -> np.ndarray:
        d = np.dtype(dtype)
        out = np.frombuffer(self.data, d, n, self.at)
        self.at += d.itemsize * n
        return out.astype(d.newbyteorder("="))

    def string(self) -> str:
        """One byte of length, or 255 and four bytes of it; then the text."""
        n = self.take("B")
        return self.bytes(self.take("I") if n == 255 else n).decode("utf-8", "replace")

    def cstring(self) -> str:
        """Text up to a zero byte."""
        end = self.data.index(b"\0", self.at)
        out = self.data[self.at : end].decode("utf-8", "replace")
        self.at = end + 1
        return out

    def header(self) -> tuple[int, int | None]:
        """Version of the object that begins here and where it ends, if that is counted. A class without versions has a checksum behind."""
        begin = self.at
        n = self.take("I")
        if n & BYTE_COUNT:
            version = self.take("h")
            end = begin + 4 + (n & ~BYTE_COUNT)
            if version <= 0 and end - self.at >= 4:
                self.at += 4
            return version, end
        self.at = begin
        return self.take("h"), None

    def finish(self, end: int | None, what: str = "object") -> None:
        """Check that an object ends where it says."""
        if end is not None and self.at != end:
            raise ValueError(f"{what} ends at {self.at} instead of {end}")


def strings(data: bytes) -> list[str]:
    """Strings with their lengths before them, up to the first that is cut off."""
    c, out = Cursor(data), []
    while c.at < len(data):
        try:
            n = c.take("B")
            n = c.take("I") if n == 255 else n
        except struct.error:
            break
        if c.at + n > len(data):
            break
        out.append(c.bytes(n).decode("utf-8", "replace"))
    return out


@dataclass
class Element:
    kind: str
    name: str
    title: str
    type: int
    length: int
    type_name: str
    more: dict = field(default_factory=dict)


@dataclass
class Obj:
    """An object that was read: its class, version and members by name, those of base classes among them."""

    cls: str
    version: int = 0
    members: dict = field(default_factory=dict)

    def __getitem__(self, name: str):
        return self.members[name]

    def get(self, name: str, default=None):
        return self.members.get(name, default)


class Reader:
    """Reads objects by the layouts of a file: (class, version) to elements. `custom` has readers of classes that users add."""

    def __init__(self, layouts: dict[str, dict[int, list[Element]]] | None = None, custom: dict[str, Callable] | None = None):
        self.layouts, self.custom = layouts or {}, custom or {}
        self.refs: dict[int, object] = {}

    def elements(self, cls: str, version: int) -> list[Element]:
        """The layout of a class version; that of the only one known, if the version isn't."""
        known = self.layouts.get(cls)
        if not known:
            raise NotImplementedError(f"no layout of class {cls}")
        if version in known:
            return known[version]
        if len(known) == 1:
            return next(iter(known.values()))
        raise NotImplementedError(f"class {cls} has no version {version}")

    def pointer(self, c: Cursor):
        """The object that a pointer stands for: written here, or a reference to one before; None for a null pointer."""
        begin = c.at
        n = c.take("I")
        if n & BYTE_COUNT and n != NEW_CLASS:
            at, tag, end = c.at, c.take("I"), begin + 4 + (n & ~BYTE_COUNT)
        else:
            at, tag, end = begin, n, None
        if not tag & CLASS_MASK:
            if tag in (0, 1):
                return None
            if tag not in self.refs:
                raise ValueError(f"reference to {tag}, where nothing begins")
            return self.refs[tag]
        if tag == NEW_CLASS:
            cls = c.cstring()
            self.refs[at + c.origin + MAP_OFFSET] = cls
        else:
            cls = self.refs[tag & ~CLASS_MASK]
        place = begin + c.origin + MAP_OFFSET
        out = Obj(cls)
        self.refs[place] = out  # members may refer to it
        try:
            got = self.read(c, cls, out)
        except NotImplementedError:
            if end is None:
                raise
            got = out
        if got is not out:
            self.refs[place] = got
        if end is not None:
            c.at = end
        return got

    def read(self, c: Cursor, cls: str, into: Obj | None = None):
        """The object of class `cls` that begins here."""
        if cls in self.custom:
            return self.custom[cls](self, c)
        if cls in UNSUPPORTED:
            raise NotImplementedError(f"class {cls} is not supported")
        if own := _OWN.get(cls):
            return own(self, c)
        if cls in _ARRAYS:
            return c.array(_ARRAYS[cls], c.take("i"))
        if cls.startswith("TMatrixTSym<"):
            return _symmetric(self, c)
        version, end = c.header()
        out = into or Obj(cls)
        out.version = version
        if cls == "TBranch" and version < 10:
            _old_branch(self, c, out)
            c.finish(end, cls)
            return out
        for e in self.elements(cls, version):
            self.member(c, e, out, end)
        c.finish(end, cls)
        return out

    def member(self, c: Cursor, e: Element, out: Obj, end: int | None) -> None:
        t, m = e.type, out.members
        if e.kind == "TStreamerBase" or t == 0:
            if e.name == "TObject":
                m.update(_tobject(self, c).members)
                return
            got = self.read(c, e.name)
            if isinstance(got, Obj):
                m.update(got.members)
            else:  # arrays and lists as bases
                m["[base]"] = got
        elif t in BASIC and t != 15:
            m[e.name] = c.array(BASIC[t], 1)[0].item()
        elif t == 15:  # bits of a TObject
            m[e.name] = c.take("I")
            if m[e.name] & IS_REFERENCED:
                c.take("H")
        elif t - 20 in BASIC:
            m[e.name] = c.array(BASIC[t - 20], e.length)
        elif t - 40 in BASIC:
            c.take("b")
            m[e.name] = c.array(BASIC[t - 40], m[e.more["count"]])
        elif t == 65:
            m[e.name] = c.string()
        elif t == 66:
            m[e.name] = _tobject(self, c)
        elif t == 67:
            m[e.name] = _named(self, c)
        elif t in (61, 62, 63, 68):
            m[e.name] = self.read(c, e.type_name.rstrip("*").strip())
        elif t in (64, 69):
            m[e.name] = self.pointer(c)
        elif t - 20 in (61, 62):
            m[e.name] = [self.read(c, e.type_name) for _ in range(e.length)]
        elif t in (300, 365, 500) or e.kind in ("TStreamerSTL", "TStreamerSTLstring"):
            m[e.name] = self.container(c, e.type_name)
        elif t == 7:
            m[e.name] = c.bytes(c.take("i")).decode("utf-8", "replace")
        elif end is not None:  # what can't be read is the rest of its object
            m[e.name] = c.bytes(end - c.at)
        else:
            raise NotImplementedError(f"member {e.name} of type {t}")

    def container(self, c: Cursor, spelling: str):
        """A string, vector or map of the standard library, with its header."""
        if spelling.rstrip("*").strip() in ("string", "std::string"):
            _, end = c.header()
            out = c.string()
        else:
            version, end = c.header()
            if not version & STREAMED_MEMBERWISE:
                out = self.items(c, spelling.rstrip("*").strip())
            elif parse_type(spelling) == ("map", ["string", "string"]):
                if c.take("h") <= 0:  # version of the pair; without one its checksum follows
                    c.take("I")
                n = c.take("i")
                c.header()
                keys = [c.string() for _ in range(n)]
                c.header()
                out = dict(zip(keys, [c.string() for _ in range(n)], strict=True))
            else:
                raise NotImplementedError(f"{spelling} by members")
        if end is not None:
            c.at = end
        return out

    def items(self, c: Cursor, spelling: str):
        """What a type is as an item of a container: without a header of its own."""
        kind, args = parse_type(spelling)
        if kind in CPP:
            return c.array(CPP[kind], 1)[0].item()
        if kind in ("string", "TString"):
            return c.string()
        if kind in ("vector", "list", "deque", "set", "multiset"):
            n = c.take("i")
            return c.array(CPP[args[0]], n) if args[0] in CPP else [self.items(c, args[0]) for _ in range(n)]
        if kind in ("map", "multimap"):
            n = c.take("i")
            pairs = [(self.items(c, args[0]), self.items(c, args[1])) for _ in range(n)]
            return dict(pairs) if kind == "map" else pairs
        if kind == "pair":
            return self.items(c, args[0]), self.items(c, args[1])
        if spelling.endswith("*"):
            return self.pointer(c)
        return self.read(c, spelling)


def parse_type(spelling: str) -> tuple[str, list[str]]:
    """A C++ type as its name and its template arguments: vector<vector<int> > is ('vector', ['vector<int>'])."""
    s = spelling.replace("std::", "").removeprefix("const ").strip()
    if "<" not in s or not s.endswith(">"):
        return s, []
    name, inner = s.split("<", 1)
    args, depth, begin = [], 0, 0
    inner = inner[:-1]
    for i, x in enumerate(inner):
        depth += (x in "<(") - (x in ">)")
        if x == "," and not depth:
            args.append(inner[begin:i].strip())
            begin = i + 1
    return name.strip(), [*args, inner[begin:].strip()]


# ---- classes with rules of their own ----


def _tobject(r: Reader, c: Cursor) -> Obj:
    version = c.take("h")
    if version & 0x4000:  # a byte count before the version
        c.at -= 2
        version, _ = c.header()
    uid, bits = c.take("II")
    if bits & IS_REFERENCED:
        c.take("H")
    return Obj("TObject", version, {"fUniqueID": uid, "fBits": bits})


def _named(r: Reader, c: Cursor) -> Obj:
    version, end = c.header()
    out = _tobject(r, c)
    out.members |= {"fName": c.string(), "fTitle": c.string()}
    c.finish(end, "TNamed")
    return Obj("TNamed", version, out.members)


def _obj_string(r: Reader, c: Cursor) -> str:
    _, end = c.header()
    _tobject(r, c)
    out = c.string()
    c.finish(end, "TObjString")
    return out


def _obj_array(r: Reader, c: Cursor) -> list:
    version, end = c.header()
    if version > 2:
        _tobject(r, c)
    if version > 1:
        c.string()
    n = c.take("i")
    c.take("i")  # the lowest place
    out = [r.pointer(c) for _ in range(n)]
    c.finish(end, "TObjArray")
    return out


def _list(r: Reader, c: Cursor) -> list:
    version, end = c.header()
    if version <= 3:
        raise NotImplementedError(f"TList has no version {version}")
    _tobject(r, c)
    c.string()
    out = []
    for _ in range(c.take("i")):
        out.append(r.pointer(c))
        n = c.take("B")
        c.bytes(c.take("I") if n == 255 else n)
    c.finish(end, "TList")
    return out


def _vector(r: Reader, c: Cursor) -> np.ndarray:
    """TVectorT<double>: rows, lowest row, a flag and the elements."""
    _, end = c.header()
    _tobject(r, c)
    n, _ = c.take("ii")
    c.take("b")
    out = c.array(">f8", n)
    c.finish(end, "TVectorT<double>")
    return out


def _symmetric(r: Reader, c: Cursor) -> np.ndarray:
    """TMatrixTSym<double>: the upper triangle, row by row, as a full matrix. Its byte count ends before the elements."""
    c.header()
    _tobject(r, c)
    rows, cols, _, _, _, _ = c.take("iiiiii")
    c.take("d")
    out = np.zeros((rows, cols))
    out[np.triu_indices(rows)] = c.array(">f8", rows * (rows + 1) // 2)
    return out + np.triu(out, 1).T


def _tree_index(r: Reader, c: Cursor) -> Obj:
    """The index of a tree: its expressions, the sorted keys and the entries (from 0) in that order."""
    version, end = c.header()
    _, inner = c.header()
    name = _named(r, c)
    if inner is not None:
        c.at = inner
    m = {"fName": name["fName"], "fMajorName": c.string(), "fMinorName": c.string(), "fN": c.take("q")}
    m["fIndexValues"] = c.array(">i8", m["fN"])
    m["fIndexValuesMinor"] = c.array(">i8", m["fN"]) if version > 1 else np.zeros(0, np.int64)
    m["fIndex"] = c.array(">i8", m["fN"])
    c.finish(end, "TTreeIndex")
    return Obj("TTreeIndex", version, m)


def _element(kind: str):
    def read(r: Reader, c: Cursor) -> Element:
        """A streamer element: the part that all kinds share, then what is its kind's own."""
        _, end = c.header()
        if kind == "TStreamerArtificial":
            _, end2 = c.header()
            c.at = end
            return Element(kind, "", "", -1, 0, "")
        version, inner = c.header()
        name = _named(r, c)
        t, _, length, _ = c.take("iiii")
        if version == 1:
            c.bytes(4 * c.take("i"))
        else:
            c.bytes(20)
        out = Element(kind, name["fName"], name["fTitle"], t, length, c.string())
        if inner is not None:
            c.at = inner  # a range of values may follow
        if kind in ("TStreamerBasicPointer", "TStreamerLoop"):
            out.more = {"count_version": c.take("i"), "count": c.string(), "count_class": c.string()}
        elif kind == "TStreamerBase" and end is not None and end - c.at >= 4:
            out.more = {"version": c.take("i")}
        elif kind == "TStreamerSTL":
            out.more = dict(zip(("stl", "content"), c.take("ii"), strict=True))
        if kind == "TStreamerSTLstring" and end is not None:
            c.at = end
        if end is not None:
            c.at = end
        return out

    return read


def _streamer_info(r: Reader, c: Cursor) -> Obj:
    version, end = c.header()
    name = _named(r, c)
    checksum, cls_version = c.take("Ii")
    elements = r.pointer(c)
    c.finish(end, "TStreamerInfo")
    return Obj("TStreamerInfo", version, {"fName": name["fName"], "fCheckSum": checksum, "fClassVersion": cls_version, "fElements": elements})


def _basket(r: Reader, c: Cursor) -> Obj:
    """A chunk that never was written on its own: its key, its sizes, its offsets and its bytes stand in the branch."""
    begin = c.at
    nbytes, key_version, objlen, _, keylen, _ = c.take("ihiIhh")
    c.at = begin + keylen - 18 - 1
    _, size, offsets_size, n, last = c.take("hiiii")
    c.take("b")
    offsets = None
    if offsets_size > 8:
        c.take("i")
        offsets = np.append(c.array(">i4", n) - keylen, last - keylen)
    c.at += keylen  # the key once more
    return Obj("TBasket", 0, {"data": c.bytes(last - keylen), "offsets": offsets, "n": n})


def _old_branch(r: Reader, c: Cursor, out: Obj) -> None:
    """A branch before version 10: counts as doubles, places in 32 bits unless a flag says otherwise. The file's layout doesn't tell."""
    m = out.members
    m |= _named(r, c).members
    _, end = c.header()  # fill attributes
    c.at = end
    for n in ("fCompress", "fBasketSize", "fEntryOffsetLen", "fWriteBasket", "fEntryNumber", "fOffset", "fMaxBaskets", "fSplitLevel"):
        m[n] = c.take("i")
    for n in ("fEntries", "fTotBytes", "fZipBytes"):
        m[n] = int(c.take("d"))
    for n in ("fBranches", "fLeaves", "fBaskets"):
        m[n] = _obj_array(r, c)
    n = m["fMaxBaskets"]
    c.take("b")
    m["fBasketBytes"] = c.array(">i4", n)
    c.take("b")
    m["fBasketEntry"] = c.array(">i4", n)
    m["fBasketSeek"] = c.array(">i8" if c.take("b") == 2 else ">i4", n)
    m["fFileName"] = c.string()


_ELEMENTS = ("Base", "BasicType", "BasicPointer", "Loop", "STL", "STLstring", "Object", "ObjectPointer", "ObjectAny", "ObjectAnyPointer", "String", "Artificial")
_OWN: dict[str, Callable] = {
    "TObject": _tobject, "TNamed": _named, "TObjString": _obj_string, "TObjArray": _obj_array, "TList": _list, "THashList": _list, "TString": lambda r, c: c.string(),
    "TStreamerInfo": _streamer_info, "TVectorT<double>": _vector, "TBasket": _basket, "TTreeIndex": _tree_index, "string": lambda r, c: c.string(),
    **{f"TStreamer{k}": _element(f"TStreamer{k}") for k in _ELEMENTS},
}


def read_layouts(data: bytes, origin: int) -> dict[str, dict[int, list[Element]]]:
    """(class, version) to elements, from the list of streamer infos of a file."""
    out: dict[str, dict[int, list[Element]]] = {}
    for info in _list(Reader(), Cursor(data, 0, origin)):
        if isinstance(info, Obj) and info.cls == "TStreamerInfo":
            out.setdefault(info["fName"], {})[info["fClassVersion"]] = [e for e in info["fElements"] if isinstance(e, Element)]
    return out


def layout_order(layouts: dict[str, dict[int, list[Element]]]) -> list[str]:
    """Classes so that each comes after its base classes and the classes of its members."""
    out: list[str] = []
    open_: set[str] = set()

    def visit(cls: str) -> None:
        if cls in out or cls in open_ or cls not in layouts:
            return
        open_.add(cls)
        for elements in layouts[cls].values():
            for e in elements:
                visit(e.name if e.kind == "TStreamerBase" else e.type_name.rstrip("*").strip())
        open_.discard(cls)
        out.append(cls)

    for cls in sorted(layouts):
        visit(cls)
    return out
