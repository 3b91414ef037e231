"""Writing descriptions of class layouts, and the objects that they're made of."""

from __future__ import annotations

import struct

from .objects import BASIC, BYTE_COUNT, CLASS_MASK, CPP, MAP_OFFSET, NEW_CLASS

#: Bytes of the key before the list of layouts.
INFO_KEY = 64
#: Versions of the classes that describe layouts, and codes of members.
VERSIONS = {"TStreamerBase": 3, "TStreamerBasicType": 2, "TStreamerBasicPointer": 2, "TStreamerString": 2, "TStreamerObject": 2, "TStreamerObjectAny": 2, "TStreamerObjectPointer": 2, "TStreamerSTL": 3}
OBJECT, NAMED, STRING, INLINE, ANY, POINTER, STREAMER, STL_CODES = 66, 67, 65, 61, 62, 64, 500, {"vector": 1, "list": 2, "map": 4, "set": 6, "string": 365}


def basic_code(name: str) -> int:
    """The code of a basic type of C++."""
    exact = {"bool": 18, "char": 1, "unsigned char": 11, "short": 2, "unsigned short": 12, "int": 3, "unsigned int": 13, "long": 4, "unsigned long": 14, "float": 5, "double": 8}
    return exact[name] if name in exact else next(k for k, v in BASIC.items() if v == CPP[name])


class Out:
    """Bytes with counted objects and pointers to classes; `origin` is the length of the key before them."""

    def __init__(self, origin: int = 0):
        self.data, self.origin = bytearray(), origin
        self.classes: dict[str, int] = {}

    def put(self, form: str, *values) -> Out:
        self.data += struct.pack(">" + form, *values)
        return self

    def string(self, s: str) -> Out:
        b = s.encode()
        self.data += (bytes([len(b)]) if len(b) < 255 else b"\xff" + struct.pack(">I", len(b))) + b
        return self

    def counted(self, version: int, body) -> Out:
        """An object with its byte count and version before what body() writes."""
        at = len(self.data)
        self.put("Ih", 0, version)
        body()
        struct.pack_into(">I", self.data, at, BYTE_COUNT | len(self.data) - at - 4)
        return self

    def pointer(self, cls: str | None, body=None) -> int:
        """What a pointer holds: null, or an object that body() writes; gives the place by which others may refer to it."""
        if cls is None:
            self.put("I", 0)
            return 0
        at = len(self.data)
        self.put("I", 0)
        if cls in self.classes:
            self.put("I", CLASS_MASK | self.classes[cls])
        else:
            self.classes[cls] = len(self.data) + self.origin + MAP_OFFSET
            self.put("I", NEW_CLASS)
            self.data += cls.encode() + b"\0"
        body()
        struct.pack_into(">I", self.data, at, BYTE_COUNT | len(self.data) - at - 4)
        return at + self.origin + MAP_OFFSET

    def tobject(self) -> Out:
        return self.put("hII", 1, 0, 0x03000000)

    def named(self, name: str, title: str = "") -> Out:
        return self.counted(1, lambda: self.tobject().string(name).string(title))

    def objects(self, items: list, cls: str = "TObjArray") -> Out:
        """A TObjArray or TList of (class, body)."""

        def body():
            self.tobject().string("").put("i", len(items))
            if cls == "TObjArray":
                self.put("i", 0)
            for kind, write in items:
                self.pointer(kind, write)
                if cls == "TList":
                    self.put("B", 0)

        return self.counted(3 if cls == "TObjArray" else 5, body)


def element(kind: str, name: str, type_name: str = "", more: int | str = 0) -> tuple[str, str, int, int, str, tuple]:
    """(class, name, code, array length, spelling, what comes last) of a member.

    Kinds: base, basic (more: length of an array), counted (more: member with the count), string, object, any, pointer, stl.
    """
    if kind == "base":
        return "TStreamerBase", name, {"TObject": OBJECT, "TNamed": NAMED}.get(name, 0), 0, "BASE", ("i", int(more or 1))
    if kind == "basic":
        return "TStreamerBasicType", name, basic_code(type_name) + (20 if more else 0), int(more), type_name, ()
    if kind == "counted":
        return "TStreamerBasicPointer", name, basic_code(type_name) + 40, 0, f"{type_name}*", ("count", str(more))
    if kind == "string":
        return "TStreamerString", name, STRING, 0, "TString", ()
    if kind in ("object", "any"):
        return ("TStreamerObject", name, INLINE, 0, type_name, ()) if kind == "object" else ("TStreamerObjectAny", name, ANY, 0, type_name, ())
    if kind == "pointer":
        return "TStreamerObjectPointer", name, POINTER, 0, f"{type_name}*", ()
    return "TStreamerSTL", name, STREAMER, 0, type_name, ("ii", STL_CODES.get(type_name.split("<")[0], 1), 0)


def layout_list(classes: list[tuple[str, int, list[tuple]]], origin: int = INFO_KEY) -> bytes:
    """The list of layouts of a file: (class, version, members as arguments of `element`)."""
    out = Out(origin)

    def write_element(e):
        cls, name, code, length, spelling, last = e

        def inner():
            out.named(name).put("iiii", code, 0, length, 1 if length else 0).put("5i", length, 0, 0, 0, 0).string(spelling)

        def body():
            out.counted(4, inner)
            if last and last[0] == "count":
                out.put("i", 0).string(last[1]).string("")
            elif last:
                out.put(*last)

        return cls, lambda: out.counted(VERSIONS[cls], body)

    def write_info(cls, version, members):
        def body():
            out.named(cls).put("Ii", 0, version)
            out.pointer("TObjArray", lambda: out.objects([write_element(element(*m)) for m in members]))

        return "TStreamerInfo", lambda: out.counted(9, body)

    out.objects([write_info(*c) for c in classes], "TList")
    return bytes(out.data)
