"""Writing columnar ntuples: Arrow tables to the bytes of a container file with one ntuple in it."""

from __future__ import annotations

import datetime as dt
import io
import struct
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from nestlake.functions import codecs

from .framing import compress, pack_time
from .objects import BYTE_COUNT

#: LZ4 of level 4. Elements of a page at most; entries of a cluster.
COMPRESSION, PAGE, CLUSTER = 404, 1 << 16, 100_000
WRITER = "nestlake"
#: Where records begin in a file, its version, the version of the anchor's class, and the end of the last free segment.
BEGIN, VERSION, ANCHOR_VERSION, LAST_FREE = 100, 63501, 2, 2_000_000_000
#: Arrow types to the type name of the field, the code of its column and the bits of an element.
NUMBERS = {
    pa.bool_(): ("bool", 0x00, 1), pa.int8(): ("std::int8_t", 0x03, 8), pa.uint8(): ("std::uint8_t", 0x04, 8), pa.int16(): ("std::int16_t", 0x05, 16), pa.uint16(): ("std::uint16_t", 0x06, 16),
    pa.int32(): ("std::int32_t", 0x07, 32), pa.uint32(): ("std::uint32_t", 0x08, 32), pa.int64(): ("std::int64_t", 0x09, 64), pa.uint64(): ("std::uint64_t", 0x0A, 64),
    pa.float16(): ("float", 0x0B, 16), pa.float32(): ("float", 0x0C, 32), pa.float64(): ("double", 0x0D, 64),
}
CHAR, INDEX, SWITCH = (0x02, 8), (0x0F, 64), (0x10, 96)


def _text(t: pa.DataType) -> bool:
    return pa.types.is_string(t) or pa.types.is_large_string(t)


def _list(t: pa.DataType) -> bool:
    return pa.types.is_list(t) or pa.types.is_large_list(t)


def type_name(t: pa.DataType) -> str:
    if _text(t):
        return "std::string"
    if _list(t):
        return f"std::vector<{type_name(t.value_type)}>"
    if pa.types.is_fixed_size_list(t):
        return f"std::array<{type_name(t.value_type)},{t.list_size}>"
    if pa.types.is_struct(t):
        return f"std::tuple<{','.join(type_name(t.field(i).type) for i in range(t.num_fields))}>"
    if t not in NUMBERS:
        raise TypeError(f"no column for {t}")
    return NUMBERS[t][0]


def records(schema: pa.Schema) -> tuple[list[tuple], list[tuple]]:
    """Field records (parent, role, name, type name, repetition) and column records (code, bits, field), depth first."""
    fields: list[tuple] = []
    columns: list[tuple] = []

    def add(name: str, t: pa.DataType, parent: int | None) -> None:
        own = len(fields)
        parent = own if parent is None else parent
        if _list(t):
            fields.append((parent, 1, name, type_name(t), 0))
            columns.append((*INDEX, own))
            add("_0", t.value_type, own)
        elif pa.types.is_fixed_size_list(t):
            fields.append((parent, 0, name, type_name(t), t.list_size))
            add("_0", t.value_type, own)
        elif pa.types.is_struct(t):
            fields.append((parent, 2, name, type_name(t), 0))
            for i in range(t.num_fields):
                add(t.field(i).name, t.field(i).type, own)
        else:
            fields.append((parent, 0, name, type_name(t), 0))
            if _text(t):
                columns.extend([(*INDEX, own), (*CHAR, own)])
            else:
                columns.append((*NUMBERS[t][1:], own))

    for f in schema:
        add(f.name, f.type, None)
    return fields, columns


def flat(x: pa.Array) -> list[np.ndarray]:
    """The elements of each column of a field: offsets before content. Nulls become zeros, empty strings and empty lists."""
    t = x.type
    if _text(t):
        x = pc.fill_null(x, "").cast(pa.large_string())
        _, off, data = x.buffers()
        off = np.frombuffer(off, np.int64)[x.offset : x.offset + len(x) + 1] if len(x) else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
        return [(off[1:] - off[0]).astype("<u8"), raw]
    if _list(t):
        n = pc.list_value_length(x).fill_null(0).to_numpy(zero_copy_only=False)
        return [np.cumsum(n).astype("<u8"), *flat(x.flatten())]
    if pa.types.is_fixed_size_list(t):
        if x.null_count:
            raise ValueError("a fixed array can't be null")
        return flat(x.flatten())
    if pa.types.is_struct(t):
        return [y for i in range(t.num_fields) for y in flat(x.flatten()[i])]
    if x.null_count:
        x = pc.fill_null(x, pa.scalar(False if pa.types.is_boolean(t) else np.dtype(t.to_pandas_dtype()).type(0), t))
    return [x.to_numpy(zero_copy_only=False)]


def _string(s: str) -> bytes:
    b = s.encode()
    return struct.pack("<I", len(b)) + b


def _record(payload: bytes) -> bytes:
    return struct.pack("<q", len(payload) + 8) + payload


def _frames(items: Iterable[bytes], tail: bytes = b"") -> bytes:
    items = list(items)
    body = b"".join(items) + tail
    return struct.pack("<qI", -(len(body) + 12), len(items)) + body


def _envelope(kind: int, payload: bytes) -> bytes:
    data = struct.pack("<Q", (len(payload) + 16) << 16 | kind) + payload
    return data + struct.pack("<Q", xxhash.xxh3_64_intdigest(data))


def _short(s: str) -> bytes:
    b = s.encode()
    return (bytes([len(b)]) if len(b) < 255 else b"\xff" + struct.pack(">I", len(b))) + b


def key(cls: str, name: str, title: str, payload: int, objlen: int, seek: int, parent: int, time: int) -> bytes:
    """The record before an object: payload is its size as stored, objlen as it is."""
    names = _short(cls) + _short(name) + _short(title)
    n = 26 + len(names)
    return struct.pack(">ihiIhhii", n + payload, 4, objlen, time, n, 1, seek, parent) + names


class NtupleFile:
    """Gathers clusters and gives the bytes of the file: `add(table)` for each cluster, then `finish()`."""

    def __init__(self, schema: pa.Schema, name: str = "ntuple", compression: int = COMPRESSION, file_name: str = "ntuple.root"):
        self.schema, self.name, self.setting, self.file_name = schema, name, compression, file_name
        self.fields, self.columns = records(schema)
        self.time = pack_time(dt.datetime.now())
        self.out, self.clusters, self.entries, self.totals = io.BytesIO(), [], 0, [0] * len(self.columns)
        self.name_bytes = len(key("TFile", file_name, "", 0, 0, BEGIN, 0, self.time)) + len(_short(file_name)) + 1
        # the head of the file is written last, when all places are known
        self.out.write(b"\0" * (BEGIN + self.name_bytes + 60))
        head = struct.pack("<Q", 0) + _string(name) + _string("") + _string(WRITER)
        head += _frames(_record(struct.pack("<IIIHH", 0, 0, p, role, 1 if n else 0) + _string(f) + _string(t) + _string("") * 2 + (struct.pack("<q", n) if n else b"")) for p, role, f, t, n in self.fields)
        head += _frames(_record(struct.pack("<HHIHH", c, bits, own, 0, 0)) for c, bits, own in self.columns) + _frames([]) + _frames([])
        self.head = _envelope(1, head)
        self.head_at = self._blob(self.head)

    def _blob(self, payload: bytes, setting: int | None = None) -> tuple[int, int]:
        """Write bytes behind a key of their own; their place and size as stored."""
        stored = compress(payload, self.setting if setting is None else setting)
        self.out.write(key("RBlob", "", "", len(stored), len(payload), self.out.tell(), BEGIN, self.time))
        at = self.out.tell()
        self.out.write(stored)
        return at, len(stored)

    def add(self, table: pa.Table) -> None:
        """One cluster of all rows of a table."""
        if table.schema.names != self.schema.names:
            raise ValueError("columns differ")
        elements = [y for c in table.columns for y in flat(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c)]
        stored, pages = [], []
        for x, (code, _, _) in zip(elements, self.columns, strict=True):
            own = []
            for at in range(0, len(x), PAGE):
                part = x[at : at + PAGE]
                raw = codecs.np_pack_bools(part) if code == 0 else np.ascontiguousarray(part).astype(part.dtype.newbyteorder("<")).tobytes()
                stored.append(compress(raw, self.setting))
                own.append((len(part), len(stored[-1])))
            pages.append(own)
        body = b"".join(p + struct.pack("<Q", xxhash.xxh3_64_intdigest(p)) for p in stored)
        at, _ = self._blob(body, 0)
        lists = []
        for i, own in enumerate(pages):
            frames = []
            for n, size in own:
                frames.append(struct.pack("<iiQ", -n, size, at))
                at += size + 8
            lists.append(_frames(frames, struct.pack("<qI", self.totals[i], self.setting)))
            self.totals[i] += len(elements[i])
        self.clusters.append((self.entries, table.num_rows, lists))
        self.entries += table.num_rows

    def finish(self) -> bytes:
        """The whole file."""
        checksum = self.head[-8:]
        summaries = _frames(_record(struct.pack("<qQ", first, n)) for first, n, _ in self.clusters)
        nested = _frames(_frames(lists) for _, _, lists in self.clusters)
        links = _envelope(3, checksum + summaries + nested)
        at, size = self._blob(links)
        group = _record(struct.pack("<qqI", 0, self.entries, len(self.clusters)) + struct.pack("<QiQ", len(links), size, at))
        foot = _envelope(2, struct.pack("<Q", 0) + checksum + _record(_frames([]) * 4) + _frames([group]))
        foot_at, foot_size = self._blob(foot)
        anchor = struct.pack(">HHHH7Q", 1, 0, 0, 0, self.head_at[0], self.head_at[1], len(self.head), foot_at, foot_size, len(foot), 0x40000000)
        object_ = struct.pack(">IH", BYTE_COUNT | len(anchor) + 2, ANCHOR_VERSION) + anchor + struct.pack(">Q", xxhash.xxh3_64_intdigest(anchor))
        anchor_key = key("ROOT::RNTuple", self.name, "", len(object_), len(object_), self.out.tell(), BEGIN, self.time)
        self.out.write(anchor_key + object_)
        keys_at = self.out.tell()
        listed = struct.pack(">i", 1) + anchor_key
        keys = key("", self.file_name, "", len(listed), len(listed), keys_at, BEGIN, self.time) + listed
        self.out.write(keys)
        info_at = self.out.tell()
        info = _streamer_infos()
        info = key("TList", "StreamerInfo", "Doubly linked list", len(info), len(info), info_at, BEGIN, self.time) + info
        self.out.write(info)
        free_at = self.out.tell()
        n = len(key("", self.file_name, "", 10, 10, free_at, BEGIN, self.time)) + 10
        end = free_at + n
        self.out.write(key("", self.file_name, "", 10, 10, free_at, BEGIN, self.time) + struct.pack(">HII", 1, end, LAST_FREE))
        if end >= LAST_FREE:
            raise ValueError("a file of this form holds two billion bytes")
        self.out.seek(0)
        self.out.write(b"root" + struct.pack(">iiiiiiiBiii", VERSION, BEGIN, end, free_at, n, 1, self.name_bytes, 4, self.setting, info_at, len(info)))
        self.out.seek(BEGIN)
        named = _short(self.file_name) + b"\0"
        self.out.write(key("TFile", self.file_name, "", len(named) + 60, len(named) + 60, BEGIN, 0, self.time) + named)
        self.out.write(struct.pack(">hIIiiiii", 5, self.time, self.time, len(keys), self.name_bytes, BEGIN, 0, keys_at) + struct.pack(">H", 1) + b"\0" * 28)
        return self.out.getvalue()


def _streamer_infos() -> bytes:
    """The layout of the anchor's class: the file's only class that is read by its layout."""
    from .describe import layout_list

    places = ["fVersionEpoch", "fVersionMajor", "fVersionMinor", "fVersionPatch"]
    sizes = ["fSeekHeader", "fNBytesHeader", "fLenHeader", "fSeekFooter", "fNBytesFooter", "fLenFooter", "fMaxKeySize"]
    return layout_list([("ROOT::RNTuple", ANCHOR_VERSION, [("basic", n, "unsigned short") for n in places] + [("basic", n, "unsigned long") for n in sizes])])


def write_ntuple(table: pa.Table, name: str = "ntuple", compression: int = COMPRESSION, cluster: int = CLUSTER, file_name: str = "ntuple.root") -> bytes:
    """A table as the bytes of a file with one ntuple."""
    out = NtupleFile(table.schema, name, compression, file_name)
    for at in range(0, table.num_rows, cluster):
        out.add(table.slice(at, cluster))
    return out.finish()
