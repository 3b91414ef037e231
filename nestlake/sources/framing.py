"""Compressed blocks as the container frames them, and its packed times.

A block has a head of nine bytes: two letters for the codec, one byte for its method, and the stored and the raw size in three
bytes each, lowest first. LZ4 blocks have eight bytes of xxh64 before the data, highest first.
"""

from __future__ import annotations

import datetime as dt
import lzma
import zlib

import pyarrow as pa
import xxhash
import zstandard

HEAD, MOST = 9, (1 << 24) - 1
#: Setting / 100 gives the codec; its letters and method byte.
CODECS = {1: (b"ZL", 8), 2: (b"XZ", 0), 4: (b"L4", 1), 5: (b"ZS", 1)}


def _pack(codec: int, level: int, raw: bytes) -> bytes:
    if codec == 1:
        return zlib.compress(raw, level)
    if codec == 2:
        return lzma.compress(raw, preset=level)
    if codec == 4:
        data = pa.compress(raw, "lz4_raw", asbytes=True)
        return xxhash.xxh64_digest(data) + data
    return zstandard.ZstdCompressor(level=level).compress(raw)


def _unpack(name: bytes, data: bytes, size: int) -> bytes:
    if name == b"ZL":
        return zlib.decompress(data)
    if name == b"XZ":
        return lzma.decompress(data)
    if name == b"ZS":
        return zstandard.ZstdDecompressor().decompress(data, max_output_size=size)
    if name != b"L4":
        raise ValueError(f"unknown codec {name!r}")
    if xxhash.xxh64_digest(data[8:]) != data[:8]:
        raise ValueError("a block's checksum is wrong")
    return pa.decompress(data[8:], size, "lz4_raw", asbytes=True)


def compress(raw: bytes, setting: int = 404) -> bytes:
    """Blocks for `raw`; `raw` itself if setting is 0 or they'd be no smaller. Setting: 100 * codec + level."""
    codec, level = divmod(setting, 100)
    if not setting or not raw:
        return raw
    if codec not in CODECS:
        raise ValueError(f"unknown setting {setting}")
    name, method = CODECS[codec]
    out = []
    for at in range(0, len(raw), MOST):
        part = raw[at : at + MOST]
        data = _pack(codec, level, part)
        if len(data) > MOST:
            return raw
        out.append(name + bytes([method]) + len(data).to_bytes(3, "little") + len(part).to_bytes(3, "little") + data)
    packed = b"".join(out)
    return packed if len(packed) < len(raw) else raw


def decompress(stored: bytes, size: int) -> bytes:
    """The `size` raw bytes of blocks, or `stored` itself if it is that long."""
    if len(stored) == size:
        return stored
    out, at = [], 0
    while at < len(stored):
        head = stored[at : at + HEAD]
        n, raw = int.from_bytes(head[3:6], "little"), int.from_bytes(head[6:9], "little")
        out.append(_unpack(head[:2], stored[at + HEAD : at + HEAD + n], raw))
        at += HEAD + n
    whole = b"".join(out)
    if len(whole) != size:
        raise ValueError(f"{len(whole)} bytes instead of {size}")
    return whole


def pack_time(t: dt.datetime) -> int:
    """A time of 1995 to 2058 in 32 bits: year, month, day, hour, minute and second from the highest down."""
    return (t.year - 1995) << 26 | t.month << 22 | t.day << 17 | t.hour << 12 | t.minute << 6 | t.second


def unpack_time(x: int) -> dt.datetime:
    return dt.datetime((x >> 26) + 1995, x >> 22 & 15, x >> 17 & 31, x >> 12 & 31, x >> 6 & 63, x & 63)
