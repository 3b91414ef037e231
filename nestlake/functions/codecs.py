"""Codecs of stored columns, as Spark expressions where bits allow it, and as numpy for the file reader and writer."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def zigzag(c: Column, bits: int = 64) -> Column:
    """Signed to unsigned, small numbers of either sign becoming small ones."""
    return F.shiftleft(c, 1).bitwiseXOR(F.shiftright(c, bits - 1))


def unzigzag(c: Column) -> Column:
    return F.shiftrightunsigned(c, 1).bitwiseXOR(-c.bitwiseAND(F.lit(1)))


def undelta(df: DataFrame, column: str, order_by: str, page: Sequence[str], name: str) -> DataFrame:
    """Running sums within each page."""
    w = Window.partitionBy(*page).orderBy(order_by).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(column).over(w))


def delta(df: DataFrame, column: str, order_by: str, page: Sequence[str], name: str) -> DataFrame:
    return df.withColumn(name, F.col(column) - F.lag(column, 1, 0).over(Window.partitionBy(*page).orderBy(order_by)))


def split_bytes(df: DataFrame, column: str, width: int, place: str, count: str, *keep: str) -> DataFrame:
    """The bytes of whole numbers, those of equal weight together: byte j of element `place` (from 0) is at j * count + place."""
    parts = F.array(*[F.struct((F.lit(j).cast("long") * F.col(count) + F.col(place)).alias("pos"), F.shiftright(F.col(column), 8 * j).bitwiseAND(F.lit(255)).cast("int").alias("byte")) for j in range(width)])
    return df.select(*keep, F.explode(parts).alias("__b")).select(*keep, "__b.pos", "__b.byte")


def quantized(c: Column, bits: int, low: float, high: float) -> Column:
    """Values in [low, high] as whole numbers of so many bits."""
    return F.round((c - F.lit(low)) * F.lit(float((1 << bits) - 1)) / F.lit(high - low)).cast("long")


def unquantized(c: Column, bits: int, low: float, high: float) -> Column:
    return (F.lit(low) + c * F.lit(high - low) / F.lit(float((1 << bits) - 1))).cast("float")


def switch_parts(c: Column) -> tuple[Column, Column]:
    """(tag, index from 1) of a 96-bit switch, given as 24 hexadecimal digits: 32 bits of tag above 64 of index."""
    number = lambda x: F.conv(x, 16, 10).cast("long")
    return number(F.substring(c, 1, 8)), number(F.substring(c, 9, 16)) + 1


def pack_bits(c: Column) -> Column:
    """An array of booleans as bytes, the first being the lowest bit of the first byte; null counts as false."""
    byte = lambda k: F.aggregate(F.slice(c, k * 8 + 1, 8), F.struct(F.lit(0).alias("x"), F.lit(1).alias("bit")), lambda t, x: F.struct((t.x + F.when(x, t.bit).otherwise(0)).alias("x"), (t.bit * 2).alias("bit")), lambda t: F.lpad(F.hex(t.x), 2, "0"))
    whole = F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.size(c) - 1) / 8).cast("int")), byte), "")
    return F.unhex(F.when(F.size(c) > 0, whole).otherwise(""))


def unpack_bits(c: Column, n: Column) -> Column:
    """The first n booleans of bytes."""
    byte = lambda i: F.conv(F.substr(F.hex(c), (F.floor(i / 8) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
    bit = lambda i: F.call_function("shiftright", byte(i), (i % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n.cast("int") - 1), bit)).otherwise(F.array().cast("array<boolean>"))


# ---- numpy, for pages of stored columns ----


def np_zigzag(x: np.ndarray) -> np.ndarray:
    bits = x.dtype.itemsize * 8
    return ((x << 1) ^ (x >> (bits - 1))).view(f"u{x.dtype.itemsize}")


def np_unzigzag(x: np.ndarray) -> np.ndarray:
    u = x.view(f"u{x.dtype.itemsize}")
    one = u.dtype.type(1)
    return ((u >> one) ^ (np.zeros_like(u) - (u & one))).view(f"i{x.dtype.itemsize}")


def np_split(x: np.ndarray) -> bytes:
    """Little-endian elements to planes of equal weight."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes()


def np_unsplit(raw: bytes, dtype: str) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(dtype).reshape(-1)


def np_pack_bools(x: np.ndarray) -> bytes:
    return np.packbits(x.astype(np.uint8), bitorder="little").tobytes()


def np_unpack_bools(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[:n].astype(bool)


def np_unpack(raw: bytes, bits: int, n: int) -> np.ndarray:
    """n numbers of `bits` bits each, the lowest first."""
    b = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[: n * bits].reshape(n, bits).astype(np.uint64)
    return (b << np.arange(bits, dtype=np.uint64)).sum(1, dtype=np.uint64)


def np_pack(x: np.ndarray, bits: int) -> bytes:
    b = (x.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(b.astype(np.uint8).ravel(), bitorder="little").tobytes()


def np_untruncate(x: np.ndarray, bits: int) -> np.ndarray:
    """Floats of which only the highest `bits` bits are stored."""
    return (x.astype(np.uint32) << np.uint32(32 - bits)).view(np.float32)


def np_truncate(x: np.ndarray, bits: int) -> np.ndarray:
    return x.astype(np.float32).view(np.uint32) >> np.uint32(32 - bits)


def np_unquantize(x: np.ndarray, bits: int, low: float, high: float) -> np.ndarray:
    return (low + x.astype(np.float64) * ((high - low) / ((1 << bits) - 1))).astype(np.float32)


def np_switch(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(index from 1, tag) of 96-bit switches."""
    x = np.frombuffer(raw, np.dtype([("index", "<u8"), ("tag", "<u4")]))
    return x["index"] + 1, x["tag"]
