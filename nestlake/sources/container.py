"""The container file: its head, directories and keys, and the objects behind them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from .byteranges import open_bytes
from .framing import decompress, unpack_time
from .objects import CPP, Cursor, Obj, Reader, parse_type, read_layouts

MAGIC = b"root"
#: Files of this version and above may have 64-bit places; so have keys of versions above the second.
BIG_FILE, BIG_KEY = 1_000_000, 1000


@dataclass(frozen=True)
class Key:
    """Where an object lies and what it is."""

    cls: str
    name: str
    title: str
    cycle: int
    seek: int
    nbytes: int
    objlen: int
    keylen: int
    datime: int

    @property
    def compressed(self) -> bool:
        return self.objlen != self.nbytes - self.keylen


def read_key(c: Cursor) -> Key:
    begin = c.at
    nbytes, version, objlen, datime, keylen, cycle = c.take("ihiIhh")
    seek, _ = c.take("qq" if version > BIG_KEY else "ii")
    out = Key(c.string(), c.string(), c.string(), cycle, seek, nbytes, objlen, keylen, datime)
    c.at = begin + keylen
    return out


@dataclass(frozen=True)
class Directory:
    """The keys of one level of the file."""

    path: str
    keys: tuple[Key, ...]

    def newest(self) -> list[Key]:
        """The keys, of equal names only that of the greatest cycle, in the order in which names first appear."""
        out: dict[str, Key] = {}
        for k in self.keys:
            if k.name not in out or k.cycle > out[k.name].cycle:
                out[k.name] = k
        return list(out.values())


class Container:
    """An open file: `keys()`, `key in file`, `file[path]`. Paths go through directories, and on into branches of trees, by slashes.

    `custom` maps names of classes to readers (reader, cursor) -> object, for classes that hold their own rules.
    """

    def __init__(self, path: str, custom: dict[str, Callable] | None = None):
        self.path, self.bytes = path, open_bytes(path)
        head = self.bytes.read(0, 512)
        if head[:4] != MAGIC:
            raise ValueError(f"{path} is no container")
        c = Cursor(head, 4)
        self.version, begin = c.take("ii")
        wide = "q" if self.version >= BIG_FILE else "i"
        c.take(f"{wide}{wide}ii")  # end, free segments
        name_bytes = c.take("i")
        c.take("B")
        self.compression = c.take("i")
        self.seek_info, self.info_bytes = c.take(f"{wide}i")
        self.custom = dict(custom or {})
        self.root = self._directory("", begin + name_bytes)
        self._layouts = None
        self._found: dict[str, object] = {}

    def __enter__(self) -> Container:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        self.bytes.close()

    def _directory(self, path: str, seek: int) -> Directory:
        return self._listed(path, Cursor(self.bytes.read(seek, 64)))

    def _listed(self, path: str, c: Cursor) -> Directory:
        version = c.take("h")
        c.take("IIii")  # times, bytes of keys and of the name
        _, _, keys = c.take("qqq" if version > BIG_KEY else "iii")
        if not keys:
            return Directory(path, ())
        own = read_key(Cursor(self.bytes.read(keys, 1024)))
        k = Cursor(self.bytes.read(keys + own.keylen, own.nbytes - own.keylen))
        return Directory(path, tuple(read_key(k) for _ in range(k.take("i"))))

    @property
    def layouts(self) -> dict:
        """The class layouts that the file describes, read when first asked for."""
        if self._layouts is None:
            self._layouts = {}
            if self.seek_info:
                key = read_key(Cursor(self.bytes.read(self.seek_info, 1024)))
                self._layouts = read_layouts(self.payload(key), key.keylen)
        return self._layouts

    def streamer(self, cls: str, member: int | None = None):
        """The elements of the newest layout of a class, or the one of a member's number."""
        known = self.layouts[cls]
        elements = known[max(known)]
        return elements if member is None else elements[member]

    def payload(self, key: Key) -> bytes:
        """The uncompressed bytes behind a key."""
        raw = self.bytes.read(key.seek + key.keylen, key.nbytes - key.keylen)
        return decompress(raw, key.objlen) if key.compressed else raw

    def keys(self, directory: str = "") -> list[str]:
        """Names in a directory, without repeats by cycle."""
        d = self.root if not directory else self[directory]
        return [k.name for k in d.newest()]

    def __contains__(self, path: str) -> bool:
        try:
            return self[path] is not None
        except KeyError:
            return False

    def key(self, path: str) -> tuple[Key, str]:
        """The key that a path leads to and what of the path is left, which names a branch of it."""
        d, parts, i = self.root, path.strip("/").split("/"), 0
        while i < len(parts):
            # names may hold slashes themselves: the longest that fits comes first
            for j in range(len(parts), i, -1):
                name = "/".join(parts[i:j])
                found = next((k for k in d.newest() if k.name == name), None) or next((k for k in d.keys if f"{k.name};{k.cycle}" == name), None)
                if found is not None:
                    break
            else:
                break
            if j == len(parts) or not found.cls.startswith("TDirectory"):
                return found, "/".join(parts[j:])
            d, i = self._sub(found, "/".join(parts[:j])), j
        raise KeyError(path)

    def _sub(self, key: Key, path: str) -> Directory:
        return self._listed(path, Cursor(self.payload(key)))

    def __getitem__(self, path: str):
        """The object at a path; None where a tree has no such branch. KeyError where there is no object."""
        if path not in self._found:
            key, rest = self.key(path)
            out = self._object(key, path)
            if rest:
                out = out.branch(rest) if hasattr(out, "branch") else None
            self._found[path] = out
        return self._found[path]

    def _object(self, key: Key, path: str):
        if key.cls.startswith("TDirectory"):
            return self._sub(key, path)
        data = self.payload(key)
        c = Cursor(data, 0, key.keylen)
        if key.cls == "ROOT::RNTuple":
            from .ntuple import Ntuple

            return Ntuple(self, data)
        if key.cls in ("TTree", "TNtuple", "TNtupleD"):
            from .tree import Tree

            return Tree(self, Reader(self.layouts, self.custom).read(c, key.cls))
        if key.cls == "TNamed":
            return Reader().read(c, "TNamed")["fTitle"]
        out = Reader(self.layouts, self.custom).read(c, key.cls)
        if isinstance(out, Obj) and key.cls not in self.custom:
            for e in self.layouts.get(key.cls, {}).get(out.version, ()):
                if e.kind == "TStreamerSTL" and parse_type(e.type_name) == ("map", ["string", "string"]):
                    return out[e.name]  # nothing but a map of strings with a name
        return out

    def walk(self, directory: Directory | None = None, prefix: str = "") -> Iterator[tuple[str, Key]]:
        """Path and key of everything in the file, directories before what is in them."""
        for k in (directory or self.root).newest():
            yield prefix + k.name, k
            if k.cls.startswith("TDirectory"):
                yield from self.walk(self._sub(k, prefix + k.name), f"{prefix}{k.name}/")


@lru_cache(maxsize=32)
def opened(path: str) -> Container:
    """A container that is kept open in this process for further tasks."""
    return Container(path)


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """The objects of a file: path, class, title, cycle, nbytes, objlen, written. One row each, whatever their cycles."""
    with Container(path) as f:
        rows = [(p, k.cls, k.title, k.cycle, k.nbytes, k.objlen, unpack_time(k.datime) if k.datime else None) for p, k in f.walk()]
    return spark.createDataFrame(rows, "path string, class string, title string, cycle int, nbytes long, objlen long, written timestamp_ntz")


__all__ = ["CPP", "Container", "Directory", "Key", "Obj", "catalog", "opened", "read_key"]
