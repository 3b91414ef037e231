"""The container as a source and sink of Spark: a task reads the chosen columns alone of neighbouring clusters or ranges of baskets, one at a time."""

from __future__ import annotations

import functools
import importlib
import json
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from nestlake.functions.structs import Record, stacked
from nestlake.operators.select import Selector, chosen, normalized

from . import ntuple, ntuple_write
from .container import Container, catalog, opened
from .tree import Plan, Tree, read_entries

FORMAT, ENTRY, CHUNK, ENDING = "nestlake", "__entry", "__chunk", ".root"
#: Rows of a batch that a task hands to Spark.
BATCH = 65_536
#: Stored bytes of a task's spans: a share of the whole, within these bounds. A span isn't cut, so it may have more.
TASKS, LEAST, MOST = 96, 64 << 10, 32 << 20


def _paths(path: str) -> list[str]:
    """The files of a path: itself, those of a list, or those of a folder in order of their names."""
    if "," in path:
        return [q for p in path.split(",") for q in _paths(p.strip())]
    if re.match(r"(https?|root)://", path):
        return [path]
    fs, top = (pa.fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9+.-]+:", path) else (pa.fs.LocalFileSystem(), path))
    if fs.get_file_info(top).type != pa.fs.FileType.Directory:
        return [path]
    base = path.rstrip("/")
    return sorted(f"{base}/{i.base_name}" for i in fs.get_file_info(pa.fs.FileSelector(top)) if i.base_name.endswith(ENDING))


@dataclass
class Span(InputPartition):
    """Entries [first, last) of one file; shift is the number of entries in the files before, chunk the number of the span."""

    path: str
    first: int
    last: int
    shift: int
    chunk: int
    what: object = None
    nbytes: int = 0


@dataclass
class Spans(InputPartition):
    """Neighbouring spans, which one task reads in turn."""

    spans: list[Span]


def grouped(spans: list[Span]) -> list[Spans]:
    """Spans in tasks of several: small clusters don't cost a task each."""
    most = min(max(sum(s.nbytes for s in spans) // TASKS, LEAST), MOST)
    out, held = [], 0
    for s in spans:
        if not out or held + s.nbytes > most:
            out.append(Spans([]))
            held = 0
        out[-1].spans.append(s)
        held += s.nbytes
    return out


def custom_records(given: dict[str, Record] | None) -> str:
    """Records of users as an option."""
    return json.dumps({k: asdict(v) for k, v in (given or {}).items()})


def _records(option: str) -> dict[str, Record]:
    def record(d: dict) -> Record:
        return Record(d["name"], tuple(map(tuple, d["fields"])), d["skip"], tuple(d["order"]))

    return {k: record(v) for k, v in json.loads(option or "{}").items()}


def _readers(option: str) -> dict[str, Callable]:
    """Readers of top-level classes, given as module:function, so that every process can find them."""
    out = {}
    for cls, place in json.loads(option or "{}").items():
        module, _, name = place.partition(":")
        out[cls] = getattr(importlib.import_module(module), name)
    return out


class Options:
    """What the options of a read say: path, object, columns (list of [path, name]), custom, entry, raw, chunk."""

    def __init__(self, options: dict[str, str]):
        self.paths = _paths(options["path"])
        self.object = options.get("object", "")
        self.columns = [tuple(c) for c in json.loads(options["columns"])] if options.get("columns") else None
        self.custom = _records(options.get("custom", ""))
        self.readers = _readers(options.get("readers", ""))
        self.entry, self.chunk, self.raw = (options.get(n, "false").lower() == "true" for n in ("entry", "chunk", "raw"))
        low, _, high = options.get("rows", "").partition(":")
        self.low, self.high = int(low or 0), int(high) if high else None

    def open(self, path: str):
        f = Container(path, self.readers)
        found = f[self.object or next(n for n, k in f.walk() if k.cls in ("ROOT::RNTuple", "TTree", "TNtuple", "TNtupleD"))]
        if not isinstance(found, (ntuple.Ntuple, Tree)):
            raise ValueError(f"{self.object} is no table")
        return f, found

    def names(self, found) -> list[tuple[str, str]]:
        if self.columns is not None:
            return self.columns
        if isinstance(found, Tree):
            return [(n, normalized(n)) for n in found.branches]
        return [(f.name, f.name) for f in found.fields]

    def schema(self) -> T.StructType:
        f, found = self.open(self.paths[0])
        with f:
            own = T.StructType([T.StructField(n, T.LongType(), False) for n, on in ((ENTRY, self.entry), (CHUNK, self.chunk)) if on])
            names = self.names(found)
            if isinstance(found, Tree):
                plans = [found.branches[p].plan(n, self.custom, self.raw) for p, n in names]
                fields = [T.StructField(p.name, p.layout.spark_type(), False, {"fixed_len": p.layout.fixed} if p.layout.fixed > 1 else {}) for p in plans]
            else:
                fields = [T.StructField(n, x.dataType, x.nullable, x.metadata) for (_, n), x in zip(names, found.schema([p for p, _ in names]), strict=True)]
            return stacked(own, T.StructType(fields))

    def spans(self) -> list[Span]:
        out, shift = [], 0
        for path in self.paths:
            f, found = self.open(path)
            with f:
                names = self.names(found)
                if isinstance(found, Tree):
                    plans = [found.branches[p].plan(n, self.custom, self.raw) for p, n in names]
                    for a, b in found.ranges([p for p, _ in names]):
                        own = [p.within(a, b) for p in plans]
                        out.append(Span(path, a, b, shift, len(out), own, sum(c.nbytes or len(c.data or b"") for p in own for c in p.chunks)))
                else:
                    by = {x.name: x for x in found.fields}
                    fields, needed = [by[p] for p, _ in names], found.needed([p for p, _ in names])
                    for c in found.clusters():
                        kept = ntuple.Cluster(c.first, c.n, tuple(p if i in needed else () for i, p in enumerate(c.pages)), c.group)
                        out.append(Span(path, c.first, c.first + c.n, shift, len(out), (found.columns, fields, [n for _, n in names], kept), sum(p.nbytes for own in kept.pages for p in own)))
                shift += found.entries
        for s in out:  # what lies outside of the rows asked for isn't read
            s.first = max(s.first, self.low - s.shift)
            s.last = s.last if self.high is None else min(s.last, self.high - s.shift)
        return [s for s in out if s.first < s.last]


def _arrays(span: Span) -> tuple[list[str], list]:
    source = opened(span.path).bytes
    if isinstance(span.what, list):
        plans: list[Plan] = span.what
        return [p.name for p in plans], [read_entries(source, p, span.first, span.last) for p in plans]
    columns, fields, names, cluster = span.what
    table = ntuple.cluster_table(source, columns, fields, cluster)
    return names, table.slice(span.first - cluster.first, span.last - span.first).columns


class ContainerReader(DataSourceReader):
    def __init__(self, options: Options, schema: T.StructType):
        self.options, self.names = options, schema.names

    def partitions(self) -> list[Spans]:
        return grouped(self.options.spans()) or [Spans([])]

    def read(self, part: Spans) -> Iterator[pa.RecordBatch]:
        for span in part.spans:
            yield from self._batches(span)

    def _batches(self, span: Span) -> Iterator[pa.RecordBatch]:
        names, arrays = _arrays(span)
        n = span.last - span.first
        if CHUNK in self.names:
            names, arrays = [CHUNK, *names], [pa.chunked_array([pa.repeat(span.chunk, n).cast(pa.int64())]), *arrays]
        if ENTRY in self.names:
            first = span.first + span.shift
            names, arrays = [ENTRY, *names], [pa.chunked_array([pa.array(range(first, first + n), pa.int64())]), *arrays]
        yield from pa.table(arrays, names).combine_chunks().to_batches(BATCH)


@dataclass
class Written(WriterCommitMessage):
    moves: list[tuple[str, str]]


class ContainerWriter(DataSourceArrowWriter):
    """A file or more per task, under hidden names until the driver commits: what repeated or lost tasks leave behind has no name that is read."""

    def __init__(self, options: dict[str, str], schema: T.StructType, overwrite: bool):
        self.path, self.name = options["path"].rstrip("/"), options.get("object", "ntuple")
        self.setting = int(options.get("compression", ntuple_write.COMPRESSION))
        self.cluster, self.file_bytes = int(options.get("cluster", ntuple_write.CLUSTER)), int(options.get("filebytes", 256 << 20))
        self.schema, self.overwrite, self.job = schema, overwrite, uuid.uuid4().hex[:12]

    def _fs(self):
        return pa.fs.FileSystem.from_uri(self.path) if re.match(r"[a-z0-9+.-]+:", self.path) else (pa.fs.LocalFileSystem(), self.path)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        fs, top = self._fs()
        fs.create_dir(top, recursive=True)
        part, moves, out, held, n = TaskContext.get().partitionId(), [], None, [], 0

        def close():
            nonlocal out
            if out is not None:
                name = f"part-{part:06d}-{len(moves):04d}-{self.job}{ENDING}"
                hidden = f".{name}.{uuid.uuid4().hex[:8]}"
                with fs.open_output_stream(f"{top}/{hidden}") as s:
                    s.write(out.finish())
                moves.append((hidden, name))
                out = None

        def flush():
            nonlocal out, held, n
            if held:
                table = pa.Table.from_batches(held)
                if out is None:
                    out = ntuple_write.NtupleFile(table.schema, self.name, self.setting)
                out.add(table)
                held, n = [], 0
                if out.out.tell() >= self.file_bytes:
                    close()

        for b in batches:
            while len(b):
                take = min(len(b), self.cluster - n)
                held.append(b.slice(0, take))
                n += take
                b = b.slice(take)
                if n >= self.cluster:
                    flush()
        flush()
        close()
        return Written(moves)

    def commit(self, messages: list[Written | None]) -> None:
        fs, top = self._fs()
        if self.overwrite:
            for i in fs.get_file_info(pa.fs.FileSelector(top)):
                if i.base_name.endswith(ENDING) and not i.base_name.startswith("."):
                    fs.delete_file(i.path)
        for m in messages:
            for hidden, name in m.moves if m else ():
                fs.move(f"{top}/{hidden}", f"{top}/{name}")
        self._clear(fs, top)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*self._fs())

    def _clear(self, fs, top: str) -> None:
        for i in fs.get_file_info(pa.fs.FileSelector(top, allow_not_found=True)):
            if i.base_name.startswith(".") and f"-{self.job}{ENDING}." in i.base_name:
                fs.delete_file(i.path)


class ContainerSource(DataSource):
    """spark.read.format("nestlake").option("object", name).load(path). Options: columns (JSON list of [path, name]), entry, chunk, rows (first:last), raw, custom, readers."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    @functools.cached_property
    def _read(self) -> Options:
        return Options(self.options)

    def schema(self) -> T.StructType:
        return self._read.schema()

    def reader(self, schema: T.StructType) -> DataSourceReader:
        # conditions aren't pushed down: Spark keeps those of one query for all later ones over the same DataFrame
        return ContainerReader(self._read, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> ContainerWriter:
        return ContainerWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ContainerSource)


def read(spark: SparkSession, path: str | list[str], object: str = "", selectors: Iterable[Selector] | Selector | None = None, entry: bool = False, chunk: bool = False, raw: bool = False, custom: dict[str, Record] | None = None, readers: dict[str, str] | None = None, rows: tuple[int, int | None] | None = None) -> DataFrame:
    """A tree or ntuple as a DataFrame. Only selected columns are read: Spark doesn't tell a Python source what it needs later, so select here.

    path: a file, a list of files or a folder of them; entry: the row's number from 0 as `__entry`; chunk: the number of its cluster or range of baskets as `__chunk`;
    rows: only entries [first, last) of the whole, by reading no other chunks; raw: cells as bytes; custom: records for classes; readers: module:function for classes of top-level objects.
    """
    register(spark)
    path = ",".join(path) if isinstance(path, list) else path
    options = {"path": path, "object": object, "entry": str(entry), "chunk": str(chunk), "raw": str(raw), "custom": custom_records(custom), "readers": json.dumps(readers or {})}
    if selectors is not None:
        o = Options(options)
        f, found = o.open(o.paths[0])
        with f:
            paths = list(found.branches) if isinstance(found, Tree) else [x.name for x in found.fields]
        options["columns"] = json.dumps(chosen(paths, selectors))
    if rows is not None:
        options["rows"] = f"{rows[0]}:{'' if rows[1] is None else rows[1]}"
    return spark.read.format(FORMAT).options(**options).load()


def write(df: DataFrame, path: str, object: str = "ntuple", compression: int = ntuple_write.COMPRESSION, mode: str = "overwrite", cluster: int = ntuple_write.CLUSTER) -> None:
    """df as ntuples in a folder, a file or more for each partition of it."""
    register(df.sparkSession)
    df.write.format(FORMAT).mode(mode).option("object", object).option("compression", compression).option("cluster", cluster).save(path)


def entry_count(path: str, object: str = "") -> int:
    """The number of rows, from what the files say of themselves."""
    o = Options({"path": path, "object": object})
    n = 0
    for p in o.paths:
        f, found = o.open(p)
        with f:
            n += found.entries
    return n


def with_aliases(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """df with a column for each alias of a tree that Spark can compute; an expression in which it finds no column of df is left out."""
    out = df
    for name, text in aliases.items():
        e: Column = F.expr(text.replace("&&", " and ").replace("||", " or "))
        try:
            out = out.withColumn(name, e)
            out.schema  # noqa: B018 - makes Spark look at the expression now
        except Exception as e:  # noqa: BLE001
            if type(e).__name__ not in ("AnalysisException", "ParseException"):
                raise
    return out


def index_frame(spark: SparkSession, path: str, object: str) -> DataFrame:
    """The index that a tree has: major, minor, entry (from 0), sorted by the keys."""
    with Container(path) as f:
        i = f[object].index
    if i is None:
        raise KeyError(f"{object} has no index")
    minor = i["fIndexValuesMinor"] if len(i["fIndexValuesMinor"]) else [0] * int(i["fN"])
    return spark.createDataFrame(pa.table({"major": pa.array(i["fIndexValues"], pa.int64()), "minor": pa.array(minor, pa.int64()), "entry": pa.array(i["fIndex"], pa.int64())}))


__all__ = ["ContainerSource", "catalog", "entry_count", "index_frame", "read", "register", "with_aliases", "write"]
