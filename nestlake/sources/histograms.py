"""Histograms that files hold: their bins, flow included, as DataFrames, with axes, labels and running sums."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from ..operators.hist import PLACES, Axis, Hist
from .container import Container
from .objects import Obj

#: Members of histograms and axes that are read; the layout of a file may have more.
AXES = ("fXaxis", "fYaxis", "fZaxis")
SUMS = {"fTsumw": "tsumw", "fTsumw2": "tsumw2", **{f"fTsumw{a}": f"tsumw{a}" for a in ("x", "x2", "y", "y2", "z", "z2", "xy", "xz", "yz")}}
_AXIS = [
    ("base", "TNamed", 1), ("base", "TAttAxis", 4), ("basic", "fNbins", "int"), ("basic", "fXmin", "double"), ("basic", "fXmax", "double"), ("any", "fXbins", "TArrayD"), ("basic", "fFirst", "int"), ("basic", "fLast", "int"),
    ("basic", "fBits2", "unsigned short"), ("basic", "fTimeDisplay", "bool"), ("string", "fTimeFormat"), ("pointer", "fLabels", "THashList"), ("pointer", "fModLabs", "TList"),
]
_ONE = [
    ("base", "TNamed", 1), ("base", "TAttFill", 2), ("basic", "fNcells", "int"), *[("object", a, "TAxis") for a in AXES], ("basic", "fBarOffset", "short"), ("basic", "fBarWidth", "short"),
    *[("basic", n, "double") for n in ("fEntries", "fTsumw", "fTsumw2", "fTsumwx", "fTsumwx2", "fMaximum", "fMinimum", "fNormFactor")], ("any", "fContour", "TArrayD"), ("any", "fSumw2", "TArrayD"), ("string", "fOption"), ("pointer", "fFunctions", "TList"),
    ("basic", "fBufferSize", "int"), ("counted", "fBuffer", "double", "fBufferSize"),
]
#: Layouts of histograms for files that are built.
LAYOUTS = [
    ("TAttAxis", 4, [("basic", "fNdivisions", "int"), ("basic", "fTickLength", "float")]), ("TAxis", 10, _AXIS), ("TH1", 8, _ONE),
    ("TH2", 5, [("base", "TH1", 8), *[("basic", n, "double") for n in ("fScalefactor", "fTsumwy", "fTsumwy2", "fTsumwxy")]]),
    ("TH3", 6, [("base", "TH1", 8), *[("basic", n, "double") for n in ("fTsumwy", "fTsumwy2", "fTsumwxy", "fTsumwz", "fTsumwz2", "fTsumwxz", "fTsumwyz")]]),
    *[(f"TH{d}{k}", 3, [("base", f"TH{d}", 8), ("base", f"TArray{k}", 1)]) for d in (1, 2, 3) for k in "IFD"],
]


def axis_of(obj: Obj, column: str) -> Axis:
    """Bins between edges where the file has them, equal ones where not."""
    cuts = obj.get("fXbins")
    edges = tuple(float(x) for x in cuts) if cuts is not None and len(cuts) else ()
    labels = tuple(str(x) for x in obj.get("fLabels") or ())
    return Axis(column, int(obj["fNbins"]), float(obj["fXmin"]), float(obj["fXmax"]), edges, labels)


def parsed(obj: Obj) -> tuple[np.ndarray, tuple[Axis, ...], np.ndarray, float]:
    """(contents, axes, sumw2, entries), without under- and overflow. The class says how many dimensions there are, whatever the numbers of bins."""
    dims = int(obj.cls[2])
    axes = tuple(axis_of(obj[a], n) for a, n in zip(AXES[:dims], "xyz", strict=False))
    sizes = [a.n + 2 for a in axes]
    content = np.asarray(obj["[base]"], np.float64)
    squares = np.asarray(obj.get("fSumw2", ()), np.float64)
    squares = squares if len(squares) else content  # unweighted
    cut = tuple(slice(1, n - 1) for n in sizes)
    shape = lambda x: x.reshape(sizes, order="F")[cut]  # noqa: E731 - the first axis runs fastest
    return shape(content), axes, shape(squares), float(obj["fEntries"])


def as_hist(spark: SparkSession, obj: Obj) -> Hist:
    """All bins, flow included: places, content, sumw2; entries of single bins aren't kept in files."""
    _, axes, _, entries = parsed(obj)
    sizes = [a.n + 2 for a in axes]
    content = np.asarray(obj["[base]"], np.float64)
    squares = np.asarray(obj.get("fSumw2", ()), np.float64)
    places = np.unravel_index(np.arange(len(content)), sizes, order="F")
    table = {n: pa.array(p.astype(np.int32)) for n, p in zip(PLACES, places, strict=False)}
    table |= {"entries": pa.nulls(len(content), pa.int64()), "content": pa.array(content), "sumw2": pa.array(squares if len(squares) else content)}
    sums = {new: float(obj[old]) for old, new in SUMS.items() if old in obj.members}
    return Hist(spark.createDataFrame(pa.table(table)), axes, obj["fName"], obj["fTitle"], entries, sums)


def read_hist(spark: SparkSession, path: str, name: str) -> Hist:
    with Container(path) as f:
        return as_hist(spark, f[name])
