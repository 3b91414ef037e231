"""Results of fits that files hold: what they say of the fit, their parameters as rows, and their matrices."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .container import Container
from .objects import Obj


@dataclass(frozen=True)
class Parameter:
    name: str
    title: str
    value: float
    error: float
    error_low: float
    error_high: float
    plot_min: float
    plot_max: float
    plot_bins: int
    unit: str
    label: str


@dataclass(frozen=True)
class FitResult:
    """Matrices are None where the fit stored none. What single steps returned isn't read."""

    name: str
    title: str
    status: int
    covqual: int
    bad_nll: int
    minnll: float
    edm: float
    const: tuple[Parameter, ...]
    initial: tuple[Parameter, ...]
    final: tuple[Parameter, ...]
    correlation: np.ndarray | None
    covariance: np.ndarray | None
    global_correlations: np.ndarray | None

    def parameters(self, spark: SparkSession) -> DataFrame:
        """A row for each parameter: kind (const, initial or final), place and what is known of it."""
        rows = [(kind, i, *vars(p).values()) for kind in ("const", "initial", "final") for i, p in enumerate(getattr(self, kind))]
        numbers = ", ".join(f"{n} double" for n in ("value", "error", "error_low", "error_high", "plot_min", "plot_max"))
        return spark.createDataFrame(rows, f"kind string, place int, name string, title string, {numbers}, plot_bins int, unit string, label string")

    def matrix_frame(self, spark: SparkSession, which: str = "covariance") -> DataFrame | None:
        """(i, j, v) of a matrix."""
        m = getattr(self, which)
        if m is None:
            return None
        return spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(m)], "i int, j int, v double")


def parameter(obj: Obj) -> Parameter:
    get = lambda n, d=0.0: obj.get(n, d)
    return Parameter(obj["fName"], obj["fTitle"], *(float(get(n)) for n in ("_value", "_error", "_asymErrLo", "_asymErrHi", "_plotMin", "_plotMax")), int(get("_plotBins")), get("_unit", ""), get("_label", ""))


def parameters(collection: Obj | None) -> tuple[Parameter, ...]:
    """The variables in a list of arguments; others are left out."""
    return tuple(parameter(x) for x in (collection.get("_list") or ()) if isinstance(x, Obj) and "_value" in x.members) if collection else ()


def fit_result(obj: Obj) -> FitResult:
    lists = (parameters(obj.get(n)) for n in ("_constPars", "_initPars", "_finalPars"))
    return FitResult(obj["fName"], obj["fTitle"], obj["_status"], obj["_covQual"], obj["_numBadNLL"], obj["_minNLL"], obj["_edm"], *lists, *(obj.get(n) for n in ("_CM", "_VM", "_GC")))


def read_fit(path: str, name: str) -> FitResult:
    with Container(path) as f:
        return fit_result(f[name])
