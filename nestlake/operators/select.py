"""Choice of columns by exact name, by pattern, by pattern with a new name, and by container."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Selector = str | re.Pattern | tuple


def normalized(name: str) -> str:
    """A flat name for a path: split at . and /, without repeats of the first part and without the coordinates' container."""
    parts = [p for p in re.split(r"[./]", name) if p]
    head = parts[0] if parts else name
    rest = [p for k, p in enumerate(parts[1:]) if not (p == head and all(x == head for x in parts[1 : k + 1])) and p != "fCoordinates"]
    return "_".join([head, *rest])


def leaf_paths(schema: T.StructType, prefix: str = "") -> list[str]:
    """Paths of all leaves of nested structs, joined by a slash."""
    out = []
    for f in schema.fields:
        path = f"{prefix}{f.name}"
        out += leaf_paths(f.dataType, f"{path}/") if isinstance(f.dataType, T.StructType) else [path]
    return out


def _column(path: str, df: DataFrame) -> Column:
    if path in df.columns:
        return F.col(f"`{path}`")
    return F.col(".".join(f"`{p}`" for p in path.split("/")))


def chosen(names: list[str], selectors: Iterable[Selector] | Selector) -> list[tuple[str, str]]:
    """(source path, new name) in the order of the selectors; a pair that several select counts once, for the first.

    A string is an exact name, or a container whose members are taken without its prefix; where the container's own name begins the names of its
    members, it's kept. A pattern takes every path in which it is found, under the normalised path. (pattern, replacement)
    takes the same paths, under the path with every match replaced.
    """
    if isinstance(selectors, (str, re.Pattern)) or (isinstance(selectors, tuple) and len(selectors) == 2 and isinstance(selectors[0], re.Pattern)):
        selectors = [selectors]
    out: dict[tuple[str, str], None] = {}
    for s in selectors:
        if isinstance(s, str):
            inside = [n for n in names if n.startswith(f"{s}/")]
            if double := [n for n in inside if n.startswith(f"{s}/{s}")]:
                found = {n: normalized(n) for n in double}
            elif s in names:
                found = {s: normalized(s)}
            elif inside:
                found = {n: normalized(n[len(s) + 1 :]) for n in inside}
            else:
                raise KeyError(s)
        elif isinstance(s, re.Pattern):
            found = {n: normalized(n) for n in names if s.search(n)}
        elif isinstance(s, tuple) and len(s) == 2 and isinstance(s[0], re.Pattern):
            found = {n: s[0].sub(s[1], n) for n in names if s[0].search(n)}
        else:
            raise TypeError(f"no selector: {s!r}")
        out |= dict.fromkeys(found.items())
    return list(out)


def resolve(names: list[str], selectors: Iterable[Selector] | Selector) -> dict[str, str]:
    """`chosen` for readers that give a path one name: its first."""
    out: dict[str, str] = {}
    for path, name in chosen(names, selectors):
        out.setdefault(path, name)
    return out


def select(df: DataFrame, selectors: Iterable[Selector] | Selector) -> DataFrame:
    """df with the chosen columns only: Catalyst then reads no others from columnar files."""
    return df.select(*[_column(p, df).alias(new) for p, new in chosen(leaf_paths(df.schema), selectors)])


def row_struct(df: DataFrame, name: str = "row") -> DataFrame:
    """Each row as one struct."""
    return df.select(F.struct("*").alias(name))
