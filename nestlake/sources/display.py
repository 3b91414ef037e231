"""Files and tables as text: a tree of the objects of a file, and the first rows of a table with short cells."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame

from .container import Container, Directory
from .ntuple import Field, Ntuple
from .tree import Tree

#: Rows and columns of a table, letters of a cell; names of a list before and after the gap.
ROWS, COLUMNS, CELL, ENDS, MOST_NAMES = 10, 30, 100, 3, 7


def rounded(x: float) -> float:
    """To three significant digits."""
    return float(f"{x:.3g}") if x == x and abs(x) != float("inf") else x


def short(value, letters: int = CELL) -> str:
    """A cell as text: numbers in lists to three significant digits, cut off after so many letters."""
    if isinstance(value, (list, tuple)):
        value = [rounded(v) if isinstance(v, float) else v for v in value]
        return ("[" + ", ".join(short(v, letters) for v in value) + "]")[:letters]
    return str(value)[:letters]


def thousands(n: int) -> str:
    return f"{n:,}"


def _names(names: list[str]) -> list[str]:
    return names if len(names) <= MOST_NAMES else [*names[:ENDS], "⋮", *names[-ENDS:]]


def file_tree(f: Container) -> str:
    """The objects of a file: trees with their branches first, each name once, then all else; ntuples with their fields."""
    out = [f.path]

    def field(x: Field, prefix: str) -> None:
        out.append(f"{prefix}{x.name} ({x.type_name or 'struct'})")
        for c in x.children:
            if c.name != "_0":
                field(c, prefix + "  ")

    def level(d: Directory, prefix: str, path: str) -> None:
        keys = d.newest()
        for k in sorted(keys, key=lambda k: k.cls != "TTree"):
            at = f"{path}{k.name}"
            out.append(f"{prefix}{k.name} ({k.cls})")
            if k.cls.startswith("TDirectory"):
                level(f[at], prefix + "  ", f"{at}/")
            elif k.cls in ("TTree", "TNtuple", "TNtupleD", "ROOT::RNTuple"):
                found = f[at]
                if isinstance(found, Tree):
                    out.extend(f"{prefix}  {n}" for n in _names(list(found.branches)))
                elif isinstance(found, Ntuple):
                    for x in found.fields:
                        field(x, prefix + "  ")

    level(f.root, "  ", "")
    return "\n".join(out)


def text_table(df: DataFrame, rows: int = ROWS, width: int = 160) -> str:
    """The first rows with names and types over them; columns are cut to share `width`."""
    names = df.columns[:COLUMNS]
    letters = max(4, width // max(1, min(8, len(names))))
    head = [[n[:15] for n in names], [df.schema[n].dataType.simpleString()[:15] for n in names]]
    body = [[short(r[n], letters) for n in names] for r in df.limit(rows).collect()]
    sizes = [max(len(x[i]) for x in [*head, *body]) for i in range(len(names))]
    line = lambda cells: " | ".join(c.ljust(s) for c, s in zip(cells, sizes, strict=True)).rstrip()
    return "\n".join([line(head[0]), line(head[1]), "-+-".join("-" * s for s in sizes), *map(line, body)])


def html_table(df: DataFrame, rows: int = ROWS, columns: int = COLUMNS) -> str:
    """The first rows and columns as HTML, with the numbers of all before them."""
    n, names = df.count(), df.columns[:columns]
    left = [f"{thousands(n - rows)} rows"] * (n > rows) + [f"{len(df.columns) - columns} columns"] * (len(df.columns) > columns)
    note = f" (omitted printing of {' and '.join(left)})" if left else ""
    head = "".join(f"<th>{escape(c)}<br>{escape(df.schema[c].dataType.simpleString()[:15])}</th>" for c in names)
    body = "".join(f"<tr><td>{i}</td>{''.join(f'<td>{escape(short(r[c]))}</td>' for c in names)}</tr>" for i, r in enumerate(df.limit(rows).collect(), 1))
    return f"<p>{thousands(n)} rows × {len(df.columns)} columns{note}</p><table><tr><th></th>{head}</tr>{body}</table>"
