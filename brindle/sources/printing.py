"""Texts of matrices, vectors and plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.core import Matrix, Vector
from brindle.functions import scalar as S
from brindle.plans.lineage import DENSE, must_fit


def _text(kind: str, precision: int) -> Column:
    """A value with so many digits, zeros at the end of a fraction left out."""
    shown = lambda c: F.format_string(f"%.{precision}g", c)
    number = lambda c: F.when(shown(c).contains(".") & ~shown(c).contains("e"), F.regexp_replace(shown(c), r"\.?0+$", "")).otherwise(shown(c))
    if kind == "complex":
        return F.concat(F.lit("("), number(S.real("v")), F.lit(","), number(S.imag("v")), F.lit(")"))
    return number(F.col("v"))


def print_rows(A: Matrix, width: int = 8, precision: int = 6) -> DataFrame:
    """(i, text): a line for each row that has an entry, values right-aligned, absent ones as 0."""
    must_fit(A.ncols, DENSE, "a printed row")
    cells = A.df.select("i", F.struct(F.col("j"), _text(A.kind, precision).alias("t")).alias("c")).groupBy("i").agg(F.map_from_entries(F.collect_list("c")).alias("m"))
    line = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(A.ncols - 1)), lambda k: F.lpad(F.coalesce(F.col("m")[k.cast("long")], F.lit("0")), width, " ")), " ")
    return cells.select("i", F.concat(F.lit("["), line, F.lit("]")).alias("text"))


def print_matrix(A: Matrix, width: int = 8, precision: int = 6) -> str:
    """All rows; for matrices that fit the driver."""
    must_fit(A.nrows, DENSE, "a printed matrix")
    found = {r["i"]: r["text"] for r in print_rows(A, width, precision).collect()}
    empty = "[" + " ".join("0".rjust(width) for _ in range(A.ncols)) + "]"
    return "\n".join(found.get(i, empty) for i in range(A.nrows))


def print_vector(x: Vector, precision: int = 6) -> str:
    must_fit(x.size, DENSE * DENSE, "a printed vector")
    found = {r["i"]: r["t"] for r in x.df.select("i", _text(x.kind, precision).alias("t")).collect()}
    return f"{{{x.size}{'R' if x.row else 'C'}}}[" + ",".join(found.get(i, "0") for i in range(x.size)) + "]"


def print_size(x: Matrix | Vector, precision: int = 6) -> int:
    """Characters of the widest entry."""
    return x.df.agg(F.coalesce(F.max(F.length(_text(x.kind, precision))), F.lit(1))).first()[0]


def plan_text(x) -> str:
    """The expression behind a lazy value, as Spark's formatted plan."""
    return x.df._sc._jvm.PythonSQLUtils.explainString(x.df._jdf.queryExecution(), "formatted")


def plan_graph(x) -> str:
    """The same as GraphViz text: a node for each logical operator, an edge to each operand."""
    names, edges = [], []

    def walk(node) -> int:
        k = len(names)
        names.append(node.nodeName())
        children = node.children()
        for c in range(children.size()):
            edges.append((k, walk(children.apply(c))))
        return k

    walk(x.df._jdf.queryExecution().analyzed())
    return "digraph plan {\n" + "".join(f'  n{k} [label="{n}"];\n' for k, n in enumerate(names)) + "".join(f"  n{a} -> n{b};\n" for a, b in edges) + "}\n"
