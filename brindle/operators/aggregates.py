"""Reductions and norms: partial sums in every task, one row or one row per key after the shuffle.

An empty reduction is the identity of its monoid, never null. Reductions look at stored entries, as sparse storage has it;
`implicit_zeros=True` lets absent entries count where that changes the result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.core import Matrix, Vector
from brindle.errors import NeedNonempty
from brindle.functions import scalar as S
from brindle.functions.scalar import MONOID_IDENTITY, Field


def _stored(x) -> Column:
    return F.count("*")


def _or(agg: Column, op: str) -> Column:
    return F.coalesce(agg, F.lit(MONOID_IDENTITY[op]))


def _with_zeros(x, agg: Column, pick: Callable[[Column, Column], Column]) -> Column:
    size = x.size if isinstance(x, Vector) else x.nrows * x.ncols
    return F.when(F.count("*") < size, F.coalesce(pick(agg, F.lit(0.0)), F.lit(0.0))).otherwise(agg)


def reductions(x, implicit_zeros: bool = False) -> dict[str, Column]:
    """All reductions of a vector's or matrix's entries as aggregate Columns, to be computed together in one pass."""
    f = Field(x.kind)
    z = (lambda a, p: _with_zeros(x, a, p)) if implicit_zeros else (lambda a, p: a)
    out = {"one_norm": _or(F.sum(f.abs(F.col("v"))), "add"), "two_norm": F.sqrt(_or(F.sum(f.abs2(F.col("v"))), "add")), "infinity_norm": F.coalesce(F.max(f.abs(F.col("v"))), F.lit(0.0)), "unary_dot": _or(F.sum(f.abs2(F.col("v"))), "add")}
    if x.kind == "real":
        product = _or(F.product(F.col("v")), "multiply")
        size = x.size if isinstance(x, Vector) else x.nrows * x.ncols
        out |= {
            "sum": _or(F.sum(F.col("v")), "add"),
            "product": F.when(F.count("*") < size, F.lit(0.0)).otherwise(product) if implicit_zeros else product,
            "max": _or(z(F.max(F.col("v")), F.greatest), "max"),
            "min": _or(z(F.min(F.col("v")), F.least), "min"),
        }
    else:
        out["sum"] = S.complex_(_or(F.sum(S.real(F.col("v"))), "add"), _or(F.sum(S.imag(F.col("v"))), "add"))
    return out


def reduce_many(x, names: Sequence[str], implicit_zeros: bool = False) -> DataFrame:
    """One row with the named reductions, fused into one pass."""
    every = reductions(x, implicit_zeros)
    return x.df.agg(*[every[n].alias(n) for n in names])


def _one(name: str):
    def reduction(x, implicit_zeros: bool = False):
        found = reduce_many(x, [name], implicit_zeros).first()[0]
        return complex(found["re"], found["im"]) if x.kind == "complex" and name == "sum" else found

    reduction.__name__ = name
    return reduction


sum_, product, max_, min_, unary_dot = map(_one, ("sum", "product", "max", "min", "unary_dot"))
two_norm = _one("two_norm")


def frobenius_norm(A: Matrix) -> float:
    return two_norm(A)


def sums_along(A: Matrix, by: str) -> DataFrame:
    """Sums of magnitudes of each row (by i) or column (by j)."""
    return A.df.groupBy(by).agg(F.sum(Field(A.kind).abs(F.col("v"))).alias("s"))


def max_of_sums(A: Matrix, by: str) -> float:
    return sums_along(A, by).agg(F.coalesce(F.max("s"), F.lit(0.0))).first()[0]


def one_norm(x) -> float:
    """Of a vector the sum of magnitudes, of a matrix the largest column sum."""
    return reduce_many(x, ["one_norm"]).first()[0] if isinstance(x, Vector) else max_of_sums(x, "j")


def infinity_norm(x) -> float:
    """Of a vector the largest magnitude, of a matrix the largest row sum."""
    return reduce_many(x, ["infinity_norm"]).first()[0] if isinstance(x, Vector) else max_of_sums(x, "i")


def _position(x, key: Column):
    keys = ["i"] if isinstance(x, Vector) else ["i", "j"]
    found = x.df.agg(F.min_by(F.struct(*keys), F.struct(key.alias("k"), *keys)).alias("p")).first()["p"]
    if found is None:
        raise NeedNonempty("no stored entry")
    return found[0] if len(keys) == 1 else tuple(found)


def max_pos(x):
    """Position of the largest stored entry, the first of equal ones."""
    return _position(x, -F.col("v"))


def min_pos(x):
    return _position(x, F.col("v"))


def max_abs_pos(x):
    return _position(x, -Field(x.kind).abs(F.col("v")))


def paired(x: Vector, y: Vector) -> DataFrame:
    """(i, a, b) where both have an entry."""
    x.same_size(y)
    return x.df.select("i", F.col("v").alias("a")).join(y.df.select("i", F.col("v").alias("b")), "i")


def _dot(x: Vector, y: Vector, conjugate: bool):
    from brindle.operators.joins import _kind

    x, y, kind = _kind(x, y)
    f = Field(kind)
    a = f.conj(F.col("a")) if conjugate else F.col("a")
    found = paired(x, y).agg(f.sum(f.mul(a, F.col("b"))).alias("d")).first()["d"]
    if kind == "complex":
        return complex(found["re"] or 0.0, found["im"] or 0.0)
    return found or 0.0


def dot(x: Vector, y: Vector):
    """The inner product; the first argument is conjugated."""
    return _dot(x, y, True)


def dot_real(x: Vector, y: Vector):
    """The product without conjugation."""
    return _dot(x, y, False)


pseudo_dot = dot_real


def trace(A: Matrix) -> float:
    A.square()
    diagonal = Vector(A.df.filter("i = j").select("i", "v"), A.nrows, False, A.kind)
    return sum_(diagonal)


def accumulate(x: Vector, op: str | Callable[[Column], Column]):
    """A fold by a monoid's name, or by any aggregate of v."""
    how = {"add": F.sum, "multiply": F.product, "max": F.max, "min": F.min, "bit_and": F.bit_and, "bit_or": F.bit_or, "bit_xor": F.bit_xor, "concat": lambda c: F.listagg(c)}
    agg = how[op](F.col("v")) if isinstance(op, str) else op(F.col("v"))
    found = x.df.agg(agg).first()[0]
    return MONOID_IDENTITY[op] if found is None and isinstance(op, str) else found


def reduce_with(x, init, update: Callable, merge: Callable, finish: Callable = lambda a: a):
    """A user's reduction: every task folds its entries from `init`, the tasks' results are merged in a tree."""
    states = x.df.select("v").mapInPandas(lambda batches: _folded(batches, init, update), "state binary")
    import pickle

    merged = states.rdd.map(lambda r: pickle.loads(r["state"])).treeReduce(merge) if x.df.limit(1).count() else init
    return finish(merged)


def _folded(batches, init, update):
    import pickle

    state, seen = init, False
    for b in batches:
        for v in b["v"]:
            state, seen = update(state, v), True
    if seen:
        yield pd.DataFrame({"state": [pickle.dumps(state)]})


def compress(entries: DataFrame, how: Column) -> DataFrame:
    """Triplets that meet at one place, combined."""
    return entries.groupBy("i", "j").agg(how.alias("v"))
