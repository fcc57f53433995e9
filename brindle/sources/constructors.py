"""Matrices and vectors made from a rule. Rows come from ranges, so nothing is held on the driver."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.core import Matrix, MultiVector, Vector
from brindle.errors import IncompatibleSize, IndexOutOfRange
from brindle.operators.strips import UNSUMMED


def make_sparse(entries: DataFrame, nrows: int | None = None, ncols: int | None = None) -> Matrix:
    """Of triplets (i, j, v): zeros dropped, equal places summed. Without a shape it is the largest index plus one."""
    lines = entries.filter("v <> 0").select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))
    df = lines.groupBy("i", "j").agg(F.sum("v").alias("v"))
    setattr(df, UNSUMMED, lines)
    if nrows is None or ncols is None:
        m, n = entries.agg(F.coalesce(F.max("i") + 1, F.lit(0)), F.coalesce(F.max("j") + 1, F.lit(0))).first()
        nrows, ncols = m if nrows is None else nrows, n if ncols is None else ncols
    return Matrix(df, int(nrows), int(ncols))


def triplets(spark: SparkSession, rows: Sequence[int], cols: Sequence[int], values: Sequence[float]) -> DataFrame:
    if not len(rows) == len(cols) == len(values):
        raise IncompatibleSize("triplet arrays of different lengths")
    return spark.createDataFrame(pa.table({"i": pa.array(rows, pa.int64()), "j": pa.array(cols, pa.int64()), "v": pa.array(values, pa.float64())}))


def from_compressed(spark: SparkSession, nrows: int, ncols: int, starts: Sequence[int], indices: Sequence[int], values: Sequence[float], by_column: bool = False) -> Matrix:
    """Of compressed rows (or columns): starts, indices, values."""
    major = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    i, j = (indices, major) if by_column else (major, indices)
    return Matrix(triplets(spark, list(i), list(j), list(values)), nrows, ncols)


def from_numpy(spark: SparkSession, a: np.ndarray, zeros: bool = False) -> Matrix | Vector:
    """Of an array of one or two dimensions; zeros are stored only if asked for."""
    if a.ndim == 1:
        k = np.arange(len(a)) if zeros else np.flatnonzero(a)
        return Vector(spark.createDataFrame(pa.table({"i": pa.array(k, pa.int64()), "v": pa.array(np.asarray(a, float)[k])})), len(a))
    i, j = np.indices(a.shape).reshape(2, -1) if zeros else np.nonzero(a)
    return Matrix(triplets(spark, i, j, np.asarray(a, float)[i, j]), *a.shape)


def computed(spark: SparkSession, nrows: int, ncols: int, f: Callable[[Column, Column], Column]) -> Matrix:
    """v = f(i, j) at every place; one range over all places, no join."""
    n = F.lit(ncols)
    at = spark.range(nrows * ncols).select(F.floor(F.col("id") / n).cast("long").alias("i"), (F.col("id") % n).alias("j"))
    return Matrix(at.select("i", "j", f(F.col("i"), F.col("j")).cast("double").alias("v")), nrows, ncols)


def ones(spark: SparkSession, nrows: int, ncols: int) -> Matrix:
    return computed(spark, nrows, ncols, lambda i, j: F.lit(1.0))


def hilbert(spark: SparkSession, nrows: int, ncols: int) -> Matrix:
    return computed(spark, nrows, ncols, lambda i, j: 1.0 / (i + j + 1))


def hessian(spark: SparkSession, nrows: int, ncols: int, factor: float = 1.0) -> Matrix:
    """v = factor * (i + j)."""
    return computed(spark, nrows, ncols, lambda i, j: factor * (i + j))


def hessian_product(i: int, j: int, n: int, factor: float = 1.0) -> float:
    """The entry (i, j) of hessian(m, n, 1) * hessian(n, p, factor), worked out."""
    return factor * sum((i + k) * (k + j) for k in range(n))


def check_hessian_product(C: Matrix, n: int, factor: float = 1.0) -> bool:
    """Whether corners and centre of a product of two such matrices are right."""
    at = {(r, c) for r in (0, C.nrows // 2, C.nrows - 1) for c in (0, C.ncols // 2, C.ncols - 1)}
    found = {(x["i"], x["j"]): x["v"] for x in C.df.filter(F.struct("i", "j").isin([F.struct(F.lit(r).cast("long"), F.lit(c).cast("long")) for r, c in at])).collect()}
    return all(abs(found.get(x, 0.0) - hessian_product(*x, n, factor)) <= 1e-9 * max(1.0, abs(hessian_product(*x, n, factor))) for x in at)


def diagonal_setup(spark: SparkSession, nrows: int, ncols: int, value: float) -> Matrix:
    """The value on the diagonal, of any shape."""
    k = spark.range(min(nrows, ncols))
    return Matrix(k.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(float(value)).alias("v")), nrows, ncols)


scaled_identity = diagonal_setup


def identity(spark: SparkSession, nrows: int, ncols: int | None = None) -> Matrix:
    return diagonal_setup(spark, nrows, nrows if ncols is None else ncols, 1.0)


def _stencil(df: DataFrame, m: int, n: int, row: Column) -> DataFrame:
    """Five cells of each grid point, those off the grid left out."""
    k = F.col("id")
    x, y = F.floor(k / n), k % n
    cells = [(F.lit(True), k, 4.0), (y > 0, k - 1, -1.0), (y < n - 1, k + 1, -1.0), (x > 0, k - n, -1.0), (x < m - 1, k + n, -1.0)]
    cell = F.array(*[F.when(ok, F.struct(at.cast("long").alias("j"), F.lit(v).alias("w"))) for ok, at, v in cells])
    return df.select(row.alias("i"), F.explode(F.filter(cell, lambda c: c.isNotNull())).alias("c"), "*")


def laplacian(spark: SparkSession, m: int, n: int) -> Matrix:
    """The five-point Laplace operator on an m x n grid."""
    cells = _stencil(spark.range(m * n), m, n, F.col("id"))
    return Matrix(cells.select("i", F.col("c.j").alias("j"), F.col("c.w").alias("v")), m * n, m * n)


def poisson_apply(m: int, n: int, x: Vector) -> Vector:
    """The same operator on a vector without a matrix: every entry is sent to its neighbours and summed there."""
    sent = _stencil(x.df.select(F.col("i").alias("id"), F.col("v").alias("x")), m, n, F.col("id"))
    out = sent.groupBy(F.col("c.j").alias("i")).agg(F.sum(F.col("c.w") * F.col("x")).alias("v"))
    return x.with_df(out)


def unit_vector(spark: SparkSession, k: int, n: int) -> Vector:
    if not 0 <= k < n:
        raise IndexOutOfRange(f"{k} of {n}")
    return Vector(spark.range(n).select(F.col("id").alias("i"), F.when(F.col("id") == k, 1.0).otherwise(0.0).alias("v")), n)


def iota(spark: SparkSession, n: int, offset: float = 0) -> Vector:
    return Vector(spark.range(n).select(F.col("id").alias("i"), (F.col("id") + offset).cast("double").alias("v")), n)


def fill(spark: SparkSession, shape: int | tuple[int, int], value: float) -> Vector | Matrix:
    """The value everywhere."""
    if isinstance(shape, int):
        return Vector(spark.range(shape).select(F.col("id").alias("i"), F.lit(float(value)).alias("v")), shape)
    return computed(spark, *shape, lambda i, j: F.lit(float(value)))


def set_to_zero(x):
    """No entries."""
    return x.with_df(x.df.limit(0))


def random(spark: SparkSession, shape: int | tuple[int, int], seed: int = 42, generator: Callable[[Column], Column] | None = None) -> Vector | Matrix:
    """Uniform values in [0, 1), a function of seed and place: the same however the rows are dealt. `generator` maps them.

    Multiplicative congruences by the prime 2**31 - 1, the place taken in twice, so neighbours are not related; all in 64-bit integers.
    """
    prime = F.lit((1 << 31) - 1).cast("long")

    def uniform(*at: Column) -> Column:
        state = F.lit(int(seed) % ((1 << 31) - 1)).cast("long")
        for k in at:
            k = k % prime
            state = (k * 16807 + state * 48271 + 11) % prime
            state = (state * 69621 % prime * 48271 + k) % prime
        return (state * 69621 % prime).cast("double") / float((1 << 31) - 1)

    g = generator or (lambda u: u)
    if isinstance(shape, int):
        return Vector(spark.range(shape).select(F.col("id").alias("i"), g(uniform(F.col("id"))).alias("v")), shape)
    return computed(spark, *shape, lambda i, j: g(uniform(i, j)))


def tag_vector(spark: SparkSession, n: int, start: int, end: int) -> DataFrame:
    """(i, tag): whether i is in [start, end)."""
    return spark.range(n).select(F.col("id").alias("i"), F.col("id").between(start, end - 1).alias("tag"))


def block_diagonal(blocks: DataFrame, n: int) -> Matrix:
    """Of blocks (start, data: rows of values) on the diagonal."""
    rows = blocks.select("start", F.posexplode("data").alias("a", "row")).select("start", "a", F.posexplode("row").alias("b", "v"))
    return Matrix(rows.select((F.col("start") + F.col("a")).cast("long").alias("i"), (F.col("start") + F.col("b")).cast("long").alias("j"), F.col("v").cast("double").alias("v")), n, n)


def exploded(df: DataFrame, row: str, array: str, nrows: int, ncols: int) -> Matrix:
    """A dense matrix of rows held as arrays."""
    cells = df.select(F.col(row).cast("long").alias("i"), F.posexplode(array).alias("j", "v"))
    return Matrix(cells.select("i", F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v")), nrows, ncols)


def zero_multi_vector(spark: SparkSession, size: int, count: int) -> MultiVector:
    return MultiVector(spark.createDataFrame([], "j long, i long, v double"), size, count)
