"""Projections, filters and other views: lazy plans without a shuffle unless stated."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.core import Matrix, MultiVector, Vector
from brindle.errors import IncompatibleSize, IndexOutOfRange, RangeError
from brindle.functions import scalar as S
from brindle.functions.scalar import Field
from brindle.plans.lineage import broadcast_if_small


def _map(x, f: Callable[[Column], Column], kind: str | None = None):
    return x.with_df(x.df.withColumn("v", f(F.col("v"))), kind=kind or x.kind)


def trans(x):
    """Of a matrix the mirror image, of a vector the other orientation."""
    if isinstance(x, Vector):
        return x.with_df(x.df, row=not x.row)
    df = x.df.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
    if found := getattr(x.df, "_of_panels", None):  # operators.panels.ORIGIN
        df._of_panels = (*found[:2], not found[2])
    df._of_view = (x.df, "t")  # operators.components.VIEW
    df._of_mirror = x  # operators.strips.MIRROR
    return x.with_df(df, nrows=x.ncols, ncols=x.nrows)


def conj(x):
    return _map(x, Field(x.kind).conj)


def hermitian(x):
    return conj(trans(x))


adjoint = hermitian


def real(x):
    return _map(x, S.real if x.kind == "complex" else S.identity, "real")


def imag(x):
    return _map(x, S.imag if x.kind == "complex" else (lambda v: v * 0.0), "real")


def negate(x):
    return _map(x, Field(x.kind).neg)


def scale(alpha, x):
    """alpha * x for a number; on either side, for matrices and vectors."""
    if isinstance(alpha, complex) and x.kind == "real":
        return _map(x, lambda v: S.c_mul(S.as_complex(v), Field("complex").lit(alpha)), "complex")
    f = Field(x.kind)
    return _map(x, lambda v: f.mul(v, f.lit(alpha)))


left_scale = right_scale = scale


def divide_by(x, alpha):
    """x / alpha; division by zero gives infinities and NaN, as IEEE has it."""
    return _map(x, lambda v: S.c_div(v, Field("complex").lit(alpha)) if x.kind == "complex" else S.divide(v, F.lit(float(alpha))))


def left_scale_inplace(alpha, x):
    """alpha * x for a number or a matrix alpha."""
    from brindle.operators.joins import matmul

    return matmul(alpha, x) if isinstance(alpha, Matrix) else scale(alpha, x)


def right_scale_inplace(x, alpha):
    from brindle.operators.joins import matmul

    return matmul(x, alpha) if isinstance(alpha, Matrix) else scale(alpha, x)


def map_values(x, *functions: Callable[[Column], Column]):
    """Applies functions to every stored entry, the first one first. Chained views collapse to one projection."""
    return _map(x, lambda v: reduce(lambda acc, f: f(acc), functions, v))


def map_positions(A: Matrix, f: Callable[[Column, Column, Column], Column]) -> Matrix:
    """v = f(i, j, v) for every stored entry."""
    return A.with_df(A.df.withColumn("v", f(F.col("i"), F.col("j"), F.col("v"))))


assign_each_nonzero = map_values


def look_at_each_nonzero(A: Matrix, aggregate: Column) -> DataFrame:
    """One aggregate over all stored entries (of columns i, j, v)."""
    return A.df.agg(aggregate)


def bands(A: Matrix, begin: int, end: int) -> Matrix:
    """Entries with begin <= j - i < end."""
    if end < begin:
        raise RangeError(f"[{begin}, {end})")
    return A.with_df(A.df.filter((F.col("j") - F.col("i") >= begin) & (F.col("j") - F.col("i") < end)))


def triu(A: Matrix, d: int = 0) -> Matrix:
    return A.with_df(A.df.filter(F.col("j") - F.col("i") >= d))


def tril(A: Matrix, d: int = 0) -> Matrix:
    return A.with_df(A.df.filter(F.col("j") - F.col("i") <= d))


def upper(A: Matrix) -> Matrix:
    out = triu(A)
    out.df._of_view = (A.df, "upper")  # operators.components.VIEW
    return out


def lower(A: Matrix) -> Matrix:
    out = tril(A)
    out.df._of_view = (A.df, "lower")  # operators.components.VIEW
    return out


def strict_upper(A: Matrix) -> Matrix:
    return triu(A, 1)


def strict_lower(A: Matrix) -> Matrix:
    return tril(A, -1)


def sub_matrix(A: Matrix, r0: int, r1: int, c0: int, c1: int) -> Matrix:
    """Rows [r0, r1) and columns [c0, c1), clamped to the shape."""
    r1, c1 = min(r1, A.nrows), min(c1, A.ncols)
    if r0 < 0 or c0 < 0 or r0 > r1 or c0 > c1:
        raise RangeError(f"[{r0}, {r1}) x [{c0}, {c1})")
    inside = A.df.filter(F.col("i").between(r0, r1 - 1) & F.col("j").between(c0, c1 - 1))
    return A.with_df(inside.select((F.col("i") - r0).alias("i"), (F.col("j") - c0).alias("j"), "v"), nrows=r1 - r0, ncols=c1 - c0)


def sub_vector(x: Vector, start: int, end: int) -> Vector:
    end = min(end, x.size)
    if start < 0 or start > end:
        raise RangeError(f"[{start}, {end})")
    return x.with_df(x.df.filter(F.col("i").between(start, end - 1)).select((F.col("i") - start).alias("i"), "v"), size=end - start)


def strided(x: Vector, start: int, end: int, stride: int) -> Vector:
    """Entries start, start + stride, ... below end."""
    size = max(0, -(-(min(end, x.size) - start) // stride))
    inside = x.df.filter(F.col("i").between(start, min(end, x.size) - 1) & ((F.col("i") - start) % stride == 0))
    return x.with_df(inside.select(((F.col("i") - start) / stride).cast("long").alias("i"), "v"), size=size)


def row(A: Matrix, r: int) -> Vector:
    if not 0 <= r < A.nrows:
        raise IndexOutOfRange(f"row {r} of {A.nrows}")
    return Vector(A.df.filter(F.col("i") == r).select(F.col("j").alias("i"), "v"), A.ncols, True, A.kind)


def column(A: Matrix, c: int) -> Vector:
    if not 0 <= c < A.ncols:
        raise IndexOutOfRange(f"column {c} of {A.ncols}")
    return Vector(A.df.filter(F.col("j") == c).select("i", "v"), A.nrows, False, A.kind)


def index_map(spark, indices: Sequence[int]) -> DataFrame:
    """(pos, src): position k takes what stands at indices[k]."""
    return spark.createDataFrame([(k, int(s)) for k, s in enumerate(indices)], "pos long, src long")


def indirect(A: Matrix, rows: Sequence[int], cols: Sequence[int]) -> Matrix:
    """A's rows and columns by index lists, repeats allowed."""
    for n, idx in ((A.nrows, rows), (A.ncols, cols)):
        if any(not 0 <= k < n for k in idx):
            raise IndexOutOfRange(f"an index outside [0, {n})")
    r = broadcast_if_small(index_map(A.spark, rows), len(rows))
    c = broadcast_if_small(index_map(A.spark, cols), len(cols))
    a = A.df.join(r, F.col("i") == F.col("src")).select(F.col("pos").alias("i"), "j", "v")
    a = a.join(c, F.col("j") == F.col("src")).select("i", F.col("pos").alias("j"), "v")
    return A.with_df(a, nrows=len(rows), ncols=len(cols))


def crop(x, threshold: float = 0.0):
    """Without entries of at most this magnitude (zeros, by default)."""
    return x.with_df(x.df.filter(Field(x.kind).abs(F.col("v")) > threshold))


def diagonal(x):
    """Of a matrix its diagonal as a vector, of a vector the diagonal matrix."""
    if isinstance(x, Vector):
        return Matrix(x.df.select("i", F.col("i").alias("j"), "v"), x.size, x.size, x.kind)
    return Vector(x.df.filter(F.col("i") == F.col("j")).select("i", "v"), min(x.nrows, x.ncols), False, x.kind)


def invert_diagonal(A: Matrix) -> Matrix:
    """Stored diagonal entries become their reciprocals."""
    inverse = S.c_div(Field("complex").lit(1), F.col("v")) if A.kind == "complex" else S.reciprocal(F.col("v"))
    return A.with_df(A.df.withColumn("v", F.when(F.col("i") == F.col("j"), inverse).otherwise(F.col("v"))))


def split_complex(x):
    """Real and imaginary parts."""
    return real(x), imag(x)


def merge_complex(re, im):
    """One complex vector or matrix of two real ones; where one has no entry it counts as zero."""
    keys = ["i"] if isinstance(re, Vector) else ["i", "j"]
    re.same_size(im) if isinstance(re, Vector) else re.same_shape(im)
    both = re.df.select(*keys, F.col("v").alias("a")).join(im.df.select(*keys, F.col("v").alias("b")), keys, "full")
    return re.with_df(both.select(*keys, S.complex_(F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))).alias("v")), kind="complex")


def at(A: Matrix, r: int, c: int) -> Column | float | complex:
    """The value of one entry."""
    A.check(r, c)
    found = A.df.filter((F.col("i") == r) & (F.col("j") == c)).select("v").first()
    if A.kind == "complex":
        return complex(found["v"]["re"], found["v"]["im"]) if found else 0j
    return found["v"] if found else 0.0


def extract(x: Vector, positions: Sequence[int]) -> list:
    """Several entries of a vector as numbers."""
    if any(not 0 <= p < x.size for p in positions):
        raise IndexOutOfRange(str(positions))
    found = {r["i"]: r["v"] for r in x.df.filter(F.col("i").isin(list(positions))).collect()}
    return [found.get(p, 0.0) for p in positions]


def equal(x: Vector, y: Vector) -> DataFrame:
    """One row, `equal`: whether all entries agree, absent ones as zero."""
    x.same_size(y)
    both = x.df.select("i", F.col("v").alias("a")).join(y.df.select("i", F.col("v").alias("b")), "i", "full")
    zero = Field(x.kind).lit(0)
    a, b = F.coalesce("a", zero), F.coalesce("b", zero)
    same = S.c_equal(a, b) if x.kind == "complex" else a == b
    return both.agg(F.coalesce(F.bool_and(same), F.lit(True)).alias("equal"))


def entry_similar(A: Matrix, r: int, c: int, value: float, eps: float) -> bool:
    return abs(at(A, r, c) - value) <= eps


def nnz(A: Matrix) -> int:
    """Stored entries; zeros that are stored count."""
    return A.df.count()


def nnz_per_row(A: Matrix) -> DataFrame:
    return A.df.groupBy("i").agg(F.count("*").alias("nnz"))


def symmetric_pattern(A: Matrix) -> Matrix:
    """With a stored zero wherever only the mirror image is stored."""
    A.square()
    mirror = A.df.select(F.col("j").alias("i"), F.col("i").alias("j")).join(A.df.select("i", "j"), ["i", "j"], "left_anti").distinct()
    return A.with_df(A.df.unionByName(mirror.withColumn("v", Field(A.kind).lit(0))))


# --- ranges ---------------------------------------------------------------------------------------------------------


def intersection(a: tuple[int, int], b: tuple[int, int]) -> tuple[int, int]:
    lo, hi = max(a[0], b[0]), min(a[1], b[1])
    return (lo, max(lo, hi))


def in_range(r: tuple[int, int], k: int) -> bool:
    return r[0] <= k < r[1]


def to_range(r: tuple[int, int], k: int) -> int:
    """The place of index k within the range."""
    return k - r[0]


def from_range(r: tuple[int, int], k: int) -> int:
    return k + r[0]


# --- recursion ------------------------------------------------------------------------------------------------------


class Quadrants:
    """A block of a matrix that splits into four at a power of two, the view that block algorithms walk."""

    def __init__(self, A: Matrix, r0: int = 0, r1: int | None = None, c0: int = 0, c1: int | None = None):
        self.A, self.r0, self.c0 = A, r0, c0
        self.r1, self.c1 = A.nrows if r1 is None else r1, A.ncols if c1 is None else c1
        n = max(self.r1 - r0, self.c1 - c0)
        self.half = 1 << max(0, (n - 1).bit_length() - 1) if n > 1 else 1

    def matrix(self) -> Matrix:
        return sub_matrix(self.A, self.r0, self.r1, self.c0, self.c1)

    def _part(self, south: bool, east: bool) -> Quadrants:
        rm, cm = min(self.r0 + self.half, self.r1), min(self.c0 + self.half, self.c1)
        return Quadrants(self.A, rm if south else self.r0, self.r1 if south else rm, cm if east else self.c0, self.c1 if east else cm)

    def north_west(self) -> Quadrants:
        return self._part(False, False)

    def north_east(self) -> Quadrants:
        return self._part(False, True)

    def south_west(self) -> Quadrants:
        return self._part(True, False)

    def south_east(self) -> Quadrants:
        return self._part(True, True)

    def empty(self) -> bool:
        return self.r0 >= self.r1 or self.c0 >= self.c1

    def is_leaf(self, most: int = 64) -> bool:
        return max(self.r1 - self.r0, self.c1 - self.c0) <= most

    def for_each(self, f: Callable[[Quadrants], None], leaf: Callable[[Quadrants], bool] | None = None) -> None:
        """f on every leaf that has an entry's place."""
        if self.empty():
            return
        if (leaf or Quadrants.is_leaf)(self):
            f(self)
            return
        for q in (self.north_west(), self.north_east(), self.south_west(), self.south_east()):
            q.for_each(f, leaf)


def multi_vector(vectors: Sequence[Vector]) -> MultiVector:
    """Vectors of one size side by side."""
    if len({v.size for v in vectors}) != 1:
        raise IncompatibleSize("vectors of different sizes")
    parts = [v.df.select(F.lit(k).cast("long").alias("j"), "i", "v") for k, v in enumerate(vectors)]
    return MultiVector(reduce(DataFrame.unionByName, parts), vectors[0].size, len(vectors), vectors[0].kind)
