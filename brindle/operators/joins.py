"""Operators that are joins: products, sums, element-wise combinations, permutations and insertion.

A product joins on the inner index and sums by the outer ones; Spark combines partial sums before the second shuffle. A vector
operand is broadcast only if its size, which metadata bounds, is small; otherwise both sides are shuffled on the inner index.
A row or column that holds a large part of all entries is split by `salt`: the heavy side is dealt over salts, the other repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.core import Matrix, MultiVector, Vector
from brindle.errors import IncompatibleShape, IncompatibleSize, IndexOutOfRange
from brindle.functions import scalar as S
from brindle.functions.scalar import Field
from brindle.operators import components, strips
from brindle.operators.views import conj, index_map, scale, trans
from brindle.plans.lineage import BROADCAST_ROWS, DENSE, broadcast_if_small, must_fit, numbered, rows_at_most

#: Entries that an outer or Kronecker product of two operands may have, unless told otherwise.
OUTER = 10_000_000_000


def _fits(a: int, b: int) -> None:
    if a != b:
        raise IncompatibleSize(f"inner sizes {a} and {b}")


def _kind(x, y) -> tuple:
    """Both operands in one kind."""
    if x.kind == y.kind:
        return x, y, x.kind
    up = lambda z: z if z.kind == "complex" else z.with_df(z.df.withColumn("v", S.as_complex(F.col("v"))), kind="complex")
    return up(x), up(y), "complex"


def _inner(a: DataFrame, a_key: str, b: DataFrame, b_key: str, salt: int) -> DataFrame:
    """a and b (columns prefixed) joined on a key; with salt > 1 the entries of one key on a's side are dealt over that many tasks."""
    if salt <= 1:
        return a.join(b, F.col(a_key) == F.col(b_key))
    a = a.withColumn("_s", F.pmod(F.xxhash64(*[c for c in a.columns if not c.endswith("v")]), F.lit(salt)).cast("int"))
    b = b.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    return a.join(b, (F.col(a_key) == F.col(b_key)) & (F.col("_s") == F.col("_t")))


def _named(df: DataFrame, p: str) -> DataFrame:
    return df.select(*[F.col(c).alias(p + c) for c in df.columns])


#: Products of a user's own, tried before the built-in ones: (applies, product), the last registered first.
KERNELS: list[tuple[Callable, Callable]] = []


def register_kernel(applies: Callable, product: Callable) -> None:
    """From now on matmul(A, B) is product(A, B) wherever applies(A, B) holds."""
    KERNELS.insert(0, (applies, product))


def single_rows(A: Matrix) -> bool:
    """Whether no row of A has two entries: a row of a product is then one row of the other operand, times a number."""
    return not A.df.groupBy("i").count().filter("count > 1").limit(1).count()


def _spread(A: Matrix, B: Matrix, f: Field) -> DataFrame:
    """A * B where A has single rows: pairs are entries already, so nothing is summed or shuffled but the operands.

    B is cut into bundles of entries of one row, and the rows of A are dealt over all tasks; a bundle meets each of its rows.
    """
    b = B.df.groupBy(F.col("i").alias("b_i"), F.pmod(F.xxhash64("j"), F.lit(64)).alias("_s")).agg(F.collect_list(F.struct("j", "v")).alias("b"))
    a = _named(A.df, "a_").repartition(4 * A.spark.sparkContext.defaultParallelism)
    pairs = a.join(F.broadcast(b), F.col("a_j") == F.col("b_i")).select("a_i", "a_v", F.explode("b").alias("b"))
    return pairs.select(F.col("a_i").alias("i"), F.col("b.j").alias("j"), f.mul(F.col("a_v"), F.col("b.v")).alias("v"))


def matmul(A, B, salt: int = 1, single: bool = False):
    """Product of matrix and matrix, matrix and column vector, row vector and matrix, or two vectors (a number or a matrix). single: the rows of A have one entry at most."""
    for applies, product in KERNELS:
        if applies(A, B):
            return product(A, B)
    if isinstance(A, MultiVector):
        A = A.matrix()
    if isinstance(B, MultiVector):
        B = B.matrix()
    A, B, kind = _kind(A, B)
    f = Field(kind)
    if isinstance(A, Matrix) and isinstance(B, Matrix):
        _fits(A.ncols, B.nrows)
        if single and rows_at_most(B.df, BROADCAST_ROWS):
            return Matrix(_spread(A, B, f), A.nrows, B.ncols, kind)
        pairs = _inner(_named(A.df, "a_"), "a_j", _named(B.df, "b_"), "b_i", salt)
        out = pairs.groupBy(F.col("a_i").alias("i"), F.col("b_j").alias("j")).agg(f.sum(f.mul(F.col("a_v"), F.col("b_v"))).alias("v"))
        setattr(out, strips.FACTORS, (A, B))
        return Matrix(out, A.nrows, B.ncols, kind)
    if isinstance(A, Matrix) and isinstance(B, Vector):
        if B.row:
            raise IncompatibleShape("matrix times row vector")
        _fits(A.ncols, B.size)
        pairs = _inner(_named(A.df, "a_"), "a_j", broadcast_if_small(_named(B.df, "b_"), B.size), "b_i", salt)
        return Vector(pairs.groupBy(F.col("a_i").alias("i")).agg(f.sum(f.mul(F.col("a_v"), F.col("b_v"))).alias("v")), A.nrows, False, kind)
    if isinstance(A, Vector) and isinstance(B, Matrix):
        if not A.row:
            raise IncompatibleShape("column vector times matrix")
        _fits(A.size, B.nrows)
        pairs = _inner(_named(B.df, "b_"), "b_i", broadcast_if_small(_named(A.df, "a_"), A.size), "a_i", salt)
        return Vector(pairs.groupBy(F.col("b_j").alias("i")).agg(f.sum(f.mul(F.col("a_v"), F.col("b_v"))).alias("v")), B.ncols, True, kind)
    if A.row and not B.row:
        from brindle.operators.aggregates import dot_real

        return dot_real(trans(A), B)
    if not A.row and B.row:
        return outer(A, B)
    raise IncompatibleShape("two vectors of one orientation; use ele_prod or dot")


def spmm(A: Matrix, B: Matrix, salt: int = 1, single: bool = False) -> Matrix:
    return matmul(A, B, salt, single)


def spmv(A: Matrix, x: Vector, salt: int = 1) -> Vector:
    return matmul(A, x, salt)


def mult(A, B, add=None):
    """A*B, or A*B + add."""
    product = matmul(A, B)
    return product if add is None else add_(product, add)


def mult_add(A, B, C):
    """C + A*B. Where C is a product too, both are summed where their pairs are made, see strips."""
    factors = getattr(C.df, strips.FACTORS, None)
    if factors and isinstance(A, Matrix) and isinstance(B, Matrix) and not any(applies(A, B) for applies, _ in KERNELS):
        _fits(A.ncols, B.nrows)
        C.same_shape(Matrix(C.df, A.nrows, B.ncols))
        grams = all(getattr(left.df, strips.MIRROR, left).df is right.df for left, right in ((A, B), factors))
        if grams and (blocks := components.gram([B, factors[1]], DENSE)) is not None:
            return blocks
    if factors and isinstance(A, Matrix) and isinstance(B, Matrix) and not any(applies(A, B) for applies, _ in KERNELS) and strips.fits(A, B, *factors):
        return strips.products([(A, [B]), (factors[0], [factors[1]])])
    return add_(C, matmul(A, B))


def matrix_power(A: Matrix, n: int) -> Matrix:
    """A to the n: few products in one pass over ranges of rows, see strips, more by repeated squaring; n = 0 is the identity."""
    from brindle.functions.integer import power
    from brindle.plans.lineage import cut
    from brindle.sources.constructors import identity

    A.square()
    if 2 <= n <= 8 and not any(applies(A, A) for applies, _ in KERNELS) and strips.fits(A):
        return strips.products([(A, [A] * (n - 1))])
    return power(A, n, lambda a, b: matmul(a, b).with_df(cut(matmul(a, b).df)), identity(A.spark, A.nrows))


def _keys(x) -> list[str]:
    return ["i"] if isinstance(x, Vector) else ["i", "j"]


def _same(x, y) -> None:
    x.same_size(y) if isinstance(x, Vector) else x.same_shape(y)


def add_(x, y):
    """x + y: a union summed by position, one shuffle, absent entries as zero."""
    _same(x, y)
    x, y, kind = _kind(x, y)
    f = Field(kind)
    return x.with_df(x.df.unionByName(y.df).groupBy(*_keys(x)).agg(f.sum(F.col("v")).alias("v")), kind=kind)


def sub(x, y):
    _same(x, y)
    return add_(x, scale(-1.0, y))


def axpy(alpha: float, x, y):
    """alpha * x + y."""
    return add_(scale(alpha, x), y)


def ele_prod(x, y):
    """Element-wise product: entries that both have; products that are zero are not stored."""
    _same(x, y)
    x, y, kind = _kind(x, y)
    f = Field(kind)
    both = x.df.select(*_keys(x), F.col("v").alias("a")).join(y.df.select(*_keys(x), F.col("v").alias("b")), _keys(x))
    out = both.select(*_keys(x), f.mul(F.col("a"), F.col("b")).alias("v"))
    return x.with_df(out.filter(f.nonzero(F.col("v"))), kind=kind)


def ele_quot(x, y):
    """Element-wise quotient x / y over entries of x; where y has none the divisor is zero."""
    _same(x, y)
    both = x.df.select(*_keys(x), F.col("v").alias("a")).join(y.df.select(*_keys(x), F.col("v").alias("b")), _keys(x), "left")
    return x.with_df(both.select(*_keys(x), S.divide(F.col("a"), F.coalesce("b", F.lit(0.0))).alias("v")))


def combine(x, y, f: Callable[[Column, Column], Column]):
    """v = f(x, y) wherever either has an entry, absent ones as zero."""
    _same(x, y)
    zero = F.lit(0.0)
    both = x.df.select(*_keys(x), F.col("v").alias("a")).join(y.df.select(*_keys(x), F.col("v").alias("b")), _keys(x), "full")
    return x.with_df(both.select(*_keys(x), f(F.coalesce("a", zero), F.coalesce("b", zero)).alias("v")))


def assign(x, y, mode: str = "store"):
    """Compound assignment: store (=), plus, minus, times, divide."""
    return {
        "store": lambda: y, "plus": lambda: add_(x, y), "minus": lambda: sub(x, y), "times": lambda: ele_prod(x, y), "divide": lambda: ele_quot(x, y),
    }[mode]()


def outer(x: Vector, y: Vector, most: int = OUTER) -> Matrix:
    """x * yᵀ. Its result is all pairs, so the product of the sizes is checked first; the smaller operand is sent to the other."""
    must_fit(x.size * y.size, most, "the outer product")
    x, y, kind = _kind(x, y)
    a, b = _named(x.df, "a_"), _named(y.df, "b_")
    pairs = a.join(broadcast_if_small(b, y.size)) if y.size <= x.size else b.join(broadcast_if_small(a, x.size))
    return Matrix(pairs.select(F.col("a_i").alias("i"), F.col("b_i").alias("j"), Field(kind).mul(F.col("a_v"), F.col("b_v")).alias("v")), x.size, y.size, kind)


def kron(A: Matrix, B: Matrix, most: int = OUTER) -> Matrix:
    """Kronecker product: all pairs of entries, each at a place of its own. What is checked is the number of entries, counted; the operand of fewer is sent to the other."""
    A, B, kind = _kind(A, B)
    m, n = A.df.count(), B.df.count()
    must_fit(m * n, most, "the Kronecker product")
    a, b = _named(A.df, "a_"), _named(B.df, "b_")
    pairs = a.join(broadcast_if_small(b, n)) if n <= m else b.join(broadcast_if_small(a, m))
    at = lambda k, n: (F.col(f"a_{k}") * n + F.col(f"b_{k}")).alias(k)
    return Matrix(pairs.select(at("i", B.nrows), at("j", B.ncols), Field(kind).mul(F.col("a_v"), F.col("b_v")).alias("v")), A.nrows * B.nrows, A.ncols * B.ncols, kind)


def rank_one_update(A: Matrix, x: Vector, y: Vector) -> Matrix:
    """A + x * yᴴ."""
    return add_(A, outer(x, conj(y)))


def rank_two_update(A: Matrix, x: Vector, y: Vector) -> Matrix:
    """A + x * yᴴ + y * xᴴ."""
    return add_(rank_one_update(A, x, y), outer(y, conj(x)))


#: The lines (a, b, c) with e_a x e_b = e_c, in three and in seven dimensions.
CROSS_LINES = {3: ((0, 1, 2),), 7: ((0, 1, 3), (1, 2, 4), (2, 3, 5), (3, 4, 6), (4, 5, 0), (5, 6, 1), (6, 0, 2))}


def cross(x: Vector, y: Vector) -> Vector:
    """The cross product in three or seven dimensions."""
    x.same_size(y)
    if x.size not in CROSS_LINES:
        raise IncompatibleSize(f"no cross product in {x.size} dimensions")
    table = []
    for line in CROSS_LINES[x.size]:
        for k in range(3):
            a, b, c = line[k], line[(k + 1) % 3], line[(k + 2) % 3]
            table += [(a, b, c, 1.0), (b, a, c, -1.0)]
    t = F.broadcast(x.df.sparkSession.createDataFrame(table, "p long, q long, r long, s double"))
    pairs = x.df.select(F.col("i").alias("p"), F.col("v").alias("a")).join(t, "p").join(y.df.select(F.col("i").alias("q"), F.col("v").alias("b")), "q")
    return x.with_df(pairs.groupBy(F.col("r").alias("i")).agg(F.sum(F.col("s") * F.col("a") * F.col("b")).alias("v")))


# --- permutations ---------------------------------------------------------------------------------------------------


def _permutation(p: Sequence[int]) -> None:
    if sorted(p) != list(range(len(p))):
        raise IndexOutOfRange("not a permutation")


def reorder(spark, indices: Sequence[int], ncols: int) -> Matrix:
    """The matrix that takes row indices[k] to row k; repeats allowed."""
    return Matrix(index_map(spark, indices).select(F.col("pos").alias("i"), F.col("src").alias("j"), F.lit(1.0).alias("v")), len(indices), ncols)


def permutation(spark, p: Sequence[int]) -> Matrix:
    """(P x)[k] = x[p[k]]: a gather."""
    _permutation(p)
    return reorder(spark, p, len(p))


def reorder_rows(indices: Sequence[int], A: Matrix) -> Matrix:
    """Rows of A by an index list."""
    if any(not 0 <= k < A.nrows for k in indices):
        raise IndexOutOfRange(str(indices))
    m = broadcast_if_small(index_map(A.spark, indices), len(indices))
    return A.with_df(A.df.join(m, F.col("i") == F.col("src")).select(F.col("pos").alias("i"), "j", "v"), nrows=len(indices))


def gather(p: Sequence[int], x: Vector) -> Vector:
    """result[k] = x[p[k]]."""
    _fits(len(p), x.size)
    m = broadcast_if_small(index_map(x.df.sparkSession, p), len(p))
    return x.with_df(x.df.join(m, F.col("i") == F.col("src")).select(F.col("pos").alias("i"), "v"))


def scatter(p: Sequence[int], x: Vector) -> Vector:
    """result[p[k]] = x[k]."""
    _permutation(p)
    _fits(len(p), x.size)
    m = broadcast_if_small(index_map(x.df.sparkSession, p), len(p))
    return x.with_df(x.df.join(m, F.col("i") == F.col("pos")).select(F.col("src").alias("i"), "v"))


permute, reverse_permute = scatter, gather


def swap_row(A: Matrix, r: int, s: int) -> Matrix:
    A.check(r, 0)
    A.check(s, 0)
    return A.with_df(A.df.withColumn("i", F.when(F.col("i") == r, F.lit(s).cast("long")).when(F.col("i") == s, F.lit(r).cast("long")).otherwise(F.col("i"))))


# --- insertion ------------------------------------------------------------------------------------------------------

#: Updaters: how values that meet at one place combine. `store` takes the last by sequence number.
UPDATERS: dict[str, Callable[[], Column]] = {
    "plus": lambda: F.sum("v"), "times": lambda: F.product("v"), "min": lambda: F.min("v"), "max": lambda: F.max("v"), "store": lambda: F.max_by("v", "seq"),
}


def insert(A: Matrix, entries: DataFrame, updater: str | Callable[[], Column], shift: tuple[int, int] = (0, 0), row_map: DataFrame | None = None, col_map: DataFrame | None = None) -> Matrix:
    """Entries (i, j, v[, seq]) merged into A. The updater has no default.

    `minus` subtracts; a new place starts at -v. `store` needs the column seq, whose largest wins; old entries come first.
    shift moves places; row_map and col_map (src, pos) rename them.
    """
    new = entries
    if updater == "store" and "seq" not in new.columns:
        raise IncompatibleShape("the updater store needs a column seq that orders the entries")
    if row_map is not None:
        new = new.join(row_map.select(F.col("src").alias("i"), F.col("pos").alias("_p")), "i").withColumn("i", F.col("_p")).drop("_p")
    if col_map is not None:
        new = new.join(col_map.select(F.col("src").alias("j"), F.col("pos").alias("_p")), "j").withColumn("j", F.col("_p")).drop("_p")
    seq = F.col("seq").cast("long") if "seq" in new.columns else F.lit(0).cast("long")
    new = new.select((F.col("i") + shift[0]).cast("long").alias("i"), (F.col("j") + shift[1]).cast("long").alias("j"), "v", seq.alias("seq"))
    if updater == "minus":
        new, updater = new.withColumn("v", Field(A.kind).neg(F.col("v"))), "plus"
    old = A.df.select("i", "j", "v", F.lit(-(1 << 62)).cast("long").alias("seq"))
    if updater == "plus" and A.kind == "complex":
        how = Field("complex").sum(F.col("v"))
    else:
        how = UPDATERS[updater]() if isinstance(updater, str) else updater()
    return A.with_df(old.unionByName(new).groupBy("i", "j").agg(how.alias("v")))


def insert_block(A: Matrix, block: Sequence[Sequence[float]], rows: Sequence[int], cols: Sequence[int], updater: str = "plus") -> Matrix:
    """A small dense matrix at the given rows and columns."""
    cells = [(int(r), int(c), float(block[a][b]), a * len(cols) + b) for a, r in enumerate(rows) for b, c in enumerate(cols)]
    return insert(A, A.spark.createDataFrame(cells, "i long, j long, v double, seq long"), updater)


def insert_matrix(A: Matrix, r: int, c: int, M: Matrix, updater: str = "store") -> Matrix:
    """M with its corner at (r, c)."""
    return insert(A, M.df.withColumn("seq", F.lit(0)), updater, (r, c))  # one entry for each place


def restrict(x: Vector, tags: DataFrame) -> tuple[Vector, DataFrame]:
    """Entries at tagged positions (i, tag), renumbered without gaps; also the map (src, pos). No task numbers all rows, see numbered()."""
    m = numbered(tags.filter("tag").select(F.col("i").alias("src")), F.col("src"), name="pos")
    n = m.count()
    return x.with_df(x.df.join(m, F.col("i") == F.col("src")).select(F.col("pos").alias("i"), "v"), size=n), m


def prolongate(x: Vector, m: DataFrame, size: int) -> Vector:
    """The way back of restrict()."""
    return x.with_df(x.df.join(m, F.col("i") == F.col("pos")).select(F.col("src").alias("i"), "v"), size=size)
