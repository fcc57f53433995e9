"""Factorisations, triangular solves and eigenvalues.

Tall matrices are reduced where they lie: every task factors its rows and only small triangles meet. Triangular systems of
any size are solved level by level, one join for each level of the dependency graph. Kernels on whole matrices gather at most
DENSE rows (checked first) and run in NumPy on the driver; larger systems have the iterative solvers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.core import Matrix, MultiVector, Vector
from brindle.errors import MatrixSingular, MatrixTooSmall, MissingDiagonal
from brindle.operators import components, panels
from brindle.plans.lineage import DENSE, cut, must_fit
from brindle.sources.constructors import from_numpy, triplets

EPS = 1e-14


def _columns(df: DataFrame, *names: str) -> list[np.ndarray]:
    """Places and values as arrays. Rows come as columns: a row takes 24 bytes of the driver, not some hundred."""
    t = df.select(*names).toArrow()
    return [t.column(c).to_numpy().astype(float if c == "v" else np.int64) for c in names]


def gathered(A: Matrix) -> np.ndarray:
    """The whole matrix as an array; at most DENSE rows and columns."""
    must_fit(max(A.nrows, A.ncols), DENSE, "a matrix gathered whole")
    i, j, v = _columns(A.df, "i", "j", "v")
    out = np.zeros((A.nrows, A.ncols))
    out[i, j] = v
    return out


def gathered_vector(x: Vector) -> np.ndarray:
    must_fit(x.size, DENSE * DENSE, "a vector gathered whole")
    i, v = _columns(x.df, "i", "v")
    out = np.zeros(x.size)
    out[i] = v
    return out


# --- triangular systems ---------------------------------------------------------------------------------------------


def triangular_solve(A: Matrix, b: Vector, lower: bool = True, diagonal: str = "regular", most_levels: int = 200) -> Vector:
    """x with T x = b, T the lower or upper triangle of A (the other is not looked at).

    diagonal: regular; unit (taken as 1, stored or not); inverse (stored entries are reciprocals). Row k can be solved once all
    rows that it needs are: a level. Each level is one join of the newly solved entries; systems of more levels than
    `most_levels` are gathered if they are small enough.
    """
    n = A.square()
    strict = A.df.filter("j < i" if lower else "j > i")
    diag = A.df.filter("i = j").select("i", F.col("v").alias("d"))
    if diagonal == "unit":
        diag = A.spark.range(n).select(F.col("id").alias("i"), F.lit(1.0).alias("d"))
    else:
        stored = diag.count()
        if stored < n:
            raise MissingDiagonal(f"{n - stored} diagonal entries are not stored")
        if diagonal == "regular" and diag.filter("d = 0").limit(1).count():
            raise MatrixSingular("a zero on the diagonal")
    if n <= DENSE:
        t = gathered(A)
        t = np.tril(t) if lower else np.triu(t)
        if diagonal != "regular":
            np.fill_diagonal(t, 1.0 if diagonal == "unit" else 1 / np.diag(t))
        return from_numpy(A.spark, substitute(t, gathered_vector(b), lower), zeros=True)
    if diagonal == "regular" and (C := _blocks(A)):
        return from_numpy(A.spark, C.solved(lambda t, y: panels.triangle(t, y, lower), gathered_vector(b)), zeros=True)
    if diagonal == "regular" and n * panels.SIDE <= DENSE * DENSE:  # a panel of the size that is gathered elsewhere
        return from_numpy(A.spark, panels.triangular_solved(panels.Panels.of(A, panels.SIDE), gathered_vector(b), lower), zeros=True)
    factor = F.col("d") if diagonal == "inverse" else 1 / F.col("d")
    return _by_levels(strict, diag.select("i", factor.alias("f")), b, n, most_levels)


def _by_levels(strict: DataFrame, inverse: DataFrame, b: Vector, n: int, most_levels: int) -> Vector:
    """state: (i, rest, open, f): what is left of b, how many unknowns it waits for, the factor."""
    waits = strict.groupBy("i").agg(F.count("*").alias("open"))
    rest = inverse.join(b.df.select("i", F.col("v").alias("rest")), "i", "left").join(waits, "i", "left")
    state = cut(rest.select("i", F.coalesce("rest", F.lit(0.0)).alias("rest"), F.coalesce("open", F.lit(0)).cast("long").alias("open"), "f"))
    done: DataFrame | None = None
    for _ in range(most_levels):
        ready = cut(state.filter("open = 0").select("i", (F.col("rest") * F.col("f")).alias("v")))
        if not ready.limit(1).count():
            return Vector(done, n)
        done = ready if done is None else done.union(ready)
        sent = strict.join(ready.select(F.col("i").alias("j"), F.col("v").alias("x")), "j")
        sent = sent.groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("s"), F.count("*").alias("k"))
        left = state.filter("open > 0").join(sent, "i", "left")
        state = cut(left.select("i", (F.col("rest") - F.coalesce("s", F.lit(0.0))).alias("rest"), (F.col("open") - F.coalesce("k", F.lit(0))).alias("open"), "f"))
    if not state.limit(1).count():
        return Vector(done, n)
    raise MatrixTooSmall(f"more than {most_levels} levels: use an iterative solver")


def lower_solve(A: Matrix, b: Vector, diagonal: str = "regular") -> Vector:
    return triangular_solve(A, b, True, diagonal)


def upper_solve(A: Matrix, b: Vector, diagonal: str = "regular") -> Vector:
    return triangular_solve(A, b, False, diagonal)


def substitute(t: np.ndarray, b: np.ndarray, lower: bool) -> np.ndarray:
    """Forward or back substitution, column by column, for one right side or several side by side."""
    x, n = b.astype(float).copy(), len(b)
    for k in range(n) if lower else reversed(range(n)):
        x[k] = x[k] / t[k, k]
        rest = slice(k + 1, n) if lower else slice(0, k)
        x[rest] -= np.multiply.outer(t[rest, k], x[k])
    return x


# --- LU -------------------------------------------------------------------------------------------------------------


def lu_kernel(a: np.ndarray, pivot: bool, eps: float = EPS) -> tuple[np.ndarray, np.ndarray]:
    """L and U in one array, and the gather vector p with (P a)[k] = a[p[k]]."""
    a, n = a.astype(float).copy(), len(a)
    p = np.arange(n)
    for k in range(n):
        if pivot:
            r = k + int(np.argmax(np.abs(a[k:, k])))
            a[[k, r]], p[[k, r]] = a[[r, k]], p[[r, k]]
        if abs(a[k, k]) <= eps:
            raise MatrixSingular(f"pivot {k} is {a[k, k]:g}")
        a[k + 1 :, k] /= a[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k, k + 1 :])
    return a, p


def lu_substitute(f: np.ndarray, p: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x with A x = b, for one right side or several side by side."""
    return panels.triangle(f, panels.triangle(f, b[p], True, True), False)


def lu_adjoint_substitute(f: np.ndarray, p: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x with Aᵀ x = b."""
    x = np.empty_like(b)
    x[p] = panels.triangle((np.tril(f, -1) + np.eye(len(f))).T, panels.triangle(f.T, b, True), False)
    return x


def lu(A: Matrix, pivot: bool = True, eps: float = EPS) -> tuple[Matrix, list[int]]:
    """The packed factors and the row order."""
    A.square()
    f, p = lu_kernel(gathered(A), pivot, eps)
    return from_numpy(A.spark, f), p.tolist()


def lu_f(A: Matrix) -> Matrix:
    return lu(A, False)[0]


def lu_apply(LU: Matrix, p: list[int], b: Vector) -> Vector:
    """x with A x = b from factors of A."""
    f, y = gathered(LU), gathered_vector(b)[p]
    unit = np.tril(f, -1) + np.eye(len(f))
    return from_numpy(LU.spark, substitute(np.triu(f), substitute(unit, y, True), False), zeros=True)


lu_solve_apply = lu_apply


def _large(A: Matrix) -> bool:
    """Whether A is factored by components or panels, since it may not be gathered."""
    return A.square() > DENSE


def _blocks(A: Matrix) -> components.Blocks | None:
    """The components of a large matrix, if each may be held whole; else panels are to be used."""
    return components.Blocks.of(A, DENSE)


def _lu_solved(A: Matrix, b: Vector, pivot: bool, eps: float) -> Vector:
    if _large(A):
        if C := _blocks(A):
            return from_numpy(A.spark, C.solved(lambda a, y: lu_substitute(*lu_kernel(a, pivot, eps), y), gathered_vector(b)), zeros=True)
        P = panels.Panels.of(A, panels.SIDE)
        return from_numpy(A.spark, panels.lu_solved(P, panels.lu(P, pivot, eps), gathered_vector(b)), zeros=True)
    f, p = lu_kernel(gathered(A), pivot, eps)
    unit = np.tril(f, -1) + np.eye(len(f))
    return from_numpy(A.spark, substitute(np.triu(f), substitute(unit, gathered_vector(b)[p], True), False), zeros=True)


def lu_solve(A: Matrix, b: Vector, eps: float = EPS) -> Vector:
    return _lu_solved(A, b, True, eps)


def lu_solve_straight(A: Matrix, b: Vector, eps: float = EPS) -> Vector:
    """Without pivots."""
    return _lu_solved(A, b, False, eps)


def lu_adjoint_apply(LU: Matrix, p: list[int], b: Vector) -> Vector:
    """x with Aᵀ x = b from factors of A."""
    f, y = gathered(LU), gathered_vector(b)
    unit = np.tril(f, -1) + np.eye(len(f))
    z = substitute(unit.T, substitute(np.triu(f).T, y, True), False)
    x = np.empty_like(z)
    x[p] = z
    return from_numpy(LU.spark, x, zeros=True)


def lu_adjoint_solve(A: Matrix, b: Vector) -> Vector:
    if _large(A):
        if C := _blocks(A):
            return from_numpy(A.spark, C.solved(lambda a, y: lu_adjoint_substitute(*lu_kernel(a, True), y), gathered_vector(b)), zeros=True)
        P = panels.Panels.of(A, panels.SIDE)
        return from_numpy(A.spark, panels.lu_adjoint_solved(P, panels.lu(P, True, EPS), gathered_vector(b)), zeros=True)
    return lu_adjoint_apply(*lu(A), b)


class LuSolver:
    """Factors once, solves many times."""

    def __init__(self, A: Matrix):
        self.factors = lu(A)

    def solve(self, b: Vector) -> Vector:
        return lu_apply(*self.factors, b)

    def adjoint_solve(self, b: Vector) -> Vector:
        return lu_adjoint_apply(*self.factors, b)


def solve(A, b: Vector) -> Vector:
    """A direct solve where the matrix may be gathered, else stabilised bi-conjugate gradients to a small residual. A may be a space, which iterates."""
    if isinstance(A, Matrix) and A.nrows <= DENSE:
        return lu_solve(A, b)
    from brindle.plans.krylov import IterationControl, bicgstab

    return bicgstab(A, b, control=IterationControl(1000, 1e-12))[0]


direct_solve = solve


def determinant(A: Matrix) -> float:
    try:
        f, p = lu_kernel(gathered(A), True)
    except MatrixSingular:
        return 0.0
    sign, seen = 1.0, set()
    for k in range(len(p)):  # the sign of a permutation, cycle by cycle
        length = 0
        while k not in seen:
            seen.add(k)
            k, length = int(p[k]), length + 1
        sign *= -1.0 if length and length % 2 == 0 else 1.0
    return sign * float(np.prod(np.diag(f)))


def inv(A: Matrix) -> Matrix:
    if _large(A):
        if C := _blocks(A):
            return C.factored(lambda a: (lu_substitute(*lu_kernel(a, True), np.eye(len(a))),), "x")[0].matrix()
        P = panels.Panels.of(A, panels.SIDE)
        return panels.inverse(P, "all", panels.lu(P, True, EPS)).matrix("x")
    f, p = lu_kernel(gathered(A), True)
    unit, u = np.tril(f, -1) + np.eye(len(f)), np.triu(f)
    return from_numpy(A.spark, substitute(u, substitute(unit, np.eye(len(f))[p], True), False))


def inv_upper(A: Matrix) -> Matrix:
    if _large(A):
        if A.df.filter("i = j AND v <> 0").count() < A.nrows:
            raise MatrixSingular("a zero on the diagonal")
        if C := _blocks(A):
            return C.factored(lambda a: (panels.triangle(a, np.eye(len(a)), False),), "x")[0].matrix()
        return panels.inverse(panels.Panels.of(A, panels.SIDE), "upper").matrix("x")
    u = np.triu(gathered(A))
    if (np.diag(u) == 0).any():
        raise MatrixSingular("a zero on the diagonal")
    return from_numpy(A.spark, substitute(u, np.eye(len(u)), False))


def inv_lower(A: Matrix) -> Matrix:
    if _large(A):
        if A.df.filter("i = j AND v <> 0").count() < A.nrows:
            raise MatrixSingular("a zero on the diagonal")
        if C := _blocks(A):
            return C.factored(lambda a: (panels.triangle(a, np.eye(len(a)), True),), "x")[0].matrix()
        return panels.inverse(panels.Panels.of(A, panels.SIDE), "lower").matrix("x")
    t = np.tril(gathered(A))
    if (np.diag(t) == 0).any():
        raise MatrixSingular("a zero on the diagonal")
    return from_numpy(A.spark, substitute(t, np.eye(len(t)), True))


def _lower_factor(d: np.ndarray) -> np.ndarray:
    """Only the lower triangle is looked at."""
    try:
        return np.linalg.cholesky(d)
    except np.linalg.LinAlgError as e:
        raise MatrixSingular("not positive definite") from e


def cholesky(A: Matrix, side: int = 64, kernel: Callable[[np.ndarray], np.ndarray] | None = None) -> Matrix:
    """The lower factor, by blocks; `kernel` factors a diagonal block of a matrix that is gathered."""
    if kernel is None and _large(A):
        if C := _blocks(A):
            return C.factored(lambda a: (_lower_factor(a),), "l")[0].matrix()
        return panels.cholesky(panels.Panels.of(A, panels.SIDE)).matrix("l")
    a = np.tril(gathered(A))
    a = a + np.tril(a, -1).T
    n = A.square()

    kernel = kernel or _lower_factor
    for k in range(0, n, side):
        e = min(k + side, n)
        a[k:e, k:e] = np.tril(kernel(a[k:e, k:e]))
        if e < n:
            a[e:, k:e] = np.linalg.solve(a[k:e, k:e], a[e:, k:e].T).T
            a[e:, e:] -= a[e:, k:e] @ a[e:, k:e].T
    return from_numpy(A.spark, np.tril(a))


# --- orthogonal factorisations --------------------------------------------------------------------------------------


def householder(y: np.ndarray) -> tuple[np.ndarray, float]:
    """v with v[0] = 1 and b so that (I - b v vᵀ) y is a multiple of e_0."""
    y = np.asarray(y, float)
    rest = float(y[1:] @ y[1:])
    v = np.concatenate([[1.0], y[1:]])
    if rest == 0:
        return v, 0.0
    norm = np.sqrt(y[0] ** 2 + rest)
    v0 = y[0] - norm if y[0] <= 0 else -rest / (y[0] + norm)
    b = 2 * v0 * v0 / (rest + v0 * v0)
    return np.concatenate([[1.0], y[1:] / v0]), b


def givens(a: float, b: float) -> np.ndarray:
    """The rotation that takes (a, b) to (r, 0)."""
    r = np.hypot(a, b)
    return np.eye(2) if r == 0 else np.array([[a, b], [-b, a]]) / r


def _positive(q: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = np.where(np.diag(r) < 0, -1.0, 1.0)
    return q * s, s[:, None] * r


def qr_kernel(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Q (square) and R by reflections."""
    m, n = a.shape
    r, q = a.astype(float).copy(), np.eye(m)
    for k in range(min(m - 1, n)):
        v, b = householder(r[k:, k])
        r[k:] -= b * np.outer(v, v @ r[k:])
        q[:, k:] -= b * np.outer(q[:, k:] @ v, v)
    return q, np.triu(r)


def qr(A: Matrix) -> tuple[Matrix, Matrix]:
    if A.nrows < A.ncols:
        raise MatrixTooSmall("fewer rows than columns; use lq")
    if A.nrows == A.ncols and _large(A):
        if C := _blocks(A):
            return tuple(x.matrix() for x in C.factored(np.linalg.qr, "q", "r"))  # type: ignore[return-value]
        P = panels.qr(panels.Panels.of(A, panels.SIDE))
        return P.matrix("q"), P.matrix("r")
    q, r = qr_kernel(gathered(A))
    return from_numpy(A.spark, q), from_numpy(A.spark, r)


def lq(A: Matrix) -> tuple[Matrix, Matrix]:
    """L and Q with A = L Q."""
    from brindle.operators.views import trans

    if A.nrows == A.ncols and _large(A):
        q, r = qr(trans(A))
        return trans(r), trans(q)
    q, r = qr_kernel(gathered(A).T)
    return from_numpy(A.spark, r.T), from_numpy(A.spark, q.T)


def qr_givens(A: Matrix) -> tuple[Matrix, Matrix]:
    """By rotations; a matrix that may not be gathered by reflections, as qr()."""
    if A.nrows == A.ncols and _large(A):
        return qr(A)
    r = gathered(A)
    m, n = r.shape
    q = np.eye(m)
    for c in range(n):
        for k in range(m - 1, c, -1):
            if r[k, c] != 0:
                g = givens(r[k - 1, c], r[k, c])
                r[k - 1 : k + 1] = g @ r[k - 1 : k + 1]
                q[:, k - 1 : k + 1] = q[:, k - 1 : k + 1] @ g.T
    return from_numpy(A.spark, q), from_numpy(A.spark, np.triu(r))


def tall_r(rows: DataFrame, array: str, n: int) -> np.ndarray:
    """R (n x n, positive diagonal) of all rows held as arrays: every task keeps one triangle, triangles meet in a tree of fixed width."""

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = np.zeros((0, n))
        for b in batches:
            if len(b):
                r = np.linalg.qr(np.vstack([r, np.stack(b[array].to_numpy()).astype(float)]), mode="r")
        if len(r):
            yield pd.DataFrame({array: list(r)})

    schema = f"{array} array<double>"
    triangles = rows.select(array).mapInPandas(local, schema)
    lanes = triangles.repartition(16).mapInPandas(local, schema)
    last = lanes.collect()  # at most 16 triangles of n rows
    r = np.linalg.qr(np.array([x[array] for x in last], float), mode="r") if last else np.zeros((n, n))
    full = np.zeros((n, n))
    full[: len(r)] = r
    return _positive(np.zeros((n, n)), full)[1]


def tall_q(rows: DataFrame, key: str, array: str, r: np.ndarray) -> DataFrame:
    """(key, q): each row times the inverse of R; no row leaves its task."""
    inverse = np.linalg.inv(r)
    shared = rows.sparkSession.sparkContext.broadcast(inverse)  # n x n

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({key: b[key], "q": list(np.stack(b[array].to_numpy()).astype(float) @ shared.value)})

    return rows.select(key, array).mapInPandas(local, f"{key} {rows.schema[key].dataType.simpleString()}, q array<double>")


def svd(A: Matrix) -> tuple[Matrix, Matrix, Matrix]:
    """S, V, D with A = S V Dᵀ; V diagonal and not negative, in falling order."""
    if A.nrows == A.ncols and _large(A):
        if C := _blocks(A):
            s, values, d = components.svd(C)
            S, D = s.matrix(), d.matrix()
        else:
            s, values, d = panels.svd(panels.Panels.of(A, panels.SIDE))
            S, D = s.matrix("s"), d.matrix("d")
        k = np.arange(A.nrows)
        V = Matrix(triplets(A.spark, k, k, values), A.nrows, A.ncols)
        setattr(V.df, panels.DIAGONAL, values)
        return S, V, D
    u, s, vt = np.linalg.svd(gathered(A))
    v = np.zeros((A.nrows, A.ncols))
    np.fill_diagonal(v, s)
    return tuple(from_numpy(A.spark, x) for x in (u, v, vt.T))  # type: ignore[return-value]


def tall_singular_values(rows: DataFrame, array: str, n: int) -> np.ndarray:
    """Singular values of a matrix of rows held as arrays."""
    return np.linalg.svd(tall_r(rows, array, n), compute_uv=False)


def orth(V: MultiVector, only: int | None = None) -> tuple[MultiVector, np.ndarray]:
    """Orthonormal vectors with the same span, by modified Gram-Schmidt, and the factors (upper triangle).

    only: make just that vector orthonormal to those before it. Each step is one aggregation of dot products and one projection.
    """
    from brindle.operators.joins import add_
    from brindle.operators.views import multi_vector, scale

    vs, t = [V.vector(k) for k in range(V.count)], np.zeros((V.count, V.count))
    for k in range(V.count):
        if only is not None and k != only:
            continue
        for m in range(k):
            both = vs[m].df.select("i", F.col("v").alias("a")).join(vs[k].df.select("i", F.col("v").alias("b")), "i")
            t[m, k] = both.agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0.0
            w = add_(vs[k], scale(-float(t[m, k]), vs[m]))
            vs[k] = w.with_df(cut(w.df))
        t[k, k] = vs[k].df.agg(F.sqrt(F.sum(F.col("v") * F.col("v")))).first()[0] or 0.0
        if t[k, k] == 0:
            raise MatrixSingular(f"vector {k} depends on those before it")
        vs[k] = scale(1 / float(t[k, k]), vs[k])
    return multi_vector(vs), t


# --- eigenvalues ----------------------------------------------------------------------------------------------------


def hessenberg_kernel(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """H and Q with a = Q H Qᵀ."""
    h, n = a.astype(float).copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v, b = householder(h[k + 1 :, k])
        h[k + 1 :] -= b * np.outer(v, v @ h[k + 1 :])
        h[:, k + 1 :] -= b * np.outer(h[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= b * np.outer(q[:, k + 1 :] @ v, v)
        h[k + 2 :, k] = 0
    return h, q


def hessenberg(A: Matrix) -> tuple[Matrix, Matrix]:
    """H and Q with A = Q H Qᵀ."""
    if _large(A):
        if C := _blocks(A):
            return tuple(x.matrix() for x in components.hessenberg(C))  # type: ignore[return-value]
        P = panels.hessenberg(panels.Panels.of(A, panels.SIDE))
        return P.matrix("h"), P.matrix("q")
    h, q = hessenberg_kernel(gathered(A))
    return from_numpy(A.spark, h), from_numpy(A.spark, q)


def eigenvalues(A: Matrix) -> list[complex]:
    """All eigenvalues, by real then imaginary part."""
    A.square()
    return sorted(np.linalg.eigvals(gathered(A)).astype(complex).tolist(), key=lambda z: (round(z.real, 12), z.imag))


def eigenvalues_symmetric(A: Matrix) -> list[float]:
    A.square()
    return np.linalg.eigvalsh(gathered(A)).tolist()


def qr_algorithm(A: Matrix, steps: int) -> list[float]:
    """The diagonal after plain QR steps, largest first; for symmetric matrices it tends to the eigenvalues."""
    a = gathered(A)
    for _ in range(steps):
        q, r = np.linalg.qr(a)
        a = r @ q
    return sorted(np.diag(a).tolist(), reverse=True)


def secular_roots(z: np.ndarray, d: np.ndarray, sigma: float) -> np.ndarray:
    """Roots of 1 + sigma * sum z_k² / (d_k - x), d rising and z not zero: one in each gap, found by bisection to the last digit."""
    z, d = np.asarray(z, float), np.asarray(d, float)
    f = lambda x: 1 + sigma * np.sum(z * z / (d - x))
    reach = abs(sigma) * float(z @ z)
    lo, hi = (d, np.append(d[1:], d[-1] + reach)) if sigma > 0 else (np.append(d[0] - reach, d[:-1]), d)
    roots = []
    for a, b in zip(lo, hi, strict=True):
        a0 = a
        for _ in range(200):
            m = (a + b) / 2
            if m in (a, b):
                break
            if (f(m) < 0) == (sigma > 0):
                a = m
            else:
                b = m
        roots.append(m if a0 != b else a0)
    return np.array(roots)


def cuppen(diag: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of a symmetric tridiagonal matrix, by division at the middle.

    The halves differ from the whole by rho w wᵀ; equal poles and small components are deflated, the rest are secular roots.
    """
    n = len(diag)
    if n == 1:
        return np.array(diag, float), np.ones((1, 1))
    m = n // 2
    rho = float(off[m - 1])
    if rho == 0:
        parts = [cuppen(diag[:m], off[: m - 1]), cuppen(diag[m:], off[m:])]
        lam, q = np.concatenate([p[0] for p in parts]), np.zeros((n, n))
        q[:m, :m], q[m:, m:] = parts[0][1], parts[1][1]
    else:
        a, b = np.array(diag[:m], float), np.array(diag[m:], float)
        a[-1] -= rho
        b[0] -= rho
        (la, qa), (lb, qb) = cuppen(a, off[: m - 1]), cuppen(b, off[m:])
        d, z = np.concatenate([la, lb]), np.concatenate([qa[-1], qb[0]])
        q0 = np.zeros((n, n))
        q0[:m, :m], q0[m:, m:] = qa, qb
        order = np.argsort(d)
        d, z, q0 = d[order], z[order], q0[:, order]
        tol = 1e-14 * max(1.0, np.abs(d).max() + abs(rho))
        for k in range(n - 1):  # rotate equal poles so that one of them has no component
            if d[k + 1] - d[k] <= tol and z[k] != 0:
                r = np.hypot(z[k], z[k + 1])
                c, s = z[k + 1] / r, z[k] / r
                z[k], z[k + 1] = 0.0, r
                q0[:, [k, k + 1]] = np.stack([c * q0[:, k] - s * q0[:, k + 1], s * q0[:, k] + c * q0[:, k + 1]], 1)
        live = np.flatnonzero(np.abs(z) > 1e-14)
        lam, vectors = d.copy(), np.eye(n)
        if len(live):
            roots = secular_roots(z[live], d[live], rho)
            gap = d[live][:, None] - roots[None]
            gap[gap == 0] = tol
            # Weights that make the computed roots exact keep the vectors orthogonal.
            w = np.array([np.sqrt(abs(np.prod(gap[k]) / (rho * np.prod(np.delete(d[live], k) - d[live][k])))) for k in range(len(live))]) * np.sign(z[live])
            v = w[:, None] / gap
            v /= np.linalg.norm(v, axis=0)
            lam[live] = roots
            vectors[np.ix_(live, live)] = v
        q = q0 @ vectors
    order = np.argsort(lam)
    return lam[order], q[:, order]


def power_iteration(A, x: Vector, steps: int = 5, tolerance: float | None = None) -> tuple[Vector, float]:
    """The dominant eigenvector (unit two-norm) and the last norm; stops after `steps`, or once the norm settles. A is a matrix or a space."""
    from brindle.operators.joins import matmul
    from brindle.operators.views import scale

    norm = 0.0
    for _ in range(steps):
        y = x.with_df(cut(matmul(A, x).df) if isinstance(A, Matrix) else A.apply(x.df))
        last, norm = norm, y.df.agg(F.sqrt(F.sum(F.col("v") * F.col("v")))).first()[0] or 0.0
        if norm == 0:
            raise MatrixSingular("the vector fell into the null space")
        x = scale(1 / norm, y)
        if tolerance is not None and abs(norm - last) <= tolerance * norm:
            break
    return x, norm


def folded_spectrum(H: Matrix, x: Vector, shift: float, alpha: float, steps: int) -> Vector:
    """An eigenvector near the shift: x <- x - alpha (H - shift)² x, normalised."""
    from brindle.operators.joins import add_, matmul
    from brindle.operators.views import scale

    shifted = lambda v: add_(matmul(H, v), scale(-shift, v))
    for _ in range(steps):
        y = add_(x, scale(-alpha, shifted(shifted(x))))
        y = y.with_df(cut(y.df))
        norm = y.df.agg(F.sqrt(F.sum(F.col("v") * F.col("v")))).first()[0]
        x = scale(1 / norm, y)
    return x


def page_rank(edges: DataFrame, n: int, damping: float = 0.85, steps: int = 20, spark: SparkSession | None = None) -> Vector:
    """Ranks of nodes 0 .. n-1 from (src, dst): sum 1; nodes without links pass their rank to all."""
    spark = spark or edges.sparkSession
    links = edges.select("src", "dst").distinct()
    links = cut(links.join(links.groupBy("src").agg(F.count("*").alias("k")), "src"))
    sources = links.select("src").distinct()
    ranks = spark.range(n).select(F.col("id").alias("i"), F.lit(1.0 / n).alias("v"))
    for _ in range(steps):
        lost = ranks.join(sources, F.col("i") == F.col("src"), "left_anti").agg(F.coalesce(F.sum("v"), F.lit(0.0))).first()[0]
        sent = links.join(ranks, F.col("src") == F.col("i")).groupBy(F.col("dst").alias("k")).agg(F.sum(F.col("v") / F.col("k")).alias("s"))
        every = spark.range(n).select(F.col("id").alias("i")).join(sent, F.col("i") == F.col("k"), "left")
        ranks = cut(every.select("i", ((1 - damping) / n + damping * (F.coalesce("s", F.lit(0.0)) + lost / n)).alias("v")))
    return Vector(ranks, n)
