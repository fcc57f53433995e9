"""Krylov solvers, written once over a small algebra of vectors.

`SparkSpace` keeps vectors as relations: a product is a join and a sum, a linear combination one union and sum, a dot product
one aggregation; every new vector that a later step needs is written, so plans stay short however many steps there are, and
only numbers reach the driver. `LocalSpace` does the same with arrays, for systems whose matrix and vectors surely fit the
driver. `space_of` chooses by the count of entries, never by trial.

All solvers take A, b, a start x0 (zero by default), a left preconditioner and an IterationControl, and give (x, control).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.core import Matrix, Vector
from brindle.errors import IncompatibleSize, SearchSpaceExhaustion, UnexpectedOrthogonality
from brindle.operators.strips import ORIGIN, Strips
from brindle.plans.lineage import BROADCAST_ROWS, cut, rows_at_most

#: Entries of a matrix that a solver may gather.
LOCAL_ENTRIES = 2_000_000


@dataclass
class IterationControl:
    """Ends when the residual is at most rtol times the first one, or at most atol; after max_steps with code 1.

    every: report each so-many-th step through `report`; 0 is silent.
    """

    max_steps: int = 100
    rtol: float = 1e-8
    atol: float = 0.0
    every: int = 0
    report: Callable[[str], None] = print
    first: float | None = None
    residual: float = float("nan")
    step: int = 0
    code: int = 0
    log: list[tuple[int, float]] = field(default_factory=list)

    def done(self, residual: float) -> bool:
        residual = abs(float(residual))
        if self.first is None:
            self.first = residual
        self.residual = residual
        self.log.append((self.step, residual))
        if self.every and self.step % self.every == 0:
            self.report(f"step {self.step}: residual {residual:.6g}")
        if residual <= self.atol or (self.first != 0 and residual <= self.rtol * self.first):
            return True
        if self.step >= self.max_steps:
            self.code = 1
            return True
        return False

    def advance(self) -> None:
        self.step += 1

    def failed(self, code: int) -> None:
        self.code = code

    def again(self) -> IterationControl:
        """A new control with the same limits."""
        return IterationControl(self.max_steps, self.rtol, self.atol, self.every, self.report)


class LocalSpace:
    """Vectors as arrays, the matrix as three arrays."""

    def __init__(self, A: Matrix):
        pdf = A.df.toPandas()
        self.spark, self.n, self.m = A.spark, A.nrows, A.ncols
        self.i, self.j, self.v = pdf["i"].to_numpy(np.int64), pdf["j"].to_numpy(np.int64), pdf["v"].to_numpy(float)

    def take(self, x: Vector | None):
        out = np.zeros(self.n)
        if x is not None:
            pdf = x.df.toPandas()
            out[pdf["i"].to_numpy(np.int64)] = pdf["v"].to_numpy(float)
        return out

    def give(self, x) -> Vector:
        from brindle.sources.constructors import from_numpy

        return from_numpy(self.spark, x, zeros=True)

    def apply(self, x):
        return np.bincount(self.i, self.v * x[self.j], self.n)

    def apply_t(self, x):
        return np.bincount(self.j, self.v * x[self.i], self.m)

    def lin(self, *terms):
        return sum(float(c) * x for c, x in terms)

    def dot(self, x, y) -> float:
        return float(x @ y)

    def dots(self, x, ys) -> list[float]:
        return [float(x @ y) for y in ys]

    def norm(self, x) -> float:
        return float(np.linalg.norm(x))

    def random(self, k: int):
        return np.random.default_rng(k).random(self.n)

    def split(self):
        """The diagonal, and the product with all off it."""
        d = np.bincount(self.i, np.where(self.i == self.j, self.v, 0.0), self.n)
        return d, lambda x: self.apply(x) - d * x

    def divide(self, x, d):
        return x / d


class SparkSpace:
    """Vectors as relations (i, v)."""

    def __init__(self, A: Matrix):
        self.A, self.spark, self.n = A, A.spark, A.nrows
        self.entries = A.df

    def take(self, x: Vector | None) -> DataFrame:
        if x is None:
            return self.spark.createDataFrame([], "i long, v double")
        return x.df.select("i", "v")

    def give(self, x: DataFrame) -> Vector:
        return Vector(x, self.n)

    def _product(self, x: DataFrame, key: str, out: str) -> DataFrame:
        from brindle.plans.lineage import broadcast_if_small

        right = broadcast_if_small(x.select(F.col("i").alias("_k"), F.col("v").alias("_x")), self.n)
        pairs = self.entries.join(right, F.col(key) == F.col("_k"))
        return cut(pairs.groupBy(F.col(out).alias("i")).agg(F.sum(F.col("v") * F.col("_x")).alias("v")))

    def apply(self, x: DataFrame) -> DataFrame:
        return self._product(x, "j", "i")

    def apply_t(self, x: DataFrame) -> DataFrame:
        return self._product(x, "i", "j")

    def lin(self, *terms) -> DataFrame:
        parts = [x.select("i", (F.col("v") * float(c)).alias("v")) for c, x in terms if c != 0]
        if not parts:
            return self.take(None)
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        return cut(every.groupBy("i").agg(F.sum("v").alias("v")))

    def dot(self, x: DataFrame, y: DataFrame) -> float:
        both = x.select("i", F.col("v").alias("a")).join(y.select("i", F.col("v").alias("b")), "i")
        return both.agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0.0

    def dots(self, x: DataFrame, ys: Sequence[DataFrame]) -> list[float]:
        """x with each of ys, in one job: all vectors stand one under the other and meet by place."""
        if not ys:
            return []
        rows = reduce(DataFrame.union, [y.select("i", "v", F.lit(k).alias("k")) for k, y in enumerate(ys)])
        both = rows.join(x.select("i", F.col("v").alias("x")), "i")
        found = {r["k"]: r["d"] for r in both.groupBy("k").agg(F.sum(F.col("v") * F.col("x")).alias("d")).collect()}
        return [found.get(k) or 0.0 for k in range(len(ys))]

    def norm(self, x: DataFrame) -> float:
        return x.agg(F.sqrt(F.sum(F.col("v") * F.col("v")))).first()[0] or 0.0

    def random(self, k: int) -> DataFrame:
        from brindle.sources.constructors import random

        return random(self.spark, self.n, k).df

    def split(self):
        d = cut(self.entries.filter("i = j").select("i", F.col("v").alias("d")))
        off = SparkSpace(self.A.with_df(self.entries.filter("i <> j")))
        return d, off.apply

    def within(self, side: int) -> DataFrame:
        """Entries inside the diagonal blocks of `side` rows."""
        return self.entries.filter(F.floor(F.col("i") / side) == F.floor(F.col("j") / side))

    def divide(self, x: DataFrame, d: DataFrame) -> DataFrame:
        return cut(x.join(d, "i").select("i", (F.col("v") / F.col("d")).alias("v")))


class GramSpace(SparkSpace):
    """The matrix shift * I + diag(row) C NᵀN C, C = diag(columns), as an operator that is never formed: a product is two products with N.

    NᵀN may have a thousand times the entries of N. Where N is in strips and a vector may be gathered, a product is one pass over them, and what
    is sent is each task's sums by column; else N is best written row by row, so the sums of each task shrink before they are sent.
    `row` is an expression of i, `columns` a relation (i, c); rows without a c have no entries.
    """

    def __init__(self, N: Matrix, shift: float = 0.0, row: Column | None = None, columns: DataFrame | None = None):
        self.A, self.spark, self.n, self.m = N, N.spark, N.ncols, N.nrows
        self.shift, self.row, self.columns = shift, row, columns
        self.strips = getattr(N.df, ORIGIN, None) if N.ncols <= BROADCAST_ROWS else None
        self.factors = self._array(columns, "c") if self.strips and columns is not None else None

    @staticmethod
    def by_rows(N: Matrix) -> Matrix:
        """N written in strips: a row lies in one record."""
        return Strips.of(N).matrix()

    def _array(self, x: DataFrame, value: str = "v") -> np.ndarray:
        """A vector that a broadcast would send whole, as an array."""
        t, out = x.select("i", value).toArrow(), np.zeros(self.n)
        out[t.column("i").to_numpy()] = t.column(value).to_numpy()
        return out

    def gathered(self) -> GramSpace | GatheredSpace:
        """With vectors as arrays, where the matrix is in strips."""
        return GatheredSpace(self) if self.strips else self

    def matrix(self) -> Matrix:
        """Formed after all, for kernels that hold it whole."""
        pairs = self._pairs(F.col("j") == F.col("j"))
        if self.shift:
            pairs = pairs.unionByName(self.spark.range(self.n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(float(self.shift)).alias("v")))
        return Matrix(cut(pairs.groupBy("i", "j").agg(F.sum("v").alias("v"))), self.n, self.n)

    def _times(self, x: DataFrame, factor: str) -> DataFrame:
        """x by the row factor, or by the column factors."""
        if factor == "row":
            return x if self.row is None else x.select("i", (F.col("v") * self.row).alias("v"))
        return x if self.columns is None else x.join(self.columns, "i").select("i", (F.col("v") * F.col("c")).alias("v"))

    def _gram(self, x: DataFrame) -> DataFrame:
        """(i, v) of C NᵀN C x; of strips the addends, which _shifted() sums."""
        from brindle.plans.lineage import broadcast_if_small

        if self.strips:
            return self.strips.gram(self._array(x), self.factors)
        x = self._times(x, "columns")
        right = broadcast_if_small(x.select(F.col("i").alias("j"), F.col("v").alias("_x")), self.n)
        y = self.A.df.join(right, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("_x")).alias("_y"))
        z = self.A.df.join(broadcast_if_small(y, self.m), "i").groupBy(F.col("j").alias("i")).agg(F.sum(F.col("v") * F.col("_y")).alias("v"))
        return self._times(z, "columns")

    def _shifted(self, z: DataFrame, x: DataFrame) -> DataFrame:
        both = z.unionByName(x.select("i", (F.col("v") * self.shift).alias("v"))) if self.shift else z
        return cut(both.groupBy("i").agg(F.sum("v").alias("v")))

    def apply(self, x: DataFrame) -> DataFrame:
        return self._shifted(self._times(self._gram(x), "row"), x)

    def apply_t(self, x: DataFrame) -> DataFrame:
        return self._shifted(self._gram(self._times(x, "row")), x)

    def _pairs(self, which: Column, *keys: Column) -> DataFrame:
        """(i, j, v) of diag(row) C NᵀN C, unsummed, over pairs of entries that share a row of N and the keys (expressions of j)."""
        a = self.A.df.select(F.col("i").alias("_r"), "j", "v", *[k.alias(f"_k{n}") for n, k in enumerate(keys)])
        if self.columns is not None:
            a = a.join(self.columns.select(F.col("i").alias("j"), "c"), "j").withColumn("v", F.col("v") * F.col("c")).drop("c")
        left = a.filter(which).select("_r", F.col("j").alias("i"), F.col("v").alias("_v"), *[f"_k{n}" for n in range(len(keys))])
        pairs = left.join(a, ["_r", *[f"_k{n}" for n in range(len(keys))]])
        return pairs.select("i", "j", (F.col("_v") * F.col("v") * (F.lit(1.0) if self.row is None else self.row)).alias("v"))

    def within(self, side: int) -> DataFrame:
        if self.strips:
            v = F.col("v") if self.row is None else F.col("v") * self.row
            return self.strips.gram_blocks(side, self.factors).select("i", "j", (v + F.when(F.expr("i = j"), float(self.shift)).otherwise(0.0)).alias("v"))
        own = self._pairs(F.lit(True), F.floor(F.col("j") / side))
        shift = self.spark.range(self.n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(float(self.shift)).alias("v"))
        return own.unionByName(shift).groupBy("i", "j").agg(F.sum("v").alias("v"))

    def split(self):
        squares = self._times(self._times(self.A.df.groupBy(F.col("j").alias("i")).agg(F.sum(F.col("v") * F.col("v")).alias("v")), "columns"), "columns")
        d = self._shifted(self._times(squares, "row"), self.spark.range(self.n).select(F.col("id").alias("i"), F.lit(1.0).alias("v")))
        d = d.select("i", F.col("v").alias("d"))

        def off(x: DataFrame) -> DataFrame:
            own = x.join(d, "i").select("i", (F.col("v") * F.col("d")).alias("v"))
            return self.lin((1, self.apply(x)), (-1, own))

        return d, off


class GatheredSpace(LocalSpace):
    """A GramSpace in strips with its vectors as arrays, which each of its products gathers and broadcasts anyway: at most BROADCAST_ROWS numbers.

    The matrix stays where it is. A product sends each task's sums by column, and a step writes nothing, so disk does not grow with the steps.
    """

    def __init__(self, S: GramSpace):
        if not S.strips:
            raise IncompatibleSize("vectors are gathered only for a matrix in strips")
        self.S, self.spark, self.n, self.m, self.strips, self.factors = S, S.spark, S.n, S.n, S.strips, S.factors
        self.scale = None if S.row is None else S._array(S.spark.range(S.n).withColumnRenamed("id", "i").select("i", S.row.cast("double").alias("v")))

    def take(self, x: Vector | None):
        return np.zeros(self.n) if x is None else self.S._array(x.df)

    def _gram(self, x):
        return self.strips.gram_sum(x, self.factors)

    def apply(self, x):
        y = self._gram(x)
        return (y if self.scale is None else y * self.scale) + self.S.shift * x

    def apply_t(self, x):
        return self._gram(x if self.scale is None else x * self.scale) + self.S.shift * x

    def split(self):
        d = self.strips.squares()
        d = d if self.factors is None else d * self.factors * self.factors
        d = (d if self.scale is None else d * self.scale) + self.S.shift
        return d, lambda x: self.apply(x) - d * x


def space_of(A: Matrix, local: bool | None = None):
    """Arrays if the matrix has at most LOCAL_ENTRIES entries (and rows), else relations."""
    A.square()
    if local is None:
        local = A.nrows <= LOCAL_ENTRIES and rows_at_most(A.df, LOCAL_ENTRIES)
    return LocalSpace(A) if local else SparkSpace(A)


class Operator:
    """A matrix-free operator: any function from vector to vector of a space, and the one of its transpose."""

    def __init__(self, space, apply: Callable, apply_t: Callable | None = None):
        self.space, self._apply, self._apply_t = space, apply, apply_t

    def __getattr__(self, name):
        return getattr(self.space, name)

    def apply(self, x):
        return self._apply(x)

    def apply_t(self, x):
        if self._apply_t is None:
            raise NotImplementedError("no product with the transpose")
        return self._apply_t(x)


def _start(A, b: Vector, x0: Vector | None, pc, control: IterationControl | None, local: bool | None):
    S = A if isinstance(A, (Operator, LocalSpace, SparkSpace)) else space_of(A, local)
    if b.size != S.n:
        raise IncompatibleSize(f"right side of {b.size}, matrix of {S.n}")
    from brindle.plans.preconditioners import Identity

    pc = Identity() if pc is None else pc
    rhs, x = S.take(b), S.take(x0)
    r = S.lin((1, rhs), (-1, S.apply(x))) if x0 is not None else rhs
    return S, rhs, x, r, pc.on(S), control or IterationControl()


def cg(A, b, x0=None, pc=None, control=None, local=None):
    """Conjugate gradients, for symmetric positive definite A."""
    S, _, x, r, L, c = _start(A, b, x0, pc, control, local)
    p, rho_old = None, 0.0
    while not c.done(S.norm(r)):
        z = L.solve(r)
        rho = S.dot(r, z)
        p = z if p is None else S.lin((1, z), (rho / rho_old, p))
        q = S.apply(p)
        curve = S.dot(p, q)
        if curve == 0:
            raise SearchSpaceExhaustion("a direction without curvature")
        alpha = rho / curve
        x, r, rho_old = S.lin((1, x), (alpha, p)), S.lin((1, r), (-alpha, q)), rho
        c.advance()
    return S.give(x), c


def bicg(A, b, x0=None, pc=None, control=None, local=None):
    """Bi-conjugate gradients; also multiplies by the transpose."""
    S, _, x, r, L, c = _start(A, b, x0, pc, control, local)
    s, p, q, rho_old = r, None, None, 0.0
    while not c.done(S.norm(r)):
        z, w = L.solve(r), L.adjoint_solve(s)
        rho = S.dot(z, s)
        if rho == 0:
            c.failed(2)
            break
        beta = rho / rho_old if p is not None else 0.0
        p = z if p is None else S.lin((1, z), (beta, p))
        q = w if q is None else S.lin((1, w), (beta, q))
        Ap, Aq = S.apply(p), S.apply_t(q)
        curve = S.dot(q, Ap)
        if curve == 0:
            c.failed(2)
            break
        alpha = rho / curve
        x, r, s, rho_old = S.lin((1, x), (alpha, p)), S.lin((1, r), (-alpha, Ap)), S.lin((1, s), (-alpha, Aq)), rho
        c.advance()
    return S.give(x), c


def cgs(A, b, x0=None, pc=None, control=None, local=None):
    """Conjugate gradients squared; a breakdown ends it with code 2."""
    S, _, x, r, L, c = _start(A, b, x0, pc, control, local)
    shadow, p, q, rho_old = r, None, None, 0.0
    while not c.done(S.norm(r)):
        rho = S.dot(shadow, r)
        if rho == 0:
            c.failed(2)
            break
        if p is None:
            u = p = r
        else:
            beta = rho / rho_old
            u = S.lin((1, r), (beta, q))
            p = S.lin((1, u), (beta, q), (beta * beta, p))
        v = S.apply(L.solve(p))
        sigma = S.dot(shadow, v)
        if sigma == 0:
            c.failed(2)
            break
        alpha = rho / sigma
        q = S.lin((1, u), (-alpha, v))
        w = L.solve(S.lin((1, u), (1, q)))
        x, r, rho_old = S.lin((1, x), (alpha, w)), S.lin((1, r), (-alpha, S.apply(w))), rho
        c.advance()
    return S.give(x), c


def bicgstab(A, b, x0=None, pc=None, control=None, local=None):
    """Stabilised bi-conjugate gradients."""
    S, _, x, r, L, c = _start(A, b, x0, pc, control, local)
    shadow, p, v, rho_old, alpha, omega = r, None, None, 1.0, 1.0, 1.0
    while not c.done(S.norm(r)):
        rho = S.dot(shadow, r)
        if rho == 0 or omega == 0:
            c.failed(2)
            break
        beta = rho / rho_old * alpha / omega
        p = r if p is None else S.lin((1, r), (beta, p), (-beta * omega, v))
        y = L.solve(p)
        v = S.apply(y)
        sigma = S.dot(shadow, v)
        if sigma == 0:
            c.failed(2)
            break
        alpha = rho / sigma
        s = S.lin((1, r), (-alpha, v))
        if S.norm(s) <= max(c.atol, c.rtol * (c.first or 0.0)):
            x, r = S.lin((1, x), (alpha, y)), s
            c.advance()
            continue
        z = L.solve(s)
        t = S.apply(z)
        square = S.dot(t, t)
        if square == 0:
            x, r = S.lin((1, x), (alpha, y)), s
            c.failed(2)
            break
        omega = S.dot(t, s) / square
        x, r, rho_old = S.lin((1, x), (alpha, y), (omega, z)), S.lin((1, s), (-omega, t)), rho
        c.advance()
    return S.give(x), c


def bicgstab_ell(A, b, x0=None, pc=None, control=None, local=None, ell: int = 2):
    """The same with a minimal-residual polynomial of degree ell."""
    S, rhs, x, r, L, c = _start(A, b, x0, pc, control, local)
    apply = lambda y: S.apply(L.solve(y))  # right preconditioned
    shadow, rho_old, alpha, omega = r, 1.0, 0.0, 1.0
    dx, u = S.take(None), S.take(None)
    while not c.done(S.norm(r)):
        rho_old *= -omega
        rs, us = [r], [u]
        broke = False
        for j in range(ell):
            rho = S.dot(rs[j], shadow)
            if rho_old == 0:
                broke = True
                break
            beta = alpha * rho / rho_old
            rho_old = rho
            us = [S.lin((1, rs[i]), (-beta, us[i])) for i in range(j + 1)]
            us.append(apply(us[j]))
            gamma = S.dot(us[j + 1], shadow)
            if gamma == 0:
                broke = True
                break
            alpha = rho / gamma
            rs = [S.lin((1, rs[i]), (-alpha, us[i + 1])) for i in range(j + 1)]
            rs.append(apply(rs[j]))
            dx = S.lin((1, dx), (alpha, us[0]))
        if broke:
            c.failed(2)
            r = rs[0]
            break
        G = np.array([[S.dot(rs[i], rs[j]) for j in range(1, ell + 1)] for i in range(1, ell + 1)])
        g = np.linalg.lstsq(G, np.array([S.dot(rs[0], rs[j]) for j in range(1, ell + 1)]), rcond=None)[0]
        dx = S.lin((1, dx), *[(g[j], rs[j]) for j in range(ell)])
        r = S.lin((1, rs[0]), *[(-g[j], rs[j + 1]) for j in range(ell)])
        u = S.lin((1, us[0]), *[(-g[j], us[j + 1]) for j in range(ell)])
        omega = float(g[-1])
        c.advance()
    return S.give(S.lin((1, x), (1, L.solve(dx)))), c


def bicgstab_2(A, b, x0=None, pc=None, control=None, local=None):
    return bicgstab_ell(A, b, x0, pc, control, local, 2)


def gmres(A, b, x0=None, pc=None, control=None, local=None, restart: int = 30):
    """Generalised minimal residuals, started anew every `restart` steps; the small triangle lives on the driver."""
    S, rhs, x, r, L, c = _start(A, b, x0, pc, control, local)
    r = L.solve(r)
    norm = S.norm(r)
    while not c.done(norm):
        basis, H, rotations, g = [S.lin((1 / norm, r))], np.zeros((restart + 1, restart)), [], [norm]
        k = 0
        while k < restart:
            w = L.solve(S.apply(basis[k]))
            for _ in range(2):  # classical projection, twice: as orthogonal as one by one, in two passes for any number of vectors
                h = S.dots(w, basis)
                H[: k + 1, k] += h
                w = S.lin((1, w), *[(-x, y) for x, y in zip(h, basis, strict=True)])
            H[k + 1, k] = S.norm(w)
            grown = H[k + 1, k] > 1e-14 * norm
            if grown:
                basis.append(S.lin((1 / H[k + 1, k], w)))
            for i, (co, si) in enumerate(rotations):
                H[i, k], H[i + 1, k] = co * H[i, k] + si * H[i + 1, k], co * H[i + 1, k] - si * H[i, k]
            size = np.hypot(H[k, k], H[k + 1, k])
            co, si = (H[k, k] / size, H[k + 1, k] / size) if size else (1.0, 0.0)
            rotations.append((co, si))
            H[k, k], H[k + 1, k] = size, 0.0
            g[k], tail = co * g[k], -si * g[k]
            g.append(tail)
            k += 1
            c.advance()
            if not grown or c.done(abs(tail)):
                break
        y = np.linalg.lstsq(H[:k, :k], np.array(g[:k]), rcond=None)[0]
        x = S.lin((1, x), *[(y[i], basis[i]) for i in range(k)])
        r = L.solve(S.lin((1, rhs), (-1, S.apply(x))))
        norm = S.norm(r)
        if c.code:
            break
    return S.give(x), c


def gmres_full(A, b, x0=None, pc=None, control=None, local=None):
    control = control or IterationControl()
    return gmres(A, b, x0, pc, control, local, restart=control.max_steps)


def idr_s(A, b, x0=None, pc=None, control=None, local=None, s: int = 4):
    """Induced dimension reduction; the preconditioner is applied from the right."""
    S, rhs, x, r, L, c = _start(A, b, x0, pc, control, local)
    s = min(s, S.n)
    P = []
    for k in range(s):  # orthonormal shadow vectors
        v = S.random(k + 1)
        for q in P:
            v = S.lin((1, v), (-S.dot(v, q), q))
        P.append(S.lin((1 / S.norm(v), v)))
    zero = S.take(None)
    G, U, M, omega = [zero] * s, [zero] * s, np.eye(s), 1.0
    while not c.done(S.norm(r)):
        f = np.array(S.dots(r, P))
        ended = False
        for k in range(s):
            co = np.linalg.solve(M[k:, k:], f[k:])
            v = L.solve(S.lin((1, r), *[(-co[i - k], G[i]) for i in range(k, s)]))
            u = S.lin((omega, v), *[(co[i - k], U[i]) for i in range(k, s)])
            g = S.apply(u)
            for i in range(k):
                a = S.dot(P[i], g) / M[i, i]
                g, u = S.lin((1, g), (-a, G[i])), S.lin((1, u), (-a, U[i]))
            G[k], U[k] = g, u
            M[k:, k] = S.dots(g, P[k:])
            if M[k, k] == 0:
                raise SearchSpaceExhaustion("the shadow space is exhausted")
            beta = f[k] / M[k, k]
            r, x = S.lin((1, r), (-beta, g)), S.lin((1, x), (beta, u))
            f[k + 1 :] -= beta * M[k + 1 :, k]
            c.advance()
            if S.norm(r) <= max(c.atol, c.rtol * (c.first or 0.0)) or c.step >= c.max_steps:
                ended = True
                break
        if ended:
            continue
        v = L.solve(r)
        t = S.apply(v)
        tt = S.dot(t, t)
        if tt == 0:
            raise UnexpectedOrthogonality("A r is zero")
        omega = S.dot(t, r) / tt
        x, r = S.lin((1, x), (omega, v)), S.lin((1, r), (-omega, t))
        c.advance()
    return S.give(x), c


def qmr(A, b, x0=None, pc=None, control=None, local=None):
    """Quasi-minimal residuals over coupled two-term Lanczos recurrences; the preconditioner stands on the left.

    Lanczos vectors stay as long as they come and only their lengths are kept, so a step scales numbers, not vectors: (v, y) are
    a residual-like vector and its preconditioned image of length `a`, w its partner for the transpose of length `e`.
    """
    S, _, x, r, L, c = _start(A, b, x0, pc, control, local)
    v, w = r, r
    y = L.solve(v)
    a, e = S.norm(y), S.norm(w)
    turn, share, weight = 1.0, 0.0, -1.0  # of the last rotation: its cosine, its tangent, and the length of the step along p
    p = q = step = shift = None
    pairing = 1.0
    while not c.done(S.norm(r)):
        if a == 0 or e == 0:
            c.failed(2)
            break
        both = S.dot(w, y) / (a * e)
        if both == 0:
            c.failed(3)
            break
        z = L.adjoint_solve(w)
        if p is None:
            p, q = S.lin((1 / a, y)), S.lin((1 / e, z))
        else:
            p, q = S.lin((1 / a, y), (-e * both / pairing, p)), S.lin((1 / e, z), (-a * both / pairing, q))
        image = S.apply(p)
        pairing = S.dot(q, image)
        if pairing == 0:
            c.failed(4)
            break
        beta = pairing / both
        v, w = S.lin((1, image), (-beta / a, v)), S.lin((1, S.apply_t(q)), (-beta / e, w))
        y, came = L.solve(v), a
        a, e = S.norm(y), S.norm(w)
        tangent = a / (turn * abs(beta))
        cosine = 1 / np.sqrt(1 + tangent * tangent)
        weight *= -came * cosine * cosine / (beta * turn * turn)
        past = (share * cosine) ** 2
        step = S.lin((weight, p)) if step is None else S.lin((weight, p), (past, step))
        shift = S.lin((weight, image)) if shift is None else S.lin((weight, image), (past, shift))
        x, r = S.lin((1, x), (1, step)), S.lin((1, r), (-1, shift))
        turn, share = cosine, tangent
        c.advance()
    return S.give(x), c


def tfqmr(A, b, x0=None, pc=None, control=None, local=None):
    """Transpose-free quasi-minimal residuals, right preconditioned."""
    S, rhs, x, r, L, c = _start(A, b, x0, pc, control, local)
    apply = lambda y: S.apply(L.solve(y))
    w = u = r
    v = apply(u)
    d, dx, shadow = S.take(None), S.take(None), r
    tau, theta, eta = S.norm(r), 0.0, 0.0
    rho = S.dot(shadow, r)
    au = v
    estimate = tau
    while not c.done(estimate):
        sigma = S.dot(shadow, v)
        if sigma == 0 or rho == 0:
            c.failed(2)
            break
        alpha = rho / sigma
        for half in range(2):
            if half:
                u = S.lin((1, u), (-alpha, v))
                au = apply(u)
            w = S.lin((1, w), (-alpha, au))
            d = S.lin((1, u), (theta * theta * eta / alpha, d))
            theta = S.norm(w) / tau
            co = 1 / np.sqrt(1 + theta * theta)
            tau *= theta * co
            eta = co * co * alpha
            dx = S.lin((1, dx), (eta, d))
        rho_old, rho = rho, S.dot(shadow, w)
        beta = rho / rho_old
        u_old, u = u, S.lin((1, w), (beta, u))
        au_old, au = au, apply(u)
        v = S.lin((1, au), (beta, au_old), (beta * beta, v))
        c.advance()
        estimate = tau * np.sqrt(2 * c.step + 1)
    return S.give(S.lin((1, x), (1, L.solve(dx)))), c


SOLVERS: dict[str, Callable] = {"cg": cg, "bicg": bicg, "cgs": cgs, "bicgstab": bicgstab, "bicgstab_2": bicgstab_2, "bicgstab_ell": bicgstab_ell, "gmres": gmres, "gmres_full": gmres_full, "idr_s": idr_s, "qmr": qmr, "tfqmr": tfqmr}


class Solver:
    """A solver bound to a matrix: the matrix is taken once, solves share it."""

    def __init__(self, method: str, A: Matrix, pc=None, control: IterationControl | None = None, local: bool | None = None, **options):
        self.method, self.space, self.pc, self.control, self.options = SOLVERS[method], space_of(A, local), pc, control or IterationControl(), options

    def solve(self, b: Vector, x0: Vector | None = None) -> tuple[Vector, IterationControl]:
        return self.method(self.space, b, x0, self.pc, self.control.again(), None, **self.options)

    __call__ = solve

    def step(self, b: Vector, x0: Vector, steps: int = 1) -> Vector:
        """So many steps from a start, without a test of the residual."""
        return self.method(self.space, b, x0, self.pc, IterationControl(steps, 0.0, 0.0), None, **self.options)[0]


class RepeatingSolver:
    """Runs a solver for so many steps again and again from where it came, until the control ends."""

    def __init__(self, solver: Solver, times: int):
        self.solver, self.times = solver, times

    def solve(self, b: Vector, x0: Vector) -> Vector:
        for _ in range(self.times):
            x0 = self.solver.step(b, x0)
        return x0
