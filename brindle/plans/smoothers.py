"""Smoothers: sweeps that take x closer to the solution of A x = b."""

from __future__ import annotations

import numpy as np

from brindle.core import Matrix, Vector
from brindle.errors import MissingDiagonal
from brindle.plans.krylov import LocalSpace, space_of


class Jacobi:
    """x <- (1 - omega) x + omega D⁻¹ (b - (A - D) x); omega 1 is the plain sweep. All rows at once, on relations too."""

    def __init__(self, A: Matrix, omega: float = 1.0, local: bool | None = None):
        self.space, self.omega = space_of(A, local), omega
        self.d, self.off = self.space.split()
        if isinstance(self.d, np.ndarray) and (self.d == 0).any():
            raise MissingDiagonal("a zero or no entry on the diagonal")

    def sweep(self, x, b):
        S = self.space
        y = S.divide(S.lin((1, b), (-1, self.off(x))), self.d)
        return y if self.omega == 1 else S.lin((self.omega, y), (1 - self.omega, x))

    def __call__(self, x: Vector, b: Vector, sweeps: int = 1) -> Vector:
        S = self.space
        own, rhs = S.take(x), S.take(b)
        for _ in range(sweeps):
            own = self.sweep(own, rhs)
        return S.give(own)


def jor(A: Matrix, omega: float = 2 / 3, local: bool | None = None) -> Jacobi:
    """Damped Jacobi."""
    return Jacobi(A, omega, local)


class GaussSeidel:
    """Rows in turn, each with the newest values; omega other than 1 over- or under-relaxes.

    On arrays row by row; on relations x <- (D/omega + L)⁻¹ (b - (U + (1 - 1/omega) D) x), a triangular solve by levels.
    """

    def __init__(self, A: Matrix, omega: float = 1.0, local: bool | None = None):
        self.A, self.omega, self.space = A, omega, space_of(A, local)
        S = self.space
        if isinstance(S, LocalSpace):
            order = np.argsort(S.i, kind="stable")
            cuts = np.searchsorted(S.i[order], np.arange(S.n + 1))
            self.rows = [(S.j[order][a:b], S.v[order][a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            self.d = S.split()[0]
            if (self.d == 0).any():
                raise MissingDiagonal("a zero or no entry on the diagonal")

    def sweep(self, x, b):
        S, w = self.space, self.omega
        if isinstance(S, LocalSpace):
            x = x.copy()
            for k, (c, v) in enumerate(self.rows):
                new = (b[k] - v @ x[c]) / self.d[k] + x[k]
                x[k] += w * (new - x[k])
            return x
        from pyspark.sql import functions as F

        from brindle.operators.factor import triangular_solve
        from brindle.plans.krylov import SparkSpace

        e = S.entries
        upper = e.filter("j >= i").withColumn("v", F.when(F.col("i") == F.col("j"), F.col("v") * (1 - 1 / w)).otherwise(F.col("v")))
        rhs = S.lin((1, b), (-1, SparkSpace(self.A.with_df(upper)).apply(x)))
        left = self.A.with_df(e.filter("j <= i").withColumn("v", F.when(F.col("i") == F.col("j"), F.col("v") / w).otherwise(F.col("v"))))
        return triangular_solve(left, Vector(rhs, S.n), True).df

    def __call__(self, x: Vector, b: Vector, sweeps: int = 1) -> Vector:
        S = self.space
        own, rhs = S.take(x), S.take(b)
        for _ in range(sweeps):
            own = self.sweep(own, rhs)
        return S.give(own)


def sor(A: Matrix, omega: float = 1.3, local: bool | None = None) -> GaussSeidel:
    """Successive over-relaxation."""
    return GaussSeidel(A, omega, local)


class Repeated:
    """A smoother, so many times."""

    def __init__(self, smoother, times: int):
        self.smoother, self.times = smoother, times

    def __call__(self, x: Vector, b: Vector) -> Vector:
        return self.smoother(x, b, self.times)
