"""Preconditioners: approximate solves that are bound to a space and then applied step by step.

Incomplete factors depend row on row, so they are made by a kernel on arrays: of the whole matrix where it fits the driver, or
of every diagonal block where it lies (`BlockIlu`), which no size stops.
"""

from __future__ import annotations

import copy
import pickle

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.core import Matrix
from brindle.errors import MatrixSingular, MissingDiagonal
from brindle.plans.lineage import broadcast_if_small, cut


class Identity:
    def on(self, space) -> Identity:
        return self

    def solve(self, r):
        return r

    def adjoint_solve(self, r):
        return r


def is_identity(pc) -> bool:
    return isinstance(pc, Identity)


class Diagonal:
    """Division by the diagonal; on relations a join."""

    def on(self, space) -> Diagonal:
        self.space = space
        self.d = space.split()[0]
        if isinstance(self.d, np.ndarray) and (self.d == 0).any():
            raise MissingDiagonal("a zero or no entry on the diagonal")
        return self

    def solve(self, r):
        return self.space.divide(r, self.d)

    adjoint_solve = solve


def _rows(i: np.ndarray, j: np.ndarray, v: np.ndarray, n: int) -> list[dict[int, float]]:
    rows: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, x in zip(i.tolist(), j.tolist(), v.tolist(), strict=True):
        rows[a][b] = rows[a].get(b, 0.0) + x
    return rows


def ilu_rows(rows: list[dict[int, float]], keep=None) -> list[dict[int, float]]:
    """Row by row elimination. keep(k, row, norm) thins a finished row; without it only the given pattern is kept.

    The result holds L below the diagonal (unit, not stored), U from it on, and reciprocals on it.
    """
    out: list[dict[int, float]] = []
    for k, given in enumerate(rows):
        row, norm = dict(given), np.sqrt(sum(x * x for x in given.values()))
        todo = sorted(c for c in row if c < k)
        while todo:
            c = todo.pop(0)
            f = row[c] = row[c] * out[c][c]
            for b, x in out[c].items():
                if b > c:
                    if b in row:
                        row[b] -= f * x
                    elif keep is not None and f * x != 0:
                        row[b] = -f * x
                        if b < k:
                            todo = sorted([*todo, b])
        if keep is not None:
            row = keep(k, row, norm)
        if row.get(k, 0.0) == 0:
            raise MatrixSingular(f"pivot {k} is zero or missing")
        row[k] = 1 / row[k]
        out.append(row)
    return out


def ilut_keep(p: int, tau: float):
    """Entries of at least tau times the row's norm, and of them the p largest of L and of U; the diagonal always."""

    def keep(k: int, row: dict[int, float], norm: float) -> dict[int, float]:
        big = {c: x for c, x in row.items() if c != k and abs(x) >= tau * norm}
        out = {}
        for side in (lambda c: c < k, lambda c: c > k):
            out |= dict(sorted(((c, x) for c, x in big.items() if side(c)), key=lambda e: (-abs(e[1]), e[0]))[:p])
        out[k] = row.get(k, 0.0)
        return out

    return keep


def ic_rows(rows: list[dict[int, float]]) -> list[dict[int, float]]:
    """Rows of the lower factor with the matrix's own pattern, reciprocals on the diagonal."""
    out: list[dict[int, float]] = []
    for k, given in enumerate(rows):
        row: dict[int, float] = {}
        for c in sorted(c for c in given if c < k):
            row[c] = (given[c] - sum(row[b] * x for b, x in out[c].items() if b < c and b in row)) * out[c][c]
        d = given.get(k, 0.0) - sum(x * x for x in row.values())
        if d <= 0:
            raise MatrixSingular(f"pivot {k} is not positive")
        row[k] = 1 / np.sqrt(d)
        out.append(row)
    return out


def forward(rows: list[dict[int, float]], r: np.ndarray, unit: bool) -> np.ndarray:
    x = r.astype(float).copy()
    for k, row in enumerate(rows):
        x[k] -= sum(v * x[c] for c, v in row.items() if c < k)
        if not unit:
            x[k] *= row[k]
    return x


def backward(rows: list[dict[int, float]], r: np.ndarray) -> np.ndarray:
    x = r.astype(float).copy()
    for k in reversed(range(len(rows))):
        x[k] = (x[k] - sum(v * x[c] for c, v in rows[k].items() if c > k)) * rows[k][k]
    return x


def forward_t(rows: list[dict[int, float]], r: np.ndarray) -> np.ndarray:
    """Uᵀ x = r."""
    x = r.astype(float).copy()
    for k, row in enumerate(rows):
        x[k] *= row[k]
        for c, v in row.items():
            if c > k:
                x[c] -= v * x[k]
    return x


def backward_t(rows: list[dict[int, float]], r: np.ndarray, unit: bool) -> np.ndarray:
    """Lᵀ x = r."""
    x = r.astype(float).copy()
    for k in reversed(range(len(rows))):
        if not unit:
            x[k] *= rows[k][k]
        for c, v in rows[k].items():
            if c < k:
                x[c] -= v * x[k]
    return x


class _Kernel:
    """A preconditioner whose factors are made from the gathered matrix."""

    def on(self, space):
        if not hasattr(space, "i"):
            raise MemoryError("an incomplete factor of a matrix that can't be gathered; use BlockIlu")
        self.rows = self.factor(_rows(space.i, space.j, space.v, space.n))
        return self


class Ilu0(_Kernel):
    def factor(self, rows):
        return ilu_rows(rows)

    def solve(self, r):
        return backward(self.rows, forward(self.rows, r, True))

    def adjoint_solve(self, r):
        return backward_t(self.rows, forward_t(self.rows, r), True)


class Ilut(Ilu0):
    def __init__(self, p: int, tau: float):
        self.keep = ilut_keep(p, tau)

    def factor(self, rows):
        return ilu_rows(rows, self.keep)


class Ic0(_Kernel):
    def factor(self, rows):
        return ic_rows(rows)

    def solve(self, r):
        return backward_t(self.rows, forward(self.rows, r, False), False)

    adjoint_solve = solve


class Imf:
    """A multilevel incomplete factor: every level eliminates nodes that share no entry, then goes on with what is left.

    Fill is kept up to a level: an entry of the matrix has level 0, one that elimination of node k makes at (i, j) has the levels of
    (i, k) and (k, j) plus one. Without a bound the factor is exact. Element structures are assembled first (`of_elements`).
    """

    def __init__(self, most_fill: int | None = 1):
        self.most_fill = most_fill

    @staticmethod
    def of_elements(es, most_fill: int | None = 1) -> tuple[Matrix, Imf]:
        """The assembled matrix, and the preconditioner to be bound to it."""
        return es.assemble(), Imf(most_fill)

    def on(self, space) -> Imf:
        if not hasattr(space, "i"):
            raise MemoryError("a multilevel factor of a matrix that can't be gathered; use BlockIlu")
        rows = [{c: (v, 0) for c, v in row.items()} for row in _rows(space.i, space.j, space.v, space.n)]
        columns: list[set[int]] = [set() for _ in rows]
        for r, row in enumerate(rows):
            for c in row:
                columns[c].add(r)
        active, self.steps, self.levels = set(range(len(rows))), [], 0
        while active:
            self.levels += 1
            blocked: set[int] = set()
            chosen = []
            for k in sorted(active, key=lambda k: (len(rows[k]) + len(columns[k]), k)):
                if k not in blocked:
                    chosen.append(k)
                    blocked |= {*rows[k], *columns[k]}
            for k in chosen:
                self._eliminate(rows, columns, k)
            active.difference_update(chosen)
        return self

    def _eliminate(self, rows, columns, k: int) -> None:
        pivot = rows[k].pop(k, (0.0, 0))[0]
        if pivot == 0:
            raise MatrixSingular(f"pivot {k} is zero or missing")
        columns[k].discard(k)
        right = rows[k]
        left = {r: rows[r].pop(k) for r in columns[k]}
        for c in right:
            columns[c].discard(k)
        for r, (v, up) in left.items():
            for c, (w, over) in right.items():
                fill = up + over + 1
                if c in rows[r]:
                    old, level = rows[r][c]
                    rows[r][c] = (old - v * w / pivot, min(level, fill))
                elif self.most_fill is None or fill <= self.most_fill:
                    rows[r][c] = (-v * w / pivot, fill)
                    columns[c].add(r)
        self.steps.append((k, pivot, {r: v / pivot for r, (v, _) in left.items()}, {c: w for c, (w, _) in right.items()}))

    def solve(self, r):
        x = r.astype(float).copy()
        for k, _, left, _ in self.steps:
            for i, v in left.items():
                x[i] -= v * x[k]
        for k, pivot, _, right in reversed(self.steps):
            x[k] = (x[k] - sum(w * x[c] for c, w in right.items())) / pivot
        return x

    def adjoint_solve(self, r):
        x = r.astype(float).copy()
        for k, pivot, _, right in self.steps:
            x[k] /= pivot
            for c, w in right.items():
                x[c] -= w * x[k]
        for k, _, left, _ in reversed(self.steps):
            x[k] -= sum(v * x[i] for i, v in left.items())
        return x


def _factored(kernel: _Kernel, i: np.ndarray, j: np.ndarray, v: np.ndarray, b: int, side: int, n: int) -> _Kernel:
    """The factor of diagonal block b of `side` rows."""
    own = copy.copy(kernel)
    own.rows = own.factor(_rows(i - b * side, j - b * side, v, min(side, n - b * side)))
    return own


class BlockIlu:
    """An incomplete factor (`kernel`: Ilu0, Ilut or Ic0) of every diagonal block of `side` rows, made once where the block lies and written; a vector meets the factors there, which no step shuffles."""

    def __init__(self, side: int = 4096, kernel: _Kernel | None = None):
        self.side, self.kernel = side, kernel or Ilu0()

    def on(self, space) -> BlockIlu:
        self.space, side = space, self.side
        if hasattr(space, "i"):
            inside = space.i // side == space.j // side
            parts = {int(b): inside & (space.i // side == b) for b in np.unique(space.i // side)}
            self.blocks = {b: _factored(self.kernel, space.i[p], space.j[p], space.v[p], b, side, space.n) for b, p in parts.items()}
        else:
            n, kernel = space.n, self.kernel

            def factor(key, a: pd.DataFrame) -> pd.DataFrame:
                own = _factored(kernel, a["i"].to_numpy(), a["j"].to_numpy(), a["v"].to_numpy(), int(key[0]), side, n)
                return pd.DataFrame({"b": [int(key[0])], "data": [cloudpickle.dumps(own)]})

            entries = space.within(side).withColumn("b", F.floor(F.col("i") / side))
            self.factors = cut(entries.groupBy("b").applyInPandas(factor, "b long, data binary"))
            if self.factors.count() < -(-n // side):
                raise MissingDiagonal("a diagonal block has no entries")
        return self

    def _applied(self, r, how: str):
        side, n = self.side, self.space.n
        if hasattr(self, "blocks"):
            out = r.copy()
            for b, own in self.blocks.items():
                part = slice(b * side, b * side + len(own.rows))
                out[part] = getattr(own, how)(r[part])
            return out

        def apply(batches):
            for t in batches:
                for b, data, at, values in zip(t["b"], t["data"], t["at"], t["x"], strict=True):
                    own = np.zeros(min(side, n - b * side))
                    if at is not None:
                        own[np.asarray(at, int) - b * side] = values
                    yield pd.DataFrame({"i": np.arange(len(own)) + b * side, "v": getattr(pickle.loads(data), how)(own)})

        x: DataFrame = r.groupBy(F.floor(F.col("i") / side).alias("b")).agg(F.collect_list(F.struct("i", "v")).alias("x")).select("b", F.col("x.i").alias("at"), F.col("x.v").alias("x"))
        return cut(self.factors.join(broadcast_if_small(x, n), "b", "left").mapInPandas(apply, "i long, v double"))

    def solve(self, r):
        return self._applied(r, "solve")

    def adjoint_solve(self, r):
        return self._applied(r, "adjoint_solve")


class Concat:
    """Two preconditioners in turn: the second corrects what the first leaves of the residual."""

    def __init__(self, first, second):
        self.first, self.second = first, second

    def on(self, space) -> Concat:
        self.space, self.first, self.second = space, self.first.on(space), self.second.on(space)
        return self

    def solve(self, r):
        S = self.space
        x = self.first.solve(r)
        return S.lin((1, x), (1, self.second.solve(S.lin((1, r), (-1, S.apply(x))))))

    def adjoint_solve(self, r):
        S = self.space
        x = self.second.adjoint_solve(r)
        return S.lin((1, x), (1, self.first.adjoint_solve(S.lin((1, r), (-1, S.apply_t(x))))))


class SubMatrix:
    """A preconditioner on the rows and columns of tagged indices; other entries pass through."""

    def __init__(self, tags: list[bool], inner):
        self.tags, self.inner = np.array(tags, bool), inner

    def on(self, space) -> SubMatrix:
        import copy

        if not hasattr(space, "i"):
            raise MemoryError("a tagged sub-matrix needs a matrix that can be gathered")
        place = np.cumsum(self.tags) - 1
        inside = self.tags[space.i] & self.tags[space.j]
        sub = copy.copy(space)
        sub.i, sub.j, sub.v = place[space.i[inside]], place[space.j[inside]], space.v[inside]
        sub.n = sub.m = int(self.tags.sum())
        self.inner = self.inner.on(sub)
        return self

    def _through(self, r, f):
        out = r.copy()
        out[self.tags] = f(r[self.tags])
        return out

    def solve(self, r):
        return self._through(r, self.inner.solve)

    def adjoint_solve(self, r):
        return self._through(r, self.inner.adjoint_solve)


def factored(A: Matrix, pc):
    """The incomplete factors of a matrix as arrays: L (with its diagonal) and U."""
    from brindle.plans.krylov import LocalSpace

    own = pc.on(LocalSpace(A))
    n = A.nrows
    L, U = np.eye(n), np.zeros((n, n))
    for k, row in enumerate(own.rows):
        for c, v in row.items():
            if c < k:
                L[k, c] = v
            elif isinstance(pc, Ic0):
                L[k, k] = 1 / v
            else:
                U[k, c] = 1 / v if c == k else v
    return L, (L.T if isinstance(pc, Ic0) else U)


def solve(pc, A: Matrix, r):
    """A preconditioner applied once to a vector."""
    from brindle.plans.krylov import space_of

    S = space_of(A)
    return S.give(pc.on(S).solve(S.take(r)))


def adjoint_solve(pc, A: Matrix, r):
    from brindle.plans.krylov import space_of

    S = space_of(A)
    return S.give(pc.on(S).adjoint_solve(S.take(r)))
