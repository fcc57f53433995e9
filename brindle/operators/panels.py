"""Square matrices beyond what one process holds whole, as column panels of SIDE columns: files in the folder that driver and executors share.

Factorisations look left: one task makes one panel from those before it, which it reads one by one, so a task holds a few panels of
n * SIDE numbers and every panel is written once. What has no such order (products, inverses) makes all its panels side by side.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from brindle.core import Matrix, Vector
from brindle.errors import MatrixSingular
from brindle.plans.lineage import shared_dir

#: Columns of a panel.
SIDE = 512
#: Attribute of a matrix's relation: (panels, name, whether it is their transpose).
ORIGIN = "_of_panels"
#: Attribute of a diagonal matrix's relation: its diagonal.
DIAGONAL = "_of_diagonal"
#: Bytes of panels that one task holds while it makes reflections.
HELD = 768 << 20
#: Products of columns, as a share of the matrix's norm and the longer column's, that are taken for zero; passes over all pairs of panels to come there.
ORTHOGONAL, SWEEPS = 1e-13, 60


@dataclass(frozen=True)
class Panels:
    spark: SparkSession
    path: str
    n: int
    side: int = SIDE
    source: str = ""  # where panels of a lie, if with others

    @staticmethod
    def new(spark: SparkSession, n: int, side: int = SIDE, source: str = "") -> Panels:
        at = f"{shared_dir(spark)}/brindle/panels-{uuid.uuid4().hex}"
        return Panels(spark, at if ":" in at else f"file://{at}", n, side, source)

    @staticmethod
    def of(A: Matrix, side: int = SIDE) -> Panels:
        """A in panels, as matrix a. A matrix that was made of panels, or put into them before, or the transpose of one, is not shuffled again."""
        found = getattr(A.df, ORIGIN, None)
        if found and found[0].n == A.square() and found[0].side == side:
            P, name, flipped = found
            return _flipped(P, name) if flipped else Panels.new(A.spark, P.n, side, P.store().prefix(name))
        out = Panels.new(A.spark, A.square(), side)
        setattr(A.df, ORIGIN, (out, "a", False))
        store = out.store()
        cells = A.df.select(F.floor(F.col("j") / side).cast("int").alias("p"), F.col("i").cast("int").alias("i"), (F.col("j") % side).cast("int").alias("c"), "v")

        def build(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
            k = key[0].as_py()
            a = np.zeros(store.shape(k))
            for b in group.to_batches():
                a[b.column("i").to_numpy(), b.column("c").to_numpy()] = b.column("v").to_numpy()
            store.put("a", k, a)
            return pa.table({"p": pa.array([k], pa.int32())})

        got = {r["p"] for r in cells.groupBy("p").applyInArrow(build, "p int").collect()}
        for k in set(range(store.count)) - got:  # panels without an entry
            store.put("a", k, np.zeros(store.shape(k)))
        return out

    def store(self) -> Store:
        return Store(self.path, self.n, self.side, self.source)

    def drop(self, name: str, k: int) -> None:
        """Takes away a panel that only a step before this one has read."""
        files, path = fs.FileSystem.from_uri(f"{self.path}/{name}-{k}.npy")
        files.delete_file(path)

    def run(self, tasks: list, f: Callable) -> list:
        """f on each, a task for each; what comes back is small."""
        return self.spark.sparkContext.parallelize(tasks, len(tasks)).map(f).collect()

    def each(self, f: Callable) -> None:
        self.run(list(range(self.store().count)), f)

    def in_turn(self, f: Callable, state=None):
        """One panel after another: f(k, state) gives the next state."""
        for k in range(self.store().count):
            state = self.run([k], lambda k, state=state: f(k, state))[0]
        return state

    def matrix(self, name: str) -> Matrix:
        """Entries of a panelled matrix, without zeros."""
        store = self.store()

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in b.column(0).to_pylist():
                    a = store.get(name, k)
                    for c in range(0, a.shape[1], 16):
                        i, j = np.nonzero(a[:, c : c + 16])
                        yield pa.record_batch({"i": pa.array(i, pa.int64()), "j": pa.array(j + c + k * store.side, pa.int64()), "v": pa.array(a[i, j + c])})

        df = self.spark.range(0, store.count, 1, store.count).mapInArrow(cells, "i long, j long, v double")
        setattr(df, ORIGIN, (self, name, False))
        return Matrix(df, self.n, self.n)


@dataclass(frozen=True)
class Store:
    """What tasks know of the panels: reading and writing them, whole or not at all."""

    path: str
    n: int
    side: int
    source: str

    def prefix(self, name: str) -> str:
        return self.source if name == "a" and self.source else f"{self.path}/{name}"

    @property
    def count(self) -> int:
        return -(-self.n // self.side)

    def at(self, k: int) -> slice:
        return slice(k * self.side, min(self.n, (k + 1) * self.side))

    def shape(self, k: int) -> tuple[int, int]:
        return self.n, min(self.side, self.n - k * self.side)

    def put(self, name: str, k: int, a: np.ndarray) -> None:
        files, path = fs.FileSystem.from_uri(self.path)
        files.create_dir(path, recursive=True)
        own = f"{path}/{name}-{k}.{uuid.uuid4().hex}"
        text = io.BytesIO()
        np.save(text, np.ascontiguousarray(a))
        with files.open_output_stream(own, compression=None) as f:
            f.write(text.getbuffer())
        files.move(own, f"{path}/{name}-{k}.npy")

    def get(self, name: str, k: int) -> np.ndarray:
        files, path = fs.FileSystem.from_uri(f"{self.prefix(name)}-{k}.npy")
        with files.open_input_file(path) as f:
            return np.load(io.BytesIO(f.read_buffer()))

    def forward(self, name: str, x: np.ndarray, p: np.ndarray | None = None, unit: bool = False) -> np.ndarray:
        """x with T x = b, T the lower triangle of panels whose rows p puts in order."""
        for j in range(self.count):
            t, own = self.get(name, j), self.at(j)
            t = t if p is None else t[p]
            x[own] = triangle(t[own], x[own], True, unit)
            x[own.stop :] -= t[own.stop :] @ x[own]
        return x

    def backward(self, name: str, x: np.ndarray) -> np.ndarray:
        for j in reversed(range(self.count)):
            t, own = self.get(name, j), self.at(j)
            x[own] = triangle(t[own], x[own], False)
            x[: own.start] -= t[: own.start] @ x[own]
        return x


def _flipped(P: Panels, name: str) -> Panels:
    out = Panels.new(P.spark, P.n, P.side)
    s, t = P.store(), out.store()
    out.each(lambda k: t.put("a", k, np.vstack([s.get(name, j)[s.at(k)].T for j in range(s.count)])))
    return out


def triangle(t: np.ndarray, b: np.ndarray, lower: bool, unit: bool = False) -> np.ndarray:
    """Substitution with a triangle of at most a panel's side, halved until it is small."""
    n = len(t)
    if n <= 32:
        from brindle.operators.factor import substitute

        return substitute(np.tril(t, -1) + np.eye(n) if unit else t, b, lower)
    h, x = n // 2, np.array(b, float)
    if lower:
        x[:h] = triangle(t[:h, :h], x[:h], True, unit)
        x[h:] = triangle(t[h:, h:], x[h:] - t[h:, :h] @ x[:h], True, unit)
    else:
        x[h:] = triangle(t[h:, h:], x[h:], False)
        x[:h] = triangle(t[:h, :h], x[:h] - t[:h, h:] @ x[h:], False)
    return x


def product(A: Panels, B: Panels, a: str = "a", b: str = "a") -> Panels:
    """y, beside A's panels: the product of a panelled matrix of A and one of B."""
    s, t = A.store(), B.store()

    def panel(k: int) -> None:
        right, total = t.get(b, k), np.zeros(s.shape(k))
        for j in range(s.count):
            total += s.get(a, j) @ right[s.at(j)]
        s.put("y", k, total)

    A.each(panel)
    return A


def cholesky(P: Panels) -> Panels:
    """l: the lower factor; only the lower triangle of a is looked at."""
    s = P.store()

    def panel(k: int, _) -> None:
        own, x = s.at(k), s.get("a", k)
        x[: own.start] = 0
        for j in range(k):
            l = s.get("l", j)  # noqa: E741
            x[own.start :] -= l[own.start :] @ l[own].T
        low = np.tril(x[own])
        try:
            x[own] = np.linalg.cholesky(low + np.tril(low, -1).T)
        except np.linalg.LinAlgError as e:
            raise MatrixSingular("not positive definite") from e
        x[own.stop :] = triangle(x[own], x[own.stop :].T, True).T
        s.put("l", k, x)

    P.in_turn(panel)
    return P


def lu(P: Panels, pivot: bool, eps: float) -> np.ndarray:
    """l (unit, rows by their own numbers) and u (upper); the row order is returned."""
    s = P.store()

    def panel(k: int, p: np.ndarray) -> np.ndarray:
        own, x, p = s.at(k), s.get("a", k)[p], p.copy()
        for j in range(k):
            l, jth = s.get("l", j)[p], s.at(j)  # noqa: E741
            x[jth] = triangle(l[jth], x[jth], True, True)
            x[jth.stop :] -= l[jth.stop :] @ x[jth]
        y, q = x[own.start :], p[own.start :]
        for c0 in range(0, y.shape[1], 32):
            c1 = min(c0 + 32, y.shape[1])
            for c in range(c0, c1):
                r = c + int(np.argmax(np.abs(y[c:, c]))) if pivot else c
                if r != c:
                    y[[c, r]], q[[c, r]] = y[[r, c]], q[[r, c]]
                if abs(y[c, c]) <= eps:
                    raise MatrixSingular(f"pivot {own.start + c} is {y[c, c]:g}")
                y[c + 1 :, c] /= y[c, c]
                y[c + 1 :, c + 1 : c1] -= np.outer(y[c + 1 :, c], y[c, c + 1 : c1])
            y[c0:c1, c1:] = triangle(y[c0:c1, c0:c1], y[c0:c1, c1:], True, True)
            y[c1:, c1:] -= y[c1:, c0:c1] @ y[c0:c1, c1:]
        u = np.zeros_like(x)
        u[: own.stop] = x[: own.stop]
        u[own] = np.triu(u[own])
        l = np.zeros_like(x)  # noqa: E741
        l[p[own.start :]] = y
        l[p[own]] = np.tril(y[: own.stop - own.start], -1) + np.eye(own.stop - own.start)
        s.put("u", k, u)
        s.put("l", k, l)
        return p

    return P.in_turn(panel, np.arange(P.n))


def lu_solved(P: Panels, p: np.ndarray, b: np.ndarray) -> np.ndarray:
    s = P.store()
    return P.run([0], lambda _: s.backward("u", s.forward("l", b[p].astype(float), p, True)))[0]


def lu_adjoint_solved(P: Panels, p: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Aᵀ x = b: with the panels' transposes, each a row of blocks."""
    s = P.store()

    def solve(_) -> np.ndarray:
        y = b.astype(float)
        for k in range(s.count):
            u, own = s.get("u", k), s.at(k)
            y[own] = triangle(u[own].T, y[own] - u[: own.start].T @ y[: own.start], True)
        for k in reversed(range(s.count)):
            l, own = s.get("l", k)[p], s.at(k)  # noqa: E741
            y[own] = triangle(l[own].T, y[own] - l[own.stop :].T @ y[own.stop :], False)
        x = np.empty_like(y)
        x[p] = y
        return x

    return P.run([0], solve)[0]


def inverse(P: Panels, how: str, p: np.ndarray | None = None) -> Panels:
    """x: the inverse of all (from lu), or of the lower or upper triangle of a."""
    s = P.store()

    def panel(k: int) -> None:
        x = np.zeros(s.shape(k))
        x[s.at(k)] = np.eye(x.shape[1])
        if how == "all":
            x = s.backward("u", s.forward("l", x[p], p, True))
        else:
            x = s.forward("a", x) if how == "lower" else s.backward("a", x)
        s.put("x", k, x)

    P.each(panel)
    return P


def triangular_solved(P: Panels, b: np.ndarray, lower: bool) -> np.ndarray:
    s = P.store()
    return P.run([0], lambda _: (s.forward if lower else s.backward)("a", b.astype(float)))[0]


def qr(P: Panels) -> Panels:
    """q and r, by blocks of reflections I - v t vᵀ that are applied to each later panel."""
    s = P.store()

    def panel(k: int, _) -> None:
        own, x = s.at(k), s.get("a", k)
        for j in range(k):
            vt = s.get("v", j)
            v, t = vt[: s.n], vt[s.n :]
            x -= v @ (t.T @ (v.T @ x))
        h, tau = np.linalg.qr(x[own.start :], mode="raw")
        h, w = h.T, x.shape[1]
        v, t = np.zeros((s.n, w)), np.zeros((w, w))
        v[own.start :] = np.tril(h, -1)
        v[own] += np.eye(w)
        gram = v.T @ v
        for c in range(w):
            t[:c, c] = -tau[c] * (t[:c, :c] @ gram[:c, c])
            t[c, c] = tau[c]
        r = np.zeros_like(x)
        r[: own.start] = x[: own.start]
        r[own] = np.triu(h[:w])
        s.put("v", k, np.vstack([v, t]))
        s.put("r", k, r)

    P.in_turn(panel)
    P.each(lambda k: _reflected(s, k))
    return P


def _reflected(s: Store, k: int) -> None:
    """q: a panel of the product of all blocks of reflections."""
    q = np.zeros(s.shape(k))
    q[s.at(k)] = np.eye(q.shape[1])
    for j in reversed(range(s.count)):
        vt = s.get("v", j)
        v, t = vt[: s.n], vt[s.n :]
        q -= v @ (t @ (v.T @ q))
    s.put("q", k, q)


def hessenberg(P: Panels) -> Panels:
    """h and q with a = q h qᵀ. One task makes the reflections of a panel, each from a product with all panels not yet reduced; then all panels are reflected side by side.

    What a panel was is read until the step is over, so a task that is run again finds it.
    """
    from brindle.operators.factor import householder

    s = P.store()

    def reflections(k: int, now: str) -> None:
        own, v, t = s.at(k), np.zeros((s.n, s.shape(k)[1])), np.zeros((s.shape(k)[1],) * 2)
        y, held, size = np.zeros(v.shape), {}, s.n * s.side * 8
        for p in range(k, s.count):  # the others are read for every column
            if (len(held) + 1) * size <= HELD:
                held[p] = s.get(now, p)
        panel = held.get(k)
        panel = s.get(now, k) if panel is None else panel
        for j in range(v.shape[1]):
            c = own.start + j
            if c + 2 >= s.n:
                break
            x = panel[:, j] - y[:, :j] @ v[c, :j]
            x -= v[:, :j] @ (t[:j, :j].T @ (v[:, :j].T @ x))
            v[c + 1 :, j], b = householder(x[c + 1 :])
            if b == 0:
                v[:, j] = 0
                continue
            image, met = np.zeros(s.n), v[:, :j].T @ v[:, j]
            for p in range(k, s.count):
                part = v[s.at(p), j]
                if part.any():
                    image += (held[p] if p in held else s.get(now, p)) @ part
            y[:, j] = b * (image - y[:, :j] @ met)
            t[:j, j], t[j, j] = -b * (t[:j, :j] @ met), b
        s.put("v", k, np.vstack([v, t]))
        s.put("w", k, y)

    def reflect(k: int, p: int, now: str, then: str) -> None:
        x, vt = s.get(now, p), s.get("v", k)
        v, t = vt[: s.n], vt[s.n :]
        x -= s.get("w", k) @ v[s.at(p)].T
        x -= v @ (t.T @ (v.T @ x))
        s.put("h" if p == k else then, p, np.triu(x, -s.at(p).start - 1) if p == k else x)

    for k in range(s.count):
        now, then = f"h{k}" if k else "a", f"h{k + 1}"
        P.run([k], lambda k, now=now: reflections(k, now))
        P.run(list(range(k, s.count)), lambda p, k=k, now=now, then=then: reflect(k, p, now, then))
        P.drop("w", k)
        for p in range(k, s.count) if k else ():
            P.drop(now, p)
    P.each(lambda k: _reflected(s, k))
    for k in range(s.count):
        P.drop("v", k)
    return P


def _rounds(count: int) -> list[list[tuple[int, int]]]:
    """Every pair of panels once, in rounds of pairs without a common panel."""
    ring, rounds = [*range(count), *([None] if count % 2 else [])], []
    for _ in range(len(ring) - 1):
        pairs = [(ring[k], ring[-1 - k]) for k in range(len(ring) // 2)]
        rounds.append([(min(x), max(x)) for x in pairs if None not in x])
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return rounds


def svd(P: Panels) -> tuple[Panels, np.ndarray, Panels]:
    """(S, values, D) with a = s diag(values) dᵀ, values falling; s and d are panels of these names.

    Columns are turned until all are orthogonal, two panels in a task, all panels in a round: y = a d. Sorted, y has a triangle that is diagonal up to rounding.
    A task writes new panels and those that it read are dropped after the round, so it may be run again.
    """
    s = P.store()

    def start(k: int) -> float:
        x, d = s.get("a", k), np.zeros(s.shape(k))
        d[s.at(k)] = np.eye(d.shape[1])
        s.put("y0", k, x)
        s.put("d0", k, d)
        return float((x * x).sum())

    whole = np.sqrt(sum(P.run(list(range(s.count)), start)))
    if not np.isfinite(whole):
        raise ValueError("singular values of a matrix with values that are not finite")

    def turn(task: tuple, sweep: int) -> float:
        """Makes the columns of two panels (or of one) orthogonal; how far they were from it."""
        own, now, then = task
        y = np.hstack([s.get(f"y{v}", k) for k, v in zip(own, now, strict=True)])
        gram = y.T @ y
        norm = np.sqrt(np.diag(gram))
        far = np.abs(gram - np.diag(np.diag(gram)))
        scale = whole * np.maximum(norm[:, None], norm)
        off = float(np.divide(far, scale, out=np.zeros_like(far), where=scale > 0).max())
        if off <= ORTHOGONAL:
            return off
        if sweep < 4 and off > 1e-6:  # cheaper, and as good while much is to be turned
            u = np.linalg.eigh(gram)[1][:, ::-1]
        else:
            u = np.linalg.svd(np.linalg.qr(y, mode="r"), full_matrices=True)[2].T
        y, d = y @ u, np.hstack([s.get(f"d{v}", k) for k, v in zip(own, now, strict=True)]) @ u
        at = 0
        for k in own:
            w = s.shape(k)[1]
            s.put(f"y{then}", k, y[:, at : at + w])
            s.put(f"d{then}", k, d[:, at : at + w])
            at += w
        return off

    version, step = [0] * s.count, 0
    rounds = _rounds(s.count) if s.count > 1 else [[(0,)]]
    for sweep in range(SWEEPS):
        worst = 0.0
        for pairs in rounds:
            step += 1
            tasks = [(own, [version[k] for k in own], step) for own in pairs]
            for (own, now, then), off in zip(tasks, P.run(tasks, lambda task, sweep=sweep: turn(task, sweep)), strict=True):
                worst = max(worst, off)
                if off > ORTHOGONAL:
                    for k, v in zip(own, now, strict=True):
                        P.drop(f"y{v}", k)
                        P.drop(f"d{v}", k)
                        version[k] = then
        if worst <= ORTHOGONAL:
            break
    else:
        raise MatrixSingular(f"columns are not orthogonal after {SWEEPS} sweeps: {worst:g}")

    norms = np.concatenate(P.run(list(range(s.count)), lambda k: np.linalg.norm(s.get(f"y{version[k]}", k), axis=0)))
    order = np.argsort(-norms, kind="stable")

    def sort(k: int) -> None:
        own = order[s.at(k)]
        for name in "yd":
            x = np.empty(s.shape(k))
            for j in np.unique(own // s.side):
                at = np.flatnonzero(own // s.side == j)
                x[:, at] = s.get(f"{name}{version[j]}", j)[:, own[at] - j * s.side]
            s.put(name, k, x)

    P.each(sort)
    for k, v in enumerate(version):
        P.drop(f"y{v}", k)
        P.drop(f"d{v}", k)
    Q = Panels.new(P.spark, P.n, P.side, s.prefix("y"))
    t = Q.store()
    qr(Q)

    def sign(k: int) -> None:
        t.put("s", k, t.get("q", k) * np.where(np.diag(t.get("r", k)[t.at(k)]) < 0, -1.0, 1.0))

    Q.each(sign)
    for k in range(s.count):
        P.drop("y", k)
        for name in "vrq":
            Q.drop(name, k)
    return Q, norms[order], P


def scaled(A: Panels, factors: np.ndarray) -> Panels:
    """y: the panels of a, every column by its factor."""
    s = A.store()
    A.each(lambda k: s.put("y", k, s.get("a", k) * factors[s.at(k)]))
    return A
