"""Square matrices whose graph falls apart, as dense blocks of its components.

An entry (i, j) ties i to j; what is not tied, directly or over others, never meets in a factor, a solve or a product. So a matrix whose components
have few rows (`most`) is factored block by block, a task for a bin of blocks, and takes the squares of its components instead of that of the whole.
Blocks lie in the folder that driver and executors share. Labels are forests of the tasks, merged on the driver: up to BROADCAST_ROWS rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.core import Matrix
from brindle.operators import panels
from brindle.operators.strips import LINES, Strips, _table, chunks, dealt, joined
from brindle.plans.lineage import BROADCAST_ROWS, shuffled_once

#: Attribute of a matrix's relation: its blocks, or False if it has too large a component.
ORIGIN = "_of_components"
#: Attribute of a view's relation: (the relation it shows, how).
VIEW = "_of_view"
#: Cells of a bin, unless one component has more; of a piece of a block that is turned into entries.
BIN, PIECE = 1 << 20, 1 << 18
#: Columns for each entry of a row from which its pairs are cheaper than a dense row.
SPARSE = 10


@dataclass(frozen=True)
class Layout:
    """What tasks know: where blocks lie, and which rows they have."""

    path: str
    order: np.ndarray  # the index of each slot: components one after another, indices rising in each
    starts: np.ndarray  # first slots of the components, and the end
    bins: np.ndarray  # first components of the bins, and the end

    @property
    def count(self) -> int:
        return len(self.bins) - 1

    def slots(self, b: int) -> list[tuple[int, int]]:
        return [(int(self.starts[c]), int(self.starts[c + 1])) for c in range(self.bins[b], self.bins[b + 1])]

    def bin_of(self) -> np.ndarray:
        """The bin of each index."""
        out = np.empty(len(self.order), np.int32)
        out[self.order] = np.repeat(np.arange(self.count), np.diff(self.starts[self.bins]))
        return out

    def place_of(self) -> np.ndarray:
        """The slot of each index."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.arange(len(self.order))
        return out

    def _store(self) -> panels.Store:
        return panels.Store(self.path, len(self.order), 0, "")

    def put(self, name: str, b: int, blocks: list[np.ndarray]) -> None:
        self._store().put(name, b, np.concatenate([x.ravel() for x in blocks]))

    def get(self, name: str, b: int) -> list[np.ndarray]:
        flat, at, out = self._store().get(name, b), 0, []
        for lo, hi in self.slots(b):
            out.append(flat[at : at + (hi - lo) ** 2].reshape(hi - lo, hi - lo))
            at += (hi - lo) ** 2
        return out


@dataclass(frozen=True)
class Blocks:
    """A product of stored matrices: (name, one of "", "t", "lower", "upper"), or ("", a factor for each slot). rows and cols name the slots."""

    spark: SparkSession
    layout: Layout
    factors: tuple
    rows: np.ndarray
    cols: np.ndarray
    marked: frozenset[int] = frozenset()  # bins whose entries are told by the matrix "met", since some may be zero

    @staticmethod
    def of(A: Matrix, most: int) -> Blocks | None:
        """A by components; None if one of them has more than `most` rows."""
        if (found := known(A.df)) is not None:
            return found or None
        n = A.square()
        if n > BROADCAST_ROWS:
            return None

        def ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _forest(((b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches), n)

        root = np.arange(n)
        _merge(root, A.df.select("i", "j").coalesce(4 * A.spark.sparkContext.defaultParallelism).mapInArrow(ties, "i long, j long"))
        layout = _layout(A.spark, root, most)
        if layout is None:
            setattr(A.df, ORIGIN, False)
            return None

        def build(b: int, group: pa.Table) -> None:
            place, blocks = layout.place_of(), [np.zeros((hi - lo, hi - lo)) for lo, hi in layout.slots(b)]
            if held := [data for data in group.column("data").to_pylist() if data]:
                i, j, v = joined(held)
                for k, at, lo in _by_component(layout, b, place[i]):
                    blocks[k][place[i[at]] - lo, place[j[at]] - lo] = v[at]
            layout.put("a", b, blocks)

        out = Blocks(A.spark, layout, (("a", ""),), layout.order, layout.order)
        own = layout.bin_of()

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n = [], 0
            for b in batches:
                held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
                n += b.num_rows
                if n >= LINES:
                    yield _dealt(own, *map(np.concatenate, zip(*held, strict=True)))
                    held, n = [], 0
            if held:
                yield _dealt(own, *map(np.concatenate, zip(*held, strict=True)))

        out._gathered(A.df.select("i", "j", F.col("v").cast("double").alias("v")).mapInArrow(deal, "s int, data binary"), build)
        setattr(A.df, ORIGIN, out)
        return out

    def _gathered(self, dealt_rows: DataFrame, build: Callable[[int, pa.Table], int | None]) -> dict[int, int]:
        """build on the rows (s, data) of each bin, of those without any too."""
        layout = self.layout
        none = self.spark.range(layout.count).select(F.col("id").cast("int").alias("s"), F.lit(b"").alias("data"))
        rows = dealt_rows.select("s", "data", *[c for c in dealt_rows.columns if c == "t"])
        rows = rows.unionByName(none, allowMissingColumns=True).repartition(min(layout.count, 4096), "s")

        def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
            b = key[0].as_py()
            return pa.table({"s": pa.array([b], pa.int32()), "n": pa.array([build(b, group) or 0], pa.int64())})

        with shuffled_once(self.spark):
            return {r["s"]: r["n"] for r in rows.groupBy("s").applyInArrow(run, "s int, n long").collect()}

    def block(self, b: int) -> list[np.ndarray]:
        """The blocks of a bin."""
        out: list[np.ndarray] = []
        for name, how in self.factors:
            if name:
                own = [{"": lambda x: x, "t": lambda x: x.T, "lower": np.tril, "upper": np.triu}[how](x) for x in self.layout.get(name, b)]
                out = [x @ y for x, y in zip(out, own, strict=True)] if out else own
            else:
                out = [x * how[lo:hi] for x, (lo, hi) in zip(out, self.layout.slots(b), strict=True)]
        return out

    def each(self, f: Callable[[Layout, int, list[np.ndarray]], object]) -> list:
        """f on each bin's number and blocks; what comes back is small."""
        layout, bare = self.layout, replace(self, spark=None)
        return self.spark.sparkContext.parallelize(range(layout.count), layout.count).map(lambda b: f(layout, b, bare.block(b))).collect()

    def factored(self, kernel: Callable[[np.ndarray], tuple[np.ndarray, ...]], *names: str) -> list[Blocks]:
        """The matrices that a kernel makes of each block."""
        names = _fresh(*names)

        def run(layout: Layout, b: int, blocks: list[np.ndarray]) -> None:
            for name, made in zip(names, zip(*[kernel(x) for x in blocks], strict=True), strict=True):
                layout.put(name, b, list(made))

        self.each(run)
        return [replace(self, factors=((name, ""),), marked=frozenset()) for name in names]

    def solved(self, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray], right: np.ndarray) -> np.ndarray:
        """kernel(block, its part of a right side) for each block, as one array."""

        def run(layout: Layout, b: int, blocks: list[np.ndarray]) -> np.ndarray:
            return np.concatenate([kernel(x, right[layout.order[lo:hi]]) for x, (lo, hi) in zip(blocks, layout.slots(b), strict=True)])

        out = np.empty(len(right))
        out[self.layout.order] = np.concatenate(self.each(run))
        return out

    def times(self, other: Blocks) -> Blocks | None:
        if self.layout is not other.layout or not np.array_equal(self.cols, other.rows):
            return None
        return replace(self, factors=self.factors + other.factors, cols=other.cols, marked=frozenset())

    def scaled(self, values: np.ndarray) -> Blocks:
        """Every column by its factor."""
        return replace(self, factors=(*self.factors, ("", values[self.cols])), marked=frozenset())

    def changed(self, how: str) -> Blocks | None:
        """The transpose, or the lower or upper triangle, where it is one stored matrix."""
        name, before = self.factors[0]
        if len(self.factors) > 1 or before not in ("", "t"):
            return None
        if how == "t":
            return replace(self, factors=((name, "" if before else "t"),), rows=self.cols, cols=self.rows, marked=frozenset())
        own = not before and all(np.array_equal(x, self.layout.order) for x in (self.rows, self.cols))
        return replace(self, factors=((name, how),), marked=frozenset()) if own else None

    def relation(self) -> DataFrame:
        """(i, j, v) without zeros, but for those of a marked bin."""
        bare = replace(self, spark=None)

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in batch.column(0).to_pylist():
                    met = bare.layout.get("met", b) if b in bare.marked else None
                    for k, (x, (lo, hi)) in enumerate(zip(bare.block(b), bare.layout.slots(b), strict=True)):
                        x, i, j = np.ascontiguousarray(x), bare.rows[lo:hi], bare.cols[lo:hi]
                        for r in range(0, hi - lo, max(1, PIECE // (hi - lo))):
                            own = slice(r, r + max(1, PIECE // (hi - lo)))
                            at = np.flatnonzero(x[own] if met is None else met[k][own])
                            if len(at):
                                yield pa.record_batch({"i": i[own][at // (hi - lo)], "j": j[at % (hi - lo)], "v": x[own].ravel()[at]})

        return self.spark.range(0, self.layout.count, 1, self.layout.count).mapInArrow(cells, "i long, j long, v double")

    def matrix(self) -> Matrix:
        """The relation, which knows its blocks."""
        df = self.relation()
        setattr(df, ORIGIN, self)
        return Matrix(df, len(self.rows), len(self.cols))


def known(df: DataFrame) -> Blocks | bool | None:
    """The blocks of a relation, or of what it is a view of, if they were looked for."""
    found, of = getattr(df, ORIGIN, None), getattr(df, VIEW, None)
    if found is None and of and (whole := known(of[0])):
        found = whole.changed(of[1])
        setattr(df, ORIGIN, found)
    return found


def _fresh(*names: str) -> tuple[str, ...]:
    """Names that no other matrix of the same components has."""
    return tuple(f"{name}-{uuid.uuid4().hex}" for name in names)


def _dealt(own: np.ndarray, i: np.ndarray, j: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return _table(list(dealt(own[j], i, j, v)))


def _by_component(layout: Layout, b: int, place: np.ndarray) -> Iterator[tuple[int, np.ndarray, int]]:
    """(number in the bin, its entries, its first slot) of entries at these slots."""
    order = np.argsort(place, kind="stable")
    slots = layout.slots(b)
    ends = np.searchsorted(place[order], [lo for lo, _ in slots] + [slots[-1][1]])
    for k, (lo, _) in enumerate(slots):
        if ends[k] < ends[k + 1]:
            yield k, order[ends[k] : ends[k + 1]], lo


def _tie(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Joins the trees of u and v; root[k] <= k leads to the smallest index of a tree at once."""
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        root[np.maximum(a, b)] = np.minimum(a, b)
        while not np.array_equal(up := root[root], root):
            root[:] = up


def _forest(pairs: Iterator[tuple[np.ndarray, np.ndarray]], n: int) -> Iterator[pa.RecordBatch]:
    root = np.arange(n)
    for u, v in pairs:
        _tie(root, u, v)
    at = np.flatnonzero(root != np.arange(n))
    yield pa.record_batch({"i": at, "j": root[at]})


def _merge(root: np.ndarray, forests: DataFrame) -> None:
    t = forests.toArrow()
    _tie(root, t.column("i").to_numpy(), t.column("j").to_numpy())


def _layout(spark: SparkSession, root: np.ndarray, most: int) -> Layout | None:
    order = np.argsort(root, kind="stable")
    starts = np.append(np.flatnonzero(np.diff(root[order], prepend=-1)), len(root))
    sizes = np.diff(starts)
    if sizes.max() > most:
        return None
    cells = np.cumsum(sizes**2)
    bins = np.append(np.flatnonzero(np.diff((cells - 1) // BIN, prepend=-1)), len(sizes))
    return Layout(panels.Panels.new(spark, len(root)).path, order, starts, bins)


def _gram_block(g: np.ndarray, i: np.ndarray, c: np.ndarray, v: np.ndarray) -> None:
    """Adds NᵀN of the entries (i, c, v), rows standing together: sparse rows by their pairs, those of one length at once; full ones by products."""
    w = len(g)
    at = np.flatnonzero(np.diff(i, prepend=i[0] - 1))
    length = np.diff(np.append(at, len(i)))
    for d in np.unique(length):
        rows, full = at[length == d], d * SPARSE >= w
        step = max(1, LINES // int(w if full else d * d))
        for k in range(0, len(rows), step):
            own = rows[k : k + step, None] + np.arange(d)
            if full:
                x = np.zeros((len(own), w))
                x[np.arange(len(own))[:, None], c[own]] = v[own]
                g += x.T @ x
            else:
                cells = c[own][:, :, None] * w + c[own][:, None, :]
                np.add.at(g.reshape(-1), cells.ravel(), (v[own][:, :, None] * v[own][:, None, :]).ravel())


def gram(matrices: list[Matrix], most: int, shift: float = 0.0) -> Matrix | None:
    """shift * I and NᵀN of every matrix N, summed, by components of the columns that share rows. Sums that are zero stay entries.

    None if a component has more than `most` columns, or all have no more.
    """
    spark, n = matrices[0].spark, matrices[0].ncols
    if not most < n <= BROADCAST_ROWS or any(A.kind != "real" for A in matrices):
        return None
    strips = [Strips.of(A) for A in matrices]

    def ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for held in chunks(batches, LINES):
                i, j, _ = joined(held)
                first = np.flatnonzero(np.diff(i, prepend=i[:1] - 1))
                yield np.repeat(j[first], np.diff(np.append(first, len(i)))), j

        yield from _forest(pairs(), n)

    root = np.arange(n)
    for S in strips:
        _merge(root, S.df.coalesce(4 * spark.sparkContext.defaultParallelism).mapInArrow(ties, "i long, j long"))
    layout = _layout(spark, root, most)
    if layout is None:
        return None
    own, terms, dealt_rows = layout.bin_of(), len(strips), None
    for t, S in enumerate(strips):

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for held in chunks(batches, LINES):
                yield _dealt(own, *joined(held))

        part = S.df.mapInArrow(deal, "s int, data binary").withColumn("t", F.lit(t))
        dealt_rows = part if dealt_rows is None else dealt_rows.unionByName(part)

    def build(b: int, group: pa.Table) -> int:
        place, slots = layout.place_of(), layout.slots(b)
        blocks, met, signed = [shift * np.eye(hi - lo) for lo, hi in slots], [np.eye(hi - lo) * bool(shift) for lo, hi in slots], False
        records = list(zip(group.column("t").to_pylist(), group.column("data").to_pylist(), strict=True))
        for t in range(terms):
            if not (held := [data for k, data in records if k == t and data]):
                continue
            i, j, v = joined(held)
            rising = np.argsort(i, kind="stable")
            i, j, v = i[rising], place[j[rising]], v[rising]
            signed = signed or not (v > 0).all()
            for k, at, lo in _by_component(layout, b, j):
                at = np.sort(at)
                _gram_block(blocks[k], i[at], j[at] - lo, v[at])
                if signed:
                    _gram_block(met[k], i[at], j[at] - lo, np.ones(len(at)))
        layout.put("a", b, blocks)
        if signed:
            layout.put("met", b, [x != 0 for x in met])
        return int(signed)

    out = Blocks(spark, layout, (("a", ""),), layout.order, layout.order)
    signed = out._gathered(dealt_rows, build)
    return replace(out, marked=frozenset(b for b, s in signed.items() if s)).matrix()


def product(A: Matrix, B: Matrix) -> Matrix | None:
    """A * B where both are blocks of the same components, or B is a diagonal."""
    a, b = known(A.df), known(B.df)
    factors = getattr(B.df, panels.DIAGONAL, None)
    if a and factors is not None:
        return a.scaled(factors).matrix()
    both = a.times(b) if a and b else None
    return both.matrix() if both else None


def hessenberg_kernel(a: np.ndarray, side: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """H and Q with a = Q H Qᵀ, by blocks of reflections I - v t vᵀ: a column is met by those of its block when it is its turn, the rest once a block is done."""
    from brindle.operators.factor import householder

    h, n = a.astype(float).copy(), len(a)
    q = np.eye(n)
    for k in range(0, max(0, n - 2), side):
        w = min(side, n - 2 - k)
        v, t, y = np.zeros((n, w)), np.zeros((w, w)), np.zeros((n, w))
        for j in range(w):
            c = k + j
            x = h[:, c] - y[:, :j] @ v[c, :j]
            x -= v[:, :j] @ (t[:j, :j].T @ (v[:, :j].T @ x))
            v[c + 1 :, j], b = householder(x[c + 1 :])
            if b == 0:
                v[:, j] = 0
                continue
            met = v[:, :j].T @ v[:, j]
            y[:, j] = b * (h[:, c + 1 :] @ v[c + 1 :, j] - y[:, :j] @ met)
            t[:j, j], t[j, j] = -b * (t[:j, :j] @ met), b
        h[:, k:] -= y @ v[k:].T
        h[:, k:] -= v @ (t.T @ (v.T @ h[:, k:]))
        q -= ((q @ v) @ t) @ v.T
    return np.triu(h, -1), q


def hessenberg(A: Blocks) -> tuple[Blocks, Blocks]:
    """(H, Q) with a = Q H Qᵀ: H and the columns of Q are numbered component by component, so H has nothing below its subdiagonal."""
    h, q = A.factored(hessenberg_kernel, "h", "q")
    at = np.arange(len(A.rows))
    return replace(h, rows=at, cols=at), replace(q, cols=at)


def svd(A: Blocks) -> tuple[Blocks, np.ndarray, Blocks]:
    """(S, values, D) with a = S diag(values) Dᵀ, values falling over all components."""
    left, right = _fresh("s", "d")

    def run(layout: Layout, b: int, blocks: list[np.ndarray]) -> np.ndarray:
        u, s, vt = zip(*[np.linalg.svd(x) for x in blocks], strict=True)
        layout.put(left, b, list(u))
        layout.put(right, b, [x.T for x in vt])
        return np.concatenate(s)

    values = np.concatenate(A.each(run))
    falling = np.argsort(-values, kind="stable")
    at = np.empty(len(values), np.int64)
    at[falling] = np.arange(len(values))
    return replace(A, factors=((left, ""),), cols=at), values[falling], replace(A, factors=((right, ""),), rows=A.cols, cols=at)
