"""Matrices as strips: whole rows, packed into narrow integers, in a written table. A strip is all rows i with one remainder.

Lines are packed before they are dealt, so a shuffle carries 6 to 8 bytes of an entry instead of 27, and equal places are summed where
they meet. A task holds a strip of about STRIP entries. Since a row lies whole in one record, NᵀN x is one pass over the strips of N,
and a product of matrices one pass for each range of its rows: pairs of entries are summed as they are made, and never sent.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.core import Matrix
from brindle.plans.lineage import cut, shared_dir, shuffled_once

#: Entries of a strip, on average; lines that are packed at once; entries of a record, unless a row has more.
STRIP, LINES, RECORD = 500_000, 1_000_000, 16_384
#: Attribute of a matrix's relation: its strips; the entries, not yet summed, that it is made of; the factors of a product; what it is the transpose of.
ORIGIN, UNSUMMED, FACTORS, MIRROR = "_of_strips", "_unsummed", "_of_product", "_of_mirror"
#: Cells that a task sums a product in, and columns of a product beyond which it is left to joins.
CELLS, COLUMNS = 1 << 23, 1 << 20


def _narrow(a: np.ndarray) -> np.ndarray:
    """The same numbers in as few bytes as hold them; -0.0 and what is not integral stay as they are."""
    if a.dtype.kind == "f":
        whole = a.astype(np.int64) if len(a) and np.abs(a).max() < 2**31 else None
        if whole is None or (whole != a).any() or np.signbit(a[a == 0]).any():
            return a
        a = whole
    low, high = (int(a.min()), int(a.max())) if len(a) else (0, 0)
    return a.astype(next(t for t in (np.uint8, np.int8, np.uint16, np.int16, np.uint32, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def pack(i: np.ndarray, j: np.ndarray, v: np.ndarray) -> bytes:
    """Entries, i in rising order."""
    first = int(i[0]) if len(i) else 0
    parts = [_narrow(np.diff(i, prepend=first)), _narrow(j), _narrow(v)]
    return struct.pack("<qq3s", len(i), first, b"".join(p.dtype.char.encode() for p in parts)) + b"".join(p.tobytes() for p in parts)


def unpack(data: bytes, wide: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, first, kinds = struct.unpack_from("<qq3s", data)
    out, at = [], struct.calcsize("<qq3s")
    for k in kinds.decode():
        out.append(np.frombuffer(data, k, n, at))
        at += out[-1].nbytes
    i = np.cumsum(out[0], dtype=np.int64) + first
    return (i, out[1].astype(np.int64), out[2].astype(float)) if wide else (i, out[1], out[2])


def joined(records: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    i, j, v = zip(*[unpack(r) for r in records], strict=True)
    return np.concatenate(i), np.concatenate(j), np.concatenate(v)


def summed(i: np.ndarray, j: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By i and j, equal places summed."""
    order = np.lexsort((j, i))
    i, j, v = i[order], j[order], v[order]
    new = np.ones(len(i), bool)
    new[1:] = (np.diff(i) != 0) | (np.diff(j) != 0)
    at = np.flatnonzero(new)
    return i[at], j[at], np.add.reduceat(v, at) if len(at) else v


def _runs(key: np.ndarray) -> list[tuple[int, int]]:
    """Where equal keys, which stand together, begin and end."""
    at = np.flatnonzero(np.diff(key, prepend=-1)).tolist()
    return list(zip(at, [*at[1:], len(key)], strict=True)) if at else []


def dealt(key: np.ndarray, i: np.ndarray, j: np.ndarray, v: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(key, packed entries of that key)."""
    order = np.lexsort((i, key))
    key, i, j, v = key[order], i[order], j[order], v[order]
    for a, b in _runs(key):
        yield int(key[a]), pack(i[a:b], j[a:b], v[a:b])


def _table(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.record_batch({"s": pa.array([k for k, _ in rows], pa.int32()), "data": pa.array([d for _, d in rows], pa.binary())})


def chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[bytes]]:
    """The records of a task, so many at once that they hold about `most` entries."""
    held, n = [], 0
    for b in batches:
        for data in b.column("data").to_pylist():
            held.append(data)
            n += struct.unpack_from("<q", data)[0]
            if n >= most:
                yield held
                held, n = [], 0
    if held:
        yield held


def _packed(batches: Iterator[pa.RecordBatch], strips: int) -> Iterator[pa.RecordBatch]:
    """Lines (i, j, v) packed by strip."""
    held: list[pa.RecordBatch] = []

    def out() -> pa.RecordBatch:
        i, j, v = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in "ijv")
        held.clear()
        return _table(list(dealt(i % strips, i, j, v)))

    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= LINES:
            yield out()
    if held:
        yield out()


@dataclass(frozen=True)
class Strips:
    """The written table (s, data) of a matrix."""

    df: DataFrame
    nrows: int
    ncols: int
    count: int

    @staticmethod
    def of(A: Matrix, strip: int = STRIP) -> Strips:
        """A in strips; made once for each relation."""
        found = getattr(A.df, ORIGIN, None)
        if found is not None:
            return found
        lines = getattr(A.df, UNSUMMED, A.df)
        with shuffled_once(A.spark):
            count = max(1, -(-lines.count() // strip))
        tasks = min(count, 4096)

        def merge(group: pa.Table) -> pa.Table:
            i, j, v = summed(*joined(group.column("data").to_pylist()))
            rows, a = [], 0
            while a < len(i):
                b = int(np.searchsorted(i, i[min(a + RECORD, len(i)) - 1], "right"))
                rows.append((group.column("s")[0].as_py(), pack(i[a:b], j[a:b], v[a:b])))
                a = b
            return pa.Table.from_batches([_table(rows)])

        packed = lines.select("i", "j", "v").filter("i IS NOT NULL AND j IS NOT NULL").mapInArrow(lambda batches: _packed(batches, count), "s int, data binary")
        with shuffled_once(A.spark):
            out = Strips(cut(packed.repartition(tasks, "s").groupBy("s").applyInArrow(merge, "s int, data binary")), A.nrows, A.ncols, count)
        setattr(A.df, ORIGIN, out)
        return out

    def matrix(self) -> Matrix:
        """The entries again, as a relation that knows its strips."""

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for held in chunks(batches, LINES // 4):
                yield pa.record_batch(list(joined(held)), names=["i", "j", "v"])

        df = self.df.mapInArrow(cells, "i long, j long, v double")
        setattr(df, ORIGIN, self)
        return Matrix(df, self.nrows, self.ncols)

    def gram(self, x: np.ndarray, factors: np.ndarray | None = None) -> DataFrame:
        """(i, v) of C NᵀN C x, C = diag(factors): what each task adds to an i, not yet summed over tasks."""
        return self._gram(self.df.sparkSession.sparkContext.broadcast((x if factors is None else x * factors, factors)))

    def _gram(self, shared: Broadcast) -> DataFrame:
        n = self.ncols

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x, c = shared.value
            z, met = np.zeros(n), np.zeros(n, bool)
            for held in chunks(batches, LINES):
                i, j, v = joined(held)
                row = np.cumsum(np.diff(i, prepend=i[:1]) != 0)  # a row is in one record
                y = np.bincount(row, v * x[j])
                z += np.bincount(j, v * y[row], n)
                met[j] = True
            at = np.flatnonzero(met)
            yield pa.record_batch({"i": at, "v": z[at] if c is None else z[at] * c[at]})

        return self.df.mapInArrow(add, "i long, v double")

    def gram_sum(self, x: np.ndarray, factors: np.ndarray | None = None) -> np.ndarray:
        """C NᵀN C x as an array."""
        shared = self.df.sparkSession.sparkContext.broadcast((x if factors is None else x * factors, None))
        out = self._added(self._gram(shared))
        shared.destroy()
        return out if factors is None else out * factors

    def squares(self) -> np.ndarray:
        """The diagonal of NᵀN as an array, in one pass."""
        n = self.ncols

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            z = np.zeros(n)
            for held in chunks(batches, LINES):
                _, j, v = joined(held)
                z += np.bincount(j, v * v, n)
            at = np.flatnonzero(z)
            yield pa.record_batch({"i": at, "v": z[at]})

        return self._added(self.df.mapInArrow(add, "i long, v double"))

    def _added(self, sums: DataFrame) -> np.ndarray:
        """The sums (i, v) of tasks as an array. Nothing of it stays on disk; they are added here, or first by column where they may be more than CELLS numbers."""
        if self.ncols * min(self.count, 4096) > CELLS:
            sums = sums.groupBy("i").agg(F.sum("v").alias("v"))

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield _table([(0, b.column(0).to_numpy().tobytes() + b.column(1).to_numpy().tobytes())])

        out = np.zeros(self.ncols)
        with shuffled_once(self.df.sparkSession):
            sent = sums.mapInArrow(packed, "s int, data binary").select("data").collect()
        for (data,) in sent:
            half = len(data) // 16
            np.add.at(out, np.frombuffer(data, np.int64, half), np.frombuffer(data, np.float64, half, 8 * half))
        return out

    def by_columns(self, side: int) -> DataFrame:
        """(s, data): entries by their range of `side` columns, packed as (i, j, v); a range is met by empty data too."""

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for held in chunks(batches, LINES):
                i, j, v = joined(held)
                yield _table(list(dealt(j // side, i, j, v)))

        ranges = -(-self.ncols // side)
        none = self.df.sparkSession.range(ranges).select(F.col("id").cast("int").alias("s"), F.lit(pack(*[np.zeros(0, np.int64)] * 2, np.zeros(0))).alias("data"))
        return self.df.mapInArrow(deal, "s int, data binary").unionByName(none)

    def gram_blocks(self, side: int, factors: np.ndarray | None = None) -> DataFrame:
        """(i, j, v) of C NᵀN C inside its diagonal blocks of `side` rows, with the whole diagonal; a task makes a block."""
        shared, n = self.df.sparkSession.sparkContext.broadcast(factors), self.ncols

        def block(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
            low = key[0].as_py() * side
            width = min(side, n - low)
            i, j, v = summed(*joined(group.column("data").to_pylist()))
            if shared.value is not None:
                v = v * shared.value[j]
            row = np.cumsum(np.diff(i, prepend=i[:1]) != 0)
            g, met = np.zeros((width, width)), np.eye(width)
            for r in range(0, int(row[-1]) + 1 if len(row) else 0, 4096):
                own = slice(*np.searchsorted(row, [r, r + 4096]))
                x, here = np.zeros((4096, width)), np.zeros((4096, width))
                x[row[own] - r, j[own] - low], here[row[own] - r, j[own] - low] = v[own], 1.0
                g, met = g + x.T @ x, met + here.T @ here
            a, b = np.nonzero(met)
            return pa.table({"i": a + low, "j": b + low, "v": g[a, b]})

        return self.by_columns(side).groupBy("s").applyInArrow(block, "i long, j long, v double")

    def files(self) -> tuple[str, frozenset[int]]:
        """A file for each strip in the shared folder, its entries in order, and the strips that have one."""
        found = getattr(self.df, "_files", None)
        if found is not None:
            return found
        at = f"{shared_dir(self.df.sparkSession)}/brindle/strips-{uuid.uuid4().hex}"
        at = at if ":" in at else f"file://{at}"

        def write(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
            i, j, v = joined(group.column("data").to_pylist())
            order = np.argsort(i, kind="stable")
            folder, path = fs.FileSystem.from_uri(at)
            folder.create_dir(path, recursive=True)
            own = f"{path}/{uuid.uuid4().hex}"
            with folder.open_output_stream(own, compression=None) as f:
                f.write(pack(i[order], j[order], v[order]))
            folder.move(own, f"{path}/{key[0].as_py()}")
            return pa.table({"s": pa.array([key[0].as_py()], pa.int32())})

        found = at, frozenset(r["s"] for r in self.df.groupBy("s").applyInArrow(write, "s int").collect())
        setattr(self.df, "_files", found)
        return found


@dataclass(frozen=True)
class _Right:
    """What tasks know of a right operand: where its strips lie."""

    path: str
    present: frozenset[int]
    count: int

    def into(self, cells: np.ndarray, met: np.ndarray, width: int, out: np.ndarray, inner: np.ndarray, v: np.ndarray) -> None:
        """Adds to the cells (out, j) every v times an entry (inner, j) of the operand, and marks them."""
        folder, path = fs.FileSystem.from_uri(self.path)
        strip = inner % self.count
        order = np.lexsort((inner, strip))
        strip, out, inner, v = strip[order], out[order], inner[order], v[order]
        for a, b in _runs(strip):
            if int(strip[a]) not in self.present:
                continue
            with folder.open_input_file(f"{path}/{int(strip[a])}") as f:
                i, j, w = unpack(f.read(), False)
            low = np.searchsorted(i, inner[a:b], "left")
            many = np.searchsorted(i, inner[a:b], "right") - low
            ends = np.cumsum(many)
            c = 0
            while c < b - a:  # some million pairs at once, or those of one entry
                before = int(ends[c - 1]) if c else 0
                d = max(c + 1, int(np.searchsorted(ends, before + LINES, "right")))
                k = np.repeat(np.arange(c, d), many[c:d])
                entry = np.arange(len(k)) - np.repeat(ends[c:d] - many[c:d] - before - low[c:d], many[c:d])
                cell = out[a + k] * width + j[entry]
                np.add.at(cells, cell, v[a + k] * w[entry])
                met[cell] = True
                c = d


def _mirrored(A: Matrix) -> tuple[Strips, bool]:
    """Strips of A, or of what A is the transpose of."""
    of = getattr(A.df, MIRROR, None)
    return (Strips.of(A), False) if of is None else (Strips.of(of), True)


def fits(*matrices: Matrix) -> bool:
    """Whether products of these may be summed in cells: real, and with no column beyond COLUMNS that has an entry."""
    return all(A.kind == "real" for A in matrices) and all((getattr(A.df, UNSUMMED, A.df).agg(F.max("j")).first()[0] or 0) < COLUMNS for A in matrices)


def products(terms: list[tuple[Matrix, list[Matrix]]]) -> Matrix:
    """The sum of products A * B * ..., each given as (A, [B, ...]): a task makes a range of rows, from the rows of A that it is dealt and the strips of the others."""
    first, last = terms[0][0], terms[0][1][-1]
    width = 1 + max((getattr(B.df, UNSUMMED, B.df).agg(F.max("j")).first()[0] or 0) for B in {id(B.df): B for _, chain in terms for B in chain}.values())
    rows = max(1, min(CELLS // width, -(-first.nrows // (4 * first.spark.sparkContext.defaultParallelism))))
    tasks = min(4096, -(-first.nrows // rows))
    chains, flips, dealt_rows = [], [], None
    for t, (A, chain) in enumerate(terms):
        left, flipped = _mirrored(A)

        def deal(batches: Iterator[pa.RecordBatch], flipped=flipped) -> Iterator[pa.RecordBatch]:
            for held in chunks(batches, LINES):
                i, j, v = joined(held)
                yield _table(list(dealt((j if flipped else i) // rows, i, j, v)))

        part = left.df.mapInArrow(deal, "s int, data binary").withColumn("t", F.lit(t))
        dealt_rows = part if dealt_rows is None else dealt_rows.unionByName(part)
        chains.append([_Right(*(s := Strips.of(B)).files(), s.count) for B in chain])
        flips.append(flipped)

    def cells_of(s: int, held: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        total, met = np.zeros(rows * width), np.zeros(rows * width, bool)
        for t, chain in enumerate(chains):
            records = [data for k, data in held if k == t]
            if not records:
                continue
            i, j, v = joined(records)
            out, inner = (j, i) if flips[t] else (i, j)
            out = out - s * rows
            for right in chain[:-1]:
                part, seen = np.zeros(rows * width), np.zeros(rows * width, bool)
                right.into(part, seen, width, out, inner, v)
                at = np.flatnonzero(seen)
                out, inner, v = at // width, at % width, part[at]
            chain[-1].into(total, met, width, out, inner, v)
        for a in range(0, len(met), LINES // 4):
            at = a + np.flatnonzero(met[a : a + LINES // 4])
            yield pa.record_batch({"i": at // width + s * rows, "j": at % width, "v": total[at]})

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, held = None, []
        for b in batches:
            for k, t, data in zip(b.column("s").to_pylist(), b.column("t").to_pylist(), b.column("data").to_pylist(), strict=True):
                if k != s and held:
                    yield from cells_of(s, held)
                    held = []
                s = k
                held.append((t, data))
        if held:
            yield from cells_of(s, held)

    df = dealt_rows.select("s", "t", "data").repartition(tasks, "s").sortWithinPartitions("s").mapInArrow(multiply, "i long, j long, v double")
    return Matrix(df, first.nrows, last.ncols)
