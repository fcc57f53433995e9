"""Dense matrices in blocks: (bi, bj, nr, nc, data ARRAY<DOUBLE>, row-major).

A product joins blocks on the inner block index, multiplies each pair with NumPy and sums blocks by their place: one
element-wise multiplication costs bytes by the square and work by the cube of the block's side, so the shuffle stays small.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.core import Matrix
from brindle.errors import IncompatibleSize
from brindle.functions.integer import interleave
from brindle.plans.lineage import DENSE

SIDE = 256
#: Block multiplications that a pair of entries in a join is worth.
EMPTY = 100
BLOCK = "bi int, bj int, nr int, nc int, data array<double>"


@dataclass(frozen=True)
class Blocked:
    df: DataFrame
    nrows: int
    ncols: int
    side: int = SIDE

    @staticmethod
    def of(A: Matrix, side: int = SIDE) -> Blocked:
        """Entries gathered by block; a block has at most side * side cells."""
        m, n = A.nrows, A.ncols
        cells = A.df.select(F.floor(F.col("i") / side).cast("int").alias("bi"), F.floor(F.col("j") / side).cast("int").alias("bj"), (F.col("i") % side).cast("int").alias("r"), (F.col("j") % side).cast("int").alias("c"), "v")

        def build(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
            bi, bj = key[0].as_py(), key[1].as_py()
            nr, nc = min(side, m - bi * side), min(side, n - bj * side)
            a = np.zeros((nr, nc))
            a[np.asarray(group.column("r")), np.asarray(group.column("c"))] = np.asarray(group.column("v"))
            return _rows([(bi, bj, a)])

        return Blocked(cells.groupBy("bi", "bj").applyInArrow(build, BLOCK), m, n, side)

    def entries(self, zeros: bool = False) -> Matrix:
        """Back to (i, j, v); zeros are left out unless asked for."""
        cells = self.df.select("bi", "bj", "nc", F.posexplode("data").alias("k", "v"))
        at = cells.select((F.col("bi").cast("long") * self.side + F.floor(F.col("k") / F.col("nc"))).alias("i"), (F.col("bj").cast("long") * self.side + F.col("k") % F.col("nc")).alias("j"), "v")
        return Matrix(at if zeros else at.filter("v <> 0"), self.nrows, self.ncols)

    def z_order(self, parts: int) -> Blocked:
        """Blocks dealt along the Z-order curve, so near blocks are in one task."""
        key = interleave(F.col("bi"), F.col("bj"))
        return Blocked(self.df.withColumn("z", key).repartitionByRange(parts, "z").drop("z"), self.nrows, self.ncols, self.side)

    def trans(self) -> Blocked:
        def flip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield from _rows([(bj, bi, a.T) for bi, bj, a in _blocks(b)]).to_batches()

        return Blocked(self.df.mapInArrow(flip, BLOCK), self.ncols, self.nrows, self.side)

    def matmul(self, other: Blocked) -> Blocked:
        if self.ncols != other.nrows or self.side != other.side:
            raise IncompatibleSize(f"{self.nrows}x{self.ncols} and {other.nrows}x{other.ncols} in blocks of {self.side} and {other.side}")
        left = self.df.select(*[F.col(c).alias(f"a_{c}") for c in ("bi", "bj", "nr", "nc", "data")])
        right = other.df.select(*[F.col(c).alias(f"b_{c}") for c in ("bi", "bj", "nr", "nc", "data")])
        pairs = left.join(right, F.col("a_bj") == F.col("b_bi"))

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Pairs of one task that fall on one block are summed before they are sent."""
            sums: dict[tuple[int, int], np.ndarray] = {}
            for b in batches:
                c = {n: b.column(n) for n in b.schema.names}
                for k in range(b.num_rows):
                    x, y = (c[f"{p}_data"][k].values.to_numpy().reshape(c[f"{p}_nr"][k].as_py(), c[f"{p}_nc"][k].as_py()) for p in "ab")
                    at = (c["a_bi"][k].as_py(), c["b_bj"][k].as_py())
                    sums[at] = sums[at] + x @ y if at in sums else x @ y
                    if len(sums) >= 256:
                        yield from _rows([(*at, a) for at, a in sums.items()]).to_batches()
                        sums = {}
            yield from _rows([(*at, a) for at, a in sums.items()]).to_batches()

        return Blocked(_summed(pairs.mapInArrow(multiply, BLOCK)), self.nrows, other.ncols, self.side)

    def add(self, other: Blocked) -> Blocked:
        return Blocked(_summed(self.df.unionByName(other.df)), self.nrows, self.ncols, self.side)


def _blocks(b: pa.RecordBatch) -> list[tuple[int, int, np.ndarray]]:
    return [(r["bi"], r["bj"], np.array(r["data"]).reshape(r["nr"], r["nc"])) for r in b.to_pylist()]


def _rows(blocks: list[tuple[int, int, np.ndarray]]) -> pa.Table:
    ints = [pa.array([f(x) for x in blocks], pa.int32()) for f in (lambda x: x[0], lambda x: x[1], lambda x: x[2].shape[0], lambda x: x[2].shape[1])]
    return pa.Table.from_arrays([*ints, pa.array([np.ascontiguousarray(x[2]).ravel() for x in blocks], pa.list_(pa.float64()))], names=["bi", "bj", "nr", "nc", "data"])


def _summed(df: DataFrame) -> DataFrame:
    """Blocks of one place added up."""

    def add(group: pa.Table) -> pa.Table:
        blocks = [x for b in group.to_batches() for x in _blocks(b)]
        return _rows([(blocks[0][0], blocks[0][1], np.sum([a for _, _, a in blocks], axis=0))])

    return df.groupBy("bi", "bj").applyInArrow(add, BLOCK)


def dense_matmul(A: Matrix, B: Matrix, side: int = SIDE) -> Matrix:
    """A * B by blocks, for operands that are mostly full; large square ones by panels, which send no block twice.

    Operands so empty that blocks would multiply EMPTY zeros or more for each pair of entries are multiplied as relations.
    """
    from brindle.operators import components, panels
    from brindle.operators.joins import spmm

    if (blocks := components.product(A, B)) is not None:
        return blocks
    large = A.nrows == A.ncols == B.ncols and A.nrows > DENSE
    factors = getattr(B.df, panels.DIAGONAL, None)
    if large and factors is not None:
        return panels.scaled(panels.Panels.of(A, panels.SIDE), factors).matrix("y")
    made = large and hasattr(A.df, panels.ORIGIN) and hasattr(B.df, panels.ORIGIN)
    if not made and A.df.count() * B.df.count() * EMPTY < A.nrows * A.ncols * B.nrows * B.ncols:
        product = spmm(A, B)
        return product.with_df(product.df.filter("v <> 0"))

    if large:
        a = panels.Panels.of(A, panels.SIDE)
        b = panels.Panels.of(B, panels.SIDE)
        return panels.product(a, b).matrix("y")
    return Blocked.of(A, side).matmul(Blocked.of(B, side)).entries()


def row_packed(A: Matrix) -> DataFrame:
    """(i, row ARRAY<DOUBLE>) of a matrix that has every entry."""
    return A.df.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda c: c["v"]).alias("row"))


def packed_dot(rows: DataFrame, x: list[float], row: str = "row") -> DataFrame:
    """rows with v, the product of their array and a short vector."""
    lit = F.array(*[F.lit(float(v)) for v in x])
    return rows.withColumn("v", F.aggregate(F.zip_with(row, lit, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda acc, p: acc + p))
