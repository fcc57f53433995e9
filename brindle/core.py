"""Matrices and vectors as relations.

A matrix is a DataFrame (i BIGINT, j BIGINT, v) and its shape, a vector a DataFrame (i BIGINT, v) and its size; rows that are
absent are zero. v is DOUBLE, or STRUCT<re DOUBLE, im DOUBLE> for complex values. Shapes are checked at once, on metadata;
everything else is a lazy plan. Orientation is a property of products alone, never of storage.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.errors import ChangeStaticSize, IncompatibleShape, IncompatibleSize, IndexOutOfRange, MatrixNotSquare

COMPLEX = T.StructType([T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())])


def _value(kind: str) -> T.DataType:
    return COMPLEX if kind == "complex" else T.DoubleType()


@dataclass(frozen=True)
class Vector:
    """Entries (i, v); `row` tells a row vector from a column vector."""

    df: DataFrame
    size: int
    row: bool = False
    kind: str = "real"

    def with_df(self, df: DataFrame, **changes) -> Vector:
        return replace(self, df=df, **changes)

    def same_size(self, other: Vector) -> None:
        if self.size != other.size:
            raise IncompatibleSize(f"sizes {self.size} and {other.size}")
        if self.row != other.row:
            raise IncompatibleShape("a row vector and a column vector")

    @staticmethod
    def of(spark: SparkSession, values: Iterable, row: bool = False) -> Vector:
        values = list(values)
        kind = "complex" if any(isinstance(x, complex) for x in values) else "real"
        cell = (lambda x: (complex(x).real, complex(x).imag)) if kind == "complex" else float
        schema = T.StructType([T.StructField("i", T.LongType()), T.StructField("v", _value(kind))])
        return Vector(spark.createDataFrame([(k, cell(x)) for k, x in enumerate(values)], schema), len(values), row, kind)

    def local(self) -> list:
        """All values in order, absent ones as zero. For vectors that fit the driver."""
        out: list = [0j if self.kind == "complex" else 0.0] * self.size
        for r in self.df.collect():
            out[r["i"]] = complex(r["v"]["re"], r["v"]["im"]) if self.kind == "complex" else r["v"]
        return out


@dataclass(frozen=True)
class Matrix:
    """Entries (i, j, v) of a shape. `fixed` shapes can't be changed."""

    df: DataFrame
    nrows: int
    ncols: int
    kind: str = "real"
    fixed: bool = False

    def with_df(self, df: DataFrame, **changes) -> Matrix:
        return replace(self, df=df, **changes)

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    def same_shape(self, other: Matrix) -> None:
        if (self.nrows, self.ncols) != (other.nrows, other.ncols):
            raise IncompatibleSize(f"shapes {self.nrows}x{self.ncols} and {other.nrows}x{other.ncols}")

    def square(self) -> int:
        if self.nrows != self.ncols:
            raise MatrixNotSquare(f"{self.nrows}x{self.ncols}")
        return self.nrows

    def check(self, r: int, c: int) -> None:
        if not (0 <= r < self.nrows and 0 <= c < self.ncols):
            raise IndexOutOfRange(f"({r}, {c}) of {self.nrows}x{self.ncols}")

    def resized(self, nrows: int, ncols: int, keep: bool = True) -> Matrix:
        """Another shape; entries inside both stay, if asked for."""
        if self.fixed and (nrows, ncols) != (self.nrows, self.ncols):
            raise ChangeStaticSize(f"{self.nrows}x{self.ncols} is fixed")
        inside = (F.col("i") < nrows) & (F.col("j") < ncols) & F.lit(keep)
        df = self.df.filter(inside)
        if (lines := getattr(self.df, "_unsummed", None)) is not None:  # operators.strips.UNSUMMED
            df._unsummed = lines.filter(inside)
        return self.with_df(df, nrows=nrows, ncols=ncols)

    @staticmethod
    def of(spark: SparkSession, rows: Iterable[Iterable], zeros: bool = False) -> Matrix:
        """From nested lists; zeros are stored only if asked for."""
        rows = [list(r) for r in rows]
        if len({len(r) for r in rows}) > 1:
            raise IncompatibleSize("rows of different lengths")
        kind = "complex" if any(isinstance(x, complex) for r in rows for x in r) else "real"
        cell = (lambda x: (complex(x).real, complex(x).imag)) if kind == "complex" else float
        cells = [(i, j, cell(x)) for i, r in enumerate(rows) for j, x in enumerate(r) if zeros or x != 0]
        schema = T.StructType([T.StructField("i", T.LongType()), T.StructField("j", T.LongType()), T.StructField("v", _value(kind))])
        return Matrix(spark.createDataFrame(cells, schema), len(rows), len(rows[0]) if rows else 0, kind)

    def local(self) -> list[list]:
        """All rows, absent entries as zero. For matrices that fit the driver."""
        zero = 0j if self.kind == "complex" else 0.0
        out = [[zero] * self.ncols for _ in range(self.nrows)]
        for r in self.df.collect():
            out[r["i"]][r["j"]] = complex(r["v"]["re"], r["v"]["im"]) if self.kind == "complex" else r["v"]
        return out


@dataclass(frozen=True)
class MultiVector:
    """Column vectors side by side: entries (j, i, v) of vector j."""

    df: DataFrame
    size: int
    count: int
    kind: str = "real"

    def matrix(self) -> Matrix:
        return Matrix(self.df.select("i", "j", "v"), self.size, self.count, self.kind)

    def vector(self, j: int) -> Vector:
        if not 0 <= j < self.count:
            raise IndexOutOfRange(f"vector {j} of {self.count}")
        return Vector(self.df.filter(F.col("j") == j).select("i", "v"), self.size, False, self.kind)

    def vectors(self, start: int, end: int) -> MultiVector:
        inside = self.df.filter(F.col("j").between(start, end - 1))
        return MultiVector(inside.withColumn("j", F.col("j") - start), self.size, end - start, self.kind)
