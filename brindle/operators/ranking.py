"""Sorting, ranking and running computations.

A global position needs an order over all rows. It comes from a range-partitioned sort whose partitions are counted, never from
a window over everything: rows stay spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.core import Matrix, Vector
from brindle.errors import IndexOutOfRange, RangeError
from brindle.plans.lineage import numbered


def sort(x: Vector) -> Vector:
    """Entries in ascending order of value."""
    return x.with_df(numbered(x.df, F.col("v"), F.col("i")).select(F.col("k").alias("i"), "v"))


def sort_with_permutation(x: Vector, companion: Vector | None = None) -> DataFrame:
    """(i, v[, w], p): the sorted entries, a companion's entry carried along, and where each stood before."""
    if companion is None:
        return numbered(x.df, F.col("v"), F.col("i")).select(F.col("k").alias("i"), "v", F.col("i").alias("p"))
    x.same_size(companion)
    both = x.df.join(companion.df.select("i", F.col("v").alias("w")), "i")
    return numbered(both, F.col("v"), F.col("i")).select(F.col("k").alias("i"), "v", "w", F.col("i").alias("p"))


def sort_xy(x: Vector, y: Vector) -> DataFrame:
    """(i, v, w, p): pairs in lexicographic order, and where each stood before."""
    x.same_size(y)
    both = x.df.join(y.df.select("i", F.col("v").alias("w")), "i")
    return numbered(both, F.col("v"), F.col("w"), F.col("i")).select(F.col("k").alias("i"), "v", "w", F.col("i").alias("p"))


def sort_zipped(first: Vector, *others: Vector, descending: bool = False) -> DataFrame:
    """(i, v, w0, w1, ..., p): several vectors sorted together by the first one's entries, ties by place, and where each row stood before."""
    rows = first.df.select("i", "v")
    for k, x in enumerate(others):
        first.same_size(x)
        rows = rows.join(x.df.select("i", F.col("v").alias(f"w{k}")), "i")
    ranked = numbered(rows, -F.col("v") if descending else F.col("v"), F.col("i"))
    return ranked.select(F.col("k").alias("i"), "v", *[f"w{k}" for k in range(len(others))], F.col("i").alias("p"))


def sort_entries(A: Matrix, by_column: bool = False) -> DataFrame:
    """All entries by rows, or by columns."""
    return A.df.orderBy(*(("j", "i") if by_column else ("i", "j")))


def sort_on_data(x: Vector) -> DataFrame:
    """Entries by falling magnitude."""
    return x.df.orderBy(F.desc(F.abs("v")), "i")


def sort_on_indices(x: Vector) -> DataFrame:
    return x.df.orderBy("i")


def largest(x: Vector, j: int) -> float:
    """The entry of the j-th largest magnitude, from 0."""
    top = sort_on_data(x).limit(j + 1).collect()
    if len(top) <= j:
        raise IndexOutOfRange(f"{j} of {len(top)} entries")
    return top[j]["v"]


def heap_top(x: Vector, j: int, smallest: bool = False) -> DataFrame:
    """(i, v, p): the j largest (or smallest) entries, the first one first, ties by place; each task keeps j of its rows, as a heap does."""
    order = F.col("v") if smallest else F.desc("v")
    top = x.df.orderBy(order, "i").limit(j)
    return top.select((F.row_number().over(Window.orderBy(order, "i")) - 1).cast("long").alias("i"), "v", F.col("i").alias("p"))


def top_per_row(A: Matrix, p: int) -> Matrix:
    """The p entries of largest magnitude of every row, ties by column.

    Rows are cut to p in two steps, parts of a row first, so a row with a large share of all entries is no single task's.
    """
    order = (F.desc(F.abs("v")), F.col("j"))
    part = F.pmod(F.xxhash64("i", "j"), F.lit(64))
    first = A.df.withColumn("part", part).withColumn("k", F.row_number().over(Window.partitionBy("i", "part").orderBy(*order))).filter(F.col("k") <= p)
    last = first.withColumn("k", F.row_number().over(Window.partitionBy("i").orderBy(*order))).filter(F.col("k") <= p)
    return A.with_df(last.select("i", "j", "v"))


def threshold_per_row(A: Matrix, tau: float) -> Matrix:
    """Entries of at least tau times their row's two-norm in magnitude."""
    norms = A.df.groupBy(F.col("i").alias("r")).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("n"))
    return A.with_df(A.df.join(norms, F.col("i") == F.col("r")).filter(F.abs("v") >= tau * F.col("n")).select("i", "j", "v"))


def window_sums(x: Vector, length: int, stride: int = 1, value: Column | None = None) -> Vector:
    """Sums over [k, k + length) for every stride-th k whose window fits; k is the new index.

    A window is the sum of the entries it covers, so each entry is sent to its windows and summed: one aggregation, no order.
    """
    if length < 1 or stride < 1:
        raise RangeError("a window needs a positive length and stride")
    v = F.col("v") if value is None else value
    count = max(0, (x.size - length) // stride + 1)
    lo = F.greatest(F.lit(0), F.ceil((F.col("i") - length + 1) / stride))
    hi = F.least(F.lit(count - 1), F.floor(F.col("i") / stride))
    sent = x.df.withColumn("k", F.explode(F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))))
    return Vector(sent.groupBy(F.col("k").alias("i")).agg(F.sum(v).alias("v")), count)


def semblance(traces: Matrix, length: int, stride: int = 1) -> Vector:
    """Of traces in rows: energy of their sum over the sum of their energies, in windows along the columns (0 where there is no energy)."""
    stacked = Vector(traces.df.groupBy(F.col("j").alias("i")).agg(F.sum("v").alias("v")), traces.ncols)
    energy = Vector(traces.df.groupBy(F.col("j").alias("i")).agg(F.sum(F.col("v") * F.col("v")).alias("v")), traces.ncols)
    top = window_sums(stacked, length, stride, F.col("v") * F.col("v"))
    low = window_sums(energy, length, stride)
    both = top.df.join(low.df.select("i", F.col("v").alias("w")), "i")
    return top.with_df(both.select("i", F.when(F.col("w") == 0, F.lit(0.0)).otherwise(F.col("v") / (traces.nrows * F.col("w"))).alias("v")))
