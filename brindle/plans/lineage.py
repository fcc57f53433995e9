"""Where a plan is cut, and how large an operand may be to be gathered or broadcast."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.errors import BrindleError, TooLarge

#: Rows of an operand that a step may broadcast or gather: 16 to 24 bytes each, so at most about 100 MB.
BROADCAST_ROWS = 4_000_000
#: Rows and columns of a dense matrix that a kernel may hold whole.
DENSE = 4096


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. A local session that names none gets a folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise BrindleError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="brindle-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a written table: later steps don't recompute them, and lost executors cost nothing."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/brindle/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffled_once(spark: SparkSession) -> Iterator[None]:
    """What is written or collected inside leaves no files of its shuffles; else they stay until the driver's JVM has collected its garbage twice."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def rows_at_most(df: DataFrame, most: int) -> bool:
    """Whether df has at most `most` rows; reads no more than one row beyond."""
    return df.limit(most + 1).count() <= most


def broadcast_if_small(df: DataFrame, size: int | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it surely has at most `most` rows; else as it is, for a shuffled join.

    `size`, where known, bounds the rows of a vector and saves counting them.
    """
    return F.broadcast(df) if size is not None and size <= most else df


def must_fit(rows: int, most: int, what: str) -> None:
    if rows > most:
        raise TooLarge(f"{what} has {rows} rows; this step holds {most} at most")


def numbered(df: DataFrame, *order: Column, name: str = "k") -> DataFrame:
    """df with its rank from 0 under a total order, as a column.

    The rows are sorted in ranges and written; the ranges are counted (a row each), and numbered each by itself from where it begins.
    """
    keys = [f"_o{k}" for k in range(len(order))]
    placed = cut(df.withColumns(dict(zip(keys, order, strict=True))).orderBy(*keys).withColumn("_range", F.spark_partition_id()))
    first, total = [], 0
    for r in placed.groupBy("_range").count().orderBy("_range").collect():
        first += [F.lit(r["_range"]), F.lit(total)]
        total += r["count"]
    if not first:
        return placed.withColumn(name, F.lit(0).cast("long")).drop("_range", *keys)
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*keys))
    return placed.withColumn(name, (F.create_map(*first)[F.col("_range")] + within - 1).cast("long")).drop("_range", *keys)
