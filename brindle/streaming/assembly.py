"""Matrices assembled from streams: insertion with a commutative updater is an incremental aggregation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.core import Matrix
from brindle.operators.joins import UPDATERS
from brindle.plans.lineage import shared_dir


def assembling(stream: DataFrame, updater: str = "plus", watermark: tuple[str, str] | None = None, window: str | None = None) -> DataFrame:
    """(i, j, v), a streaming aggregate of entries (i, j, v[, ts]); with a window also (start, end) of event time.

    With a watermark, (column, delay), state of closed windows is dropped and later entries are ignored.
    """
    if updater == "store":
        raise ValueError("`store` depends on order, so it has no incremental form")
    keys = [F.col("i"), F.col("j")]
    if watermark:
        stream = stream.withWatermark(*watermark)
    if window and watermark:
        keys.insert(0, F.window(watermark[0], window).alias("w"))
    out = stream.groupBy(*keys).agg(UPDATERS[updater]().alias("v"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "i", "j", "v") if window and watermark else out


def run_to_end(spark: SparkSession, stream: DataFrame, mode: str = "complete") -> DataFrame:
    """All that a stream holds now, through a checkpointed query: every batch replaces the table's rows in the shared folder.

    A batch that is run again after a failure writes the same path again, so its result counts once.
    """
    base = f"{shared_dir(spark)}/brindle/{uuid.uuid4().hex}"
    last: dict[str, str] = {}

    def keep(batch: DataFrame, number: int) -> None:
        path = f"{base}/rows/{number}"
        batch.write.mode("overwrite").parquet(path)
        last["path"] = path

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    if not last:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(last["path"])


def assemble_stream(spark: SparkSession, stream: DataFrame, nrows: int, ncols: int, updater: str = "plus") -> Matrix:
    """The matrix of a stream's entries so far."""
    return Matrix(run_to_end(spark, assembling(stream, updater)), nrows, ncols)
