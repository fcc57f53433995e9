"""What all operators of this subpackage share: the shared folder, written cuts, folds and column access."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    A local session (tests) that names none gets a folder of this machine; on a cluster that would be no shared one, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="brindle-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/brindle/{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str, most: int | None = None, per_task: int = 250_000) -> DataFrame:
    """The rows of df after a cut of the lineage: a Parquet table in the shared folder.

    Executors lost later cost nothing, since no shuffle file or cached block is needed any more. `most`, where it is known, bounds
    the rows: there are no more tasks and files than one for each `per_task` of them, so small tables don't come in many files.
    """
    if most is not None:
        df = df.coalesce(max(1, -(-most // per_task)))
    spark = df.sparkSession
    path = new_path(spark, name)
    long_rows(df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that the Parquet reader and Arrow hold at once, where a row is a whole document. Spark's own figures are for short rows.
ROWS_AT_ONCE = {"spark.sql.parquet.columnarReaderBatchSize": 512, "spark.sql.execution.arrow.maxRecordsPerBatch": 1000}


def long_rows(df: DataFrame) -> DataFrame:
    """df, with the session set to hold fewer of its rows at once; a lower setting stays."""
    for k, most in ROWS_AT_ONCE.items():
        if int(df.sparkSession.conf.get(k, None) or most + 1) > most:
            df.sparkSession.conf.set(k, str(most))
    return df


def id_text(col: Column | str = "doc_id") -> Column:
    """The id as text; a null id counts as the empty text."""
    return F.coalesce(F.col(col).cast("string") if isinstance(col, str) else col.cast("string"), F.lit(""))


def in_fold(folds: int, fold: int, col: Column | str = "doc_id") -> Column:
    """Whether crc32(id as text) mod folds is fold."""
    return (F.crc32(id_text(col)) % folds) == fold


def bounded_sample(df: DataFrame, rows: int, by: str) -> DataFrame:
    """At most `rows` rows: those with the least values of `by`, a 64-bit hash. The same rows in every run.

    A count fixes a hash limit that about one and a half times as many rows stay under, so that no task sends more than its share.
    """
    n = df.count()
    if n > 2 * rows:
        df = df.filter(F.col(by) <= int(-(1 << 63) + (1 << 64) * 1.5 * rows / n))
    return df.orderBy(by).limit(rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return long_rows(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def keyed(docs: DataFrame, id_col: str, text: str) -> tuple[DataFrame, bool]:
    """key (long, in the documents' order), text, row (all columns), and whether keys are unique: the id itself where it can be.

    text is a field of row: what needs both carries row alone.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.struct("*").alias("row"))
    own = F.col("row").getField(text).alias("text")
    integral = isinstance(docs.schema[id_col].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    if integral and not rows.groupBy("id").count().filter("id is null or count > 1").limit(1).collect():
        return rows.select(F.col("id").cast("long").alias("key"), own, "row"), True
    hashed = rows.withColumn("hash", F.xxhash64(own))
    order = hashed.select("id", "hash").distinct()
    keys = written(numbered(order, ["id", "hash"], "key"), "keys").select(F.col("id").alias("n_id"), F.col("hash").alias("n_hash"), "key")
    return hashed.join(keys, F.col("id").eqNullSafe(F.col("n_id")) & F.col("hash").eqNullSafe(F.col("n_hash"))).select("key", own, "row"), False


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with their places (from 0) in a total order: sorted in ranges, counted by range, numbered in each."""
    placed = written(rows.orderBy(*order).withColumn("range", F.spark_partition_id()), "ordered")
    counts = [(r["range"], r["count"]) for r in placed.groupBy("range").count().orderBy("range").collect()]  # a row for each range
    before = {k: sum(n for _, n in counts[:at]) for at, (k, _) in enumerate(counts)}
    if not before:
        return placed.withColumn(name, F.lit(0).cast("long")).drop("range")
    first = F.create_map(*[F.lit(x) for k, n in before.items() for x in (k, n)])
    within = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return placed.withColumn(name, (first[F.col("range")] + within - 1).cast("long")).drop("range")


#: A key with more than this part of all rows is hot; there are fewer than HOT such keys, whatever the table's size.
HOT = 1000


def join_hot(rows: DataFrame, unique: DataFrame, on: str, total: int) -> DataFrame:
    """rows joined with unique: a row for each key, with n, how many of the `total` rows have it (dropped).

    The hot keys, fewer than HOT by counting, are broadcast, so their rows stay where they lie; the others are joined by a shuffle in which no key
    has more than a HOT-th of the rows.
    """
    most = max(HOT, total // HOT)
    hot = F.broadcast(unique.filter(F.col("n") > most).drop("n"))
    cold = rows.join(hot.select(on), on, "left_anti").join(unique.filter(F.col("n") <= most).drop("n").hint("merge"), on)
    return rows.join(hot, on).unionByName(cold)
