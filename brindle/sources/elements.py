"""Unassembled finite elements: (elem_id, idx ARRAY<BIGINT>, vals ARRAY<ARRAY<DOUBLE>>) and their neighbour relation.

The file has a count, a line that is passed over, and for each element a line of node numbers, as many lines of values, and
a blank line. Elements of a file are told apart by counting blank lines up to each line, in parts as the file is read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.core import Matrix, Vector
from brindle.errors import IoError
from brindle.plans.lineage import numbered
from brindle.sources.matrix_market import behind, first_lines


@dataclass(frozen=True)
class ElementStructure:
    df: DataFrame
    nodes: int

    def neighbours(self) -> DataFrame:
        """(src, dst): elements that share a node. Pairs meet by node; a node is in few elements."""
        at = self.df.select("elem_id", F.explode(F.array_distinct("idx")).alias("node"))
        a, b = at.withColumnRenamed("elem_id", "src"), at.withColumnRenamed("elem_id", "dst")
        return a.join(b, "node").filter("src <> dst").select("src", "dst").distinct()

    def cells(self) -> DataFrame:
        """(i, j, v) of every element, not yet summed."""
        rows = self.df.select("idx", F.posexplode("vals").alias("a", "row")).select(F.col("idx")[F.col("a")].alias("i"), "idx", F.posexplode("row").alias("b", "v"))
        return rows.select("i", F.col("idx")[F.col("b")].alias("j"), "v")

    def total_nnz(self) -> int:
        return self.df.agg(F.coalesce(F.sum(F.size("idx") * F.size("idx")), F.lit(0))).first()[0]

    def assemble(self, order: DataFrame | None = None) -> Matrix:
        """The sparse matrix; order (src, pos) renames nodes."""
        cells = self.cells()
        if order is not None:
            m = order.select(F.col("src").alias("s"), F.col("pos").alias("p"))
            cells = cells.join(m, F.col("i") == F.col("s")).select(F.col("p").alias("i"), "j", "v").join(m, F.col("j") == F.col("s")).select("i", F.col("p").alias("j"), "v")
        return Matrix(cells.groupBy("i", "j").agg(F.sum("v").alias("v")), self.nodes, self.nodes)

    def apply(self, x: Vector) -> Vector:
        """The product with a vector, element by element, without assembling."""
        pairs = self.cells().join(x.df.select(F.col("i").alias("k"), F.col("v").alias("x")), F.col("j") == F.col("k"))
        return x.with_df(pairs.groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("v")))


def read_elements(spark: SparkSession, path: str) -> ElementStructure:
    head = first_lines(spark, path, 2)
    if not head or not head[0]["value"].split() or not head[0]["value"].split()[0].isdigit():
        raise IoError(f"{path} has no element count")
    # Blank lines end an element, so its number is how many stand before it: counted by block of the file, then within each.
    lines = behind(spark, path, head[-1]["line"]).withColumn("block", F.struct("line.file", "line.start")).withColumn("blank", (F.col("value") == "").cast("long"))
    before, total = [], 0
    for r in lines.groupBy("block").agg(F.sum("blank").alias("n")).orderBy("block").collect():  # a row for each block
        before.append((r["block"]["file"], r["block"]["start"], total))
        total += r["n"]
    base = F.broadcast(spark.createDataFrame(before, "file string, start long, base long").select(F.struct("file", "start").alias("block"), "base"))
    running = F.sum("blank").over(Window.partitionBy("block").orderBy("line"))
    counted = lines.withColumn("running", running).join(base, "block").filter("blank = 0")
    parts = counted.select((F.col("base") + F.col("running")).alias("part"), "line", "value")
    groups = parts.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("line", "value"))).alias("ls"))  # the lines of one element
    numbers = lambda text, kind: F.transform(F.split(text, r"\s+"), lambda x: x.cast(kind))
    parsed = groups.select(F.col("part").alias("elem_id"), numbers(F.col("ls")[0]["value"], "long").alias("idx"), F.transform(F.slice("ls", 2, F.size("ls")), lambda s: numbers(s["value"], "double")).alias("vals"))
    df = numbered(parsed, F.col("elem_id")).select(F.col("k").alias("elem_id"), "idx", "vals")
    nodes = df.select(F.explode("idx").alias("k")).agg(F.coalesce(F.max("k") + 1, F.lit(0))).first()[0]
    return ElementStructure(df, nodes)


def write_elements(es: ElementStructure, path: str) -> None:
    """As a folder of text parts, one after another in the format that read_elements takes."""
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), " ")
    body = F.concat(F.array(text(F.col("idx"))), F.transform("vals", text), F.array(F.lit("")))
    lines = es.df.select("elem_id", F.posexplode(body).alias("k", "value"))
    spark = es.df.sparkSession
    head = spark.createDataFrame([(-1, 0, str(es.df.count())), (-1, 1, "elements")], "elem_id long, k int, value string")
    head.union(lines).orderBy("elem_id", "k").select("value").write.mode("overwrite").text(path)


def extract_elements(A: Matrix) -> ElementStructure:
    """Cuts a matrix into elements whose assembly is the matrix again: each node in turn takes its neighbours' entries not yet taken.

    Which entries are left depends on the nodes before, so the pattern is gathered; its size is checked first.
    """
    from brindle.operators.factor import gathered

    n, a = A.square(), gathered(A)
    left = a != 0
    elements = []
    for k in range(n):
        near = [k, *(j for j in range(n) if j != k and (left[k, j] or left[j, k]))]
        if not left[near][:, near].any():
            continue
        values = [[float(a[r, c]) if left[r, c] else 0.0 for c in near] for r in near]
        for r in near:
            left[r, near] = False
        elements.append((len(elements), near, values))
    return ElementStructure(A.spark.createDataFrame(elements, "elem_id long, idx array<long>, vals array<array<double>>"), n)
