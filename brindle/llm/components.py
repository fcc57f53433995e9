"""Connected components of an edge table by alternating star steps, all in joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import join_hot, written


def _pairs(df: DataFrame, u: str, v: str) -> DataFrame:
    return df.select(F.col(u).alias("u"), F.col(v).alias("v"))


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """Edges (u > v). Every node's neighbours (large: the greater ones; small: the lesser ones and itself) are tied to its least.

    A node may have most edges; `total` (of the edges) tells which do, see join_hot.
    """
    if large:
        both = edges.union(_pairs(edges, "v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("v"), F.count("*").alias("n")).select("u", F.least("u", "v").alias("m"), "n")
        tied = join_hot(both, least, "u", 2 * total).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        near = join_hot(edges, least, "u", total)
        tied = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v")))
    return tied.filter("u > v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, component (its least id) of every node that has an edge. Steps end when one changes nothing; each is written.

    Nulls and loops are left out; repeated edges count once; an empty table gives none.
    """
    edges = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges, before = written(edges, "edges"), None
    most = edges.count()  # steps never add an edge
    while True:
        for large in (True, False):  # each written: the plan of one inside the other's would be repeated for every use of its rows
            edges = written(_star(edges, large, most), "edges", most)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
