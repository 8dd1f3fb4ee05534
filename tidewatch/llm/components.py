"""Connected components of large graphs by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "low").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the least node around it."""
    both = edges.select(F.col("node").alias("x"), F.col("low").alias("y")).unionByName(edges.select(F.col("low").alias("x"), F.col("node").alias("y")))
    least = both.groupBy("x").agg(F.min("y").alias("m")).where("m < x")  # others keep their edges
    moved = both.where("y > x").join(written(least, "star-least"), "x", "left")
    return moved.select(F.col("y").alias("node"), F.coalesce("m", "x").alias("low")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of them."""
    least = written(edges.groupBy("node").agg(F.min("low").alias("m"), F.count(F.lit(1)).alias("n")), "star-least")
    several = least.where("n > 1").select("node", "m")
    moved = edges.join(several, "node").where("low <> m").select(F.col("low").alias("node"), F.col("m").alias("low"))
    return moved.unionByName(least.select("node", F.col("m").alias("low"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of `edges` (a, b), the component named by its least node.

    Rounds of large and small stars, each written to the shared folder, until nothing changes; their number grows with
    the logarithm of the graph's diameter. Loops and repeated edges are ignored.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("low")).distinct(), "star-edges")
    seen = _checksum(now)
    while seen[0]:
        now = written(_small_star(_large_star(now)), "star-edges")
        if (after := _checksum(now)) == seen:
            break
        seen = after
    roots = now.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
    return written(now.select("node", F.col("low").alias("component")).unionByName(roots), "components")
