"""Connected components by alternating large-star and small-star steps; edges stay in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Tasks among which the edges of one node are dealt, so that the centre of a large star is no task's alone.
SALTS = 8


def _beside(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges (u, v) with m of their u in least (u, m)."""
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    return salted.join(least.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["u", "salt"]).drop("salt")


def _larger(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours go to the least of its neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _beside(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _smaller(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go to the least of them. Edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = _beside(edges, least).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, least): for each node of an edge (u, v, longs) the least node it reaches, itself included."""
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "edges")
    mark = None
    while True:
        row = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if row == mark:
            break
        mark = row
        if not row[0]:
            break
        now = written(_smaller(_larger(now)), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("least")).union(now.select(F.col("v").alias("node"), F.col("v").alias("least"))).distinct()
