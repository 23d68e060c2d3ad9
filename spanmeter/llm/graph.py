"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a grouped minimum and a join, so a node with very many edges is pre-aggregated and its
join side can be split. The number of steps grows with the logarithm of the longest path. Each step
is written to the shared folder, which cuts the lineage; only its count and a checksum are read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
        e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
            .where("a <> b").distinct())


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = e.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _counted(e: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a written table, and their number and checksum."""
    e = settle(e)
    return e, tuple(e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first())


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of `edges` (columns a, b: long), component its smallest node.

    Nulls and loops are ignored, direction and repetition do not matter; no edges give no rows.
    """
    e, mark = _counted(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                       .distinct())
    seen = None
    while mark != seen and mark[0]:
        seen = mark
        e, mark = _counted(_small_star(_large_star(e)))
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
