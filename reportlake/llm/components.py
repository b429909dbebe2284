"""Connected components of an undirected graph, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportlake.llm.common import forget, mark, stored


def _least(e: DataFrame) -> DataFrame:
    return e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _stars(e: DataFrame) -> bool:
    """Whether every node has one lesser neighbour at the most, and none that has one is itself such a neighbour."""
    ends = e.select("u", F.lit(1).alias("leaf"), F.lit(0).alias("centre")).unionByName(e.select(F.col("v").alias("u"), F.lit(0).alias("leaf"), F.lit(1).alias("centre")))
    return ends.groupBy("u").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre")).where("leaf > 1 OR leaf = 1 AND centre = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) to (node, component): the smallest node reachable, for every node that has an edge and isn't its own component.

    Each round points all larger neighbours of a node, then all smaller ones, to the least of them. Least
    neighbours come from an aggregation combined on the map side, and a hub's edges are joined with its one
    row, which the skew join splits, so no task gathers a hub. Rounds are cut by tables in the shared folder, each
    of which goes once the next is written; their number grows with the logarithm of the graph. Ties and repeated edges don't matter; null ends are dropped.
    """
    spark, at = edges.sparkSession, mark()
    pick = lambda df: df.where("u <> v").distinct()
    now = stored(pick(edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))), "edges")
    # v < u in all of `now`, so stars have the least node of their component at the centre
    while not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = pick(large)
        ends = large.join(_least(large), "u")
        small = ends.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        now = stored(pick(small), "small")
        forget(spark, at)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
