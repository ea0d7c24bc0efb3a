"""Connected components of links by alternating large and small stars (Kiveris et al., Connected Components in MapReduce and Beyond)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import kept


def _pairs(df: DataFrame) -> DataFrame:
    return df.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours go to the least of itself and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return _pairs(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _pairs(moved.unionByName(least.select("u", F.col("m").alias("v"))))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (the least node reachable) for each node that has a link; links may repeat, in either direction, and links of a node to itself or to null count for nothing.

    Only a count and a checksum of the links ever reach the driver; every round ends in the shared folder.
    """
    edges = kept(_pairs(links.select(F.col(a).alias("u"), F.col(b).alias("v")).dropna()))
    state = None
    while True:
        sums = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == (sums["n"], sums["s"]) or not sums["n"]:
            break
        state = (sums["n"], sums["s"])
        edges = kept(_small_star(_large_star(edges)))
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
