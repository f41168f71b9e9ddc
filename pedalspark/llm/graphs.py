"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import stored


def _is_stars(e: DataFrame) -> bool:
    """Whether every node of ``e`` (u > v) has one parent and no parent has one itself."""
    parents = e.groupBy("u").agg(F.count("*").alias("n"))
    chained = e.select(F.col("v").alias("u")).join(parents.select("u"), "u", "left_semi")
    return parents.filter("n > 1").select("u").unionByName(chained).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u long, v long): the component is its smallest node.

    Large-star and small-star steps in turn (Kiveris and others, 2014), each a minimum over neighbours and a join, until
    every component is a star about its smallest node. A hub's edges are only aggregated or joined, never gathered.
    """
    e = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _is_stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v")))
        e = stored(small.filter("u <> v").distinct(), "edges")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
