"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node that it reaches) of every node of ``edges`` (a, b).

    Large-star and small-star steps alternate until no edge changes.  Each step takes a
    minimum per node, with partial sums before the shuffle, and joins it back, so a hub is
    never gathered in one place; steps go through durable tables.  Edges and labels
    stay distributed: the driver sees a count and a checksum.
    """
    own = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    own = durable(own, "cc-edges")
    mark = None
    while True:
        both = own.unionByName(own.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        own = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = own.groupBy("u").agg(F.min("v").alias("m"))
        small = own.join(least, "u")
        own = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        own = durable(own, "cc-edges")
        now = own.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    leaves = own.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(own.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
