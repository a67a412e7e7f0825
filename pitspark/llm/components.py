"""Connected components of a set of links, by rounds of joins that hold in shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, component)`` for every id that occurs in ``links``; the component is the smallest reachable id.

    Alternating star rounds: every node first hangs its larger neighbours, then its smaller ones, below the
    smallest node it sees. A round halves the height of the trees, so rounds grow with the logarithm of the
    longest chain. A node with many links is pre-aggregated by the ``min`` and joined by AQE's skew join;
    no group is collected. Each round is written to the shared folder.
    """
    edges = links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo").distinct()
    edges = written(edges)
    while True:
        # large star: neighbours above a node go below the smallest of its neighbourhood
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        # small star: a node and its smaller neighbours go below the smallest of them
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (large.join(low, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo")
                 .union(low.select("hi", F.col("m").alias("lo"))).distinct())
        fresh = written(small)
        # done when every node has one parent and no parent has a parent
        parents = fresh.agg(F.count("*").alias("n"), F.countDistinct("hi").alias("d")).first()
        deep = fresh.select(F.col("lo").alias("hi")).distinct().join(fresh, "hi", "left_semi").limit(1).count()
        edges = fresh
        if parents["n"] == parents["d"] and not deep:
            break
    return edges.select(F.col("hi").alias("id"), F.col("lo").alias("component")).union(
        edges.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct())
