"""Connected components: every node and the smallest node that it is linked with.

Stars in turn: a node hands its larger neighbours to the smallest one (large star), then its smaller neighbours (small
star), until nothing moves. A round is a minimum by node, combined before the shuffle, and an equi-join; rounds grow as
the logarithm of the longest chain, and a node with very many links is split by the join, never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch, written


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b), its smallest node as the component. Loops and links that come
    again in either direction count once; null ends are none."""
    scratch = Scratch(links.sparkSession)
    ends = links.where("a IS NOT NULL AND b IS NOT NULL").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges, before = scratch.put("edges", ends.distinct()), None
    while True:
        # Large star: both directions; each larger neighbour of u (and u) meets the smallest of u and its neighbours.
        both = edges.where("u <> v").unionByName(edges.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.put("large", large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).distinct())
        # Small star: the smaller neighbours of u, and u itself, meet the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        loops = edges.where("u = v")
        edges = scratch.put("edges", small.unionByName(least.select("u", F.col("m").alias("v"))).unionByName(loops).distinct())
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    # Stars now: a node that points nowhere but at itself is a centre.
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")))
    out = written(nodes.groupBy("node").agg(F.min("component").alias("component")))
    scratch.close()
    return out
