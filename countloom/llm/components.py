"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countloom.llm.common import written


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (the smallest node reachable) for every node of ``links`` (a, b: long, no nulls).

    Each round points every node at the smallest of its neighbourhood and links neighbours to it, so long chains
    halve: a logarithmic number of rounds, each a grouping by node with partial aggregation, none holding a group.
    """
    edges = written(links.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    for _ in range(rounds):
        # Large star: every larger neighbour of a node is linked to the smallest node around.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # Small star: every smaller neighbour of a node, and the node, are linked to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = written(small, "links")
        # Done when every node has one link and no link's target has one.
        state = new.groupBy("u").agg(F.count("*").alias("n")).select(F.max("n")).first()[0]
        if state is None or state == 1 and new.alias("x").join(new.select(F.col("v").alias("t")).distinct(), F.col("x.u") == F.col("t"), "left_semi").isEmpty():
            break
        edges = new
    else:
        raise RuntimeError("links did not settle")
    return new.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(new.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
