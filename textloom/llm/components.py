"""Connected components of a graph held as an edge table, by alternating star contractions.

Every round rewrites the edges so that they point at smaller ids and the paths
get shorter; the rounds grow with the logarithm of the graph.  Minima are
combined before they shuffle.  They are written and then joined, so that each
side of the join has an exchange of its own and the neighbours of a hub can be
split over many tasks.  No part of the graph is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import stored

ROUNDS = 60


def _star(edges: DataFrame, label: str) -> DataFrame:
    """Join every (u, v) to the smallest end next to u."""
    least = stored(edges.groupBy("u").agg(F.min("v").alias("m")), label)
    return edges.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node reachable.

    ``edges`` has two columns ``a`` and ``b`` of one ordered type.  Loops,
    repeated edges and either direction are fine; nulls are dropped.  No edges
    give an empty result.
    """
    pairs = edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).where("u > v").distinct()
    pairs = stored(pairs, "edges")
    known = None
    for _ in range(ROUNDS):
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, "large").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = stored(large.where("u > v").distinct(), "edges")
        near = _star(large, "small")
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v")))
        pairs = stored(small.where("u > v").distinct(), "edges")
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == known:
            break
        known = state
    else:
        raise RuntimeError("components did not settle")
    nodes = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return nodes.unionByName(roots)
