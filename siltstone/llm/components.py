"""Connected components over a table of links, by alternating stars.

Each round links the neighbours of every node to the least id in reach
(large star, then small star) until nothing changes. Edges stay a
distributed table, written to the shared folder after each round, so that a
lost executor costs a read, not the lineage. Both stars are aggregations and
joins on node ids: the minimum of a node's neighbours is a partial aggregate,
so a node with a third of all links is summed before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, written


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node in links (a, b), component the least node reachable."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(F.col("u") != F.col("v")).distinct())
    state = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of a node goes to the least of the node and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: the smaller neighbours of a node, and itself, go to the least of them
        large = large.where(F.col("u") != F.col("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        now = written(small.select("e.u", "e.v").where(F.col("u") != F.col("v")).distinct())
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        drop(edges)
        edges = now
        if (seen.n, seen.h) == state:
            break
        state = (seen.n, seen.h)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
