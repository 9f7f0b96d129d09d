"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is a join and a map-side combined minimum; links stay distributed and each round is cut to a table in the
shared folder. A node with very many links is one hot join key, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) of every node in links(a, b): the smallest id that it reaches. Loops and repeats do no harm."""
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    for _ in range(rounds):
        # large-star: every larger neighbour of a node is tied to the least of its neighbourhood
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = cut(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
        # small-star: every smaller neighbour, and the node itself, is tied to the least
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        small = cut(small, "small")
        # done when every node hangs on one root, and no root hangs on anything
        roots = small.select(F.col("v").alias("u"), F.lit(2).alias("n")).distinct()
        done = small.select("u", F.lit(2).alias("n")).union(roots).groupBy("u").agg(F.sum("n").alias("n")).where("n > 2").isEmpty()
        forget(edges, large)
        edges = small
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
