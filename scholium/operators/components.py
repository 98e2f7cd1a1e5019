"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.session import durable, release

#: Rounds after which an unfinished run is an error; labels reach every member in about log(size) rounds.
MOST_ROUNDS = 60


def connected_components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """``node, component``: the least node of each node's component.

    Edges with a null end and self-loops name no link; repeated edges count
    once; an empty table gives an empty result.  Alternating star contraction:
    a round links every larger neighbour of a node to its least neighbour, then
    every smaller one, which halves paths; only edges are shuffled, and each
    round's edges are written to the shared folder so that lineage stays short.
    """
    a, b = F.col(src), F.col(dst)
    now = durable(
        edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    for _ in range(MOST_ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: neighbours above a node go to the least of its neighbourhood (itself included).
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: the remaining smaller neighbours, and the node, go to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        step = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        step = durable(step)
        # Both are sets, so equal sizes and nothing new in the one mean that they are equal.
        changed = step.count() != now.count() or step.join(now, ["u", "v"], "left_anti").limit(1).count()
        release(now)
        now = step
        if not changed:
            labels = now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
            roots = now.select(F.col("v").alias("node")).distinct().join(labels.select("node"), "node", "left_anti")
            return labels.unionByName(roots.select("node", F.col("node").alias("component")))
    raise RuntimeError("components did not settle")
