"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalake.core.storage import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """node and root (the least node of its component) for all nodes of edges (a, b).

    Each round hangs neighbours under the least node that they see, so stars of the least nodes remain; nothing is
    collected, and a node with very many neighbours is handled by aggregation. The rounds, logarithmic in number, go on
    until one changes nothing; a round's links are deleted when the next ones are written.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    before = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % (1 << 31)).alias("s"), F.sum(F.xxhash64("b", "a") % (1 << 31)).alias("h")).first()
        if state == before or not state["n"]:
            break
        before, old = state, now
        # Large star: every larger neighbour of a node goes under the least of the node and its neighbours.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: the smaller neighbours of a node, and the node, go under the least of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        now = materialize(small.where("a <> b").distinct(), "components")
        discard(old)
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
