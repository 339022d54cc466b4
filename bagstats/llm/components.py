"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagstats.sources.shared import written


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(row)


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """``node, component`` of every node that has an edge; the component is its smallest node.

    Each step points nodes at the smallest neighbour seen and keeps at most as many edges as there
    were, so a node with very many links is never gathered: its minimum is aggregated on the map
    side and joined back as one row, and adaptive execution splits the edges of a hub.  Steps are written to the
    shared folder; the loop ends when a step changes nothing.  Self links and null nodes are ignored.
    """
    ordered = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
    stars = written(ordered.filter("u is not null and v is not null and u <> v").distinct(), "links")
    before = _mark(stars)
    while before[0]:
        # Large star: the larger end of each edge goes to the smallest neighbour of the smaller end, or to that end itself.
        lowest = stars.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
        large = stars.join(lowest.withColumnRenamed("node", "v"), "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        # Small star: all smaller neighbours of a node, and the node, go to the smallest of them.
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u")
        moved = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = written(moved.unionByName(root.select("u", F.col("m").alias("v"))).distinct(), "links")
        after = _mark(stars)
        if after == before:
            break
        before = after
    members = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
