"""Connected components by alternating stars: no node's neighbours are ever gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftrank.scratch import materialize

ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); the component is its smallest node.

    Each round links all larger neighbours of a node to the smallest one, then
    all smaller ones, which halves distances; every step is a grouped minimum
    and a join.  Rounds end when the edges no longer change.
    """
    now = edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = materialize(now, "links")
    known = None
    for _ in range(ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        ahead = now.select(F.col("v").alias("u"), F.col("u").alias("v"))  # each node with its larger neighbours
        large = ahead.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == known:
            break
        known = state
    else:
        raise RuntimeError("components did not settle")
    centers = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        centers.select("node", F.col("node").alias("component")))
