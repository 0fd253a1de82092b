"""Connected components by alternating star contraction, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlode.session import stage


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of the undirected ``edges`` (a, b); ``component`` is the smallest node.

    Large-star and small-star rounds: every round is two aggregations with map-side combining and shuffled joins,
    so no component is gathered in one task or on the driver; O(log n) rounds.  Loops and repeated edges do no harm; null ends
    are left out; no edges give no rows.
    """
    both = edges.where("a IS NOT NULL AND b IS NOT NULL").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    nodes = both.select(F.col("u").alias("node")).union(both.select("v")).distinct()
    links = stage(both.where("u <> v").distinct())
    for _ in range(most_rounds):
        # large star: each node's larger neighbours go to the smallest of its neighbourhood
        ways = links.select(F.col("u").alias("n"), F.col("v").alias("m")).union(links.select("v", "u"))
        least = ways.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("low"))
        large = ways.where("m > n").join(least, "n").select(F.col("m").alias("u"), F.col("low").alias("v")).where("u <> v")
        large = large.distinct()
        # small star: each node's smaller neighbours and itself go to the smallest of them
        low = large.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("low"))
        small = large.select(F.col("u").alias("n"), F.col("v").alias("m")).join(low, "n")
        small = small.select(F.col("m").alias("u"), F.col("low").alias("v")).union(low.select("n", "low"))
        after = stage(small.where("u <> v").distinct())
        state = [x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for x in (links, after)]
        links = after
        if state[0] == state[1]:
            break
    else:
        raise RuntimeError("the components did not settle")
    return nodes.join(links.select(F.col("u").alias("node"), F.col("v").alias("_low")), "node", "left").select(
        "node", F.coalesce("_low", "node").alias("component")
    )
