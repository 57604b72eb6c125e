"""Connected components of a link table, without ever gathering links in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b): component is the smallest node that can be reached.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): every node passes its smallest neighbour on,
    until all links point straight at a smallest node. Each round is a few joins on the node, written to the shared
    folder; hub nodes are plain skewed join keys, which adaptive execution splits. Null ends and links of a node with
    itself are ignored; no links give an empty result.
    """
    now = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    for _ in range(ROUNDS):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        before, now = now, stored(small, "links")
        discard(before)
        parents = now.select(F.col("v").alias("u")).distinct()
        if now.groupBy("u").count().where("count > 1").isEmpty() and now.join(parents, "u", "left_semi").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
