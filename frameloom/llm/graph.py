"""Connected components of a graph of links, by large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, save


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Links (a, b) to (node, root): each linked node with its component's smallest node.

    Each round sends every node's larger neighbours to the node's smallest one
    (large star), then does the same among the smaller neighbours (small star),
    which leaves stars after a few rounds. Rounds are written to the shared
    folder. Self-links and repeated links are harmless; no links give no rows.
    """
    now, at = save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    mark = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after, after_at = save(small.select("e.u", "e.v").where("u <> v").distinct(), "links")
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        delete(edges.sparkSession, at)
        now, at = after, after_at
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("links were not contracted to stars")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
