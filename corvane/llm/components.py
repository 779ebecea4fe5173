"""Connected components of an edge table, by alternating large-star and small-star steps (Kiveris et al., 2014).

Everything stays distributed; each round's edges go to the checkpoint folder, so that lost executors cost at most
one round and plans don't grow. A hub is reduced by a partial minimum before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import ordered_size


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges`` has two long columns, a and b, no nulls. Returns (node, root) for every node but the
    roots themselves; a root is the smallest node of its component. No edges, no rows."""
    e = edges.toDF("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    state = ordered_size(e)
    for _ in range(rounds):
        if not state[0]:
            break
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low)
        e = small.select("a", "b").distinct().checkpoint()
        now = ordered_size(e)
        if now == state:
            return e.toDF("node", "root")
        state = now
    if state[0]:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.toDF("node", "root")
