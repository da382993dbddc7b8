"""Connected components of a distributed edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import Scratch


def roots(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the component's least node.

    Large star: each node sends its larger neighbours to its least one. Small star: each node sends itself
    and its smaller neighbours to the least. Both are an aggregate (combined before the shuffle) and a join
    on the node, so a node with very many neighbours is a skewed join key, never a collected group. Ends
    when a round changes nothing, after about log(diameter) rounds; each round is a table in the shared
    folder. An empty edge list gives no rows.
    """

    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("mu"), F.least("mu", "m").alias("m"))

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = scratch.save(edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}0")
    seen, turn = state(now), 0
    while seen[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = both.join(least(both), F.col("u") == F.col("mu")).where(F.col("v") > F.col("u")).select(F.col("m").alias("a"), F.col("v").alias("b"))
        large = scratch.save(large.where(F.col("a") != F.col("b")).distinct(), f"{name}{turn}l")
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        joined = down.join(least(down), F.col("u") == F.col("mu"))
        small = joined.select(F.col("m").alias("a"), F.col("v").alias("b")).union(joined.select(F.col("m").alias("a"), F.col("u").alias("b")))
        after = scratch.save(small.where(F.col("a") != F.col("b")).distinct(), f"{name}{turn + 1}")
        scratch.drop(f"{name}{turn}l", f"{name}{turn}")
        now, turn = after, turn + 1
        if (state_now := state(now)) == seen:
            break
        seen = state_now
    leaves = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return leaves.union(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
