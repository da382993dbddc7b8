"""Set operations on (set_name, member) tables: overlaps by equi-join on members, never by crossing sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """|A & B| with both sizes for each pair of sets that share a member."""
    na = a.groupBy(F.col("set_name").alias("a")).agg(F.countDistinct("member").alias("na"))
    nb = b.groupBy(F.col("set_name").alias("b")).agg(F.countDistinct("member").alias("nb"))
    left, right = a.select(F.col("set_name").alias("a"), "member").distinct(), b.select(F.col("set_name").alias("b"), "member").distinct()
    both = left.join(right, "member").groupBy("a", "b").agg(F.count(F.lit(1)).alias("inter"))
    return both.join(na, "a").join(nb, "b")


def jaccard(sets: DataFrame) -> DataFrame:
    """Jaccard similarity of every ordered pair of different sets, 0 where nothing is shared.

    Pairs of set names are few (the product of names, not of members); shared members come from ``overlaps``.
    """
    names = sets.select("set_name").distinct()
    size = sets.groupBy("set_name").agg(F.countDistinct("member").alias("n"))
    pairs = names.select(F.col("set_name").alias("a")).join(names.select(F.col("set_name").alias("b")), F.col("a") < F.col("b"))
    found = overlaps(sets, sets).select("a", "b", "inter")
    out = pairs.join(found, ["a", "b"], "left").join(size.select(F.col("set_name").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("set_name").alias("b"), F.col("n").alias("nb")), "b")
    inter = F.coalesce("inter", F.lit(0))
    value = inter / F.nullif((F.col("na") + F.col("nb") - inter).cast("double"), F.lit(0.0))
    return out.select("a", "b", inter.alias("inter"), F.round(F.coalesce(value, F.lit(0.0)), 6).alias("jaccard"))


def subsumption(a: DataFrame, b: DataFrame) -> DataFrame:
    """|A & B| / |B| of pairs that share a member."""
    return overlaps(a, b).select("a", "b", F.round(F.col("inter") / F.col("nb"), 6).alias("fraction"))


def first_wins(*sources: DataFrame) -> DataFrame:
    """One row per unit, from the first of the ordered sources (unit, source) that has it; equal rows fall to the lesser name."""
    union = None
    for priority, s in enumerate(sources):
        s = s.select("unit", "source", F.lit(priority).alias("priority"))
        union = s if union is None else union.unionByName(s)
    order = Window.partitionBy("unit").orderBy("priority", "source")
    return union.withColumn("k", F.row_number().over(order)).where("k = 1").select("unit", "source")
