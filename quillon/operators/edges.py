"""Unit-to-feature effect edges with posterior probabilities, their summaries, and convergent features."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import exprs as X
from quillon.operators import order as O
from quillon.sources.shared import Scratch

BIG = math.log2(1.5)


def recover_se(df: DataFrame, y: str = "y", z: str = "z") -> DataFrame:
    """Standard error y / z; zero z, non-finite or non-positive results give null."""
    se = F.abs(F.col(y) / F.nullif(F.col(z), F.lit(0.0)))
    return df.withColumn("se", F.when(X.finite(se) & (se > 0), se))


def edge_posterior(df: DataFrame, big: float = BIG, keep: float | None = 0.8) -> DataFrame:
    """Posterior of every (unit, feature) effect; with ``keep`` only likely big ones.

    Prior variance max(var(y) - median(se^2), 1e-6) is over all valid rows: one aggregate, one one-row join.
    Valid rows are written once: the median reads them three times, the prior and the edges once each.
    """
    valid = df.where(X.finite(F.col("y")) & X.finite(F.col("se")) & (F.col("se") > 0))
    valid = Scratch(df.sparkSession, "edges").save(valid.select("unit", "feature", "y", "se"), "valid")
    middle = O.quantiles(valid.select((F.col("se") * F.col("se")).alias("v")), "v", [0.5])[0]
    prior = valid.agg(F.greatest(F.var_pop("y") - F.lit(middle).cast("double"), F.lit(1e-6)).alias("tau2"))
    post = valid.crossJoin(F.broadcast(prior)).withColumn("v", 1 / (1 / F.col("tau2") + 1 / (F.col("se") * F.col("se"))))
    post = post.withColumn("theta", F.col("v") * F.col("y") / (F.col("se") * F.col("se"))).withColumn("sd", F.sqrt("v"))
    theta, sd = F.col("theta"), F.col("sd")
    tails = X.with_normal_tails(post, p_pos=-theta / sd, above=(big - theta) / sd, below=(big + theta) / sd)
    out = tails.select("unit", "feature", "y", "se", "theta", "sd", "p_pos", (F.col("above") + F.col("below")).alias("p_big"))
    return out if keep is None else out.where(F.col("p_big") > keep)


def _strongest(member: str, n: int = 5):
    """The n members of largest rounded magnitude, joined; the member's name breaks ties."""
    order = F.array_sort(F.collect_list(F.struct((-F.abs(F.round("theta", 9))).alias("k"), F.col(member).cast("string").alias("m"))))
    return F.concat_ws("; ", F.transform(F.slice(order, 1, n), lambda x: x["m"]))


def edge_summary(edges: DataFrame, by: str, member: str) -> DataFrame:
    """Edges, signs, mean and median magnitude and strongest members per unit or per feature."""
    size = F.abs("theta")
    return edges.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_edges"),
        F.sum((F.col("theta") > 0).cast("long")).alias("n_positive"),
        F.sum((F.col("theta") < 0).cast("long")).alias("n_negative"),
        F.round(F.avg(size), 6).alias("mean_abs_theta"),
        F.round(F.median(size), 6).alias("median_abs_theta"),
        _strongest(member).alias("strongest"),
    )


def sign_pivot(edges: DataFrame, by: str) -> DataFrame:
    """Counts of positive and negative edges as columns."""
    signed = edges.select(by, F.when(F.col("theta") > 0, "pos").otherwise("neg").alias("sign"))
    return signed.groupBy(by).pivot("sign", ["pos", "neg"]).count().na.fill(0, ["pos", "neg"])


def convergent_features(edges: DataFrame, classes: DataFrame, least: int = 2) -> DataFrame:
    """Features that at least max(least, ceil(n / 2)) of a class's n units with edges hit; self-edges do not count."""
    hits = edges.join(classes, "unit").where(F.col("feature").cast("string") != F.col("unit").cast("string"))
    size = hits.groupBy("class").agg(F.countDistinct("unit").alias("n_units"))
    found = hits.groupBy("class", "feature").agg(F.countDistinct("unit").alias("n_hit"))
    return found.join(size, "class").where(F.col("n_hit") >= F.greatest(F.lit(least), F.ceil(F.col("n_units") / 2)))


def threshold_hits(effects: DataFrame, big: float = BIG) -> DataFrame:
    """Hits by effect size alone, with their direction."""
    return effects.where(F.abs("y") > big).withColumn("up", F.col("y") > 0)


def specificity(df: DataFrame) -> DataFrame:
    """I16: columns magnitude_specific, direction_specific and verdict out of p, fold, null_fold, up, null_up and other_fold.

    Magnitude: p under 0.05 and twice the null's fold. Direction: 85 % up and a quarter above the null. The
    cascade: both; else p or a gap of 0.15 alone; else another group's fold at twice the null's.
    """
    magnitude = (F.col("p") < 0.05) & (F.col("fold") >= 2 * F.col("null_fold"))
    gap = F.col("up") - F.col("null_up")
    direction = (F.col("up") >= 0.85) & (gap >= 0.25)
    verdict = F.when(magnitude & direction, "specific").when((F.col("p") < 0.05) | (gap >= 0.15), "largely general").when(F.col("other_fold") >= 2 * F.col("null_fold"), "general").otherwise("none")
    return df.withColumns({"magnitude_specific": magnitude, "direction_specific": direction, "verdict": verdict})


def matched_null(pool: DataFrame, size: int, draws: int, observed: DataFrame, seed: str = "null") -> DataFrame:
    """Mean of ``value`` over ``draws`` seeded samples of ``size`` pool members, against one observed value.

    Draws are a grouping key; each takes the first ``size`` members in md5 order. Gives mean, sd, z,
    p = (number at least observed + 1) / (draws + 1) and the 95th percentile.
    """
    slots = pool.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    order = Window.partitionBy("b").orderBy(X.seeded(seed, F.col("b"), F.col("id")), "id")
    taken = slots.withColumn("k", F.row_number().over(order)).where(F.col("k") <= size)
    null = taken.groupBy("b").agg(F.round(F.avg("value"), 9).alias("m"))
    both = null.crossJoin(F.broadcast(observed))
    return both.agg(
        F.round(F.max("observed"), 6).alias("observed"),
        F.round(F.avg("m"), 6).alias("null_mean"),
        F.round(F.stddev_pop("m"), 6).alias("null_sd"),
        F.round((F.max("observed") - F.avg("m")) / (F.stddev_pop("m") + 1e-9), 4).alias("z"),
        F.round((F.sum((F.col("m") >= F.col("observed")).cast("long")) + 1) / (F.count(F.lit(1)) + 1.0), 6).alias("p"),
        F.round(F.percentile("m", F.lit(0.95)), 6).alias("p95"),
    )
