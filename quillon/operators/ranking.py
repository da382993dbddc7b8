"""Gate, baseline, empirical-Bayes shrinkage, rank and audit of units over (unit, context) contrasts."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import exprs as X
from quillon.functions.kernels import normal_sf
from quillon.operators import order as O
from quillon.sources.shared import Scratch

#: Mean response of a (context, gate, penalty) cell is the closed form of the saturated fixed-effects model.
CELL = ("context", "gate", "penalty_flag")


def cell_mean_baseline(df: DataFrame) -> DataFrame:
    """I1, closed form: adds mu, the mean response of the row's covariate cell."""
    cells = df.groupBy(*CELL).agg(F.avg("response").alias("mu"))
    return df.join(F.broadcast(cells), list(CELL))  # a row per cell: contexts times four


def count_glm(df: DataFrame, alpha_range: tuple[float, float] = (1e-3, 50.0), steps: int = 50) -> tuple[DataFrame, float]:
    """Adds mu of y ~ context + gate + flag by Poisson, then negative-binomial IRLS; returns (df, alpha).

    All covariates are categorical, so counts, sums and squares per covariate cell are sufficient: only
    these (contexts times four rows) come to the driver, and mu goes back as one value per cell.
    """
    cells = df.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"), F.sum("response").alias("s"), F.sum(F.col("response").cast("double") * F.col("response")).alias("q")).collect()
    if not cells:
        return df.withColumn("mu", F.lit(None).cast("double")), alpha_range[0]
    contexts = sorted({c["context"] for c in cells})
    x = np.array([[1.0, *(float(c["context"] == k) for k in contexts[1:]), float(c["gate"]), float(c["penalty_flag"])] for c in cells])
    n, s, q = (np.array([float(c[k]) for c in cells]) for k in ("n", "s", "q"))

    def irls(alpha: float) -> np.ndarray:
        mu = np.full(len(n), max(s.sum() / n.sum(), 1e-3))
        mu = (mu + s / n + 1e-3) / 2
        for _ in range(steps):
            w = n * mu / (1 + alpha * mu)
            z = np.log(mu) + (s / n - mu) / mu
            beta = np.linalg.lstsq(x * np.sqrt(w)[:, None], z * np.sqrt(w), rcond=None)[0]
            after = np.exp(np.clip(x @ beta, -30, 30))
            if np.max(np.abs(after - mu) / mu) < 1e-12:
                return after
            mu = after
        return mu

    mu0 = irls(0.0)
    moment = ((q - 2 * mu0 * s + n * mu0**2 - n * mu0) / mu0**2).sum() / n.sum()
    alpha = float(np.clip(moment, *alpha_range))
    mu = irls(alpha)
    rows = [(*(c[k] for k in CELL), float(m)) for c, m in zip(cells, mu, strict=True)]
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in CELL)
    fitted = df.sparkSession.createDataFrame(rows, f"{kinds}, mu double")
    return df.join(F.broadcast(fitted), list(CELL)), alpha


def log_deviation(df: DataFrame) -> DataFrame:
    """Adds work = ln(response + .5) - ln(mu + .5) and logmu."""
    logmu = F.log(F.col("mu") + 0.5)
    return df.withColumn("work", F.log(F.col("response") + 0.5) - logmu).withColumn("logmu", logmu)


def shrink(df: DataFrame, unit: str = "unit", ddof: int = 0, tail: bool = True) -> DataFrame:
    """Posterior per gated unit (d, n, shrinkage, u, sd, p_top, expected); without ``tail`` no p_top, which takes a quantile of all units.

    Noise variance is over all rows, everything else over gated rows. ``ddof`` is the convention of the
    variance of unit means. Two aggregates and two one-row joins.
    """
    noise = df.agg(F.var_pop("work").alias("s2e"))
    units = df.where("gate").groupBy(unit).agg(F.avg("work").alias("d"), F.count(F.lit(1)).alias("n"), F.avg("logmu").alias("logmu"))
    units = units.crossJoin(F.broadcast(noise)).withColumn("s2", F.col("s2e") / F.col("n"))
    spread = F.var_pop("d") if ddof == 0 else F.var_samp("d")
    prior = units.agg(F.greatest(spread - F.avg("s2"), F.lit(1e-6)).alias("tau2"))
    post = units.crossJoin(F.broadcast(prior)).withColumn("shrinkage", F.col("tau2") / (F.col("tau2") + F.col("s2")))
    post = post.withColumn("u", F.col("shrinkage") * F.col("d")).withColumn("sd", F.sqrt(F.col("shrinkage") * F.col("s2")))
    if tail:
        post = Scratch(df.sparkSession, "posterior").save(post, "post")
        post = post.withColumn("thr", F.lit(O.quantiles(post, "u", [0.99])[0]).cast("double"))
    return post.select(
        unit,
        F.col("n").alias("n_gated"),
        "d",
        "shrinkage",
        "u",
        "sd",
        *([F.expr(normal_sf("(thr - u) / sd")).alias("p_top")] if tail else []),
        F.greatest(F.exp(F.col("logmu") + F.col("u")) - 0.5, F.lit(0.0)).alias("expected"),
    )


def ranked(post: DataFrame, unit: str = "unit", digits: int = 9) -> DataFrame:
    """Dense 1..n order by posterior mean; the rounded mean and the unit break ties.

    Ranges of means are ranked by a task each and moved up by what lies above them.
    """
    rounded = Scratch(post.sparkSession, "ranked").save(post.withColumn("__rounded", F.round("u", digits)), "post")
    return O.row_numbers(rounded, "__rounded", [unit], "rank", descending=True).drop("__rounded")


def peak_context(df: DataFrame, unit: str = "unit") -> DataFrame:
    """The row of each unit's largest response; context breaks ties."""
    order = Window.partitionBy(unit).orderBy(F.col("response").desc(), "context")
    return df.withColumn("__k", F.row_number().over(order)).where("__k = 1").drop("__k")


def unit_breadth(df: DataFrame, unit: str = "unit") -> DataFrame:
    """Contexts seen, gated contexts, sum, extremes, concentration (max / sum) and balance (min / max) of responses."""
    return df.groupBy(unit).agg(
        F.countDistinct("context").alias("n_contexts"),
        F.sum(F.col("gate").cast("long")).alias("n_signif_contexts"),
        F.sum("response").alias("total"),
        F.max("response").alias("peak"),
        F.min("response").alias("least"),
        F.round(X.safe_ratio(F.max("response"), F.sum("response"), None), 6).alias("condition_specificity"),
        F.round(X.safe_ratio(F.min("response"), F.max("response")), 3).alias("reproducibility"),
        F.bool_or("penalty_flag").alias("any_flag"),
    )


def robust_score(df: DataFrame, contexts: int = 3, penalty: float = 0.6) -> DataFrame:
    """log1p(response) times gate, flag penalty, reproducibility and breadth, per contrast."""
    w = Window.partitionBy("unit")
    repro = F.round(X.safe_ratio(F.min("response").over(w), F.max("response").over(w)), 3)
    signif = F.sum(F.col("gate").cast("int")).over(w)
    score = F.log1p("response") * F.col("gate").cast("int") * F.when(F.col("penalty_flag"), penalty).otherwise(1.0) * (0.5 + 0.5 * repro) * (signif / contexts)
    return df.withColumn("score", F.round(score, 3))


def regulator_class(breadth: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Global if gated in two contexts at least and no context holds ``threshold`` of the response."""
    rule = (F.col("n_signif_contexts") >= 2) & (F.col("condition_specificity") < threshold)
    return breadth.withColumn("regulator_class", F.when(F.coalesce(rule, F.lit(False)), "global").otherwise("context_specific"))


def baseline_comparison(df: DataFrame, post: DataFrame) -> DataFrame:
    """Rank by raw peak, by gated peak and by posterior; who is dropped, and the shift."""
    raw = df.groupBy("unit").agg(F.max("response").alias("raw_peak"), F.max(F.when(F.col("gate"), F.col("response"))).alias("gated_peak"))
    both = raw.join(post.select("unit", F.round("u", 9).alias("u")), "unit", "full_outer")
    both = Scratch(df.sparkSession, "baselines").save(both, "both")
    both = O.min_ranks(both, {"raw_rank": "raw_peak", "gated_rank": "gated_peak", "eb_rank": "u"})
    return both.select("unit", "raw_rank", "gated_rank", "eb_rank", F.col("gated_peak").isNull().alias("dropped"), (F.col("raw_rank") - F.col("eb_rank")).alias("shift"))


def reproducibility_reweight(df: DataFrame, meta: DataFrame, post: DataFrame, neutral: float = 0.75) -> DataFrame:
    """Posterior mean times guide and donor terms and single-guide penalty; missing terms are neutral."""
    agg = df.where("gate").select("unit", "context").join(meta, ["unit", "context"], "left").groupBy("unit").agg(
        F.avg("guide_corr").alias("guide"), F.avg("donor_corr").alias("donor"), F.avg(F.col("single").cast("double")).alias("single_frac")
    )
    core = ranked(post).select("unit", F.col("rank").alias("old_rank"), "u").join(agg, "unit", "left")
    term = lambda c: F.coalesce(X.clip(F.col(c), 0.0, 1.0), F.lit(neutral))
    score = F.round(F.col("u") * term("guide") * term("donor") * (1 - 0.4 * F.coalesce("single_frac", F.lit(1.0))), 9)
    scored = Scratch(df.sparkSession, "reweight").save(core.withColumn("score", score), "scored")
    scored = O.row_numbers(scored, "score", ["unit"], "new_rank", descending=True)
    return scored.select("unit", "old_rank", "new_rank", (F.col("old_rank") - F.col("new_rank")).alias("rank_shift"), F.round("score", 6).alias("score"), F.col("donor").isNotNull().alias("donor_metadata"))


def review_status(audit: DataFrame, top: int = 30) -> DataFrame:
    """Union of two top lists with status and a reason sentence."""
    kept = audit.where((F.col("old_rank") <= top) | (F.col("new_rank") <= top))
    status = F.when((F.col("old_rank") <= top) & (F.col("new_rank") <= top), "survives").when(F.col("old_rank") <= top, "demoted").otherwise("promoted")
    reason = F.concat_ws("; ", F.when(~F.col("donor_metadata"), "no donor metadata"), F.when(F.col("rank_shift") < -5, F.format_string("falls %d ranks", -F.col("rank_shift"))), F.when(F.col("rank_shift") > 5, F.format_string("rises %d ranks", F.col("rank_shift"))))
    return kept.withColumn("status", status).withColumn("reason", F.when(reason == "", "stable").otherwise(reason))


def top_overlap(a: DataFrame, b: DataFrame, k: int, rank: str = "rank", unit: str = "unit") -> DataFrame:
    """Number of units in the first k of both rankings."""
    left = a.where(F.col(rank) <= k).select(unit)
    return left.join(b.where(F.col(rank) <= k).select(unit), unit, "left_semi").agg(F.count(F.lit(1)).alias("overlap"))


def hypergeometric_p(background: int, successes: int, draws: int, hits: int) -> float:
    """Upper tail of a hypergeometric draw, for driver-side scalars."""
    low = max(hits, draws + successes - background, 0)
    log = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    return min(1.0, sum(math.exp(log(successes, i) + log(background - successes, draws - i) - log(background, draws)) for i in range(low, min(successes, draws) + 1)))
