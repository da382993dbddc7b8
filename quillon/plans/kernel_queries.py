"""Queries of numeric kernels. Rows only, unless SQL can say the same: iterative fits have no SQL equivalent (see tests)."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import exprs as X
from quillon.operators import boosting as B
from quillon.operators import communities as C
from quillon.operators import graph as G
from quillon.operators import imputation as I  # noqa: E741
from quillon.operators import learn as M
from quillon.operators import lowrank as L
from quillon.operators import profiles as P
from quillon.operators import stats as T
from quillon.operators import tensor_fit as K
from quillon.plans.bindings import PROFILES, contrast, profiles, table
from quillon.plans.profile_queries import cells, knn, profile_balanced_panel, tensor_flagged_units
from quillon.plans.registry import query
from quillon.sources.shared import Scratch


#: Cells of a tensor that the fits of whole grids take into each task: more is an error. ``kernel_cp`` has no such bound.
MOST_CELLS = 3_000_000


def dense(spark, sf_dir):
    """The tensor of the whole expanded panel (V2: gate in all contexts and median support, no limit of units) and its mask."""
    return tensor(spark, sf_dir, P.expanded_panel(contrast(spark, sf_dir), top=None).select("unit"))[1:]


def panel_rows(spark, sf_dir):
    """The expanded panel as a written table of units, a profile per context."""
    panel = P.expanded_panel(contrast(spark, sf_dir), top=None).select("unit")
    rows = K.unit_rows(cells(spark, sf_dir).join(panel, "unit", "left_semi"), ["A", "N", "R"], F.log1p)
    return Scratch(spark, "tensor").save(rows, "units")


def tensor(spark, sf_dir, panel):
    """(units, tensor, mask) of a panel's units."""
    kept = cells(spark, sf_dir).join(panel, "unit", "left_semi").select("unit", "context", "profile")
    if (n := kept.count()) > MOST_CELLS:
        raise ValueError(f"{n} cells are more than the {MOST_CELLS} that fits in tasks take whole")
    rows = kept.toArrow()
    units, i = np.unique(rows.column("unit").to_numpy(), return_inverse=True)
    k = np.searchsorted(["A", "N", "R"], rows.column("context").to_pylist())
    t, mask = np.zeros((len(units), 5, 3)), np.zeros((len(units), 5, 3), dtype=bool)
    t[i, :, k], mask[i, :, k] = np.log1p(np.array(rows.column("profile").to_pylist(), dtype=np.float64).reshape(-1, 5)), True
    return units, t, mask


def wide(spark, sf_dir, only=None):
    """(tensor, mask, in_panel, strength) of all units gated in every context, or of those in ``only``: in_panel marks the expanded panel, strength is the largest response."""
    df = contrast(spark, sf_dir)
    gated = df.where("gate").groupBy("unit").agg(F.countDistinct("context").alias("n"), F.max("response").alias("strength")).where("n = 3").select("unit", "strength")
    gated = gated if only is None else gated.join(only, "unit", "left_semi")
    panel = P.expanded_panel(df, top=None).select("unit", F.lit(True).alias("in_panel"))
    facts = gated.join(panel, "unit", "left").na.fill(False, ["in_panel"])
    units, t, mask = tensor(spark, sf_dir, gated.select("unit"))
    f = facts.toArrow()
    at = np.searchsorted(units, f.column("unit").to_numpy())
    in_panel, strength = np.zeros(len(units), dtype=bool), np.zeros(len(units))
    in_panel[at], strength[at] = np.array(f.column("in_panel").to_pylist(), dtype=bool), f.column("strength").to_numpy()
    return t, mask, in_panel, strength


PCA_AXES, PCA_ENDS = 20, 15


@query("kernel_covariance", f"WITH {PROFILES}, l AS (SELECT unit, CAST(UNNEST(RANGE(64)) AS INT) AS i, UNNEST(profile) AS x FROM profiles) SELECT a.i, b.i AS j, ROUND(COVAR_POP(a.x, b.x), 6) AS covariance FROM l a JOIN l b ON a.unit = b.unit AND a.i <= b.i GROUP BY 1, 2")
def kernel_covariance(spark, sf_dir):
    """V12 (its matrix): covariances of all dimensions from the distributed Gram matrix that every axis comes from."""
    n, s, g = L.gram(profiles(spark, sf_dir), 64)
    c = g / max(n, 1) - np.outer(s, s) / max(n, 1) ** 2
    return spark.createDataFrame([(i, j, round(float(c[i, j]), 6)) for i in range(64) for j in range(i, 64)], "i int, j int, covariance double")


@query("kernel_pca")
def kernel_pca(spark, sf_dir):
    """Principal axes of all profiles from a distributed Gram matrix: at most rows - 1 of them."""
    n, s, g = L.gram(profiles(spark, sf_dir), 64)
    share, axes = L.principal_axes(n, s, g, max(1, min(PCA_AXES, n - 1)))
    return spark.createDataFrame([(k, round(float(s), 8), [round(float(v), 6) for v in a]) for k, (s, a) in enumerate(zip(share, axes, strict=True))], "axis int, share double, loadings array<double>")


@query("kernel_pca_loadings")
def kernel_pca_loadings(spark, sf_dir):
    """The fifteen largest and least loadings of each axis."""
    long_ = kernel_pca(spark, sf_dir).select("axis", F.posexplode("loadings").alias("feature", "loading"))
    ends = []
    for end, order in (("top", F.col("loading").desc()), ("bottom", F.col("loading").asc())):
        rank = F.row_number().over(Window.partitionBy("axis").orderBy(order, "feature"))
        ends.append(long_.withColumn("rank", rank).where(F.col("rank") <= PCA_ENDS).select("axis", F.lit(end).alias("end"), "rank", "feature", "loading"))
    return ends[0].unionByName(ends[1])


def _scores(df, axes, centre):
    """Rows' scores on axes of bounded size, projected in the JVM."""
    mean = F.array(*[F.lit(float(v)) for v in centre])
    centred = F.zip_with("profile", mean, lambda x, m: x - m)
    return F.array(*[F.round(X.dot(centred, F.array(*[F.lit(float(v)) for v in a])), 6) for a in axes])


@query("kernel_svd_scores")
def kernel_svd_scores(spark, sf_dir):
    """Scores of all rows on five axes, each oriented by its first two features (the anchors)."""
    rows, sums, g = L.gram(profiles(spark, sf_dir), 64)
    _, axes = L.principal_axes(rows, sums, g, 5, anchors=(0, 1))
    return profiles(spark, sf_dir).select("unit", _scores(profiles(spark, sf_dir), axes, sums / max(rows, 1)).alias("scores"))


POWER = 0.3


@query("kernel_power_gate")
def kernel_power_gate(spark, sf_dir):
    """Per axis of the stacked tensor rows, Spearman of score and support; over 0.3 either way the axis follows support."""
    df = cells(spark, sf_dir)
    rows, sums, g = L.gram(df, 5)
    _, axes = L.principal_axes(rows, sums, g, 3)
    long_ = df.select("support", F.posexplode(_scores(df, axes, sums / max(rows, 1))).alias("axis", "score"))
    rho = T.spearman(long_, "score", "support", ("axis",))
    return rho.select("axis", "n", F.col("rho").alias("power_rho"), (F.abs("rho") > POWER).alias("power_confounded"))


@query("kernel_varimax")
def kernel_varimax(spark, sf_dir):
    """Varimax-rotated loadings of the first five axes."""
    _, axes = L.principal_axes(*L.gram(profiles(spark, sf_dir), 64), 5)
    rotated, _ = L.varimax(axes.T)
    return spark.createDataFrame([(i, [round(float(v), 6) for v in r]) for i, r in enumerate(rotated)], "feature int, loadings array<double>")


@query("kernel_principal_angles")
def kernel_principal_angles(spark, sf_dir):
    """Angles between the subspaces of all pairs of programs (replicates), all programs in one pass of Gram sums, with the random-subspace null."""
    spaces = {n: L.principal_axes(*g, 3)[1].T for n, g in L.grams(profiles(spark, sf_dir), 64, "program").items()}
    mean, high = L.random_subspace_null(64, 3)
    out = []
    for a, b in combinations(sorted(spaces), 2):
        cos2 = L.principal_angles(spaces[a], spaces[b])
        out += [(a, b, k, round(float(c), 8), round(mean, 8), round(high, 8), bool(cos2.mean() > high)) for k, c in enumerate(cos2)]
    return spark.createDataFrame(out, "a string, b string, k int, cos2 double, null_mean double, null_p95 double, above_null boolean")


@query("kernel_linkage")
def kernel_linkage(spark, sf_dir):
    """Average-linkage clusters of the units of the balanced panel (V1, bounded by its classes and moves), all contexts end to end."""
    units, t, _ = tensor(spark, sf_dir, profile_balanced_panel(spark, sf_dir).select("unit"))
    x = L._flat(t)
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    label = L.average_linkage(1 - u @ u.T, min(12, max(2, len(units) // 15)))
    return spark.createDataFrame([(int(n), int(k)) for n, k in zip(units, label, strict=True)], "unit long, cluster int")


@query("kernel_deconvolution")
def kernel_deconvolution(spark, sf_dir):
    """The square block of units that are features too (a join of both), deconvolved per context as one grouped task each."""
    # A profile's features are the brand digits from 1 on: a unit is one of them if its id is that of a place in the profiles.
    every = cells(spark, sf_dir)
    features = every.select(F.explode(F.sequence(F.lit(1), F.size("profile"))).alias("f")).distinct().select(F.col("f").cast("long").alias("unit"), (F.col("f") - 1).alias("place"))
    df = every.join(features, "unit").select("context", "unit", "place", "profile")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        own = pdf["place"].to_numpy()
        profile = np.stack(pdf["profile"].to_numpy())
        block = profile[:, own] / (1 + np.linalg.norm(profile, axis=1, keepdims=True))
        direct, condition = L.deconvolve(block)
        return pd.DataFrame({"context": pdf["context"].iloc[0], "unit": pdf["unit"].astype("int32"), "direct": [[round(float(v), 6) for v in r] for r in direct], "condition": round(condition, 6)})

    return df.groupBy("context").applyInPandas(solve, "context string, unit int, direct array<double>, condition double")


@query("kernel_cp")
def kernel_cp(spark, sf_dir):
    """CP fits of ranks 1 to 4 of the whole expanded panel, units as rows, all fits in each pass: error, degeneracy, weights and cosines of the feature mode."""
    fits = K.best_by_rank(K.cp_fits(panel_rows(spark, sf_dir), 5, 3, [(rank, start) for rank in (1, 2, 3, 4) for start in range(2)]))
    unit = {rank: L._unit(f.features) for rank, f in fits.items()}
    rows = [(rank, round(f.error, 6), round(f.degeneracy(), 6), [round(float(w), 6) for w in f.weights], np.abs(unit[rank].T @ unit[rank]).round(6).tolist()) for rank, f in sorted(fits.items())]
    return spark.createDataFrame(rows, "rank int, error double, degeneracy double, weights array<double>, cosines array<array<double>>")


@query("kernel_cp_units")
def kernel_cp_units(spark, sf_dir):
    """T4, T5: loadings of every unit of the expanded panel under the rank-2 fit."""
    rows = panel_rows(spark, sf_dir)
    fit = K.best_by_rank(K.cp_fits(rows, 5, 3, [(2, start) for start in range(2)]))[2]
    return K.unit_factors(rows, fit, 5).select("unit", F.transform("loadings", lambda x: F.round(x, 6)).alias("loadings"))


CP_RANKS, CP_SPLITS, CP_DRAWS, GATED, CONGRUENT, COFACTOR = (2, 3, 4), 6, 100, 0.15, 0.9, 0.7


def stability_by_rank(spark, t, mask):
    tasks = pd.DataFrame([(r, s) for r in CP_RANKS for s in range(CP_SPLITS)], columns=["rank", "split"])
    fits = L.grid(spark, tasks, lambda x: {"rank": int(x["rank"]), "split": int(x["split"]), "cosine": L.split_half(t, mask, int(x["rank"]), int(x["split"]))}, "rank int, split int, cosine double")
    scores = fits.groupBy("rank").agg(F.round(F.avg("cosine"), 6).alias("stability")).withColumn("stable", F.col("stability") > 0.7)
    best = scores.agg(F.coalesce(F.max(F.when(F.col("stable"), F.col("rank"))), F.max_by("rank", "stability")).alias("best"))
    return scores.crossJoin(F.broadcast(best)).select("rank", "stability", "stable", (F.col("rank") == F.col("best")).alias("chosen"))


@query("kernel_cp_stability")
def kernel_cp_stability(spark, sf_dir):
    """Split-half stability over a grid of ranks and splits, and the rank it chooses: the largest stable one, or else the most stable."""
    return stability_by_rank(spark, *dense(spark, sf_dir))


def bootstrap_loadings(spark, t, mask, base, rank, draws):
    """(b, component, loadings) of fits to resampled units, matched and signed by the feature mode of ``base``."""

    def run(task: dict) -> dict:
        i = np.random.default_rng(int(task["b"])).integers(0, len(t), len(t))
        f, _ = L.gauge(L.cp(t[i], mask[i], rank, 1, seed=int(task["b"]))[0])
        order, _ = L.match(base[1], f[1])
        sign = np.sign((base[1] * f[1][:, order]).sum(axis=0))
        return {"b": int(task["b"]), "loadings": (f[2][:, order] * sign).T.tolist()}

    fits = L.grid(spark, pd.DataFrame({"b": range(draws)}), run, "b int, loadings array<array<double>>")
    return fits.select("b", F.posexplode("loadings").alias("component", "loadings"))


def relative_range():
    """A replicate's range over contexts in units of its largest absolute loading."""
    return (F.array_max("loadings") - F.array_min("loadings")) / (F.array_max(F.transform("loadings", F.abs)) + 1e-9)


@query("kernel_cp_bootstrap")
def kernel_cp_bootstrap(spark, sf_dir):
    """Bootstrap over units of the context loadings: 2.5 and 97.5 percentiles, and the gated call: the 2.5 percentile of the replicates' relative ranges."""
    t, mask = dense(spark, sf_dir)
    base, _ = L.gauge(L.cp(t, mask, 2, 2)[0])
    drawn = bootstrap_loadings(spark, t, mask, base, 2, CP_DRAWS)
    lows = drawn.groupBy("component").agg(F.percentile(relative_range(), F.lit(0.025)).alias("range_lo"))
    long_ = drawn.select("component", F.posexplode("loadings").alias("context", "v"))
    q = long_.groupBy("component", "context").agg(F.round(F.percentile("v", F.lit(0.025)), 6).alias("lo"), F.round(F.percentile("v", F.lit(0.975)), 6).alias("hi"))
    return q.join(lows, "component").select("component", "context", "lo", "hi", F.round("range_lo", 6).alias("range_lo"), (F.col("range_lo") > GATED).alias("gated"))


@query("kernel_cp_factors")
def kernel_cp_factors(spark, sf_dir):
    """One row per component of the chosen rank: loadings and gates, top units and features, and the best enriched feature set."""
    units, t, mask = tensor(spark, sf_dir, P.expanded_panel(contrast(spark, sf_dir), top=None).select("unit"))
    rank = stability_by_rank(spark, t, mask).where("chosen").first()["rank"]
    fit, weight = L.gauge(L.cp(t, mask, rank, 10)[0])
    drawn = bootstrap_loadings(spark, t, mask, fit, rank, CP_DRAWS)
    lows = {r["component"]: r["lo"] for r in drawn.groupBy("component").agg(F.percentile(relative_range(), F.lit(0.025)).alias("lo")).collect()}  # one row a component
    cosine, congruence = L.feature_cosines(fit), L.component_congruence(fit)
    np.fill_diagonal(cosine, 0)
    support = cells(spark, sf_dir).groupBy("unit").agg(F.avg("support").alias("support"))
    scores = spark.createDataFrame([(int(u), k, float(fit[0][i, k])) for i, u in enumerate(units) for k in range(rank)], "unit long, component int, score double")
    rho = {r["component"]: r["rho"] for r in T.spearman(scores.join(support, "unit"), "score", "support", ("component",)).collect()}
    sets = spark.createDataFrame([("odd", k) for k in (1, 3, 5)] + [("low", k) for k in (1, 2)] + [("high", k) for k in (4, 5)], "set_name string, member int")
    background = spark.createDataFrame([(k,) for k in range(1, 6)], "member int")
    rows = []
    for k in range(rank):  # components are a handful
        units_by, features_by = np.argsort(-np.abs(fit[0][:, k])), np.argsort(-np.abs(fit[1][:, k]))[:50] + 1
        top = spark.createDataFrame([(int(f),) for f in features_by[:2]], "member int")
        best = T.benjamini_hochberg(T.enrichment(top, sets, background)).orderBy("p", "set_name").first()
        c = fit[2][:, k]
        gated = bool(lows[k] > GATED)
        rows.append((
            k + 1, round(float(weight[k]), 6), [round(float(v), 6) for v in c], gated, f"gated(peak={'ANR'[int(c.argmax())]})" if gated else "constitutive(flat)", round(float(lows[k]), 6),
            rho.get(k), rho.get(k) is not None and abs(rho[k]) > POWER, round(float(congruence[k]), 6), bool(congruence[k] > CONGRUENT), round(float(np.abs(cosine[k]).max(initial=0)), 6), bool(np.abs(cosine[k]).max(initial=0) > COFACTOR),
            ";".join(str(units[i]) for i in units_by[:8]), ";".join(map(str, features_by[:10])), best["set_name"] if best["fdr"] < 0.05 else "unlabeled",
        ))
    return spark.createDataFrame(rows, "factor int, weight double, contexts array<double>, gated boolean, shape string, range_lo double, power_rho double, power_confounded boolean, congruence double, degenerate boolean, max_cofactor_cosine double, cofactor boolean, top_units string, top_features string, label string")


@query("kernel_completion")
def kernel_completion(spark, sf_dir):
    """Held-out R2 of completions of single entries over a grid of ranks and seeds, each fit a task."""
    t, mask = dense(spark, sf_dir)
    x, m = L._flat(t), L._flat(mask)

    def run(task: dict) -> dict:
        model, one = L.entry_r2(x, m, int(task["rank"]), 0.1, int(task["seed"]))
        return {"rank": int(task["rank"]), "seed": int(task["seed"]), "r2": round(model, 8), "r2_rank1": round(one, 8)}

    return L.grid(spark, pd.DataFrame([(r, s) for r in (1, 2, 3, 5) for s in range(3)], columns=["rank", "seed"]), run, "rank int, seed int, r2 double, r2_rank1 double")


@query("kernel_completion_rows")
def kernel_completion_rows(spark, sf_dir):
    """T10-T12 with units as rows, all fits in each of at most 30 passes: no bound of units; what a seed holds out is drawn per unit and entry."""
    found = I.entry_scores(panel_rows(spark, sf_dir), 5, 3, (1, 2, 3), range(2), steps=30, tol=1e-4)
    one = {seed: r2 for rank, seed, r2, _ in found if rank == 1}
    return spark.createDataFrame([(rank, seed, round(r2, 8), round(one[seed], 8)) for rank, seed, r2, _ in found], "rank int, seed int, r2 double, r2_rank1 double")


#: Held-out contexts and shares with their seeds: the last context at a fifth many times, the others for robustness.
BLOCKS = [(2, 0.2, range(20)), *[(c, share, range(100, 103)) for c, share in ((0, 0.2), (1, 0.2), (2, 0.1), (2, 0.4))]]


@query("kernel_block_rank")
def kernel_block_rank(spark, sf_dir):
    """Predictive rank when a context's whole block of a share of the units outside the panel is held out: median and 2.5 and 97.5 percentiles over seeds."""
    t, mask, in_panel, _ = wide(spark, sf_dir)

    def run(task: dict) -> dict:
        rank, r2, n = L.block_ranks(t, mask, ~in_panel, int(task["context"]), float(task["share"]), range(1, 11), int(task["seed"]))
        return {"context": int(task["context"]), "share": float(task["share"]), "rank": rank, "r2": r2, "n_test": n}

    tasks = pd.DataFrame([(c, share, s) for c, share, seeds in BLOCKS for s in seeds], columns=["context", "share", "seed"])
    fits = L.grid(spark, tasks, run, "context int, share double, rank int, r2 double, n_test int")
    at = lambda q: F.percentile("rank", F.lit(q))
    return fits.groupBy("context", "share").agg(F.count(F.lit(1)).alias("seeds"), at(0.5).alias("rank_median"), at(0.025).alias("rank_lo"), at(0.975).alias("rank_hi"), F.round(F.avg("r2"), 6).alias("mean_r2"), F.max("n_test").alias("n_test"))


@query("kernel_fibre_extrapolation")
def kernel_fibre_extrapolation(spark, sf_dir):
    """Held-out fibres of the last context, of units outside the panel, over ranks and seeds: margin over persistence, mean and sample deviation over seeds."""
    t, mask, in_panel, _ = wide(spark, sf_dir)

    def run(task: dict) -> dict:
        model, persistence, n = L.fibre_r2(t, mask, int(task["rank"]), int(task["seed"]), 2, 1, ~in_panel)
        return {"rank": int(task["rank"]), "seed": int(task["seed"]), "r2_model": model, "r2_persistence": persistence, "n_test": n}

    fits = L.grid(spark, pd.DataFrame([(r, s) for r in (1, 2, 3, 5, 8) for s in range(5)], columns=["rank", "seed"]), run, "rank int, seed int, r2_model double, r2_persistence double, n_test int")
    margin = F.col("r2_model") - F.col("r2_persistence")
    return fits.groupBy("rank").agg(F.round(F.avg(margin), 6).alias("margin_mean"), F.round(F.stddev_samp(margin), 6).alias("margin_sd"), F.max("n_test").alias("n_test"))


@query("kernel_fibre_strata")
def kernel_fibre_strata(spark, sf_dir):
    """The same extrapolation by strength of the held-out units: median split, and those as strong as the panel's median."""
    t, mask, in_panel, strength = wide(spark, sf_dir)

    def run(task: dict) -> dict:
        got = L.fibre_strata(t, mask, in_panel, strength, int(task["rank"]), 0, 2, 1)
        return {"rank": int(task["rank"]), "found": [{"stratum": n, "n_units": k, "r2_model": round(m, 6), "r2_persistence": round(p, 6), "margin": round(m - p, 6)} for n, k, m, p in got]}

    fits = L.grid(spark, pd.DataFrame({"rank": [1, 2, 3, 5, 8]}), run, "rank int, found array<struct<stratum:string,n_units:int,r2_model:double,r2_persistence:double,margin:double>>")
    return fits.select("rank", F.inline("found"))


@query("kernel_flagged_refit")
def kernel_flagged_refit(spark, sf_dir):
    """The extrapolation fitted with all units and again without those that have a flagged gated row: best margin over persistence, its rank and the held-out units.

    The held-out units differ between the two, so that their difference is no gain by itself.
    """
    every, clean = wide(spark, sf_dir), wide(spark, sf_dir, tensor_flagged_units(spark, sf_dir))

    def run(task: dict) -> dict:
        t, mask, in_panel, _ = clean if task["units"] == "unflagged" else every
        model, persistence, n = L.fibre_r2(t, mask, int(task["rank"]), 0, 2, 1, ~in_panel)
        return {"units": task["units"], "rank": int(task["rank"]), "margin": model - persistence, "n_test": n, "n_units": len(t)}

    # A set without units outside the panel has no held-out fibre, and no row.
    tasks = [(name, r) for name, (t, _, in_panel, _) in (("all", every), ("unflagged", clean)) if (~in_panel).any() for r in (1, 2, 3, 5, 8)]
    fits = L.grid(spark, pd.DataFrame(tasks, columns=["units", "rank"]), run, "units string, rank int, margin double, n_test int, n_units int")
    return fits.groupBy("units").agg(F.round(F.max("margin"), 6).alias("best_margin"), F.max_by("rank", F.struct("margin", -F.col("rank"))).alias("rank"), F.max("n_test").alias("n_test"), F.max("n_units").alias("n_units"))


@query("kernel_rmt")
def kernel_rmt(spark, sf_dir):
    """Noise edge, empirical edge (95th percentile of 100 draws, over the same rows) and signal modes of the correlations of the 64 dimensions."""
    n, s, g = L.gram(profiles(spark, sf_dir), 64)
    c = g / n - np.outer(s / n, s / n)
    d = np.sqrt(np.diag(c))
    _, edge, kept = L.rmt_clean(c / np.outer(d, d), n)
    edges = L.null_edges(profiles(spark, sf_dir), 64)
    return edges.agg(F.round(F.percentile("edge", F.lit(0.95)), 6).alias("empirical_edge")).withColumns({"theory_edge": F.lit(round(edge, 6)), "signal_modes": F.lit(kept)})


#: Edges that the community kernel takes to one task: a panel's. More is an error, never a sample.
MOST_EDGES = 5_000_000
TAU = 0.5


def _counted(edges):
    """An edge table of a panel, written once and checked for size."""
    kept = Scratch(edges.sparkSession, "graph").save(edges.where("weight > 0"), "edges")  # counted and read, made once
    if (n := kept.count()) > MOST_EDGES:
        raise ValueError(f"{n} edges are more than a panel's {MOST_EDGES}")
    return kept


def _arrays(e: pd.DataFrame) -> tuple:
    """(nodes, src, dst, weight) of edges, the ends being positions of nodes."""
    e = e.sort_values(["src", "dst"])
    nodes = np.unique(e[["src", "dst"]].to_numpy())
    return nodes, np.searchsorted(nodes, e["src"]), np.searchsorted(nodes, e["dst"]), e["weight"].to_numpy()


def _graph(edges):
    """A panel's graph as arrays, for a look at it; queries send its edges to the tasks that fit it."""
    return _arrays(_counted(edges).toPandas())


def sweep(edges):
    """(resolution, seed, node, label): G3's grid of fits on an edge table, a task each; no edge or node comes to the driver."""
    tried = edges.sparkSession.createDataFrame([(g, s) for g in (0.5, 1.0, 2.0) for s in range(2)], "resolution double, seed int")

    def run(key: tuple, e: pd.DataFrame) -> pd.DataFrame:
        nodes, src, dst, w = _arrays(e)
        label = L.communities(len(nodes), src, dst, w, float(key[0]), int(key[1]))
        return pd.DataFrame({"resolution": float(key[0]), "seed": int(key[1]), "node": nodes, "label": label})

    dealt = _counted(edges).crossJoin(F.broadcast(tried)).repartition(96, "resolution", "seed")  # six rows; a number of partitions that is not put together
    return dealt.groupBy("resolution", "seed").applyInPandas(run, "resolution double, seed int, node long, label int")


@query("kernel_communities")
def kernel_communities(spark, sf_dir):
    """Modularity communities of the neighbour graph over a grid of resolutions and seeds; edges are a panel's, and checked to be."""
    return sweep(P.neighbour_edges(knn(spark, sf_dir)))


@query("graph_communities")
def graph_communities(spark, sf_dir):
    """G3 on edge tables, for graphs of any size: communities of the neighbour graph at resolution 1, a label being its community's least node."""
    return C.communities(spark, P.neighbour_edges(knn(spark, sf_dir)), [(1.0, 0)]).select("node", "label")


#: Edges that one task fits: of nodes, else of classes of nodes; more are fitted by joins on edge tables.
TASK_EDGES = 1_000_000


def alike(runs):
    """The consensus graph with nodes of equal labels in all runs taken as one: (src, dst, weight, pairs) of heads, and (node, head).

    Such nodes have consensus 1 with each other and the same with every other node, so a partition that keeps them together
    has the modularity that it has on the nodes; pairs within a class are its loop. A head is its class's least node.
    """
    labels = runs.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("run_id", "label"))).alias("labels"))
    heads = labels.groupBy("labels").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("size"))
    heads = Scratch(runs.sparkSession, "alike").save(heads, "heads")
    size = lambda at: heads.select(F.col("head").alias(at), F.col("size").cast("double").alias(f"n_{at}"))
    pairs = G.consensus(runs.join(heads.select(F.col("head").alias("node")), "node", "left_semi"), least=TAU)
    between = pairs.join(size("src"), "src").join(size("dst"), "dst").select("src", "dst", (F.col("p") * F.col("n_src") * F.col("n_dst")).alias("weight"), (F.col("n_src") * F.col("n_dst")).alias("pairs"))
    loops = heads.where("size > 1").select(F.col("head").alias("src"), F.col("head").alias("dst"), (F.col("size") * (F.col("size") - 1) / 2.0).alias("weight"))
    loops = loops.withColumn("pairs", F.col("weight"))
    return between.unionByName(loops), labels.join(heads, "labels").select("node", "head")


def fitted(edges):
    """(head, label): communities of an edge table, in one task up to TASK_EDGES edges, so that none comes to the driver."""
    if edges.count() > TASK_EDGES:
        return C.communities(edges.sparkSession, edges.select("src", "dst", "weight"), [(1.0, 0)]).select(F.col("node").alias("head"), "label")

    def run(e: pd.DataFrame) -> pd.DataFrame:
        nodes, src, dst, w = _arrays(e)
        label = L.communities(len(nodes), src, dst, w)
        return pd.DataFrame({"head": nodes, "label": label})

    return edges.groupBy(F.lit("all")).applyInPandas(run, "head long, label long")


@query("kernel_consensus_communities")
def kernel_consensus_communities(spark, sf_dir):
    """Final communities of the graph of nodes that share a label in at least half of the sweep's runs, with node stability.

    A node without such a partner is a community of its own.
    """
    fits = kernel_communities(spark, sf_dir)
    runs = fits.select((F.col("resolution") * 100 + F.col("seed")).cast("int").alias("run_id"), "node", "label")
    runs = Scratch(spark, "consensus").save(runs, "runs")
    edges, classes = alike(runs)
    edges = Scratch(spark, "consensus").save(edges, "edges")
    if (edges.agg(F.sum("pairs")).first()[0] or 0) <= TASK_EDGES:  # few pairs: the nodes themselves
        edges = Scratch(spark, "consensus").save(G.consensus(runs, least=TAU).select("src", "dst", F.col("p").alias("weight")), "pairs")
        classes = runs.select("node", F.col("node").alias("head")).distinct()
    found = classes.join(fitted(edges), "head").select("node", "label")
    alone = runs.select("node").distinct().join(found, "node", "left").withColumn("label", F.coalesce("label", -1 - F.col("node")))
    return G.stability(runs, alone)


def features(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).cast("double").alias("n_orders"), F.concat_ws(";", F.array_sort(F.collect_set("o_orderpriority"))).alias("listed"), F.concat_ws(";", F.array_sort(F.collect_set(F.date_format("o_orderdate", "yyyy-MM")))).alias("months"))
    joined = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select(F.col("c_custkey").alias("unit"), "c_acctbal", "n_orders", F.col("c_mktsegment").alias("category"), "listed", "months")


#: The published least rows and caps of the two list columns.
LISTS = {"listed": (10, 500), "months": (10, 200)}


def full_design(spark, sf_dir, sparse=False):
    return M.design(features(spark, sf_dir), ["c_acctbal", "n_orders"], "category", LISTS, sparse)


@query("learn_tokens", "WITH e AS (SELECT DISTINCT o_custkey, o_orderpriority AS token FROM orders) SELECT token, CAST(COUNT(*) AS BIGINT) AS n FROM e GROUP BY 1 HAVING COUNT(*) >= 10")
def learn_tokens(spark, sf_dir):
    """Frequencies of list tokens."""
    return M.tokens(features(spark, sf_dir), "listed")


@query("learn_folds", "SELECT c_custkey AS unit, CAST((ROW_NUMBER() OVER (ORDER BY MD5('fold#' || CAST(c_custkey AS VARCHAR)), c_custkey) - 1) % 5 AS INT) AS fold FROM customer")
def learn_folds(spark, sf_dir):
    """M2: seeded folds of equal size."""
    return M.folds(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("unit")))


@query("learn_shuffled", "WITH a AS (SELECT c_custkey, ROW_NUMBER() OVER (ORDER BY c_custkey) AS p FROM customer), b AS (SELECT c_acctbal, ROW_NUMBER() OVER (ORDER BY MD5('shuffle#' || CAST(c_custkey AS VARCHAR)), c_custkey) AS q FROM customer) SELECT c_custkey AS unit, c_acctbal FROM a JOIN b ON p = q")
def learn_shuffled(spark, sf_dir):
    """M5: shuffled-feature control."""
    return M.shuffled(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("unit"), "c_acctbal"), "c_acctbal")


@query(
    "learn_design",
    "WITH o AS (SELECT o_custkey, CAST(COUNT(*) AS DOUBLE) AS n_orders FROM orders GROUP BY 1), f AS (SELECT c_custkey AS unit, c_acctbal, n_orders, COALESCE(c_mktsegment, 'None') AS category FROM customer LEFT JOIN o ON c_custkey = o_custkey), "
    "e AS (SELECT DISTINCT o_custkey AS unit, 'listed' AS kind, o_orderpriority AS token FROM orders UNION ALL SELECT DISTINCT o_custkey, 'months', STRFTIME(o_orderdate, '%Y-%m') FROM orders), "
    "k AS (SELECT kind, token FROM e GROUP BY 1, 2 HAVING COUNT(*) >= 10 QUALIFY ROW_NUMBER() OVER (PARTITION BY kind ORDER BY COUNT(*) DESC, token) <= CASE kind WHEN 'listed' THEN 500 ELSE 200 END), "
    "t AS (SELECT unit, COUNT(*) AS n FROM e JOIN k USING (kind, token) GROUP BY 1) "
    "SELECT f.unit, CAST(2 + (SELECT COUNT(DISTINCT category) FROM f) + (SELECT COUNT(*) FROM k) AS INT) AS width, "
    "ROUND(COALESCE(c_acctbal, (SELECT MEDIAN(c_acctbal) FROM f)) + COALESCE(n_orders, (SELECT MEDIAN(n_orders) FROM f)) + 1 + COALESCE(t.n, 0), 4) AS total FROM f LEFT JOIN t USING (unit)",
)
def learn_design(spark, sf_dir):
    """Design matrix rows of numbers, a category and two list columns: width and sum of each."""
    return full_design(spark, sf_dir).select("unit", F.size("x").alias("width"), F.round(X.array_sum(F.col("x")), 4).alias("total"))


@query("learn_ridge")
def learn_ridge(spark, sf_dir):
    """M2-M5, M7: five-fold ridge of responses on features against shuffled features, with the verdict."""
    x = full_design(spark, sf_dir, sparse=True)
    y = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("unit")).agg(F.array(F.log1p(F.sum("o_totalprice")), F.log1p(F.max("o_totalprice"))).alias("y"))
    scratch = Scratch(spark, "ridge")
    df = scratch.save(M.folds(x.join(y, "unit")), "rows")
    width, out = df.first()["x"].size, []
    for name, data in (("real", df), ("shuffled", scratch.save(M.shuffled(df, "x"), "shuffled"))):
        for k in range(5):
            train, test = data.where(F.col("fold") != k), data.where(F.col("fold") == k)
            coef, intercept, alpha = M.ridge(train, width, 2, scaled=2)
            mean = np.array(train.agg(F.avg(F.col("y")[0]), F.avg(F.col("y")[1])).first())
            out.append(M.row_r2(M.predict(test, coef, intercept), mean).agg(F.avg("r2").alias("r2")).select(F.lit(name).alias("features"), F.lit(k).alias("fold"), F.lit(alpha).alias("alpha"), F.round("r2", 6).alias("r2")))
    found = out[0]
    for part in out[1:]:
        found = found.unionByName(part)
    score = found.groupBy("fold").pivot("features", ["real", "shuffled"]).agg(F.max("r2"))
    return score.withColumn("verdict", M.verdict(F.col("real"), F.col("shuffled")))


#: Components, rounds at most, depth, step, rounds without gain. The published probe has 500 rounds (the operator's default) of smaller
#: steps, six passes each; of its 10 and 30 components fifteen responses allow the first.
BOOSTED_COMPONENTS, BOOSTED_ROUNDS, BOOSTED_DEPTH, BOOSTED_RATE, BOOSTED_PATIENCE = 10, 30, 6, 0.3, 8


def responses(spark, sf_dir):
    """(unit, profile): log responses of all contexts end to end, absent ones 0."""
    wide_ = cells(spark, sf_dir).groupBy("unit").pivot("context", ["A", "N", "R"]).agg(F.first("profile"))
    zero = F.array(*[F.lit(0.0)] * 5)
    return wide_.select("unit", F.transform(F.concat(*[F.coalesce(c, zero) for c in "ANR"]), F.log1p).alias("profile"))


@query("learn_boosted")
def learn_boosted(spark, sf_dir):
    """M6: boosted trees as a capacity probe on the leading components of the responses, all components in each pass: R2 of held-out and of training rows, rounds kept and importances per component.

    Fold 0 is held out, fold 1 stops the rounds early, the rest trains.
    """
    x = M.folds(full_design(spark, sf_dir))
    df = x.join(responses(spark, sf_dir), "unit")
    rows, sums, g = L.gram(df.where("fold > 1"), 15)
    _, axes = L.principal_axes(rows, sums, g, BOOSTED_COMPONENTS)
    data = Scratch(spark, "boosted").save(df.select("x", "fold", _scores(df, axes, sums / max(rows, 1)).alias("y")), "data")
    forest = B.boost(spark, data, len(axes), BOOSTED_ROUNDS, BOOSTED_DEPTH, BOOSTED_RATE, patience=BOOSTED_PATIENCE)
    both = forest.predict(data).where("fold <> 1").select((F.col("fold") == 0).alias("held_out"), F.posexplode(F.arrays_zip("y", "prediction")).alias("component", "v"))
    centre = F.array(*[F.lit(float(v)) for v in forest.base])[F.col("component")]
    at = lambda held: F.round(1 - F.sum(F.when(F.col("held_out") == held, (F.col("v.y") - F.col("v.prediction")) ** 2)) / F.nullif(F.sum(F.when(F.col("held_out") == held, (F.col("v.y") - centre) ** 2)), F.lit(0.0)), 6)
    scores = both.groupBy("component").agg(at(True).alias("r2"), at(False).alias("r2_train"))
    shares = [(k, len(forest.trees[k]), f, round(float(v), 6)) for k, own in enumerate(forest.importances()) for f, v in enumerate(own)]
    return scores.join(spark.createDataFrame(shares, "component int, rounds int, feature int, importance double"), "component")
