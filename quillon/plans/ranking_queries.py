"""Queries of the contrast, ranking and audit operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import exprs as X
from quillon.functions.kernels import normal_sf
from quillon.operators import bootstrap as B
from quillon.operators import order as O
from quillon.operators import ranking as R
from quillon.operators import stats as T
from quillon.plans.bindings import CONTRAST, REPLICATES, contrast, replicates, table, written_contrast, written_evidence
from quillon.plans.registry import query

BASE = f"""{CONTRAST},
cells AS (SELECT context, gate, penalty_flag, AVG(response) AS mu FROM contrast GROUP BY 1, 2, 3),
work AS (
  SELECT c.*, m.mu, LN(c.response + 0.5) - LN(m.mu + 0.5) AS work, LN(m.mu + 0.5) AS logmu
  FROM contrast c JOIN cells m ON c.context = m.context AND c.gate = m.gate AND c.penalty_flag = m.penalty_flag),
units AS (
  SELECT unit, AVG(work) AS d, CAST(COUNT(*) AS BIGINT) AS n, AVG(logmu) AS logmu, (SELECT VAR_POP(work) FROM work) / COUNT(*) AS s2
  FROM work WHERE gate GROUP BY unit),
prior AS (SELECT GREATEST(VAR_POP(d) - AVG(s2), 1e-6) AS tau2 FROM units),
posterior AS (
  SELECT unit, n, d, logmu, tau2 / (tau2 + s2) AS shrinkage, tau2 / (tau2 + s2) * d AS u, SQRT(tau2 / (tau2 + s2) * s2) AS sd FROM units, prior),
ranked AS (SELECT *, CAST(ROW_NUMBER() OVER (ORDER BY ROUND(u, 9) DESC, unit) AS BIGINT) AS rank FROM posterior),
breadth AS (
  SELECT unit, COUNT(DISTINCT context) AS n_contexts, CAST(SUM(CAST(gate AS INT)) AS BIGINT) AS n_signif_contexts, CAST(SUM(response) AS BIGINT) AS total,
         MAX(response) AS peak, MIN(response) AS least, ROUND(CAST(MAX(response) AS DOUBLE) / NULLIF(SUM(response), 0), 6) AS condition_specificity,
         ROUND(COALESCE(CAST(MIN(response) AS DOUBLE) / NULLIF(MAX(response), 0), 0), 3) AS reproducibility, BOOL_OR(penalty_flag) AS any_flag
  FROM contrast GROUP BY unit)"""


def deviations(spark, sf_dir, df=None):
    return R.log_deviation(R.cell_mean_baseline(contrast(spark, sf_dir) if df is None else df))


def posterior(spark, sf_dir, tail: bool = False, df=None):
    """Of the contrasts ``df``, where they are already made."""
    return R.shrink(deviations(spark, sf_dir, df), tail=tail)


@query("rank_eb", f"WITH {BASE} SELECT unit, rank, n AS n_gated, ROUND(u, 6) AS eb_mean, ROUND(sd, 6) AS eb_sd, ROUND({normal_sf('((SELECT QUANTILE_CONT(u, 0.99) FROM posterior) - u) / sd')}, 6) AS p_top, ROUND(GREATEST(EXP(logmu + u) - 0.5, 0), 4) AS expected, ROUND(shrinkage, 6) AS shrinkage FROM ranked")
def rank_eb(spark, sf_dir):
    """Gated empirical-Bayes ranking of units."""
    out = R.ranked(posterior(spark, sf_dir, tail=True))
    return out.select("unit", "rank", "n_gated", F.round("u", 6).alias("eb_mean"), F.round("sd", 6).alias("eb_sd"), F.round("p_top", 6).alias("p_top"), F.round("expected", 4).alias("expected"), F.round("shrinkage", 6).alias("shrinkage"))


@query("rank_cell_baseline", f"WITH {BASE} SELECT unit, context, ROUND(mu, 6) AS mu, ROUND(work, 6) AS work FROM work")
def rank_cell_baseline(spark, sf_dir):
    """I1 (closed form), I2, H4: baseline mean and log deviation of every contrast."""
    return deviations(spark, sf_dir).select("unit", "context", F.round("mu", 6).alias("mu"), F.round("work", 6).alias("work"))


@query("rank_count_glm")
def rank_count_glm(spark, sf_dir):
    """Poisson then negative-binomial baseline per covariate cell. Rows only: SQL has no iteratively reweighted fit."""
    fitted, alpha = R.count_glm(contrast(spark, sf_dir))
    return fitted.groupBy(*R.CELL).agg(F.count(F.lit(1)).alias("n"), F.round(F.max("mu"), 6).alias("mu")).withColumn("alpha", F.lit(round(alpha, 6)))


@query("contrast_gate", f"WITH {CONTRAST} SELECT unit, context, support, response, penalty_flag FROM contrast WHERE gate")
def contrast_gate(spark, sf_dir):
    """Rows that pass the gate."""
    return contrast(spark, sf_dir).where("gate").drop("gate")


@query("contrast_composite_filter", f"WITH {CONTRAST} SELECT unit, context, response FROM contrast WHERE gate AND NOT penalty_flag AND context IN ('A', 'R') AND unit IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def contrast_composite_filter(spark, sf_dir):
    """Composite predicate with literal lists and a semi join for the large set."""
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("unit"))
    kept = contrast(spark, sf_dir).where(F.col("gate") & ~F.col("penalty_flag") & F.col("context").isin("A", "R"))
    return kept.join(rich, "unit", "left_semi").select("unit", "context", "response")


@query("contrast_not_in", f"WITH {CONTRAST} SELECT unit, context FROM contrast c WHERE NOT EXISTS (SELECT 1 FROM contrast d WHERE d.unit = c.unit AND d.penalty_flag)")
def contrast_not_in(spark, sf_dir):
    """Anti join of units that are ever flagged."""
    df = contrast(spark, sf_dir)
    return df.join(df.where("penalty_flag").select("unit"), "unit", "left_anti").select("unit", "context")


@query("contrast_scaled_range", f"WITH {CONTRAST}, r AS (SELECT MIN(response) AS lo, MAX(response) AS hi FROM contrast WHERE penalty_flag AND context = 'N') SELECT unit, context, response FROM contrast, r WHERE response BETWEEN lo * 0.8 AND hi * 1.2 AND NOT penalty_flag")
def contrast_scaled_range(spark, sf_dir):
    """C4: range taken from another set, widened by a fifth."""
    df = contrast(spark, sf_dir)
    r = df.where(F.col("penalty_flag") & (F.col("context") == "N")).agg(F.min("response").alias("lo"), F.max("response").alias("hi"))
    return df.where(~F.col("penalty_flag")).crossJoin(F.broadcast(r)).where(F.col("response").between(F.col("lo") * 0.8, F.col("hi") * 1.2)).select("unit", "context", "response")


@query("contrast_finite", f"WITH {CONTRAST}, {REPLICATES} SELECT unit, context, guide_corr, donor_corr FROM replicates WHERE guide_corr IS NOT NULL AND donor_corr IS NOT NULL AND ABS(guide_corr) < 1")
def contrast_finite(spark, sf_dir):
    """Null and finite filters."""
    df = replicates(spark, sf_dir).dropna(subset=["guide_corr", "donor_corr"])
    return df.where(X.finite(F.col("guide_corr")) & (F.abs("guide_corr") < 1)).select("unit", "context", "guide_corr", "donor_corr")


@query("contrast_case_clip_fill", f"WITH {CONTRAST}, {REPLICATES} SELECT c.unit, c.context, CASE WHEN guide_corr IS NULL THEN NULL ELSE LEAST(GREATEST(guide_corr, 0), 1) END AS clipped, COALESCE(donor_corr, 0.75) AS filled, CASE WHEN NOT gate THEN 'ungated' WHEN penalty_flag THEN 'flagged' ELSE 'clean' END AS state FROM contrast c LEFT JOIN replicates r ON c.unit = r.unit AND c.context = r.context")
def contrast_case_clip_fill(spark, sf_dir):
    """Conditionals, null-safe clip, neutral fill over a composite-key left join."""
    df = contrast(spark, sf_dir).join(replicates(spark, sf_dir), ["unit", "context"], "left")
    state = F.when(~F.col("gate"), "ungated").when(F.col("penalty_flag"), "flagged").otherwise("clean")
    return df.select("unit", "context", X.clip(F.col("guide_corr"), 0.0, 1.0).alias("clipped"), F.coalesce("donor_corr", F.lit(0.75)).alias("filled"), state.alias("state"))


@query("contrast_to_bool", "SELECT o_orderkey, LOWER(TRIM(CAST(CASE WHEN o_orderkey % 5 = 0 THEN ' True ' WHEN o_orderkey % 5 = 1 THEN '1.0' WHEN o_orderkey % 5 = 2 THEN 'False' WHEN o_orderkey % 5 = 3 THEN 'yes' END AS VARCHAR))) IN ('true', '1', '1.0') AS flag FROM orders")
def contrast_to_bool(spark, sf_dir):
    """Text to boolean; anything but true, 1 and 1.0 is false, null stays null."""
    k = F.col("o_orderkey") % 5
    text = F.when(k == 0, " True ").when(k == 1, "1.0").when(k == 2, "False").when(k == 3, "yes")
    return table(spark, sf_dir, "orders").select("o_orderkey", X.to_bool(text).alias("flag"))


@query("contrast_derived", f"WITH {CONTRAST} SELECT unit, context, -CAST(response AS DOUBLE) AS neg_response, ROUND(LN(response + 0.5), 6) AS log_response, ROUND(LOG10(support), 6) AS log_support FROM contrast")
def contrast_derived(spark, sf_dir):
    """C11, H4: derived columns."""
    return contrast(spark, sf_dir).select("unit", "context", (-F.col("response").cast("double")).alias("neg_response"), F.round(F.log(F.col("response") + 0.5), 6).alias("log_response"), F.round(F.log10("support"), 6).alias("log_support"))


@query("contrast_robust_score", f"WITH {BASE} SELECT c.unit, c.context, ROUND(LN(1 + c.response) * CAST(c.gate AS INT) * CASE WHEN c.penalty_flag THEN 0.6::DOUBLE ELSE 1 END * (0.5 + 0.5 * b.reproducibility) * (b.n_signif_contexts / 3.0::DOUBLE), 3) AS score FROM contrast c JOIN breadth b ON c.unit = b.unit")
def contrast_robust_score(spark, sf_dir):
    """Composite score with group statistics as window aggregates."""
    return R.robust_score(contrast(spark, sf_dir)).select("unit", "context", "score")


@query("contrast_search", "SELECT p_partkey, p_name FROM part WHERE CONTAINS(UPPER(p_name), UPPER('re')) AND p_size <= 20")
def contrast_search(spark, sf_dir):
    """Case-insensitive substring search without wildcards, with an optional filter."""
    return table(spark, sf_dir, "part").where(F.upper("p_name").contains(F.upper(F.lit("re"))) & (F.col("p_size") <= 20)).select("p_partkey", "p_name")


@query("contrast_lookup", "SELECT c_custkey, c_mktsegment FROM customer WHERE UPPER(c_name) = UPPER('customer#000000007') OR c_mktsegment = UPPER('building')")
def contrast_lookup(spark, sf_dir):
    """Case-insensitive key lookup."""
    c = table(spark, sf_dir, "customer")
    return c.where((F.upper("c_name") == F.upper(F.lit("customer#000000007"))) | (F.col("c_mktsegment") == F.upper(F.lit("building")))).select("c_custkey", "c_mktsegment")


TRISTATE = f"{REPLICATES}, robust AS (SELECT unit, MIN(donor_corr) >= 0.0 AS robust FROM replicates GROUP BY unit)"


@query("contrast_tristate", f"WITH {TRISTATE} SELECT c_custkey AS unit, robust, COALESCE(CAST(robust AS VARCHAR), 'unknown') AS label FROM customer LEFT JOIN robust ON c_custkey = unit WHERE robust = FALSE OR robust IS NULL")
def contrast_tristate(spark, sf_dir):
    """A null flag is not a failed flag; both are told apart."""
    robust = replicates(spark, sf_dir).groupBy("unit").agg((F.min("donor_corr") >= 0.0).alias("robust"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("unit")).join(robust, "unit", "left")
    return c.where((F.col("robust") == F.lit(False)) | F.col("robust").isNull()).select("unit", "robust", F.coalesce(F.col("robust").cast("string"), F.lit("unknown")).alias("label"))


@query("contrast_interval_overlap", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderkey < 900 AND o_orderkey + 50 > 300")
def contrast_interval_overlap(spark, sf_dir):
    """C17: half-open intervals overlap."""
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'O' AND o_orderkey < 900 AND o_orderkey + 50 > 300").select("o_orderkey")


@query("contrast_sample", "SELECT o_orderkey FROM orders ORDER BY MD5('plot#' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 60")
def contrast_sample(spark, sf_dir):
    """Seeded sample of 60 rows by md5 order (a sampling operator: the limit is its feature)."""
    return table(spark, sf_dir, "orders").orderBy(X.seeded("plot", F.col("o_orderkey")), "o_orderkey").limit(60).select("o_orderkey")


@query("agg_global", f"WITH {CONTRAST} SELECT ROUND(AVG(response), 6) AS mean_response, MEDIAN(response) AS median_response, CAST(SUM(support) AS BIGINT) AS support, ROUND(AVG(CASE WHEN response = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_share, QUANTILE_CONT(response, 0.9) AS p90, QUANTILE_CONT(response, 0.99) AS p99 FROM contrast")
def agg_global(spark, sf_dir):
    """Scalars and exact interpolated quantiles."""
    df = contrast(spark, sf_dir)
    median, p90, p99 = (F.lit(q).cast("double") for q in O.quantiles(df, "response", [0.5, 0.9, 0.99]))
    plain = df.agg(F.round(F.avg("response"), 6).alias("mean_response"), F.sum("support").alias("support"), F.round(F.avg((F.col("response") == 0).cast("double")), 6).alias("zero_share"))
    return plain.select("mean_response", median.alias("median_response"), "support", "zero_share", p90.alias("p90"), p99.alias("p99"))


@query("agg_by_context", f"WITH {CONTRAST}, o(pos, context) AS (VALUES (1, 'N'), (2, 'A'), (3, 'R'), (4, 'X')) SELECT o.pos, o.context, ROUND(AVG(response), 6) AS mean_response, MEDIAN(response) AS median_response FROM o LEFT JOIN contrast c ON o.context = c.context GROUP BY 1, 2")
def agg_by_context(spark, sf_dir):
    """Mean and median in the order of a literal list; absent keys stay, with nulls."""
    order = spark.createDataFrame([(1, "N"), (2, "A"), (3, "R"), (4, "X")], "pos int, context string")
    g = contrast(spark, sf_dir).groupBy("context").agg(F.round(F.avg("response"), 6).alias("mean_response"), F.median("response").alias("median_response"))
    return order.join(g, "context", "left").select("pos", "context", "mean_response", "median_response")


@query("agg_size_histogram", f"WITH {CONTRAST} SELECT n AS contexts, CAST(COUNT(*) AS BIGINT) AS units FROM (SELECT unit, COUNT(*) AS n FROM contrast GROUP BY unit) GROUP BY n")
def agg_size_histogram(spark, sf_dir):
    """Counts of group sizes."""
    return contrast(spark, sf_dir).groupBy("unit").count().groupBy(F.col("count").alias("contexts")).agg(F.count(F.lit(1)).alias("units"))


@query("agg_unit_breadth", f"WITH {BASE} SELECT * FROM breadth")
def agg_unit_breadth(spark, sf_dir):
    """Distinct contexts, extremes, safe ratio, concentration, any-flag."""
    return R.unit_breadth(contrast(spark, sf_dir))


@query("agg_peak_context", f"WITH {CONTRAST} SELECT unit, context, response FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY unit ORDER BY response DESC, context) AS k FROM contrast) WHERE k = 1")
def agg_peak_context(spark, sf_dir):
    """Argmax row per unit with an explicit tie-break."""
    return R.peak_context(contrast(spark, sf_dir)).select("unit", "context", "response")


@query("agg_idxmax", f"WITH {CONTRAST} SELECT unit, FIRST(context ORDER BY response DESC, context) AS peak_context FROM contrast GROUP BY unit")
def agg_idxmax(spark, sf_dir):
    """Argmax as one aggregate: the greatest response, and of its contexts the least."""
    best = F.min_by("context", F.struct(-F.col("response"), "context"))
    return contrast(spark, sf_dir).groupBy("unit").agg(best.alias("peak_context"))


@query("agg_preferred_argmax", f"WITH {CONTRAST} SELECT unit, context, response FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY unit ORDER BY CASE WHEN context = 'A' THEN 0 ELSE 1 END, response DESC, context) AS k FROM contrast) WHERE k = 1")
def agg_preferred_argmax(spark, sf_dir):
    """The preferred context's row where there is one, else the largest."""
    w = Window.partitionBy("unit").orderBy(F.when(F.col("context") == "A", 0).otherwise(1), F.col("response").desc(), "context")
    return contrast(spark, sf_dir).withColumn("k", F.row_number().over(w)).where("k = 1").select("unit", "context", "response")


@query("agg_first_non_null", f"WITH {REPLICATES} SELECT unit, FIRST(guide_corr ORDER BY context) FILTER (WHERE guide_corr IS NOT NULL) AS guide, FIRST(donor_corr ORDER BY context) FILTER (WHERE donor_corr IS NOT NULL) AS donor FROM replicates GROUP BY unit")
def agg_first_non_null(spark, sf_dir):
    """First non-null value of each column on its own (not of one row)."""
    pick = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("context")))
    return replicates(spark, sf_dir).groupBy("unit").agg(pick("guide_corr").alias("guide"), pick("donor_corr").alias("donor"))


@query("agg_subset_test", f"WITH {CONTRAST} SELECT unit, LIST_SORT(LIST(DISTINCT context)) AS contexts FROM contrast WHERE gate GROUP BY unit HAVING COUNT(DISTINCT context) = 3")
def agg_subset_test(spark, sf_dir):
    """Units gated in all three contexts, with their sorted set."""
    g = contrast(spark, sf_dir).where("gate").groupBy("unit").agg(F.array_sort(F.collect_set("context")).alias("contexts"))
    return g.where(F.size("contexts") == 3)


@query("agg_coverage", f"WITH {CONTRAST}, {REPLICATES} SELECT CAST(COUNT(*) AS BIGINT) AS n_rows, CAST(COUNT(r.unit) AS BIGINT) AS n_joined, ROUND(100 * AVG(CASE WHEN guide_corr IS NOT NULL THEN 1.0 ELSE 0.0 END), 4) AS pct_guide, ROUND(100 * AVG(CASE WHEN donor_corr IS NOT NULL THEN 1.0 ELSE 0.0 END), 4) AS pct_donor FROM contrast c LEFT JOIN replicates r ON c.unit = r.unit AND c.context = r.context")
def agg_coverage(spark, sf_dir):
    """Rows, joined rows, share of non-null values."""
    r = replicates(spark, sf_dir).withColumn("there", F.lit(1))
    df = contrast(spark, sf_dir).join(r, ["unit", "context"], "left")
    pct = lambda c: F.round(100 * F.avg(F.col(c).isNotNull().cast("double")), 4)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count("there").alias("n_joined"), pct("guide_corr").alias("pct_guide"), pct("donor_corr").alias("pct_donor"))


@query("agg_best_score", "SELECT l_suppkey AS unit, ROUND(-LOG10(GREATEST(MIN(LEAST(l_discount + 0.001, l_tax + 0.001)), 1e-300)), 6) AS best FROM lineitem GROUP BY 1")
def agg_best_score(spark, sf_dir):
    """Least of two columns, least of the group, as minus log10."""
    low = F.min(F.least(F.col("l_discount") + 0.001, F.col("l_tax") + 0.001))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("unit")).agg(F.round(-F.log10(F.greatest(low, F.lit(1e-300))), 6).alias("best"))


@query("agg_max_abs", "SELECT c_nationkey AS unit, MAX(ABS(c_acctbal - 5000)) AS reach FROM customer GROUP BY 1")
def agg_max_abs(spark, sf_dir):
    """Greatest magnitude per unit."""
    return table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("unit")).agg(F.max(F.abs(F.col("c_acctbal") - 5000)).alias("reach"))


@query("agg_mode_share", "SELECT unit, value, n, ROUND(n / total, 6) AS share FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY unit ORDER BY n DESC, value) AS k, SUM(n) OVER (PARTITION BY unit) AS total FROM (SELECT c_nationkey AS unit, c_mktsegment AS value, CAST(COUNT(*) AS BIGINT) AS n FROM customer GROUP BY 1, 2)) WHERE k = 1")
def agg_mode_share(spark, sf_dir):
    """Dominant value of a group and its share."""
    counts = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("unit"), F.col("c_mktsegment").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("unit")
    k = F.row_number().over(w.orderBy(F.col("n").desc(), "value"))
    return counts.withColumns({"k": k, "total": F.sum("n").over(w)}).where("k = 1").select("unit", "value", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query("agg_dedup", "SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1")
def agg_dedup(spark, sf_dir):
    """First row per key by a total order (drop-duplicates without an order is not deterministic)."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("k", F.row_number().over(w)).where("k = 1").select("o_custkey", "o_orderkey", "o_orderdate")


@query("agg_variances", f"WITH {CONTRAST} SELECT context, ROUND(VAR_POP(response), 6) AS pop, ROUND(VAR_SAMP(response), 6) AS samp FROM contrast GROUP BY 1")
def agg_variances(spark, sf_dir):
    """Both variance conventions."""
    return contrast(spark, sf_dir).groupBy("context").agg(F.round(F.var_pop("response"), 6).alias("pop"), F.round(F.var_samp("response"), 6).alias("samp"))


@query("rank_classes", f"WITH {BASE} SELECT unit, CASE WHEN n_signif_contexts >= 2 AND condition_specificity < 0.6 THEN 'global' ELSE 'context_specific' END AS regulator_class FROM breadth")
def rank_classes(spark, sf_dir):
    """Global or context-specific."""
    return R.regulator_class(R.unit_breadth(contrast(spark, sf_dir))).select("unit", "regulator_class")


@query("rank_baselines", f"WITH {BASE}, p AS (SELECT unit, MAX(response) AS raw_peak, MAX(CASE WHEN gate THEN response END) AS gated_peak FROM contrast GROUP BY unit), b AS (SELECT p.unit, raw_peak, gated_peak, ROUND(u, 9) AS u FROM p LEFT JOIN posterior q ON p.unit = q.unit), r AS (SELECT unit, gated_peak, CASE WHEN raw_peak IS NOT NULL THEN CAST(RANK() OVER (ORDER BY raw_peak DESC NULLS LAST) AS BIGINT) END AS raw_rank, CASE WHEN gated_peak IS NOT NULL THEN CAST(RANK() OVER (ORDER BY gated_peak DESC NULLS LAST) AS BIGINT) END AS gated_rank, CASE WHEN u IS NOT NULL THEN CAST(RANK() OVER (ORDER BY u DESC NULLS LAST) AS BIGINT) END AS eb_rank FROM b) SELECT unit, raw_rank, gated_rank, eb_rank, gated_peak IS NULL AS dropped, raw_rank - eb_rank AS shift FROM r")
def rank_baselines(spark, sf_dir):
    """Raw, gated and shrunken ranks side by side."""
    df = written_contrast(spark, sf_dir)
    return R.baseline_comparison(df, posterior(spark, sf_dir, df=df))


REWEIGHT = f"""{BASE}, {REPLICATES},
meta AS (SELECT c.unit, AVG(guide_corr) AS guide, AVG(donor_corr) AS donor, AVG(CASE WHEN single THEN 1.0 WHEN NOT single THEN 0.0 END) AS single_frac FROM contrast c LEFT JOIN replicates r ON c.unit = r.unit AND c.context = r.context WHERE gate GROUP BY c.unit),
scored AS (SELECT r.unit, r.rank AS old_rank, donor, ROUND(u * COALESCE(CASE WHEN guide IS NOT NULL THEN LEAST(GREATEST(guide, 0), 1) END, 0.75) * COALESCE(CASE WHEN donor IS NOT NULL THEN LEAST(GREATEST(donor, 0), 1) END, 0.75) * (1 - 0.4::DOUBLE * COALESCE(single_frac, 1)), 9) AS score FROM ranked r LEFT JOIN meta m ON r.unit = m.unit),
audit AS (SELECT unit, old_rank, CAST(ROW_NUMBER() OVER (ORDER BY score DESC, unit) AS BIGINT) AS new_rank, score, donor IS NOT NULL AS donor_metadata FROM scored)"""


@query("rank_reweight", f"WITH {REWEIGHT} SELECT unit, old_rank, new_rank, old_rank - new_rank AS rank_shift, ROUND(score, 6) AS score, donor_metadata FROM audit")
def rank_reweight(spark, sf_dir):
    """Ranking reweighted by reproducibility."""
    return reweighted(spark, sf_dir)


def reweighted(spark, sf_dir):
    df, meta = written_evidence(spark, sf_dir)
    return R.reproducibility_reweight(df, meta, posterior(spark, sf_dir, df=df))


@query("rank_review", f"WITH {REWEIGHT}, a AS (SELECT *, old_rank - new_rank AS rank_shift FROM audit WHERE old_rank <= 30 OR new_rank <= 30), t AS (SELECT *, CONCAT_WS('; ', CASE WHEN NOT donor_metadata THEN 'no donor metadata' END, CASE WHEN rank_shift < -5 THEN 'falls ' || CAST(-rank_shift AS VARCHAR) || ' ranks' END, CASE WHEN rank_shift > 5 THEN 'rises ' || CAST(rank_shift AS VARCHAR) || ' ranks' END) AS r FROM a) SELECT unit, old_rank, new_rank, CASE WHEN old_rank <= 30 AND new_rank <= 30 THEN 'survives' WHEN old_rank <= 30 THEN 'demoted' ELSE 'promoted' END AS status, CASE WHEN r = '' THEN 'stable' ELSE r END AS reason FROM t")
def rank_review(spark, sf_dir):
    """Survivors, promoted and demoted units of the two top thirties."""
    return reviewed(reweighted(spark, sf_dir))


def reviewed(audit):
    return R.review_status(audit).select("unit", "old_rank", "new_rank", "status", "reason")


@query("rank_bootstrap", f"""WITH {BASE},
rows_ AS (SELECT CAST(ROW_NUMBER() OVER (ORDER BY unit, context) - 1 AS BIGINT) AS row_id, * FROM work),
slots AS (SELECT b, row_id AS i, (SELECT COUNT(*) FROM rows_) AS total FROM rows_, RANGE(20) t(b)),
sample AS (SELECT s.b, r.unit, r.gate, r.work FROM slots s JOIN rows_ r ON r.row_id = CAST('0x' || SUBSTR(MD5('boot#' || CAST(b AS VARCHAR) || '#' || CAST(i AS VARCHAR)), 1, 12) AS BIGINT) % total),
noise AS (SELECT b, VAR_POP(work) AS s2e FROM sample GROUP BY b),
bu AS (SELECT s.b, s.unit, AVG(work) AS d, MAX(s2e) / COUNT(*) AS s2 FROM sample s JOIN noise n ON s.b = n.b WHERE gate GROUP BY 1, 2),
bp AS (SELECT b, GREATEST(VAR_POP(d) - AVG(s2), 1e-6) AS tau2 FROM bu GROUP BY b),
br AS (SELECT bu.b, unit, ROW_NUMBER() OVER (PARTITION BY bu.b ORDER BY ROUND(d * tau2 / (tau2 + s2), 9) DESC, unit) AS r FROM bu JOIN bp ON bu.b = bp.b)
SELECT unit, CAST(COUNT(*) AS BIGINT) AS n_appearances, ROUND(AVG(CASE WHEN r <= 30 THEN 1.0 ELSE 0.0 END), 6) AS selection_frequency, QUANTILE_CONT(r, 0.5) AS median_rank, QUANTILE_CONT(r, 0.75) - QUANTILE_CONT(r, 0.25) AS rank_iqr FROM br GROUP BY unit""")
def rank_bootstrap(spark, sf_dir):
    """Seeded bootstrap of the ranking, all replicates in one job."""
    return bootstrap(spark, sf_dir, 20)


def bootstrap(spark, sf_dir, draws: int, df=None):
    nth = F.row_number().over(Window.partitionBy("unit").orderBy("context"))
    df = T.ranked(deviations(spark, sf_dir, df), ["unit"]).withColumn("row_id", (F.col("unit_below") + nth - 1).cast("long"))
    return B.stability(df.withColumn("uid", F.col("unit_below").cast("long")), draws)


@query("rank_bootstrap_full")
def rank_bootstrap_full(spark, sf_dir):
    """I17, R2, R3 with the reference's 200 replicates: the SQL is held against 20."""
    return bootstrap(spark, sf_dir, 200)


@query("rank_flag_sensitivity", f"""WITH {BASE},
cells0 AS (SELECT context, gate, AVG(response) AS mu FROM contrast GROUP BY 1, 2),
work0 AS (SELECT c.unit, c.gate, LN(response + 0.5) - LN(mu + 0.5) AS work FROM contrast c JOIN cells0 m ON c.context = m.context AND c.gate = m.gate),
units0 AS (SELECT unit, AVG(work) AS d, (SELECT VAR_POP(work) FROM work0) / COUNT(*) AS s2 FROM work0 WHERE gate GROUP BY unit),
prior0 AS (SELECT GREATEST(VAR_POP(d) - AVG(s2), 1e-6) AS tau2 FROM units0),
rank0 AS (SELECT unit, CAST(ROW_NUMBER() OVER (ORDER BY ROUND(tau2 / (tau2 + s2) * d, 9) DESC, unit) AS BIGINT) AS rank FROM units0, prior0)
SELECT ROUND(CORR(a.rank, b.rank), 6) AS rho, CAST(SUM(CASE WHEN a.rank <= 30 AND b.rank <= 30 THEN 1 ELSE 0 END) AS BIGINT) AS top_overlap, MAX(ABS(a.rank - b.rank)) AS largest_move FROM ranked a JOIN rank0 b ON a.unit = b.unit""")
def rank_flag_sensitivity(spark, sf_dir):
    """Does leaving the flag out of the baseline move the ranking? (Ranks are total orders: Spearman is Pearson of ranks.)"""
    df = contrast(spark, sf_dir)
    with_flag = R.ranked(posterior(spark, sf_dir)).select("unit", "rank")
    plain = df.groupBy("context", "gate").agg(F.avg("response").alias("mu"))
    without = R.ranked(R.shrink(R.log_deviation(df.join(F.broadcast(plain), ["context", "gate"])))).select("unit", F.col("rank").alias("rank0"))
    both = with_flag.join(without, "unit")
    return both.agg(F.round(F.corr("rank", "rank0"), 6).alias("rho"), F.sum(((F.col("rank") <= 30) & (F.col("rank0") <= 30)).cast("long")).alias("top_overlap"), F.max(F.abs(F.col("rank") - F.col("rank0"))).alias("largest_move"))
