"""Queries of edges, sets, rank statistics, enrichment and nulls, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions.kernels import hypergeometric_pmf, normal_sf, number
from quillon.operators import edges as D
from quillon.operators import ranking as R
from quillon.operators import sets as S
from quillon.operators import stats as T
from quillon.plans.bindings import CLASSES, EFFECTS, MEMBERSHIPS, PROFILES, classes, contrast, effects, memberships, profiles, table, written_contrast
from quillon.plans.ranking_queries import BASE, posterior
from quillon.plans.registry import query

B = number(D.BIG)
EDGES = f"""{EFFECTS},
valid AS (SELECT * FROM effects WHERE y IS NOT NULL AND se > 0),
tau AS (SELECT GREATEST(VAR_POP(y) - MEDIAN(se * se), 1e-6) AS tau2 FROM valid),
post AS (SELECT unit, feature, y, se, 1 / (1 / tau2 + 1 / (se * se)) AS v FROM valid, tau),
edge AS (SELECT unit, feature, y, se, v * y / (se * se) AS theta, SQRT(v) AS sd FROM post),
scored AS (SELECT *, {normal_sf('-theta / sd')} AS p_pos, {normal_sf(f'({B} - theta) / sd')} + {normal_sf(f'({B} + theta) / sd')} AS p_big FROM edge),
edges AS (SELECT * FROM scored WHERE p_big > 0.8)"""


def kept(spark, sf_dir):
    return D.edge_posterior(effects(spark, sf_dir))


@query("edge_posterior", f"WITH {EDGES} SELECT unit, feature, ROUND(theta, 6) AS theta, ROUND(sd, 6) AS sd, ROUND(p_pos, 6) AS p_pos, ROUND(p_big, 6) AS p_big FROM edges")
def edge_posterior(spark, sf_dir):
    """Likely big effects with posterior probabilities."""
    return kept(spark, sf_dir).select("unit", "feature", *[F.round(c, 6).alias(c) for c in ("theta", "sd", "p_pos", "p_big")])


def _summary_sql(by: str, member: str) -> str:
    return f"WITH {EDGES}, top AS (SELECT {by}, STRING_AGG(CAST({member} AS VARCHAR), '; ' ORDER BY k) AS strongest FROM (SELECT {by}, {member}, ROW_NUMBER() OVER (PARTITION BY {by} ORDER BY -ABS(ROUND(theta, 9)), CAST({member} AS VARCHAR)) AS k FROM edges) WHERE k <= 5 GROUP BY {by}) SELECT e.{by}, CAST(COUNT(*) AS BIGINT) AS n_edges, CAST(SUM(CASE WHEN theta > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_positive, CAST(SUM(CASE WHEN theta < 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_negative, ROUND(AVG(ABS(theta)), 6) AS mean_abs_theta, ROUND(MEDIAN(ABS(theta)), 6) AS median_abs_theta, MAX(strongest) AS strongest FROM edges e JOIN top t ON e.{by} = t.{by} GROUP BY e.{by}"


@query("edge_unit_summary", _summary_sql("unit", "feature"))
def edge_unit_summary(spark, sf_dir):
    """Edge summary per unit."""
    return D.edge_summary(kept(spark, sf_dir), "unit", "feature")


@query("edge_feature_summary", _summary_sql("feature", "unit"))
def edge_feature_summary(spark, sf_dir):
    """Edge summary per feature."""
    return D.edge_summary(kept(spark, sf_dir), "feature", "unit")


@query("edge_sign_pivot", f"WITH {EDGES} SELECT feature, CAST(SUM(CASE WHEN theta > 0 THEN 1 ELSE 0 END) AS BIGINT) AS pos, CAST(SUM(CASE WHEN theta > 0 THEN 0 ELSE 1 END) AS BIGINT) AS neg FROM edges GROUP BY feature")
def edge_sign_pivot(spark, sf_dir):
    """Signs pivoted to columns."""
    return D.sign_pivot(kept(spark, sf_dir), "feature")


@query("edge_recover_se", "SELECT l_orderkey, l_linenumber, CASE WHEN l_tax <> 0 THEN ROUND(ABS(l_discount / l_tax), 6) END AS se FROM lineitem WHERE l_tax = 0 OR l_discount > 0")
def edge_recover_se(spark, sf_dir):
    """Standard errors from value and z; zero z gives null."""
    df = table(spark, sf_dir, "lineitem").where("l_tax = 0 OR l_discount > 0").withColumnsRenamed({"l_discount": "y", "l_tax": "z"})
    return D.recover_se(df).select("l_orderkey", "l_linenumber", F.round("se", 6).alias("se"))


CONVERGENT = f"{EFFECTS}, {CLASSES}, hits AS (SELECT unit, feature FROM effects WHERE ABS(y) > 0.3), h AS (SELECT class, h.unit, feature FROM hits h JOIN classes c ON h.unit = c.unit), n AS (SELECT class, COUNT(DISTINCT unit) AS n_units FROM h GROUP BY 1), f AS (SELECT class, feature, COUNT(DISTINCT unit) AS n_hit FROM h GROUP BY 1, 2)"


@query("edge_convergent", f"WITH {CONVERGENT} SELECT f.class, feature, n_hit, n_units FROM f JOIN n ON f.class = n.class WHERE n_hit >= GREATEST(2, CEIL(n_units / 2.0 * 0.02))")
def edge_convergent(spark, sf_dir):
    """Features that a class converges on (share lowered to one in a hundred for these tables)."""
    hits = D.threshold_hits(effects(spark, sf_dir), 0.3).select("unit", "feature")
    h = hits.join(classes(spark, sf_dir), "unit")
    n = h.groupBy("class").agg(F.countDistinct("unit").alias("n_units"))
    found = h.groupBy("class", "feature").agg(F.countDistinct("unit").alias("n_hit")).join(n, "class")
    return found.where(F.col("n_hit") >= F.greatest(F.lit(2), F.ceil(F.col("n_units") / 2.0 * 0.02))).select("class", "feature", "n_hit", "n_units")


@query("edge_convergent_half", f"WITH {EFFECTS}, c AS (SELECT c_custkey AS unit, CAST(c_custkey // 3 AS VARCHAR) AS class FROM customer), h AS (SELECT class, e.unit, feature FROM effects e JOIN c ON e.unit = c.unit WHERE ABS(y) > {B} AND feature <> CAST(e.unit AS VARCHAR)), n AS (SELECT class, COUNT(DISTINCT unit) AS n_units FROM h GROUP BY 1), f AS (SELECT class, feature, COUNT(DISTINCT unit) AS n_hit FROM h GROUP BY 1, 2) SELECT f.class, feature, n_hit, n_units FROM f JOIN n ON f.class = n.class WHERE n_hit >= GREATEST(2, CEIL(n_units / 2.0))")
def edge_convergent_half(spark, sf_dir):
    """The operator's own rule (half of a class, two at least, no self-edges) on classes of three units."""
    trios = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("unit"), F.expr("CAST(c_custkey DIV 3 AS STRING)").alias("class"))
    return D.convergent_features(D.threshold_hits(effects(spark, sf_dir)), trios).select("class", "feature", "n_hit", "n_units")


@query("edge_direction", f"WITH {EFFECTS}, {CLASSES} SELECT class, CAST(COUNT(*) AS BIGINT) AS hits, ROUND(AVG(CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END), 6) AS up_share FROM effects e JOIN classes c ON e.unit = c.unit WHERE ABS(y) > {B} GROUP BY 1")
def edge_direction(spark, sf_dir):
    """Hits by effect size and the share that goes up."""
    h = D.threshold_hits(effects(spark, sf_dir)).join(classes(spark, sf_dir), "unit")
    return h.groupBy("class").agg(F.count(F.lit(1)).alias("hits"), F.round(F.avg(F.col("up").cast("double")), 6).alias("up_share"))


@query("edge_signed_hits", f"WITH {EFFECTS} SELECT unit, CAST(SUM(CASE WHEN y > {B} THEN 1 ELSE 0 END) AS BIGINT) AS up, CAST(SUM(CASE WHEN y < -{B} THEN 1 ELSE 0 END) AS BIGINT) AS down FROM effects WHERE feature LIKE 'ECONOMY%' OR feature LIKE 'PROMO%' GROUP BY unit")
def edge_signed_hits(spark, sf_dir):
    """Per unit, features of a set that go up and down."""
    df = effects(spark, sf_dir).where("feature LIKE 'ECONOMY%' OR feature LIKE 'PROMO%'")
    return df.groupBy("unit").agg(F.sum((F.col("y") > D.BIG).cast("long")).alias("up"), F.sum((F.col("y") < -D.BIG).cast("long")).alias("down"))


NULL_POOL = f"{BASE}, pool AS (SELECT unit AS id, CAST(response AS DOUBLE) AS value FROM contrast WHERE context = 'N' AND gate AND NOT penalty_flag AND response BETWEEN 0.8::DOUBLE * (SELECT MIN(response) FROM contrast WHERE context = 'N' AND gate AND penalty_flag) AND 1.2::DOUBLE * (SELECT MAX(response) FROM contrast WHERE context = 'N' AND gate AND penalty_flag)), tested AS (SELECT ROUND(AVG(CAST(response AS DOUBLE)), 9) AS observed FROM contrast WHERE context = 'N' AND gate AND penalty_flag)"


@query("edge_matched_null", f"WITH {NULL_POOL}, d AS (SELECT b, value, ROW_NUMBER() OVER (PARTITION BY b ORDER BY MD5('null#' || CAST(b AS VARCHAR) || '#' || CAST(id AS VARCHAR)), id) AS k FROM pool, RANGE(30) t(b)), m AS (SELECT b, ROUND(AVG(value), 9) AS m FROM d WHERE k <= 25 GROUP BY b) SELECT ROUND(MAX(observed), 6) AS observed, ROUND(AVG(m), 6) AS null_mean, ROUND(STDDEV_POP(m), 6) AS null_sd, ROUND((MAX(observed) - AVG(m)) / (STDDEV_POP(m) + 1e-9), 4) AS z, ROUND((SUM(CASE WHEN m >= observed THEN 1 ELSE 0 END) + 1) / (COUNT(*) + 1.0::DOUBLE), 6) AS p, ROUND(QUANTILE_CONT(m, 0.95), 6) AS p95 FROM m, tested")
def edge_matched_null(spark, sf_dir):
    """Observed mean against seeded draws from the pool of untested rows whose effect lies in 0.8 to 1.2 of the tested range."""
    return matched(spark, sf_dir, 30)


def matched(spark, sf_dir, draws: int):
    df = contrast(spark, sf_dir).where("context = 'N' AND gate")
    reach = df.where("penalty_flag").agg((F.min("response") * 0.8).alias("lo"), (F.max("response") * 1.2).alias("hi"))
    pool = df.where("NOT penalty_flag").crossJoin(F.broadcast(reach)).where("response BETWEEN lo AND hi").select(F.col("unit").alias("id"), F.col("response").cast("double").alias("value"))
    seen = df.where("penalty_flag").agg(F.round(F.avg(F.col("response").cast("double")), 9).alias("observed"))
    return D.matched_null(pool, 25, draws, seen)


@query("edge_matched_null_full")
def edge_matched_null_full(spark, sf_dir):
    """I15 with the reference's 500 draws: the SQL is held against 30."""
    return matched(spark, sf_dir, 500)


@query("edge_verdict", f"WITH {EFFECTS}, {CLASSES}, s AS (SELECT class, COUNT(*) AS hits, AVG(CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END) AS up FROM effects e JOIN classes c ON e.unit = c.unit WHERE ABS(y) > {B} GROUP BY 1) SELECT class, CASE WHEN hits >= (SELECT AVG(hits) FROM s) THEN CASE WHEN up > 0.5 THEN 'specific up' ELSE 'specific down' END WHEN up > 0.5 THEN 'direction only' ELSE 'none' END AS verdict FROM s")
def edge_verdict(spark, sf_dir):
    """I16: two-level verdict of magnitude and direction."""
    h = D.threshold_hits(effects(spark, sf_dir)).join(classes(spark, sf_dir), "unit")
    s = h.groupBy("class").agg(F.count(F.lit(1)).alias("hits"), F.avg(F.col("up").cast("double")).alias("share"))
    s = s.crossJoin(F.broadcast(s.agg(F.avg("hits").alias("mean"))))
    up = F.col("share") > 0.5
    rule = F.when(F.col("hits") >= F.col("mean"), F.when(up, "specific up").otherwise("specific down")).when(up, "direction only").otherwise("none")
    return s.select("class", rule.alias("verdict"))


SPECIFIC = f"""{EFFECTS}, {CLASSES}, h AS (SELECT class, CAST(COUNT(*) AS DOUBLE) AS hits, AVG(CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END) AS up FROM effects e JOIN classes c ON e.unit = c.unit WHERE ABS(y) > {B} GROUP BY 1),
q AS (SELECT a.class, MAX(a.hits) AS fold, AVG(b.hits) AS null_fold, MAX(a.up) AS up, AVG(b.up) AS null_up, (SUM(CASE WHEN b.hits >= a.hits THEN 1 ELSE 0 END) + 1) / (COUNT(*) + 1.0::DOUBLE) AS p, MAX(b.hits) AS other_fold FROM h a JOIN h b ON a.class <> b.class GROUP BY 1)"""


@query("edge_specificity", f"""WITH {SPECIFIC} SELECT class, ROUND(fold, 6) AS fold, ROUND(p, 6) AS p, p < 0.05 AND fold >= 2 * null_fold AS magnitude_specific, up >= 0.85 AND up - null_up >= 0.25 AS direction_specific,
CASE WHEN p < 0.05 AND fold >= 2 * null_fold AND up >= 0.85 AND up - null_up >= 0.25 THEN 'specific' WHEN p < 0.05 OR up - null_up >= 0.15 THEN 'largely general' WHEN other_fold >= 2 * null_fold THEN 'general' ELSE 'none' END AS verdict FROM q""")
def edge_specificity(spark, sf_dir):
    """I16: magnitude and direction specificity of each class against the others, by the published thresholds."""
    h = D.threshold_hits(effects(spark, sf_dir)).join(classes(spark, sf_dir), "unit")
    h = h.groupBy("class").agg(F.count(F.lit(1)).cast("double").alias("hits"), F.avg(F.col("up").cast("double")).alias("up"))
    o = h.select(F.col("class").alias("other"), F.col("hits").alias("o_hits"), F.col("up").alias("o_up"))
    q = h.join(o, F.col("class") != F.col("other")).groupBy("class").agg(  # a row a class
        F.max("hits").alias("fold"), F.avg("o_hits").alias("null_fold"), F.max("up").alias("up"), F.avg("o_up").alias("null_up"),
        ((F.sum((F.col("o_hits") >= F.col("hits")).cast("long")) + 1) / (F.count(F.lit(1)) + 1.0)).alias("p"), F.max("o_hits").alias("other_fold"),
    )
    return D.specificity(q).select("class", F.round("fold", 6).alias("fold"), F.round("p", 6).alias("p"), "magnitude_specific", "direction_specific", "verdict")


BRANDS = "brands AS (SELECT DISTINCT c_mktsegment AS set_name, l_partkey AS member FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_quantity > 48)"


def brands(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 48").select("l_orderkey", F.col("l_partkey").alias("member"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("set_name"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select("set_name", "member").distinct()


JACCARD = f"{BRANDS}, z AS (SELECT set_name, COUNT(*) AS n FROM brands GROUP BY 1), i AS (SELECT a.set_name AS a, b.set_name AS b, COUNT(*) AS inter FROM brands a JOIN brands b ON a.member = b.member GROUP BY 1, 2), j AS (SELECT x.set_name AS a, y.set_name AS b, CAST(COALESCE(inter, 0) AS BIGINT) AS inter, ROUND(COALESCE(COALESCE(inter, 0) / NULLIF(CAST(x.n + y.n - COALESCE(inter, 0) AS DOUBLE), 0), 0), 6) AS jaccard FROM z x JOIN z y ON x.set_name < y.set_name LEFT JOIN i ON i.a = x.set_name AND i.b = y.set_name)"


@query("set_jaccard", f"WITH {JACCARD} SELECT * FROM j")
def set_jaccard(spark, sf_dir):
    """Jaccard similarity of class programs by an equi-join on members."""
    return S.jaccard(brands(spark, sf_dir))


@query("set_jaccard_median", f"WITH {JACCARD} SELECT MEDIAN(jaccard) AS median_jaccard FROM j")
def set_jaccard_median(spark, sf_dir):
    """Median off-diagonal Jaccard."""
    return S.jaccard(brands(spark, sf_dir)).agg(F.median("jaccard").alias("median_jaccard"))


@query("set_subsumption", f"WITH {BRANDS}, z AS (SELECT set_name, COUNT(*) AS n FROM brands GROUP BY 1) SELECT a.set_name AS a, b.set_name AS b, ROUND(CAST(COUNT(*) AS DOUBLE) / MAX(z.n), 6) AS fraction FROM brands a JOIN brands b ON a.member = b.member JOIN z ON z.set_name = b.set_name GROUP BY 1, 2")
def set_subsumption(spark, sf_dir):
    """Asymmetric overlap."""
    b = brands(spark, sf_dir)
    return S.subsumption(b, b)


@query("set_algebra", f"WITH {BRANDS}, a AS (SELECT member FROM brands WHERE set_name = 'BUILDING'), b AS (SELECT member FROM brands WHERE set_name = 'MACHINERY') SELECT 'both' AS part, member FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'either', member FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'first', member FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def set_algebra(spark, sf_dir):
    """Intersection, union, difference, concatenation."""
    df = brands(spark, sf_dir)
    a, b = (df.where(F.col("set_name") == n).select("member") for n in ("BUILDING", "MACHINERY"))
    named = lambda x, part: x.select(F.lit(part).alias("part"), "member")
    return named(a.intersect(b), "both").unionByName(named(a.union(b).distinct(), "either")).unionByName(named(a.subtract(b), "first"))


@query("set_first_wins", f"WITH {BASE}, s AS (SELECT unit, 'top' AS source, 0 AS p FROM ranked WHERE rank <= 40 UNION ALL SELECT unit, 'flagged', 1 FROM contrast WHERE penalty_flag UNION ALL SELECT unit, 'any', 2 FROM contrast) SELECT unit, source FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY unit ORDER BY p, source) AS k FROM s) WHERE k = 1")
def set_first_wins(spark, sf_dir):
    """The first of ordered sources wins a unit."""
    df = contrast(spark, sf_dir)
    top = R.ranked(posterior(spark, sf_dir)).where("rank <= 40").select("unit", F.lit("top").alias("source"))
    return S.first_wins(top, df.where("penalty_flag").select("unit", F.lit("flagged").alias("source")), df.select("unit", F.lit("any").alias("source")))


@query("set_top_overlap", f"WITH {BASE}, raw AS (SELECT unit, ROW_NUMBER() OVER (ORDER BY MAX(response) DESC, unit) AS rank FROM contrast GROUP BY unit) SELECT CAST(COUNT(*) AS BIGINT) AS overlap FROM ranked r JOIN raw ON r.unit = raw.unit WHERE r.rank <= 100 AND raw.rank <= 100")
def set_top_overlap(spark, sf_dir):
    """Overlap of two top hundreds."""
    from pyspark.sql import Window

    raw = contrast(spark, sf_dir).groupBy("unit").agg(F.max("response").alias("m")).withColumn("rank", F.row_number().over(Window.orderBy(F.col("m").desc(), "unit")))
    return R.top_overlap(R.ranked(posterior(spark, sf_dir)), raw, 100)


def avg_rank_sql(c: str, part: str = "") -> str:
    p = f"PARTITION BY {part} " if part else ""
    both = f"{part}, {c}" if part else c
    return f"(RANK() OVER ({p}ORDER BY {c}) + (COUNT(*) OVER (PARTITION BY {both}) - 1) / 2.0::DOUBLE)"


SPEARMAN = "CASE WHEN STDDEV_POP(rx) > 0 AND STDDEV_POP(ry) > 0 THEN ROUND(CORR(rx, ry), 6) END"


@query("stat_spearman", f"WITH {BASE}, r AS (SELECT context, {avg_rank_sql('support', 'context')} AS rx, {avg_rank_sql('response', 'context')} AS ry FROM contrast) SELECT context, CAST(COUNT(*) AS BIGINT) AS n, {SPEARMAN} AS rho FROM r GROUP BY context")
def stat_spearman(spark, sf_dir):
    """Spearman correlation per context, ties by average rank."""
    return T.spearman(contrast(spark, sf_dir), "support", "response", ["context"])


@query("stat_rank_kinds", f"WITH {BASE} SELECT unit, context, {avg_rank_sql('response', 'context')} AS average_rank, CAST(FLOOR({avg_rank_sql('response', 'context')}) AS BIGINT) AS truncated_rank, ROUND({avg_rank_sql('response', 'context')} / COUNT(*) OVER (PARTITION BY context), 9) AS pct_rank, CAST(ROW_NUMBER() OVER (PARTITION BY context ORDER BY response, unit) AS BIGINT) AS first_rank FROM contrast")
def stat_rank_kinds(spark, sf_dir):
    """Average, truncated, percentile and positional ranks."""
    from pyspark.sql import Window

    from quillon.functions import exprs as X

    avg = X.average_rank(F.col("response"), ["context"])
    first = F.row_number().over(Window.partitionBy("context").orderBy("response", "unit")).cast("long")
    return contrast(spark, sf_dir).select("unit", "context", avg.alias("average_rank"), F.floor(avg).cast("long").alias("truncated_rank"), F.round(X.percentile_rank(F.col("response"), ["context"]), 9).alias("pct_rank"), first.alias("first_rank"))


@query("stat_effect_metrics", "WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS p FROM embeddings), m AS (SELECT vec_id, label, LIST_SUM(LIST_TRANSFORM(p, lambda x: ABS(x))) AS l1, SQRT(LIST_SUM(LIST_TRANSFORM(p, lambda x: x * x))) AS l2, CAST(LEN(LIST_FILTER(p, lambda x: ABS(x) > 0.2)) AS DOUBLE) AS n_big, LIST_AVG(p) AS mean FROM e), u AS (SELECT 'l1' AS metric, ROUND(l1, 6) AS x, label AS y FROM m UNION ALL SELECT 'l2', ROUND(l2, 6), label FROM m UNION ALL SELECT 'mean', ROUND(mean, 6), label FROM m UNION ALL SELECT 'n_big', n_big, label FROM m), r AS (SELECT metric, " + avg_rank_sql("x", "metric") + " AS rx, " + avg_rank_sql("y", "metric") + f" AS ry FROM u) SELECT metric, CAST(COUNT(*) AS BIGINT) AS n, {SPEARMAN} AS rho FROM r GROUP BY metric")
def stat_effect_metrics(spark, sf_dir):
    """Row summaries of the profile, unpivoted, each correlated with another column."""
    from quillon.functions import exprs as X

    p = table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("p"))
    m = p.select("label", F.round(X.array_sum(F.transform("p", F.abs)), 6).alias("l1"), F.round(X.norm(F.col("p")), 6).alias("l2"), F.size(F.filter("p", lambda x: F.abs(x) > 0.2)).cast("double").alias("n_big"), F.round(X.array_sum(F.col("p")) / F.size("p"), 6).alias("mean"))
    return T.spearman(m.unpivot(["label"], ["l1", "l2", "n_big", "mean"], "metric", "x").withColumnRenamed("label", "y"), "x", "y", ["metric"])


@query("stat_mann_whitney", f"WITH {BASE}, t AS (SELECT response AS v, penalty_flag AS g FROM contrast WHERE context = 'R'), r AS (SELECT g, v, {avg_rank_sql('v')} AS r FROM t), k AS (SELECT SUM(c * c * c - c) AS ties FROM (SELECT CAST(COUNT(*) AS DOUBLE) AS c FROM r GROUP BY v)), s AS (SELECT CAST(COUNT(*) FILTER (WHERE g) AS DOUBLE) AS n1, CAST(COUNT(*) FILTER (WHERE NOT g) AS DOUBLE) AS n2, SUM(r) FILTER (WHERE g) AS r1 FROM r), u AS (SELECT n1, n2, r1 - n1 * (n1 + 1) / 2 AS u, ties FROM s, k), z AS (SELECT n1, n2, u, (u - n1 * n2 / 2 - 0.5) / SQRT(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM u) SELECT n1, n2, ROUND(u, 3) AS u, ROUND(z, 6) AS z, ROUND({normal_sf('z')}, 6) AS p FROM z")
def stat_mann_whitney(spark, sf_dir):
    """One-sided U test with ties."""
    return T.mann_whitney(contrast(spark, sf_dir).where("context = 'R'"), "response", "penalty_flag")


ENRICH = f"""{BASE}, {MEMBERSHIPS},
bg AS (SELECT DISTINCT unit AS member FROM contrast), dr AS (SELECT unit AS member FROM ranked WHERE rank <= 100),
tot AS (SELECT (SELECT COUNT(*) FROM bg) AS M, (SELECT COUNT(*) FROM dr) AS n),
per AS (SELECT set_name, CAST(COUNT(b.member) AS BIGINT) AS K, CAST(COUNT(CASE WHEN b.member IS NOT NULL THEN d.member END) AS BIGINT) AS x FROM memberships m LEFT JOIN bg b ON m.member = b.member LEFT JOIN dr d ON m.member = d.member GROUP BY 1),
pp AS (SELECT * FROM per, tot),
tail AS (SELECT set_name, SUM({hypergeometric_pmf('i', 'M', 'K', 'n')}) AS t FROM (SELECT *, UNNEST(RANGE(x, LEAST(K, n) + 1)) AS i FROM pp WHERE x > 0) q WHERE n - i <= M - K GROUP BY 1),
en AS (SELECT p.set_name, x AS n_overlap, K AS set_size, n AS n_drawn, M AS background_size, LEAST(COALESCE(t, 1), 1) AS p, ROUND(COALESCE(x * M / NULLIF(CAST(n * K AS DOUBLE), 0), 0), 2) AS fold FROM pp p LEFT JOIN tail ON p.set_name = tail.set_name)"""


def enriched(spark, sf_dir, df=None):
    """Of the contrasts ``df``, where they are already made."""
    df = written_contrast(spark, sf_dir) if df is None else df
    drawn = R.ranked(posterior(spark, sf_dir, df=df)).where("rank <= 100").select(F.col("unit").alias("member"))
    background = df.select(F.col("unit").alias("member"))
    return T.enrichment(drawn, memberships(spark, sf_dir), background)


@query("stat_enrichment", f"WITH {ENRICH} SELECT set_name, n_overlap, set_size, n_drawn, background_size, ROUND(p, 9) AS p, fold FROM en")
def stat_enrichment(spark, sf_dir):
    """Hypergeometric enrichment of sets among top units."""
    return enriched(spark, sf_dir).withColumn("p", F.round("p", 9))


@query("stat_enrichment_fdr", f"WITH {ENRICH}, q AS (SELECT set_name, ROUND(p, 9) AS p FROM en), s AS (SELECT set_name, p, p * COUNT(*) OVER () / ROW_NUMBER() OVER (ORDER BY p, set_name) AS st FROM q) SELECT set_name, p, ROUND(LEAST(MIN(st) OVER (ORDER BY p DESC, set_name DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1), 6) AS fdr FROM s")
def stat_enrichment_fdr(spark, sf_dir):
    """Benjamini-Hochberg step-up over the family of sets."""
    return T.benjamini_hochberg(enriched(spark, sf_dir).select("set_name", F.round("p", 9).alias("p"))).withColumn("fdr", F.round("fdr", 6))


@query("stat_concordance", f"WITH {BASE}, b AS (SELECT r.unit, ROUND(r.u, 9) AS x, CAST(t.total AS DOUBLE) AS y FROM ranked r JOIN breadth t ON r.unit = t.unit), n AS (SELECT CAST(COUNT(*) AS BIGINT) AS n, CAST(LEAST(100, FLOOR(COUNT(*) / 3.0)) AS BIGINT) AS k FROM b), p AS (SELECT ROW_NUMBER() OVER (ORDER BY x DESC, unit) AS px, ROW_NUMBER() OVER (ORDER BY y DESC, unit) AS py, {avg_rank_sql('x')} AS rx, {avg_rank_sql('y')} AS ry FROM b), h AS (SELECT n, k, CAST(SUM(CASE WHEN px <= k AND py <= k THEN 1 ELSE 0 END) AS BIGINT) AS overlap FROM p, n GROUP BY 1, 2), t AS (SELECT SUM({hypergeometric_pmf('i', 'n', 'k', 'k')}) AS t FROM (SELECT *, UNNEST(RANGE(overlap, k + 1)) AS i FROM h) q WHERE k - i <= n - k) SELECT n, k, overlap, (SELECT {SPEARMAN} FROM p) AS rho, ROUND(LEAST(t, 1), 6) AS p FROM h, t")
def stat_concordance(spark, sf_dir):
    """Two rankings of the same units."""
    a = posterior(spark, sf_dir).select("unit", F.round("u", 9).alias("score"))
    b = R.unit_breadth(contrast(spark, sf_dir)).select("unit", F.col("total").cast("double").alias("score"))
    return T.concordance(a, b)


@query("stat_cohesion_null", f"WITH {PROFILES}, z AS (SELECT unit, SQRT(LIST_SUM(LIST_TRANSFORM(profile, lambda x: x * x))) AS nn, profile FROM profiles), uv AS (SELECT unit, UNNEST(RANGE(64)) AS d, UNNEST(profile) / CASE WHEN nn = 0 THEN 1 ELSE nn END AS v FROM z), mem AS (SELECT program AS set_name, unit FROM profiles), sz AS (SELECT set_name, CAST(COUNT(*) AS BIGINT) AS m FROM mem GROUP BY 1 HAVING COUNT(*) >= 2), seen AS (SELECT q.set_name, m, ROUND((SUM(s * s) - m) / (m * (m - 1)), 9) AS observed FROM (SELECT set_name, d, SUM(v) AS s FROM mem JOIN uv ON mem.unit = uv.unit GROUP BY 1, 2) q JOIN sz ON q.set_name = sz.set_name GROUP BY 1, 2), rk AS (SELECT unit, b, ROW_NUMBER() OVER (PARTITION BY b ORDER BY MD5('cohesion#' || CAST(b AS VARCHAR) || '#' || CAST(unit AS VARCHAR)), unit) AS k FROM profiles, RANGE(20) t(b)), nl AS (SELECT q.set_name, b, ROUND((SUM(s * s) - m) / (m * (m - 1)), 9) AS v FROM (SELECT set_name, b, m, d, SUM(v) AS s FROM rk JOIN sz ON k <= m JOIN uv ON rk.unit = uv.unit GROUP BY 1, 2, 3, 4) q GROUP BY q.set_name, b, m) SELECT n.set_name, m, ROUND(observed, 6) AS observed, ROUND(AVG(v), 6) AS null_mean, ROUND((observed - AVG(v)) / (STDDEV_POP(v) + 1e-9), 3) AS z, ROUND((SUM(CASE WHEN v >= observed THEN 1 ELSE 0 END) + 1) / (COUNT(*) + 1.0::DOUBLE), 6) AS p FROM nl n JOIN seen s ON n.set_name = s.set_name GROUP BY 1, 2, observed")
def stat_cohesion_null(spark, sf_dir):
    """Cohesion of sets against seeded draws, without forming pairs."""
    return cohesion(spark, sf_dir, 20)


def cohesion(spark, sf_dir, draws: int):
    df = profiles(spark, sf_dir)
    return T.cohesion_null(df, df.select(F.col("program").alias("set_name"), "unit"), draws)


@query("stat_cohesion_null_full")
def stat_cohesion_null_full(spark, sf_dir):
    """I23, R4 with the reference's 5,000 draws: too many for the SQL, which is held against 20."""
    return cohesion(spark, sf_dir, 5000)


@query("stat_stratified_load", "WITH u AS (SELECT c_custkey AS unit, ROUND(ABS(c_acctbal), 2) AS score, CAST(LENGTH(c_mktsegment) * 1000 + c_custkey % 700 AS DOUBLE) AS size FROM customer), e AS (SELECT LIST_SORT(LIST_DISTINCT(QUANTILE_CONT(size, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]))) AS cuts FROM u), s AS (SELECT unit, score, CAST(LEN(LIST_FILTER(cuts, lambda c: c < size)) AS INT) AS stratum FROM u, e), mem AS (SELECT CAST(c_nationkey AS VARCHAR) AS set_name, c_custkey AS unit FROM customer ), nd AS (SELECT set_name, stratum, COUNT(*) AS need, SUM(score) AS load FROM mem JOIN s ON mem.unit = s.unit GROUP BY 1, 2), seen AS (SELECT set_name, SUM(load) AS observed FROM nd GROUP BY 1), rk AS (SELECT b, stratum, score, ROW_NUMBER() OVER (PARTITION BY b, stratum ORDER BY MD5('load#' || CAST(b AS VARCHAR) || '#' || CAST(unit AS VARCHAR)), unit) AS k FROM s, RANGE(20) t(b)), nl AS (SELECT set_name, b, ROUND(SUM(score), 4) AS v FROM rk JOIN nd ON rk.stratum = nd.stratum AND k <= need GROUP BY 1, 2) SELECT n.set_name, ROUND(observed, 4) AS observed, ROUND(AVG(v), 4) AS null_mean, ROUND(AVG(CASE WHEN v >= ROUND(observed, 4) THEN 1.0 ELSE 0.0 END), 6) AS p FROM nl n JOIN seen s ON n.set_name = s.set_name GROUP BY 1, observed")
def stat_stratified_load(spark, sf_dir):
    """Loads of sets against draws that match the deciles of their members."""
    return load(spark, sf_dir, 20)


def load(spark, sf_dir, draws: int):
    c = table(spark, sf_dir, "customer")
    u = c.select(F.col("c_custkey").alias("unit"), F.round(F.abs("c_acctbal"), 2).alias("score"), (F.length("c_mktsegment") * 1000 + F.col("c_custkey") % 700).cast("double").alias("size"))
    members = c.select(F.col("c_nationkey").cast("string").alias("set_name"), F.col("c_custkey").alias("unit"))
    return T.stratified_load(T.decile_edges(u, "size").select("unit", "score", "stratum"), members, draws)


@query("stat_stratified_load_full")
def stat_stratified_load_full(spark, sf_dir):
    """I28, W15 with the reference's 10,000 draws: too many for the SQL, which is held against 20."""
    return load(spark, sf_dir, 10000)
