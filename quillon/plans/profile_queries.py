"""Queries of profiles, tensors and graphs, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import exprs as X
from quillon.operators import graph as G
from quillon.operators import profiles as P
from quillon.operators import ranking as R
from quillon.plans.bindings import CONTRAST, PROFILES, contrast, profiles, replicates, table
from quillon.plans.effect_queries import SPEARMAN, avg_rank_sql
from quillon.plans.ranking_queries import REWEIGHT, posterior
from quillon.plans.registry import query

NORM = "SQRT(LIST_SUM(LIST_TRANSFORM(profile, lambda x: x * x)))"
KNN = f"""{PROFILES}, p AS (SELECT unit, program, profile FROM profiles),
sim AS (SELECT a.unit AS a, b.unit AS b, ROUND(LIST_COSINE_SIMILARITY(a.profile, b.profile), 6) AS similarity FROM p a JOIN p b ON a.unit <> b.unit),
knn AS (SELECT * FROM (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY a ORDER BY similarity DESC, b) AS BIGINT) AS rank FROM sim) WHERE rank <= 8),
edges AS (SELECT LEAST(a, b) AS src, GREATEST(a, b) AS dst, MAX(similarity) AS weight FROM knn GROUP BY 1, 2)"""


def panel(spark, sf_dir):
    """The units that are compared: all of the table."""
    return profiles(spark, sf_dir)


def knn(spark, sf_dir):
    return P.neighbours(panel(spark, sf_dir))


@query("profile_similarity", f"WITH {KNN} SELECT * FROM sim")
def profile_similarity(spark, sf_dir):
    """Cosine of all ordered pairs of a panel."""
    return P.similarities(panel(spark, sf_dir))


@query("profile_knn", f"WITH {KNN} SELECT a, b, similarity, rank FROM knn")
def profile_knn(spark, sf_dir):
    """Nearest neighbours."""
    return knn(spark, sf_dir)


@query("profile_knn_edges", f"WITH {KNN} SELECT * FROM edges")
def profile_knn_edges(spark, sf_dir):
    """Undirected neighbour edges."""
    return P.neighbour_edges(knn(spark, sf_dir))


@query("profile_coherence", f"WITH {KNN} SELECT a AS unit, ROUND(AVG(similarity), 9) AS mean_similarity, ARG_MIN(b, rank) AS nearest, ROUND(AVG(CASE WHEN x.program = y.program THEN 1.0 ELSE 0.0 END), 6) AS own_share FROM knn JOIN p x ON x.unit = a JOIN p y ON y.unit = b GROUP BY a")
def profile_coherence(spark, sf_dir):
    """V8: neighbourhood coherence."""
    return P.coherence(knn(spark, sf_dir), panel(spark, sf_dir).select("unit", "program"))


LOO = f"""{PROFILES}, lg AS (SELECT unit, program, UNNEST(RANGE(64)) AS d, UNNEST(profile) AS x FROM profiles),
sm AS (SELECT program, d, SUM(x) AS s, COUNT(*) AS n FROM lg GROUP BY 1, 2),
ct AS (SELECT l.unit, l.program, sm.program AS candidate, x, CASE WHEN l.program = sm.program THEN (s - x) / (n - 1) ELSE s / n END AS c FROM lg l JOIN sm ON l.d = sm.d WHERE l.program <> sm.program OR n > 1),
cs AS (SELECT unit, program, candidate, ROUND(COALESCE(SUM(c * x) / NULLIF(SQRT(SUM(c * c)) * SQRT(SUM(x * x)), 0), 0), 6) AS cosine FROM ct GROUP BY 1, 2, 3),
rk AS (SELECT *, ROW_NUMBER() OVER w AS k, LEAD(cosine) OVER w AS second FROM cs WINDOW w AS (PARTITION BY unit ORDER BY cosine DESC, candidate)),
loo AS (SELECT unit, program, candidate AS best, cosine, ROUND(cosine - COALESCE(second, -1), 6) AS margin FROM rk WHERE k = 1)"""


@query("profile_loo_centroid", f"WITH {LOO} SELECT *, CASE WHEN cosine >= 0.25 AND margin >= 0.05 THEN best ELSE 'mixed' END AS assigned FROM loo")
def profile_loo_centroid(spark, sf_dir):
    """V9: leave-one-out centroid programs (least cosine 0.25: these vectors have little structure)."""
    return P.leave_one_out(profiles(spark, sf_dir), 0.25, 0.05)


MARK = f"""{PROFILES}, lg AS (SELECT program, UNNEST(RANGE(64)) AS feature, UNNEST(profile) AS x FROM profiles),
m AS (SELECT program, CAST(feature AS INT) AS feature, ROUND(AVG(x), 9) AS mean, COUNT(*) AS n, SUM(CASE WHEN x > 0 THEN 1 ELSE 0 END) AS up, SUM(CASE WHEN x < 0 THEN 1 ELSE 0 END) AS down FROM lg GROUP BY 1, 2),
c AS (SELECT program, feature, mean, CASE WHEN mean > 0 THEN 'up' ELSE 'down' END AS direction, ROUND(CAST(CASE WHEN mean > 0 THEN up ELSE down END AS DOUBLE) / n, 6) AS consistency FROM m WHERE mean <> 0),
k AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY program, direction ORDER BY ABS(mean) DESC, feature) AS BIGINT) AS rank FROM c WHERE consistency >= 0.55)"""


@query("profile_markers", f"WITH {MARK} SELECT program, direction, rank, feature, ROUND(mean, 6) AS mean, consistency FROM k WHERE rank <= 12")
def profile_markers(spark, sf_dir):
    """Markers of each program, twelve each way."""
    return P.markers(profiles(spark, sf_dir), 12, 0.55)


@query("profile_evidence", f"WITH {MARK}, t AS (SELECT program, direction, STRING_AGG(CAST(feature AS VARCHAR), ';' ORDER BY rank) AS features FROM k WHERE rank <= 12 GROUP BY 1, 2), s AS (SELECT program, CAST(COUNT(*) AS BIGINT) AS members FROM profiles GROUP BY 1) SELECT s.program, members, COALESCE(u.features, '') AS up, COALESCE(d.features, '') AS down FROM s LEFT JOIN t u ON s.program = u.program AND u.direction = 'up' LEFT JOIN t d ON s.program = d.program AND d.direction = 'down'")
def profile_evidence(spark, sf_dir):
    """One row of evidence per program, marker lists joined as text."""
    df = profiles(spark, sf_dir)
    m = P.markers(df, 12, 0.55)
    listed = lambda d: F.array_sort(F.collect_list(F.when(F.col("direction") == d, F.struct("rank", "feature"))))
    text = lambda d: F.concat_ws(";", F.transform(listed(d), lambda x: x["feature"].cast("string")))
    per = m.groupBy("program").agg(text("up").alias("up"), text("down").alias("down"))
    size = df.groupBy("program").agg(F.count(F.lit(1)).alias("members"))
    return size.join(per, "program", "left").na.fill("", ["up", "down"]).select("program", "members", "up", "down")


@query("profile_top_variance", f"WITH {PROFILES}, lg AS (SELECT UNNEST(RANGE(64)) AS feature, UNNEST(profile) AS x FROM profiles) SELECT CAST(feature AS INT) AS feature, ROUND(VAR_POP(x), 9) AS variance FROM lg GROUP BY 1 HAVING VAR_POP(x) > 0 ORDER BY 2 DESC, 1 LIMIT 20")
def profile_top_variance(spark, sf_dir):
    """V4: features of largest variance."""
    return P.top_variance(profiles(spark, sf_dir), 20)


@query("profile_standardise", f"WITH {PROFILES}, lg AS (SELECT unit, UNNEST(RANGE(64)) AS d, UNNEST(profile) AS x FROM profiles), s AS (SELECT d, AVG(x) AS m, STDDEV_POP(x) AS s FROM lg GROUP BY 1), z AS (SELECT unit, (x - m) / CASE WHEN s = 0 THEN 1 ELSE s END AS z FROM lg JOIN s ON lg.d = s.d) SELECT unit, ROUND(SQRT(SUM(z * z)), 6) AS norm, ROUND(SUM(z), 6) AS total FROM z GROUP BY unit")
def profile_standardise(spark, sf_dir):
    """V5: column-standardised profiles, digested to norm and sum."""
    z = P.standardise(P.clean(profiles(spark, sf_dir)))
    return z.select("unit", F.round(X.norm(F.col("profile")), 6).alias("norm"), F.round(X.array_sum(F.col("profile")), 6).alias("total"))


@query("profile_block_summary", f"WITH {PROFILES} SELECT unit, CAST(LEN(LIST_FILTER(profile, lambda x: ABS(x) > 0.2)) AS BIGINT) AS n_sig, ROUND(LIST_SUM(LIST_TRANSFORM(profile, lambda x: ABS(x))), 6) AS l1, ROUND({NORM}, 6) AS l2, ROUND(SQRT(COALESCE(LIST_SUM(LIST_TRANSFORM(LIST_FILTER(profile, lambda x: ABS(x) > 0.2), lambda x: x * x)), 0)), 6) AS l2_sig, ROUND(LIST_AVG(profile), 6) AS mean FROM profiles")
def profile_block_summary(spark, sf_dir):
    """Row summaries over features without a shuffle."""
    return P.block_summary(P.clean(profiles(spark, sf_dir)))


@query("profile_correlation", f"WITH {PROFILES}, a AS (SELECT unit, UNNEST(RANGE(64)) AS d, UNNEST(profile) AS x FROM profiles) SELECT p.unit AS a, q.unit AS b, ROUND(CORR(p.x, q.x), 6) AS r FROM a p JOIN a q ON p.d = q.d AND p.unit < q.unit GROUP BY 1, 2")
def profile_correlation(spark, sf_dir):
    """V18, I25 (observed part): row correlations: standardised rows, then inner products."""
    df = profiles(spark, sf_dir)
    mean = X.array_sum(F.col("profile")) / F.size("profile")
    centred = df.withColumn("profile", F.transform(F.array(mean), lambda m: F.transform("profile", lambda x: x - m))[0])
    return P.similarities(centred, once=True).select("a", "b", F.col("similarity").alias("r"))


@query("profile_matrix_slice", f"WITH {PROFILES}, r AS (SELECT unit, CAST(ROW_NUMBER() OVER (ORDER BY unit) - 1 AS BIGINT) AS row_id, profile FROM profiles) SELECT row_id, unit, ROUND(profile[1], 6) AS first FROM r WHERE row_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def profile_matrix_slice(spark, sf_dir):
    """Rows of the matrix by materialised position."""
    from quillon.sources.tables import slice_rows, with_row_id

    df = with_row_id(profiles(spark, sf_dir), "unit")
    wanted = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("row_id"))
    return slice_rows(df, wanted).select("row_id", "unit", F.round(F.col("profile")[0], 6).alias("first"))


@query("profile_group_collapse", f"WITH {PROFILES}, lg AS (SELECT 'u' || CAST(unit // 2 AS VARCHAR) || '_promoter_ENSG' || LPAD(CAST(unit // 2 AS VARCHAR), 5, '0') AS id, UNNEST(RANGE(64)) AS d, UNNEST(profile) AS x FROM profiles), g AS (SELECT REGEXP_EXTRACT(id, '(ENSG[^_]*)', 1) AS gene, d, AVG(x) AS m FROM lg GROUP BY 1, 2) SELECT gene, ROUND(SQRT(SUM(m * m)), 6) AS norm FROM g GROUP BY gene")
def profile_group_collapse(spark, sf_dir):
    """Token out of a composite id, then element-wise mean per token."""
    from quillon.sources.tables import collapse_bulk

    two = F.expr("CAST(unit DIV 2 AS STRING)")
    df = profiles(spark, sf_dir).select(F.concat(F.lit("u"), two, F.lit("_promoter_ENSG"), F.lpad(two, 5, "0")).alias("id"), "profile")
    return collapse_bulk(df).select("gene", F.round(X.norm(F.col("profile")), 6).alias("norm"))


@query("profile_balanced_panel", f"WITH {REWEIGHT}, moves AS (SELECT unit, old_rank - new_rank AS rank_shift FROM audit), cl AS (SELECT unit, CASE WHEN n_signif_contexts >= 2 AND condition_specificity < 0.6 THEN 'global' ELSE 'context_specific' END AS regulator_class FROM breadth), best AS (SELECT r.unit, 'top_' || regulator_class AS source, 0 AS p, ROW_NUMBER() OVER (PARTITION BY regulator_class ORDER BY rank) AS k FROM ranked r JOIN cl ON r.unit = cl.unit), s AS (SELECT unit, source, p FROM best WHERE k <= 75 UNION ALL SELECT * FROM (SELECT unit, 'promoted', 1 FROM moves ORDER BY rank_shift DESC, unit LIMIT 25) UNION ALL SELECT * FROM (SELECT unit, 'demoted', 2 FROM moves ORDER BY rank_shift, unit LIMIT 25)) SELECT unit, source FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY unit ORDER BY p, source) AS k FROM s) WHERE k = 1")
def profile_balanced_panel(spark, sf_dir):
    """Panel of the best of each class and the largest moves."""
    df, post = contrast(spark, sf_dir), posterior(spark, sf_dir)
    moves = R.reproducibility_reweight(df, replicates(spark, sf_dir), post).select("unit", "rank_shift")
    return P.balanced_panel(R.ranked(post).select("unit", "rank"), R.regulator_class(R.unit_breadth(df)).select("unit", "regulator_class"), moves)


@query("profile_expanded_panel", f"WITH {CONTRAST}, g AS (SELECT unit, AVG(support) AS s, MAX(response) AS m FROM contrast WHERE gate GROUP BY unit HAVING COUNT(DISTINCT context) = 3) SELECT unit, ROUND(s, 6) AS mean_support, m AS max_response FROM g WHERE s >= (SELECT MEDIAN(s) FROM g) ORDER BY m DESC, unit LIMIT 50")
def profile_expanded_panel(spark, sf_dir):
    """V2: units gated everywhere with enough support."""
    return P.expanded_panel(contrast(spark, sf_dir))


CELLS = """cells0 AS (
  SELECT o_custkey AS unit, l_returnflag AS context, SUBSTR(p_brand, 7, 1) AS f, SUM(l_quantity) AS q, COUNT(*) AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
cells AS (
  SELECT unit, context, CAST(SUM(n) AS BIGINT) AS support, [COALESCE(SUM(q) FILTER (f = '1'), 0), COALESCE(SUM(q) FILTER (f = '2'), 0), COALESCE(SUM(q) FILTER (f = '3'), 0), COALESCE(SUM(q) FILTER (f = '4'), 0), COALESCE(SUM(q) FILTER (f = '5'), 0)] AS profile
  FROM cells0 GROUP BY 1, 2)"""


def cells(spark, sf_dir):
    """Tensor cells: customers by return flag by the five leading digits of the brand."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    part = table(spark, sf_dir, "part").select("p_partkey", F.substring("p_brand", 7, 1).alias("f"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    sums = [F.coalesce(F.sum(F.when(F.col("f") == str(k), F.col("l_quantity"))), F.lit(0.0)) for k in range(1, 6)]
    return joined.groupBy(F.col("o_custkey").alias("unit"), F.col("l_returnflag").alias("context")).agg(F.count(F.lit(1)).alias("support"), F.array(*sums).alias("profile"))


@query("tensor_assembly", f"WITH {CELLS}, u AS (SELECT DISTINCT unit FROM cells), c AS (SELECT DISTINCT context FROM cells) SELECT u.unit, c.context, s.unit IS NOT NULL AS observed, s.support FROM u CROSS JOIN c LEFT JOIN cells s ON s.unit = u.unit AND s.context = c.context")
def tensor_assembly(spark, sf_dir):
    """Shape and mask of the tensor; an absent cell is a false mask."""
    df = P.tensor_cells(cells(spark, sf_dir).withColumn("row_id", F.lit(0)))
    wide = df.groupBy("unit").pivot("context", ["A", "N", "R"]).agg(F.first("support"))
    return wide.unpivot(["unit"], ["A", "N", "R"], "context", "support").select("unit", "context", F.col("support").isNotNull().alias("observed"), "support")


@query("tensor_rms", f"WITH {CELLS}, s AS (SELECT context, SQRT(SUM(LIST_SUM(LIST_TRANSFORM(profile, lambda x: x * x))) / SUM(LEN(profile))) AS rms FROM cells GROUP BY 1) SELECT unit, c.context, ROUND({NORM} / rms, 6) AS norm FROM cells c JOIN s ON c.context = s.context")
def tensor_rms(spark, sf_dir):
    """Slabs scaled to unit root-mean-square."""
    return P.rms_normalise(cells(spark, sf_dir)).select("unit", "context", F.round(X.norm(F.col("profile")), 6).alias("norm"))


@query("tensor_confound", f"WITH {CELLS}, r0 AS (SELECT ROUND({NORM}, 6) AS nn, support FROM cells), r AS (SELECT {avg_rank_sql('nn')} AS rx, {avg_rank_sql('support')} AS ry FROM r0) SELECT CAST(COUNT(*) AS BIGINT) AS n, {SPEARMAN} AS rho FROM r")
def tensor_confound(spark, sf_dir):
    """How much slab norms follow support (the fail-closed sink asserts on it)."""
    return P.confound_meter(cells(spark, sf_dir))


@query("tensor_persistence", f"WITH {CELLS}, p AS (SELECT a.unit, a.profile AS x, b.profile AS y FROM cells a JOIN cells b ON a.unit = b.unit WHERE a.context = 'N' AND b.context = 'R'), m AS (SELECT unit, LIST_SUM(LIST_TRANSFORM(LIST_ZIP(x, y), lambda z: (z[2] - z[1]) * (z[2] - z[1]))) AS e, LIST_SUM(LIST_TRANSFORM(y, lambda v: v * v)) AS q FROM p) SELECT CAST(COUNT(*) AS BIGINT) AS n, ROUND(1 - SUM(e) / SUM(q), 6) AS r2_persistence FROM m")
def tensor_persistence(spark, sf_dir):
    """T13 (baseline): fibres of one context predicted by those of an earlier one."""
    df = cells(spark, sf_dir)
    a = df.where("context = 'N'").select("unit", F.col("profile").alias("x"))
    b = df.where("context = 'R'").select("unit", F.col("profile").alias("y"))
    p = a.join(b, "unit")
    e = F.aggregate(F.zip_with("x", "y", lambda u, v: (v - u) * (v - u)), F.lit(0.0), lambda s, t: s + t)
    q = F.aggregate("y", F.lit(0.0), lambda s, v: s + v * v)
    return p.agg(F.count(F.lit(1)).alias("n"), F.round(1 - F.sum(e) / F.sum(q), 6).alias("r2_persistence"))


@query("tensor_train_centring", f"WITH {CELLS}, t AS (SELECT UNNEST(RANGE(5)) AS feature, UNNEST(profile) AS x FROM cells WHERE unit % 5 <> 0) SELECT CAST(feature AS INT) AS feature, ROUND(AVG(x), 6) AS mean FROM t GROUP BY 1")
def tensor_train_centring(spark, sf_dir):
    """Feature means over training rows alone."""
    return P.long_form(cells(spark, sf_dir).where("unit % 5 <> 0")).groupBy("feature").agg(F.round(F.avg("value"), 6).alias("mean"))


@query("tensor_flagged_units", f"WITH {CONTRAST} SELECT unit FROM contrast GROUP BY unit HAVING NOT BOOL_OR(gate AND penalty_flag)")
def tensor_flagged_units(spark, sf_dir):
    """Units that stay when any gated row is flagged."""
    df = contrast(spark, sf_dir)
    return df.groupBy("unit").agg(F.bool_or(F.col("gate") & F.col("penalty_flag")).alias("flag")).where("NOT flag").select("unit")


RUNS = "runs AS (SELECT r AS run_id, unit AS node, CASE WHEN r = 0 THEN CAST(program AS BIGINT) ELSE CAST('0x' || SUBSTR(MD5(program || '#' || CAST(r AS VARCHAR) || '#' || CAST(unit // 3 AS VARCHAR)), 1, 8) AS BIGINT) % 6 END AS label FROM p, RANGE(5) t(r))"
CONS = f"{KNN}, {RUNS}, cons AS (SELECT a.node AS src, b.node AS dst, ROUND(COUNT(*) / 5.0::DOUBLE, 6) AS p FROM runs a JOIN runs b ON a.run_id = b.run_id AND a.label = b.label AND a.node < b.node GROUP BY 1, 2)"


def runs(spark, sf_dir):
    """Five labelings of the panel: the given programs and four seeded ones."""
    df = panel(spark, sf_dir).withColumn("run_id", F.explode(F.sequence(F.lit(0), F.lit(4))))
    seeded = F.conv(F.substring(F.md5(F.concat_ws("#", "program", F.col("run_id").cast("string"), F.expr("CAST(unit DIV 3 AS STRING)")).cast("binary")), 1, 8), 16, 10).cast("long") % 6
    return df.select("run_id", F.col("unit").alias("node"), F.when(F.col("run_id") == 0, F.col("program").cast("long")).otherwise(seeded).alias("label"))


@query("graph_consensus", f"WITH {CONS} SELECT * FROM cons")
def graph_consensus(spark, sf_dir):
    """Consensus co-assignment over runs."""
    return G.consensus(runs(spark, sf_dir))


STAB = f"{CONS}, lab AS (SELECT node, label FROM runs WHERE run_id = 0), sz AS (SELECT label, CAST(COUNT(*) AS BIGINT) AS size FROM lab GROUP BY 1), bt AS (SELECT src AS node, dst AS other, p FROM cons UNION ALL SELECT dst, src, p FROM cons), sm AS (SELECT b.node, SUM(p) AS s FROM bt b JOIN lab x ON b.node = x.node JOIN lab y ON b.other = y.node AND x.label = y.label GROUP BY 1), nd AS (SELECT l.node, l.label, size, ROUND(COALESCE(s, 0) / NULLIF(CAST(size - 1 AS DOUBLE), 0), 6) AS stability FROM lab l JOIN sz ON l.label = sz.label LEFT JOIN sm ON l.node = sm.node)"


@query("graph_node_stability", f"WITH {STAB} SELECT *, stability >= 0.8 AS stable FROM nd")
def graph_node_stability(spark, sf_dir):
    """Stability of nodes within their community."""
    r = runs(spark, sf_dir)
    return G.stability(r, r.where("run_id = 0").select("node", "label"))


@query("graph_community_stability", f"WITH {STAB} SELECT label, MAX(size) AS size, ROUND(AVG(stability), 6) AS stability FROM nd GROUP BY label")
def graph_community_stability(spark, sf_dir):
    """Stability of communities."""
    r = runs(spark, sf_dir)
    return G.community_stability(G.stability(r, r.where("run_id = 0").select("node", "label")))


MOD = "k AS (SELECT node, SUM(weight) AS k FROM (SELECT src AS node, weight FROM edges UNION ALL SELECT dst, weight FROM edges) GROUP BY 1), w AS (SELECT SUM(weight) AS w FROM edges)"


@query("graph_modularity", f"WITH {KNN}, {RUNS}, {MOD}, i AS (SELECT a.run_id, a.label, SUM(weight) AS inside FROM edges JOIN runs a ON a.node = src JOIN runs b ON b.node = dst AND a.run_id = b.run_id AND a.label = b.label GROUP BY 1, 2), d AS (SELECT run_id, label, SUM(k) AS k FROM runs r JOIN k ON r.node = k.node GROUP BY 1, 2) SELECT d.run_id, ROUND(SUM(COALESCE(inside, 0) / w - (k / (2 * w)) * (k / (2 * w))), 6) AS modularity FROM d LEFT JOIN i ON d.run_id = i.run_id AND d.label = i.label, w GROUP BY 1")
def graph_modularity(spark, sf_dir):
    """Modularity of five labelings at once."""
    return G.modularity(P.neighbour_edges(knn(spark, sf_dir)), runs(spark, sf_dir), ("run_id",))


@query("graph_modularity_null", f"WITH {KNN}, {MOD}, o AS (SELECT unit AS node, program AS label, ROW_NUMBER() OVER (ORDER BY unit) AS pos FROM p), s AS (SELECT b, node, ROW_NUMBER() OVER (PARTITION BY b ORDER BY MD5('perm#' || CAST(b AS VARCHAR) || '#' || CAST(node AS VARCHAR)), node) AS pos FROM o, RANGE(10) t(b)), l AS (SELECT b, s.node, o.label FROM s JOIN o ON s.pos = o.pos), i AS (SELECT x.b, x.label, SUM(weight) AS inside FROM edges JOIN l x ON x.node = src JOIN l y ON y.node = dst AND x.b = y.b AND x.label = y.label GROUP BY 1, 2), d AS (SELECT b, label, SUM(k) AS k FROM l JOIN k ON l.node = k.node GROUP BY 1, 2) SELECT d.b, ROUND(SUM(COALESCE(inside, 0) / w - (k / (2 * w)) * (k / (2 * w))), 6) AS modularity FROM d LEFT JOIN i ON d.b = i.b AND d.label = i.label, w GROUP BY 1")
def graph_modularity_null(spark, sf_dir):
    """Modularity under seeded label permutations, the draw being a key."""
    return relabelled(spark, sf_dir, 10)


def relabelled(spark, sf_dir, draws: int):
    base = panel(spark, sf_dir).select(F.col("unit").alias("node"), F.col("program").alias("label")).withColumn("pos", F.row_number().over(Window.orderBy("node")))
    slots = base.select("node").withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long"))))
    placed = slots.withColumn("pos", F.row_number().over(Window.partitionBy("b").orderBy(X.seeded("perm", F.col("b"), F.col("node")), "node")))
    return G.modularity(P.neighbour_edges(knn(spark, sf_dir)), placed.join(base.select("pos", "label"), "pos"), ("b",))


@query("graph_modularity_null_full")
def graph_modularity_null_full(spark, sf_dir):
    """G8, K5 with the reference's 100 draws: the SQL is held against 10."""
    return relabelled(spark, sf_dir, 100)
