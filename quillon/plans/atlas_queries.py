"""The lookup endpoints as queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import edges as D
from quillon.operators import profiles as P
from quillon.operators import ranking as R
from quillon.operators.atlas import Atlas
from quillon.plans.bindings import CONTRAST, REPLICATES, effects, memberships, profiles, replicates, written_contrast, written_evidence
from quillon.plans.effect_queries import EDGES, ENRICH, enriched
from quillon.plans.profile_queries import KNN, MARK, knn
from quillon.plans.ranking_queries import BASE, REWEIGHT, bootstrap, posterior, reviewed
from quillon.plans.registry import QUERIES, SQL, query


def atlas(spark, sf_dir, measured: bool = False) -> Atlas:
    """Every table is a plan that is made when an endpoint asks for it: making some of them already runs jobs and writes tables.

    Contrasts are written once for all tables made of them; with ``measured`` their replicate correlations come from the same pass.
    """
    shared = {}

    def once(name, make):
        if name not in shared:
            shared[name] = make()
        return shared[name]

    both = lambda: once("evidence", lambda: written_evidence(spark, sf_dir))
    df = lambda: once("contrast", lambda: both()[0] if measured else written_contrast(spark, sf_dir))
    meta = lambda: both()[1] if measured else replicates(spark, sf_dir)
    post = lambda: once("posterior", lambda: posterior(spark, sf_dir, df=df()))
    edges = lambda: once("edges", lambda: D.edge_posterior(effects(spark, sf_dir)))
    breadth = lambda: once("breadth", lambda: R.unit_breadth(df()))
    audit = lambda: once("audit", lambda: R.reproducibility_reweight(df(), meta(), post()))
    return Atlas(
        ranking=lambda: R.ranked(post()).select("unit", "rank", F.round("u", 6).alias("eb_mean")),
        classes=lambda: R.regulator_class(breadth()).select("unit", "regulator_class"),
        breadth=breadth,
        contrast=df,
        audit=audit,
        baselines=lambda: R.baseline_comparison(df(), post()),
        edges=edges,
        edge_summary=lambda: D.edge_summary(edges(), "unit", "feature"),
        neighbours=lambda: knn(spark, sf_dir),
        programs=lambda: profiles(spark, sf_dir).select("unit", "program"),
        markers=lambda: P.markers(profiles(spark, sf_dir), 12, 0.55),
        enrichment=lambda: enriched(spark, sf_dir, df()),
        sets=lambda: memberships(spark, sf_dir),
        replicates=meta,
        peaks=lambda: R.peak_context(df()),
        stability=lambda: bootstrap(spark, sf_dir, 20, df()),
        review=lambda: reviewed(audit()),
        findings=lambda: QUERIES["profile_loo_centroid"](spark, sf_dir),
        coherence=lambda: QUERIES["profile_coherence"](spark, sf_dir),
        cohesion=None,
        jaccard=None,
    )


CLS = "cls AS (SELECT unit, CASE WHEN n_signif_contexts >= 2 AND condition_specificity < 0.6 THEN 'global' ELSE 'context_specific' END AS regulator_class FROM breadth)"
REG = f"{BASE}, {CLS}, reg AS (SELECT r.unit, r.rank AS core_rank, ROUND(u, 6) AS eb_mean, regulator_class, peak, n_contexts FROM ranked r LEFT JOIN cls c ON r.unit = c.unit LEFT JOIN breadth b ON r.unit = b.unit)"


@query("atlas_summary", f"WITH {BASE}, {CLS} SELECT 'class' AS kind, regulator_class AS key, CAST(COUNT(*) AS BIGINT) AS n FROM cls GROUP BY 2 UNION ALL SELECT 'context', context, CAST(COUNT(*) AS BIGINT) FROM contrast WHERE gate GROUP BY 2")
def atlas_summary(spark, sf_dir):
    """Q3: counts."""
    return atlas(spark, sf_dir).summary()


LOADED = ("audit", "baselines", "breadth", "classes", "coherence", "cohesion", "contrast", "edge_summary", "edges", "enrichment", "findings", "jaccard", "markers", "neighbours", "peaks", "programs", "ranking", "replicates", "review", "sets", "stability")
MISSING = ("cohesion", "jaccard")
STATES = " UNION ALL ".join(f"SELECT '{n}' AS name, {n not in MISSING} AS loaded" for n in LOADED)


@query("atlas_health", f"WITH {BASE}, t AS ({STATES}) SELECT 'ok' AS status, (SELECT CAST(COUNT(*) AS BIGINT) FROM ranked) AS n_units, name, loaded FROM t")
def atlas_health(spark, sf_dir):
    """Q2: state of the tables, as rows."""
    h = atlas(spark, sf_dir).health()
    return spark.createDataFrame([(h["status"], h["n_units"], k, v) for k, v in sorted(h["tables_loaded"].items())], "status string, n_units long, name string, loaded boolean")


@query("atlas_units", f"WITH {BASE} SELECT rank, unit FROM ranked")
def atlas_units(spark, sf_dir):
    """Q4: units in rank order (the rank is data)."""
    return atlas(spark, sf_dir).units()


@query("atlas_regulators", f"WITH {REG} SELECT * FROM reg WHERE CONTAINS(CAST(unit AS VARCHAR), '1') AND regulator_class = 'global' ORDER BY peak DESC NULLS LAST, core_rank, unit LIMIT 40")
def atlas_regulators(spark, sf_dir):
    """Search with class filter and a sort key."""
    return atlas(spark, sf_dir).regulators("1", "global", 40, "peak")


@query("atlas_class", f"WITH {REG} SELECT * FROM reg WHERE regulator_class = 'context_specific' ORDER BY core_rank, unit")
def atlas_class(spark, sf_dir):
    """Q10: all units of a class."""
    return atlas(spark, sf_dir).class_members("context_specific")


PROFILE_SQL = f"""WITH {KNN}, {EDGES.replace('edges AS (', 'big AS (')}, {REG},
ct AS (SELECT unit, STRING_AGG(context || ':' || CAST(response AS VARCHAR), ';' ORDER BY context) AS contexts FROM contrast GROUP BY 1),
eg AS (SELECT unit, CAST(COUNT(*) AS BIGINT) AS n_edges FROM big GROUP BY 1),
tp AS (SELECT unit, STRING_AGG(feature, ';' ORDER BY k) AS top FROM (SELECT unit, feature, ROW_NUMBER() OVER (PARTITION BY unit ORDER BY ABS(theta) DESC, feature) AS k FROM big) WHERE k <= 10 GROUP BY 1),
nb AS (SELECT a AS unit, STRING_AGG(CAST(b AS VARCHAR), ';' ORDER BY rank) AS near FROM knn GROUP BY 1)
SELECT g.unit, core_rank AS rank, regulator_class, contexts, COALESCE(n_edges, 0) AS n_edges, LEAST(COALESCE(n_edges, 0), 10) AS n_edges_capped, COALESCE(top, '') AS top, COALESCE(near, '') AS near,
       'Rank ' || CAST(core_rank AS VARCHAR) || ', ' || regulator_class || '.' || CASE WHEN any_flag THEN ' Carries a penalty flag.' ELSE '' END || CASE WHEN n_edges IS NULL THEN ' No likely large edge.' ELSE '' END AS interpretation_text
FROM reg g JOIN breadth b ON g.unit = b.unit LEFT JOIN ct ON g.unit = ct.unit LEFT JOIN eg ON g.unit = eg.unit LEFT JOIN tp ON g.unit = tp.unit LEFT JOIN nb ON g.unit = nb.unit"""


@query("atlas_profiles", PROFILE_SQL)
def atlas_profiles(spark, sf_dir):
    """All profiles, nested parts written as text for the comparison."""
    a = atlas(spark, sf_dir)
    a.tables["audit"] = None  # none of its columns is returned
    p = a.profiles()
    text = lambda c, f: F.coalesce(F.concat_ws(";", F.transform(c, f)), F.lit(""))
    # The map is from entries sorted by context, so its entries keep that order.
    contexts = F.concat_ws(";", F.transform(F.array_sort(F.map_entries("condition_profile")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))))
    flagged = F.when(F.col("any_flag"), F.lit(" Carries a penalty flag.")).otherwise("")
    none = F.when(F.col("n_edges") == 0, F.lit(" No likely large edge.")).otherwise("")
    sentence = F.concat(F.format_string("Rank %d, %s.", F.col("rank"), F.col("regulator_class")), flagged, none)
    return p.select("unit", "rank", "regulator_class", contexts.alias("contexts"), "n_edges", "n_edges_capped", text("top_edges", lambda e: e["feature"]).alias("top"), text("neighbours", lambda n: n["neighbour"].cast("string")).alias("near"), sentence.alias("interpretation_text"))


@query("atlas_unit_edges", f"WITH {EDGES}, u AS (SELECT MIN(unit) AS unit FROM edges) SELECT e.unit, feature, ROUND(theta, 6) AS theta, CASE WHEN theta > 0 THEN 'up' ELSE 'down' END AS direction FROM edges e JOIN u ON e.unit = u.unit ORDER BY ABS(theta) DESC, feature LIMIT 50")
def atlas_unit_edges(spark, sf_dir):
    """Edges of the first unit that has any."""
    a = atlas(spark, sf_dir)
    return a.unit_edges(a["edges"].agg(F.min("unit")).first()[0])


@query("atlas_reproducibility", f"WITH {REWEIGHT} SELECT unit, old_rank, new_rank, old_rank - new_rank AS rank_shift, ROUND(score, 6) AS score, donor_metadata FROM audit")
def atlas_reproducibility(spark, sf_dir):
    """Q8: reproducibility audit."""
    return atlas(spark, sf_dir, measured=True).reproducibility()


@query("atlas_gate_audit", f"WITH {BASE}, p AS (SELECT unit, MAX(response) AS raw_peak, MAX(CASE WHEN gate THEN response END) AS gated_peak FROM contrast GROUP BY unit), r AS (SELECT p.unit, gated_peak, CAST(RANK() OVER (ORDER BY raw_peak DESC) AS BIGINT) AS raw_rank, CASE WHEN gated_peak IS NOT NULL THEN CAST(RANK() OVER (ORDER BY gated_peak DESC NULLS LAST) AS BIGINT) END AS gated_rank, CASE WHEN u IS NOT NULL THEN CAST(RANK() OVER (ORDER BY ROUND(u, 9) DESC NULLS LAST) AS BIGINT) END AS eb_rank FROM p LEFT JOIN posterior q ON p.unit = q.unit) SELECT unit, raw_rank, gated_rank, eb_rank, gated_peak IS NULL AS dropped, raw_rank - eb_rank AS shift FROM r ORDER BY raw_rank, unit LIMIT 100")
def atlas_gate_audit(spark, sf_dir):
    """Q9: top hundred by raw rank."""
    return atlas(spark, sf_dir).gate_audit()


@query("atlas_program_summary", f"WITH {MARK}, mk AS (SELECT program, STRING_AGG(direction || CAST(rank AS VARCHAR) || '=' || CAST(feature AS VARCHAR), ';' ORDER BY direction, rank) AS markers FROM k WHERE rank <= 12 GROUP BY 1) SELECT p.program, CAST(COUNT(*) AS BIGINT) AS members, MAX(markers) AS markers FROM profiles p LEFT JOIN mk ON p.program = mk.program GROUP BY 1")
def atlas_program_summary(spark, sf_dir):
    """Q14: programs with nested markers, written as text for the comparison."""
    s = atlas(spark, sf_dir).program_summary()
    text = F.concat_ws(";", F.transform("markers", lambda m: F.concat(m["direction"], m["rank"].cast("string"), F.lit("="), m["feature"].cast("string"))))
    # A program without markers has none, not an empty text.
    return s.select("program", "members", F.when(F.col("markers").isNotNull(), text).alias("markers"))


@query("atlas_class_programs", f"WITH {ENRICH} SELECT set_name, n_overlap, set_size, n_drawn, background_size, ROUND(p, 9) AS p, fold FROM en")
def atlas_class_programs(spark, sf_dir):
    """Q15: enrichment of classes."""
    return atlas(spark, sf_dir).class_programs().withColumn("p", F.round("p", 9))


@query("atlas_class_targets", "SELECT c_custkey AS member FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = (SELECT MIN(n_name) FROM nation)")
def atlas_class_targets(spark, sf_dir):
    """Q15: members of one set."""
    a = atlas(spark, sf_dir)
    return a.class_targets(a["sets"].agg(F.min("set_name")).first()[0])


@query("atlas_edge_summaries", f"WITH {EDGES} SELECT unit, CAST(COUNT(*) AS BIGINT) AS n_edges, ROUND(AVG(ABS(theta)), 6) AS mean_abs_theta FROM edges GROUP BY unit ORDER BY 2 DESC, unit LIMIT 200")
def atlas_edge_summaries(spark, sf_dir):
    """Q16: units with most edges."""
    return atlas(spark, sf_dir).edge_summaries(200).select("unit", "n_edges", "mean_abs_theta")


@query("atlas_neighbours", f"WITH {KNN} SELECT a, b, similarity, rank FROM knn WHERE a = (SELECT MIN(a) FROM knn)")
def atlas_neighbours(spark, sf_dir):
    """Q12: ordered neighbours of one unit."""
    a = atlas(spark, sf_dir)
    n = a.neighbours_of(a["programs"].agg(F.min("unit")).first()[0])
    return spark.createDataFrame([(r["a"], r["b"], r["similarity"], r["rank"]) for r in n["neighbours"]], "a long, b long, similarity double, rank long")


@query("atlas_programs", "SELECT vec_id AS unit, CAST(label AS VARCHAR) AS program FROM embeddings")
def atlas_programs(spark, sf_dir):
    """Q11, Q13: those of the asked columns that the table has."""
    return atlas(spark, sf_dir).existing("programs", "unit", "program", "pc1", "pc2")


OVERVIEW = " UNION ALL ".join(f"SELECT 'available', '{n}', '{str(n not in MISSING).lower()}'" for n in LOADED)


@query("atlas_overview", f"""WITH {BASE}, {CLS} SELECT 'units' AS kind, 'n' AS key, CAST(COUNT(*) AS VARCHAR) AS value FROM ranked UNION ALL SELECT 'class', regulator_class, CAST(COUNT(*) AS VARCHAR) FROM cls GROUP BY 2
UNION ALL SELECT 'top', CAST(rank AS VARCHAR), CAST(unit AS VARCHAR) FROM ranked WHERE rank <= 10 UNION ALL SELECT DISTINCT 'context', context, 'true' FROM contrast UNION ALL {OVERVIEW}""")
def atlas_overview(spark, sf_dir):
    """Q3: counts, first ten units, contexts and which tables there are."""
    return atlas(spark, sf_dir).overview()


@query("atlas_profile_fields", f"""SELECT r.unit, r.rank AS core_rank, regulator_class, p.context AS peak_context, p.response AS peak_response, selection_frequency AS stability_frequency, median_rank, rank_iqr, raw_rank, dropped AS dropped_by_gate,
w.new_rank AS reweighted_rank, score AS reweighted_score, donor_metadata, status AS audit_status, reason AS audit_reason, assigned AS program_label, best AS nearest_program, cosine AS nearest_cosine, best IS NOT NULL AS in_program_panel
FROM ({SQL['atlas_units']}) r LEFT JOIN ({SQL['rank_classes']}) c ON r.unit = c.unit LEFT JOIN ({SQL['agg_peak_context']}) p ON r.unit = p.unit LEFT JOIN ({SQL['rank_bootstrap']}) s ON r.unit = s.unit LEFT JOIN ({SQL['rank_baselines']}) b ON r.unit = b.unit
LEFT JOIN ({SQL['rank_reweight']}) w ON r.unit = w.unit LEFT JOIN ({SQL['rank_review']}) v ON r.unit = v.unit LEFT JOIN ({SQL['profile_loo_centroid']}) f ON r.unit = f.unit""")
def atlas_profile_fields(spark, sf_dir):
    """The scalar fields of every unit's profile: baseline, stability, reproducibility, review, program."""
    return atlas(spark, sf_dir, measured=True).fields()


@query("atlas_coverage", f"WITH {CONTRAST}, {REPLICATES} SELECT CAST(COUNT(*) AS BIGINT) AS n, CAST(SUM(CAST(gate AS INT)) AS BIGINT) AS n_gated, ROUND(AVG(CASE WHEN guide_corr IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS guide_share, ROUND(AVG(CASE WHEN donor_corr IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS donor_share, ROUND(AVG(CASE WHEN single THEN 1.0 WHEN NOT single THEN 0.0 END), 6) AS single_share FROM contrast c LEFT JOIN replicates r ON c.unit = r.unit AND c.context = r.context")
def atlas_coverage(spark, sf_dir):
    """Q8: the coverage row of the reproducibility audit."""
    return atlas(spark, sf_dir, measured=True).coverage()


@query("atlas_findings", f"SELECT f.*, mean_similarity, nearest, own_share FROM ({SQL['profile_loo_centroid']}) f LEFT JOIN ({SQL['profile_coherence']}) c ON f.unit = c.unit")
def atlas_findings(spark, sf_dir):
    """Q13: findings per panel unit."""
    return atlas(spark, sf_dir).findings()


@query("atlas_validation", f"SELECT CAST(label AS VARCHAR) AS program, CAST(COUNT(*) AS BIGINT) AS members, MAX(n.observed) AS observed, MAX(n.z) AS z, MAX(n.p) AS p, ROUND(AVG(own_share), 6) AS own_share FROM embeddings e LEFT JOIN ({SQL['stat_cohesion_null']}) n ON n.set_name = CAST(label AS VARCHAR) LEFT JOIN ({SQL['profile_coherence']}) c ON c.unit = e.vec_id GROUP BY 1")
def atlas_validation(spark, sf_dir):
    """Q14: validation of the programs against their null, with their members' coherence."""
    a = atlas(spark, sf_dir)
    a.tables["cohesion"] = QUERIES["stat_cohesion_null"](spark, sf_dir)
    return a.validation()


@query("atlas_class_jaccard", f"WITH j AS ({SQL['set_jaccard']}) SELECT a, b, ROUND(jaccard, 3) AS jaccard FROM j UNION ALL SELECT b, a, ROUND(jaccard, 3) FROM j UNION ALL SELECT DISTINCT c, c, 1.0::DOUBLE FROM (SELECT a AS c FROM j UNION ALL SELECT b FROM j)")
def atlas_class_jaccard(spark, sf_dir):
    """Q15: matrix of target-set similarity of the classes."""
    a = atlas(spark, sf_dir)
    a.tables["jaccard"] = QUERIES["set_jaccard"](spark, sf_dir)
    return a.class_jaccard()


SOURCES = f"""{KNN}, c AS (SELECT a AS unit, AVG(similarity) AS s, AVG(CASE WHEN x.program = y.program THEN 1.0 ELSE 0.0 END) AS own FROM knn JOIN p x ON x.unit = a JOIN p y ON y.unit = b GROUP BY a)"""


@query("profile_source_summary", f"WITH {SOURCES} SELECT p.program AS source, CAST(COUNT(*) AS BIGINT) AS n, ROUND(AVG(ROUND(s, 9)), 6) AS mean_similarity, ROUND(100 * AVG(CASE WHEN ROUND(own, 6) >= 0.25 THEN 1.0 ELSE 0.0 END), 4) AS in_program FROM c JOIN p ON p.unit = c.unit GROUP BY 1")
def profile_source_summary(spark, sf_dir):
    """V8: per source the number of units, their mean coherence and the share whose neighbourhood is in their own program."""
    c = QUERIES["profile_coherence"](spark, sf_dir).join(profiles(spark, sf_dir).select("unit", F.col("program").alias("source")), "unit")
    return c.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("mean_similarity"), 6).alias("mean_similarity"), F.round(100 * F.avg((F.col("own_share") >= 0.25).cast("double")), 4).alias("in_program"))
