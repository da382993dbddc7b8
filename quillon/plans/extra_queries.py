"""Remaining operators: windows, lookups, concordance parts, text sources, and the streaming extension in batch form."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import exprs as X
from quillon.operators import ranking as R
from quillon.operators import stats as T
from quillon.operators.permuted import products
from quillon.plans.bindings import CONTRAST, PROFILES, REPLICATES, contrast, profiles, replicates, table
from quillon.plans.effect_queries import SPEARMAN, avg_rank_sql
from quillon.plans.ranking_queries import BASE, deviations, posterior
from quillon.plans.registry import query
from quillon.sources import lookups
from quillon.sources import tables as S
from quillon.sources.shared import Scratch
from quillon.streaming import statistics as stream


@query("stream_statistics", "SELECT user_id AS unit, event_type AS context, CAST(COUNT(*) AS BIGINT) AS n, ROUND(SUM(value), 4) AS total, ROUND(AVG(value), 6) AS mean FROM events GROUP BY 1, 2")
def stream_statistics(spark, sf_dir):
    """Extension: hourly sufficient statistics merged; the streamed form is tested against this one."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return stream.merged(stream.windowed(e), "unit", "context").select("unit", "context", "n", F.round("total", 4).alias("total"), "mean")


@query("text_complex_sets", "WITH s AS (SELECT DISTINCT p_type AS set_name, UNNEST(STRING_SPLIT(TRANSLATE(p_name, ' ', ';'), ';')) AS member FROM part), b AS (SELECT DISTINCT UNNEST(STRING_SPLIT(p_name, ' ')) AS member FROM part WHERE p_size > 25), i AS (SELECT set_name, member FROM s WHERE TRIM(member) <> '' AND member IN (SELECT member FROM b)) SELECT set_name, member FROM i WHERE set_name IN (SELECT set_name FROM i GROUP BY 1 HAVING COUNT(*) >= 2)")
def text_complex_sets(spark, sf_dir):
    """A4, H1: lists split at two separators, restricted to a background, two members at least."""
    part = table(spark, sf_dir, "part")
    sets = part.select(F.col("p_type").alias("set_name"), F.explode(F.split(F.translate("p_name", " ", ";"), ";")).alias("member"))
    background = part.where("p_size > 25").select(F.explode(F.split("p_name", " ")).alias("member"))
    return S.restrict_sets(sets, background)


@query("text_json_fields", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_valid(props)")
def text_json_fields(spark, sf_dir):
    """A3 (column form): a field of each row's JSON document; rows whose document does not parse are left out."""
    e = table(spark, sf_dir, "events")
    parsed = e.withColumn("doc", F.expr("try_parse_json(props)")).where("doc IS NOT NULL")
    return parsed.select("event_id", F.expr("try_variant_get(doc, '$.k', 'bigint')").alias("k"))


@query("text_decode_categories", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN NULL ELSE r_name END AS name FROM customer LEFT JOIN region ON r_regionkey = CASE WHEN c_custkey % 4 = 3 THEN -1 ELSE c_custkey % 4 END")
def text_decode_categories(spark, sf_dir):
    """Category codes to names, -1 to null."""
    codes = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 == 3, -1).otherwise(F.col("c_custkey") % 4).alias("code0"))
    dim = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("code"), F.col("r_name").alias("value"))
    return S.decode_categories(codes, "code0", dim, "name").select("c_custkey", "name")


@query("lookup_best_scores", "SELECT o_orderpriority AS key, MAX(o_totalprice) AS score FROM orders GROUP BY 1")
def lookup_best_scores(spark, sf_dir):
    """Greatest score per key of the pages."""
    return lookups.best_scores(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("key"), F.col("o_totalprice").alias("score")))


@query("lookup_hits_table", "WITH s AS (SELECT CAST(l_suppkey AS VARCHAR) AS key, l_returnflag AS g, MAX(l_discount * l_tax) AS score FROM lineitem GROUP BY 1, 2), p AS (SELECT key, CAST(SUM(CASE WHEN score >= 0.007 THEN 1 ELSE 0 END) AS BIGINT) AS n_groups, MAX(score) AS best FROM s GROUP BY 1) SELECT *, CAST(ROW_NUMBER() OVER (ORDER BY n_groups DESC, best DESC, key) AS BIGINT) AS rank FROM p")
def lookup_hits_table(spark, sf_dir):
    """Groups hit and best score per key."""
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("key"), "l_returnflag").agg(F.max(F.col("l_discount") * F.col("l_tax")).alias("score"))
    return lookups.hits_table(s, 0.007)


@query("window_fixed_bins", f"WITH {CONTRAST}, b AS (SELECT CASE WHEN response < 1 THEN '0' WHEN response < 3 THEN '1-2' WHEN response < 5 THEN '3-4' WHEN response < 10 THEN '5-9' WHEN response < 20 THEN '10-19' ELSE '20+' END AS bin FROM contrast) SELECT bin, CAST(COUNT(*) AS BIGINT) AS n FROM b GROUP BY 1")
def window_fixed_bins(spark, sf_dir):
    """Left-closed bins with fixed edges."""
    r = F.col("response")
    b = F.when(r < 1, "0").when(r < 3, "1-2").when(r < 5, "3-4").when(r < 10, "5-9").when(r < 20, "10-19").otherwise("20+")
    return contrast(spark, sf_dir).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("window_tails", f"WITH {PROFILES}, l AS (SELECT unit, UNNEST(RANGE(64)) AS feature, UNNEST(profile) AS x FROM profiles), q AS (SELECT unit, QUANTILE_CONT(x, 0.95) AS hi, QUANTILE_CONT(x, 0.05) AS lo FROM l GROUP BY 1) SELECT l.unit, CAST(feature AS INT) AS feature, CASE WHEN x >= hi THEN 'top' ELSE 'bottom' END AS tail FROM l JOIN q ON l.unit = q.unit WHERE x >= hi OR x <= lo")
def window_tails(spark, sf_dir):
    """Features in the tails of each row, by exact percentiles."""
    l = profiles(spark, sf_dir).select("unit", F.posexplode("profile").alias("feature", "x"))  # noqa: E741
    q = l.groupBy("unit").agg(F.percentile("x", F.lit(0.95)).alias("hi"), F.percentile("x", F.lit(0.05)).alias("lo"))
    return l.join(q, "unit").where("x >= hi OR x <= lo").select("unit", "feature", F.when(F.col("x") >= F.col("hi"), "top").otherwise("bottom").alias("tail"))


@query("window_top_per_group", f"WITH {CONTRAST} SELECT context, unit, response, k FROM (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY context ORDER BY response DESC, unit) AS BIGINT) AS k FROM contrast) WHERE k <= CEIL(40 / 3.0)")
def window_top_per_group(spark, sf_dir):
    """Equal shares of a cap per group, mixed-direction order."""
    w = Window.partitionBy("context").orderBy(F.col("response").desc(), "unit")
    return contrast(spark, sf_dir).withColumn("k", F.row_number().over(w).cast("long")).where("k <= 14").select("context", "unit", "response", "k")


@query("window_least_of_ranks", f"WITH {REPLICATES} SELECT unit, context, LEAST(CASE WHEN guide_corr IS NOT NULL THEN RANK() OVER (ORDER BY guide_corr DESC NULLS LAST) END, CASE WHEN donor_corr IS NOT NULL THEN RANK() OVER (ORDER BY donor_corr DESC NULLS LAST) END) AS best_rank FROM replicates")
def window_least_of_ranks(spark, sf_dir):
    """The lesser of two ranks, either of which may be null."""
    df = T.ranked(replicates(spark, sf_dir), ["guide_corr", "donor_corr"])
    down = lambda c: F.col(f"{c}_all") - F.col(f"{c}_below") - F.col(f"{c}_ties") + 1  # noqa: E731  from the largest value
    return df.select("unit", "context", F.least(down("guide_corr"), down("donor_corr")).alias("best_rank"))


@query("concord_gate", f"WITH {BASE}, n AS (SELECT COUNT(*) AS n FROM ranked r JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P') o ON r.unit = o_custkey) SELECT CAST(n AS BIGINT) AS n, CASE WHEN n < 50 THEN 'stop' WHEN n < 100 THEN 'caveat' ELSE 'proceed' END AS call FROM n")
def concord_gate(spark, sf_dir):
    """Overlap gate."""
    other = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("unit"))
    n = posterior(spark, sf_dir).join(other, "unit", "left_semi").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("call", F.when(F.col("n") < 50, "stop").when(F.col("n") < 100, "caveat").otherwise("proceed"))


@query("concord_replicates", f"WITH {CONTRAST}, {REPLICATES}, f AS (SELECT r.unit, FIRST(donor_corr ORDER BY r.context) FILTER (WHERE donor_corr IS NOT NULL) AS donor, MIN(donor_corr) >= 0 AS robust, MAX(response) AS y FROM replicates r JOIN contrast c ON r.unit = c.unit AND r.context = c.context WHERE gate GROUP BY 1), v AS (SELECT * FROM f WHERE donor IS NOT NULL), k AS (SELECT {avg_rank_sql('donor')} AS rx, {avg_rank_sql('y')} AS ry FROM v) SELECT (SELECT CAST(COUNT(*) AS BIGINT) FROM v) AS n, (SELECT {SPEARMAN} FROM k) AS rho, (SELECT CAST(COUNT(*) AS BIGINT) FROM f WHERE robust = FALSE) AS n_failed")
def concord_replicates(spark, sf_dir):
    """Replicate concordance of gated units and the robust flag."""
    df = replicates(spark, sf_dir).join(contrast(spark, sf_dir).where("gate"), ["unit", "context"])
    first = F.min_by("donor_corr", F.when(F.col("donor_corr").isNotNull(), F.col("context")))
    f = df.groupBy("unit").agg(first.alias("donor"), (F.min("donor_corr") >= 0).alias("robust"), F.max("response").alias("y"))
    failed = f.agg(F.sum(F.when(F.col("robust") == F.lit(False), 1).otherwise(0)).cast("long").alias("n_failed"))
    return T.spearman(f, "donor", "y").crossJoin(failed).select("n", "rho", "n_failed")


@query("concord_flag_lists", f"WITH {REPLICATES}, rb AS (SELECT unit, MIN(donor_corr) >= 0.0 AS robust FROM replicates GROUP BY 1), s AS (SELECT c_mktsegment AS program, c_custkey AS unit FROM customer) SELECT program, STRING_AGG(CAST(s.unit AS VARCHAR), ';' ORDER BY s.unit) AS failed FROM s JOIN rb ON s.unit = rb.unit WHERE robust = FALSE GROUP BY 1")
def concord_flag_lists(spark, sf_dir):
    """I32: per program the list of members whose flag is false (not null)."""
    rb = replicates(spark, sf_dir).groupBy("unit").agg((F.min("donor_corr") >= 0.0).alias("robust"))
    s = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("program"), F.col("c_custkey").alias("unit")).join(rb, "unit").where(F.col("robust") == F.lit(False))
    return s.groupBy("program").agg(F.concat_ws(";", F.transform(F.array_sort(F.collect_list("unit")), lambda u: u.cast("string"))).alias("failed"))


@query("concord_power", f"WITH {REPLICATES}, v AS (SELECT unit, context, guide_corr, donor_corr FROM replicates WHERE guide_corr IS NOT NULL AND donor_corr IS NOT NULL) SELECT unit, context, ROUND({avg_rank_sql('guide_corr')} / COUNT(*) OVER (), 9) AS pct_a, ROUND({avg_rank_sql('donor_corr')} / COUNT(*) OVER (), 9) AS pct_b, {avg_rank_sql('guide_corr')} / COUNT(*) OVER () >= 0.5 AND {avg_rank_sql('donor_corr')} / COUNT(*) OVER () >= 0.5 AS powered FROM v")
def concord_power(spark, sf_dir):
    """Units in the upper half of both measures."""
    v = T.ranked(replicates(spark, sf_dir).dropna(), ["guide_corr", "donor_corr"])
    a, b = (T.average_of_ties(c) / F.col(f"{c}_all") for c in ("guide_corr", "donor_corr"))
    return v.select("unit", "context", a.alias("a"), b.alias("b")).select("unit", "context", F.round("a", 9).alias("pct_a"), F.round("b", 9).alias("pct_b"), ((F.col("a") >= 0.5) & (F.col("b") >= 0.5)).alias("powered"))


@query("concord_class_transfer", f"WITH {BASE}, cls AS (SELECT unit, CASE WHEN n_signif_contexts >= 2 AND condition_specificity < 0.6 THEN 'global' ELSE 'context_specific' END AS class FROM breadth), {REPLICATES}, r AS (SELECT unit, AVG(guide_corr) AS g FROM replicates GROUP BY 1) SELECT class, CAST(COUNT(*) AS BIGINT) AS n, ROUND(AVG(g), 6) AS mean_r, ROUND(AVG(CASE WHEN g < 0.1 THEN 1.0 ELSE 0.0 END), 6) AS not_universal FROM cls JOIN r ON cls.unit = r.unit WHERE g IS NOT NULL GROUP BY 1")
def concord_class_transfer(spark, sf_dir):
    """Per class, mean concordance and the share that does not carry over."""
    cls = R.regulator_class(R.unit_breadth(contrast(spark, sf_dir))).select("unit", F.col("regulator_class").alias("class"))
    r = replicates(spark, sf_dir).groupBy("unit").agg(F.avg("guide_corr").alias("g")).where("g IS NOT NULL")
    return cls.join(r, "unit").groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("g"), 6).alias("mean_r"), F.round(F.avg((F.col("g") < 0.1).cast("double")), 6).alias("not_universal"))


@query("concord_module_rollup", f"WITH {BASE}, m(unit) AS (VALUES (1), (2), (4), (5), (7), (999999)) SELECT m.unit, COALESCE(CASE WHEN r.unit IS NOT NULL THEN CASE WHEN rank <= 500 THEN 'universal' ELSE 'weak' END END, 'not_in_shared') AS call FROM m LEFT JOIN ranked r ON m.unit = r.unit")
def concord_module_rollup(spark, sf_dir):
    """A fixed list against a table; absent units get a default."""
    m = S.literal(spark, [(u,) for u in (1, 2, 4, 5, 7, 999999)], "unit int")
    r = R.ranked(posterior(spark, sf_dir)).select("unit", "rank")
    return m.join(r, "unit", "left").select("unit", F.coalesce(F.when(F.col("rank") <= 500, "universal").when(F.col("rank").isNotNull(), "weak"), F.lit("not_in_shared")).alias("call"))


@query("concord_condition_panel", f"WITH {CONTRAST}, c AS (SELECT unit, c_mktsegment AS class, context, response FROM contrast JOIN customer ON unit = c_custkey) SELECT class, MEDIAN(response) FILTER (WHERE context = 'A') AS \"A\", MEDIAN(response) FILTER (WHERE context = 'N') AS \"N\", MEDIAN(response) FILTER (WHERE context = 'R') AS \"R\" FROM c GROUP BY 1")
def concord_condition_panel(spark, sf_dir):
    """Class by context medians as columns."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("unit"), F.col("c_mktsegment").alias("class"))
    return contrast(spark, sf_dir).join(c, "unit").groupBy("class").pivot("context", ["A", "N", "R"]).agg(F.median("response"))


@query("concord_permutation", f"WITH {BASE}, b AS (SELECT unit, context, ROUND(work, 9) AS x, support AS y, CAST(ROW_NUMBER() OVER (ORDER BY unit, context) AS BIGINT) AS pos FROM work), s AS (SELECT b.b, pos AS p0, CAST(ROW_NUMBER() OVER (PARTITION BY b.b ORDER BY MD5('perm#' || CAST(b.b AS VARCHAR) || '#' || CAST(pos AS VARCHAR)), pos) AS BIGINT) AS pos FROM (SELECT t.b, pos FROM b, RANGE(20) t(b)) b), nl AS (SELECT s.b, CORR(a.x, c.y) AS r FROM s JOIN b a ON a.pos = s.p0 JOIN b c ON c.pos = s.pos GROUP BY 1), o AS (SELECT CORR(x, y) AS r FROM b) SELECT ROUND(o.r, 6) AS observed, ROUND(QUANTILE_CONT(nl.r, 0.95), 6) AS q95, ROUND((SUM(CASE WHEN nl.r >= o.r THEN 1 ELSE 0 END) + 1) / (COUNT(*) + 1.0::DOUBLE), 6) AS p FROM nl, o GROUP BY o.r")
def concord_permutation(spark, sf_dir):
    """Correlation against seeded permutations, the draw being a key."""
    return permuted(spark, sf_dir, 20)


def permuted(spark, sf_dir, draws: int):
    b = T.ranked(deviations(spark, sf_dir).select("unit", "context", F.round("work", 9).alias("x"), F.col("support").alias("y")), ["unit"])
    nth = F.row_number().over(Window.partitionBy("unit").orderBy("context"))
    b = b.select("x", "y", (F.col("unit_below") + nth).cast("long").alias("pos"))
    b = Scratch(spark, "permuted").save(b, "rows")
    facts = b.agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy")).first()
    centred = b.select("pos", (F.col("x") - F.lit(facts["mx"])).alias("x"), (F.col("y") - F.lit(facts["my"])).alias("y"))
    scale = F.nullif(F.lit(facts["sx"]) * F.lit(facts["sy"]), F.lit(0.0))
    null = products(centred, facts["n"], draws, "perm").select("b", (F.col("total") / facts["n"] / scale).alias("r"))
    seen = b.agg(X.pearson(F.col("x"), F.col("y")).alias("o"))
    return null.crossJoin(F.broadcast(seen)).agg(F.round(F.max("o"), 6).alias("observed"), F.round(F.percentile("r", F.lit(0.95)), 6).alias("q95"), F.round((F.sum((F.col("r") >= F.col("o")).cast("long")) + 1) / (F.count(F.lit(1)) + 1.0), 6).alias("p"))


@query("concord_permutation_full")
def concord_permutation_full(spark, sf_dir):
    """I25, K5 with the reference's 300 draws: the SQL is held against 20."""
    return permuted(spark, sf_dir, 300)
