"""Audits: matched nulls, concordance of units, robustness, metrics and enrichment per community, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import exprs as X
from quillon.functions.kernels import hypergeometric_pmf, normal_sf
from quillon.operators import ranking as R
from quillon.operators import stats as T
from quillon.plans.bindings import CLASSES, CONTRAST, MEMBERSHIPS, PROFILES, REPLICATES, classes, contrast, memberships, profiles, replicates, table
from quillon.plans.effect_queries import SPEARMAN, avg_rank_sql
from quillon.plans.profile_queries import CELLS, cells
from quillon.plans.ranking_queries import BASE, deviations, posterior
from quillon.plans.registry import query
from quillon.sources.shared import Scratch


def _md5(seed: str, *parts: str) -> str:
    return "MD5('" + seed + "#' || " + " || '#' || ".join(f"CAST({p} AS VARCHAR)" for p in parts) + ")"


UNITS = f"""{PROFILES}, mem AS (SELECT program AS set_name, unit FROM profiles), sz AS (SELECT set_name, CAST(COUNT(*) AS BIGINT) AS m FROM mem GROUP BY 1 HAVING COUNT(*) >= 2)"""


def _cohesion(vector: str, drawn: str) -> str:
    """Tables seen (set_name, m, observed) and nm (set_name, b, v) of unit vectors uv and drawn members."""
    return f"""z AS (SELECT unit, {vector} AS c FROM profiles), uv AS (SELECT unit, UNNEST(RANGE(64)) AS d, UNNEST(c) / COALESCE(NULLIF(SQRT(LIST_SUM(LIST_TRANSFORM(c, lambda x: x * x))), 0), 1) AS v FROM z),
seen AS (SELECT q.set_name, m, ROUND((SUM(s * s) - m) / (m * (m - 1)), 9) AS observed FROM (SELECT set_name, d, SUM(v) AS s FROM mem JOIN uv ON mem.unit = uv.unit GROUP BY 1, 2) q JOIN sz ON q.set_name = sz.set_name GROUP BY 1, 2),
{drawn},
nm AS (SELECT q.set_name, b, ROUND((SUM(s * s) - m) / (m * (m - 1)), 9) AS v FROM (SELECT set_name, b, d, SUM(v) AS s FROM dr JOIN uv ON dr.unit = uv.unit GROUP BY 1, 2, 3) q JOIN sz ON q.set_name = sz.set_name GROUP BY 1, 2, m)"""


BY_CONTEXT = f"""rk AS (SELECT unit, b, unit % 3 AS st, ROW_NUMBER() OVER (PARTITION BY b, unit % 3 ORDER BY {_md5('mix', 'b', 'unit')}, unit) AS k FROM profiles, RANGE(20) t(b)),
nd AS (SELECT set_name, unit % 3 AS st, COUNT(*) AS need FROM mem GROUP BY 1, 2),
dr AS (SELECT set_name, b, unit FROM rk JOIN nd ON rk.st = nd.st AND k <= need)"""


@query("stat_cohesion_contexts", f"WITH {UNITS}, {_cohesion('profile', BY_CONTEXT)} SELECT n.set_name, m, ROUND(observed, 6) AS observed, ROUND(AVG(v), 6) AS null_mean, ROUND((observed - AVG(v)) / (STDDEV_POP(v) + 1e-9), 3) AS z, ROUND((SUM(CASE WHEN v >= observed THEN 1 ELSE 0 END) + 1) / (COUNT(*) + 1.0::DOUBLE), 6) AS p FROM nm n JOIN seen s ON n.set_name = s.set_name GROUP BY n.set_name, m, observed")
def stat_cohesion_contexts(spark, sf_dir):
    """I23, null B: cohesion of sets against draws with their members' mix of contexts (here unit modulo 3)."""
    return cohesion_contexts(spark, sf_dir, 20)


def cohesion_contexts(spark, sf_dir, draws: int):
    df = profiles(spark, sf_dir).withColumn("context", F.col("unit") % 3)
    return T.cohesion_null(df, df.select(F.col("program").alias("set_name"), "unit"), draws, "mix", "context")


@query("stat_cohesion_contexts_full")
def stat_cohesion_contexts_full(spark, sf_dir):
    """I23, null B with the reference's 5,000 draws: the SQL is held against 20."""
    return cohesion_contexts(spark, sf_dir, 5000)


ANY_UNIT = f"""rk AS (SELECT unit, b, ROW_NUMBER() OVER (PARTITION BY b ORDER BY {_md5('module', 'b', 'unit')}, unit) AS k FROM profiles, RANGE(20) t(b)),
dr AS (SELECT set_name, b, unit FROM rk JOIN sz ON k <= m)"""
CENTRED = "LIST_TRANSFORM(profile, lambda x: x - LIST_AVG(profile))"


@query("stat_module_null", f"WITH {UNITS}, {_cohesion(CENTRED, ANY_UNIT)} SELECT n.set_name, m, ROUND(observed, 6) AS observed, ROUND(AVG(v), 6) AS null_mean, ROUND((observed - AVG(v)) / (STDDEV_SAMP(v) + 1e-12), 3) AS z, ROUND(AVG(CASE WHEN v >= observed THEN 1.0 ELSE 0.0 END), 6) AS p FROM nm n JOIN seen s ON n.set_name = s.set_name GROUP BY n.set_name, m, observed")
def stat_module_null(spark, sf_dir):
    """Mean pairwise correlation of modules against same-size draws."""
    return modules(spark, sf_dir, 20)


def modules(spark, sf_dir, draws: int):
    df = profiles(spark, sf_dir)
    return T.module_null(df, df.select(F.col("program").alias("set_name"), "unit"), draws)


@query("stat_module_null_full")
def stat_module_null_full(spark, sf_dir):
    """I27 with the reference's 2,000 draws: the SQL is held against 20."""
    return modules(spark, sf_dir, 2000)


COMPACT = f"""{UNITS}, lg AS (SELECT unit, UNNEST(RANGE(64)) AS d, UNNEST(profile) AS x FROM profiles), sc AS (SELECT d, AVG(x) AS mu, STDDEV_POP(x) AS sd FROM lg GROUP BY 1),
wt AS (SELECT unit, LIST((x - mu) / CASE WHEN sd = 0 THEN 1 ELSE sd END ORDER BY lg.d) AS white FROM lg JOIN sc ON lg.d = sc.d GROUP BY 1),
rk AS (SELECT unit, b, ROW_NUMBER() OVER (PARTITION BY b ORDER BY {_md5('compact', 'b', 'unit')}, unit) AS k FROM profiles, RANGE(5) t(b)),
dr AS (SELECT set_name, b, unit FROM rk JOIN sz ON k <= m UNION ALL SELECT mem.set_name, -1, unit FROM mem JOIN sz ON mem.set_name = sz.set_name),
full_ AS (SELECT dr.set_name, b, dr.unit, profile, white FROM dr JOIN profiles p ON dr.unit = p.unit JOIN wt ON dr.unit = wt.unit),
pr AS (SELECT x.set_name, x.b, AVG(1 - LIST_COSINE_SIMILARITY(x.profile, y.profile)) AS cosine, AVG(LIST_DISTANCE(x.profile, y.profile)) AS euclidean, AVG(LIST_DISTANCE(x.white, y.white)) AS whitened FROM full_ x JOIN full_ y ON x.set_name = y.set_name AND x.b = y.b AND x.unit < y.unit GROUP BY 1, 2),
lv AS (SELECT set_name, b, 'cosine' AS metric, ROUND(cosine, 9) AS v FROM pr UNION ALL SELECT set_name, b, 'euclidean', ROUND(euclidean, 9) FROM pr UNION ALL SELECT set_name, b, 'whitened', ROUND(whitened, 9) FROM pr),
ob AS (SELECT set_name, metric, v AS observed FROM lv WHERE b = -1)"""


@query("stat_compactness", f"WITH {COMPACT} SELECT l.set_name, l.metric, m, ROUND(observed, 6) AS observed, ROUND(AVG(v), 6) AS null_mean, ROUND((AVG(v) - observed) / (STDDEV_POP(v) + 1e-9), 3) AS z, ROUND((SUM(CASE WHEN v <= observed THEN 1 ELSE 0 END) + 1) / (COUNT(*) + 1.0::DOUBLE), 6) AS p FROM lv l JOIN ob ON l.set_name = ob.set_name AND l.metric = ob.metric JOIN sz ON l.set_name = sz.set_name WHERE b >= 0 GROUP BY 1, 2, m, observed")
def stat_compactness(spark, sf_dir):
    """Compactness of sets under cosine, Euclidean and whitened distance, 5 draws to hold the SQL's pairs down."""
    return compactness(spark, sf_dir, 5)


def compactness(spark, sf_dir, draws: int):
    df = profiles(spark, sf_dir)
    return T.compactness_null(df, df.select(F.col("program").alias("set_name"), "unit"), draws)


@query("stat_compactness_full")
def stat_compactness_full(spark, sf_dir):
    """I24 with the reference's 5,000 draws: the SQL is held against 5."""
    return compactness(spark, sf_dir, 5000)


def _layer(name: str, stratum: str, kept: str) -> str:
    rank = f"ROW_NUMBER() OVER (PARTITION BY b, stratum ORDER BY {_md5('load', 'b', 'unit')}, unit)"
    return f"""SELECT '{name}' AS layer, * FROM (WITH s AS (SELECT unit, score, {stratum} AS stratum FROM sc WHERE {kept}), nd AS (SELECT set_name, stratum, COUNT(*) AS need, SUM(score) AS load FROM mem JOIN s ON mem.unit = s.unit GROUP BY 1, 2),
    ob AS (SELECT set_name, SUM(load) AS observed FROM nd GROUP BY 1), rk AS (SELECT b, stratum, score, {rank} AS k FROM s, RANGE(20) t(b)),
    nl AS (SELECT set_name, b, ROUND(SUM(score), 4) AS v FROM rk JOIN nd ON rk.stratum = nd.stratum AND k <= need GROUP BY 1, 2)
    SELECT nl.set_name, ROUND(observed, 4) AS observed, ROUND(AVG(v), 4) AS null_mean, ROUND(AVG(CASE WHEN v >= ROUND(observed, 4) THEN 1.0 ELSE 0.0 END), 6) AS p FROM nl JOIN ob ON nl.set_name = ob.set_name GROUP BY nl.set_name, observed)"""


LOADS = """u AS (SELECT c_custkey AS unit, ROUND(ABS(c_acctbal), 2) AS score, CAST(LENGTH(c_mktsegment) * 1000 + c_custkey % 700 AS DOUBLE) AS size, c_custkey % 11 = 0 AS flagged FROM customer),
e AS (SELECT LIST_SORT(LIST_DISTINCT(QUANTILE_CONT(size, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]))) AS cuts FROM u),
sc AS (SELECT unit, score, flagged, CAST(LEN(LIST_FILTER(cuts, lambda c: c < size)) AS INT) AS decile FROM u, e), mem AS (SELECT CAST(c_nationkey AS VARCHAR) AS set_name, c_custkey AS unit FROM customer)"""


@query("stat_load_layers", f"WITH {LOADS} {_layer('uniform', '0', 'true')} UNION ALL {_layer('matched', 'decile', 'true')} UNION ALL {_layer('matched_unflagged', 'decile', 'NOT flagged')}")
def stat_load_layers(spark, sf_dir):
    """Loads of sets in three layers: uniform, matched by decile, and matched without flagged units."""
    return load_layers(spark, sf_dir, 20)


def load_layers(spark, sf_dir, draws: int):
    c = table(spark, sf_dir, "customer")
    size = (F.length("c_mktsegment") * 1000 + F.col("c_custkey") % 700).cast("double")
    u = c.select(F.col("c_custkey").alias("unit"), F.round(F.abs("c_acctbal"), 2).alias("score"), size.alias("size"), (F.col("c_custkey") % 11 == 0).alias("flagged"))
    members = c.select(F.col("c_nationkey").cast("string").alias("set_name"), F.col("c_custkey").alias("unit"))
    return T.load_layers(T.decile_edges(u, "size"), members, draws)


@query("stat_load_layers_full")
def stat_load_layers_full(spark, sf_dir):
    """I28 with the reference's 10,000 draws: the SQL is held against 20."""
    return load_layers(spark, sf_dir, 10000)


def _corr(x: str, y: str) -> str:
    mean = lambda e: f"(LIST_SUM(LIST_TRANSFORM(LIST_ZIP({x}, {y}), lambda t: {e})) / LEN({x}))"
    mx, my = mean("t[1]"), mean("t[2]")
    sx, sy = (f"SQRT(GREATEST({mean(f't[{k}] * t[{k}]')} - {m} * {m}, 0))" for k, m in ((1, mx), (2, my)))
    return f"ROUND(({mean('t[1] * t[2]')} - {mx} * {my}) / (({sx} + 1e-9) * ({sy} + 1e-9)), 9)"


PAIRS = f"""{CELLS}, pair AS (SELECT a.unit, a.profile AS pa, b.profile AS pb FROM cells a JOIN cells b ON a.unit = b.unit WHERE a.context = 'A' AND b.context = 'N'),
seen AS (SELECT unit, CAST(LEN(pa) AS BIGINT) AS n_common, {_corr('pa', 'pb')} AS r FROM pair),
rg AS (SELECT unit, b, ROW_NUMBER() OVER (PARTITION BY b ORDER BY {_md5('partner', 'b', 'unit')}, unit) AS pos FROM pair, RANGE(20) t(b)),
mt AS (SELECT x.unit, y.unit AS other FROM rg x JOIN rg y ON x.b = y.b AND y.pos = x.pos % (SELECT COUNT(*) FROM pair) + 1),
nl AS (SELECT mt.unit, {_corr('p.pa', 'q.pb')} AS v FROM mt JOIN pair p ON mt.unit = p.unit JOIN pair q ON mt.other = q.unit),
ct AS (SELECT QUANTILE_CONT(v, 0.95) AS q95, QUANTILE_CONT(v, 0.5) AS med FROM nl),
ep AS (SELECT nl.unit, AVG(CASE WHEN v >= r THEN 1.0 ELSE 0.0 END) AS emp_p FROM nl JOIN seen s ON nl.unit = s.unit GROUP BY 1),
uc AS (SELECT s.unit, ROUND(r, 6) AS r, n_common, ROUND(emp_p, 6) AS emp_p, CASE WHEN r > q95 AND emp_p < 0.05 THEN 'universal' WHEN r <= med THEN 'specific' ELSE 'intermediate' END AS class FROM seen s JOIN ep ON s.unit = ep.unit, ct)"""


def unit_concordance(spark, sf_dir, draws: int):
    df = cells(spark, sf_dir)
    return T.unit_concordance(df.where("context = 'A'"), df.where("context = 'N'"), draws, least=5)


@query("concord_units", f"WITH {PAIRS} SELECT * FROM uc")
def concord_units(spark, sf_dir):
    """Concordance of every unit's profiles in two contexts against seeded partners."""
    return unit_concordance(spark, sf_dir, 20)


@query("concord_units_full")
def concord_units_full(spark, sf_dir):
    """I25 with the reference's 300 draws: the SQL is held against 20."""
    return unit_concordance(spark, sf_dir, 300)


DIAGNOSE = f"""{PAIRS}, sp AS (SELECT unit, MAX(support) FILTER (WHERE context = 'A') AS sa, MAX(support) FILTER (WHERE context = 'N') AS sn, CAST(SUM(LEN(LIST_FILTER(profile, lambda x: x > 0))) AS BIGINT) AS n_co FROM cells GROUP BY 1),
jn AS (SELECT uc.unit, class, r, n_co, {avg_rank_sql('sa')} / COUNT(*) OVER () AS pa, {avg_rank_sql('sn')} / COUNT(*) OVER () AS pn FROM uc JOIN sp ON uc.unit = sp.unit),
lw AS (SELECT *, ROUND(LEAST(pa, pn), 9) AS low FROM jn), kr AS (SELECT *, {avg_rank_sql('r')} AS r1, {avg_rank_sql('low')} AS r2, {avg_rank_sql('n_co')} AS r3 FROM lw)"""


@query("concord_diagnostics", f"WITH {DIAGNOSE} SELECT ROUND(CORR(r1, r2), 6) AS rho_power, ROUND(CORR(r1, r3), 6) AS rho_coverage, CAST(SUM(CASE WHEN pa >= 0.5 AND pn >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS n_powered, CAST(SUM(CASE WHEN pa >= 0.5 AND pn >= 0.5 AND class = 'universal' THEN 1 ELSE 0 END) AS BIGINT) AS powered_universal, CAST(SUM(CASE WHEN pa >= 0.5 AND pn >= 0.5 AND class = 'specific' THEN 1 ELSE 0 END) AS BIGINT) AS powered_specific FROM kr")
def concord_diagnostics(spark, sf_dir):
    """Does concordance follow power (the lesser percentile rank of support) or coverage? Classes of the well-powered units."""
    df = cells(spark, sf_dir)
    of = lambda c: F.max(F.when(F.col("context") == c, F.col("support")))
    facts = df.groupBy("unit").agg(of("A").alias("sa"), of("N").alias("sn"), F.sum(F.size(F.filter("profile", lambda x: x > 0))).alias("n_co"))
    joined = Scratch(spark, "diagnostics").save(concord_units(spark, sf_dir).join(facts, "unit"), "joined")
    j = T.ranked(joined, ["sa", "sn"])  # a row a unit, read by every ranking
    pa, pn = (T.average_of_ties(c) / F.col(f"{c}_all") for c in ("sa", "sn"))
    j = j.select("class", "r", "n_co", pa.alias("pa"), pn.alias("pn")).withColumn("low", F.round(F.least("pa", "pn"), 9))
    powered = (F.col("pa") >= 0.5) & (F.col("pn") >= 0.5)
    count = lambda c: F.sum(c.cast("long"))
    counts = j.agg(count(powered).alias("n_powered"), count(powered & (F.col("class") == "universal")).alias("powered_universal"), count(powered & (F.col("class") == "specific")).alias("powered_specific"))
    rho = lambda c, name: T.spearman(j, "r", c).select(F.col("rho").alias(name))
    return rho("low", "rho_power").crossJoin(rho("n_co", "rho_coverage")).crossJoin(counts)


FLAGGED = f"""{BASE}, {REPLICATES}, ag AS (SELECT penalty_flag, single, gate FROM contrast c JOIN replicates r ON c.unit = r.unit AND c.context = r.context),
u1 AS (SELECT unit, AVG(work) AS d, (SELECT VAR_POP(work) FROM work) / COUNT(*) AS s2 FROM work WHERE gate AND NOT penalty_flag GROUP BY 1), p1 AS (SELECT GREATEST(VAR_POP(d) - AVG(s2), 1e-6) AS tau2 FROM u1),
k1 AS (SELECT unit, ROUND(tau2 / (tau2 + s2) * d, 9) AS u, CAST(ROW_NUMBER() OVER (ORDER BY ROUND(tau2 / (tau2 + s2) * d, 9) DESC, unit) AS BIGINT) AS rank FROM u1, p1),
cm AS (SELECT {avg_rank_sql('a')} AS rx, {avg_rank_sql('b')} AS ry FROM (SELECT ROUND(r.u, 9) AS a, k1.u AS b FROM ranked r JOIN k1 ON r.unit = k1.unit))"""


@query("rank_flag_audit", f"""WITH {FLAGGED}
SELECT 'semantics' AS check_name, 'agreement %' AS metric, ROUND(100 * AVG(CASE WHEN penalty_flag = single THEN 1.0 ELSE 0.0 END), 4) AS value FROM ag
UNION ALL SELECT 'semantics', 'of flagged, % single', ROUND(100 * AVG(CASE WHEN single THEN 1.0 ELSE 0.0 END) FILTER (WHERE penalty_flag), 4) FROM ag
UNION ALL SELECT 'semantics', 'of gated, % flagged', ROUND(100 * AVG(CASE WHEN penalty_flag THEN 1.0 ELSE 0.0 END) FILTER (WHERE gate), 4) FROM ag
UNION ALL SELECT 'ranking', 'rho', ROUND(CORR(rx, ry), 4) FROM cm
UNION ALL SELECT 'ranking', 'top 30 in both', CAST(COUNT(*) AS DOUBLE) FROM ranked r JOIN k1 ON r.unit = k1.unit WHERE r.rank <= 30 AND k1.rank <= 30
UNION ALL SELECT 'moves', CAST(r.unit AS VARCHAR), CAST(r.rank - k1.rank AS DOUBLE) FROM ranked r LEFT JOIN k1 ON r.unit = k1.unit WHERE r.rank <= 5""")
def rank_flag_audit(spark, sf_dir):
    """What a flag means and whether leaving flagged rows out moves the ranking: agreement shares, rho, shared top and moves of the leaders."""
    df = contrast(spark, sf_dir)
    both = df.join(replicates(spark, sf_dir).select("unit", "context", "single"), ["unit", "context"])
    share = lambda c, where=F.lit(True): F.round(100 * F.avg(F.when(where, c.cast("double"))), 4)
    flag, single = F.col("penalty_flag"), F.col("single")
    shares = both.agg(share(flag == single).alias("agreement %"), share(single, flag).alias("of flagged, % single"), share(flag, F.col("gate")).alias("of gated, % flagged"))
    work = deviations(spark, sf_dir)
    base, clean = (R.ranked(R.shrink(w)).select("unit", F.round("u", 9).alias("u"), "rank") for w in (work, work.withColumn("gate", F.col("gate") & ~flag)))
    joined = base.join(clean.select("unit", F.col("u").alias("u1"), F.col("rank").alias("rank1")), "unit", "left")
    common = joined.where("rank1 IS NOT NULL")
    rho = T.spearman(common, "u", "u1").select(F.lit("ranking").alias("check_name"), F.lit("rho").alias("metric"), F.round("rho", 4).alias("value"))
    top = common.agg(F.sum(((F.col("rank") <= 30) & (F.col("rank1") <= 30)).cast("double")).alias("value")).select(F.lit("ranking").alias("check_name"), F.lit("top 30 in both").alias("metric"), "value")
    moves = joined.where("rank <= 5").select(F.lit("moves").alias("check_name"), F.col("unit").cast("string").alias("metric"), (F.col("rank") - F.col("rank1")).cast("double").alias("value"))
    semantics = shares.unpivot([], list(shares.columns), "metric", "value").select(F.lit("semantics").alias("check_name"), "metric", "value")
    return semantics.unionByName(rho).unionByName(top).unionByName(moves)


ROBUST = f"""{CONTRAST}, {REPLICATES}, sig AS (SELECT c.unit, c.context, response, support, donor_corr FROM contrast c JOIN replicates r ON c.unit = r.unit AND c.context = r.context WHERE gate),
per AS (SELECT unit, ARG_MAX(donor_corr, (response, context)) FILTER (WHERE donor_corr IS NOT NULL) AS donor, MIN(donor_corr) >= 0.5 AS robust, MAX(response) AS y FROM sig GROUP BY 1),
rk AS (SELECT *, ROW_NUMBER() OVER (ORDER BY y DESC, unit) AS k FROM per),
s1 AS (SELECT {avg_rank_sql('donor_corr')} AS rx, {avg_rank_sql('response')} AS ry, {avg_rank_sql('support')} AS rz FROM sig WHERE donor_corr IS NOT NULL),
mw AS (SELECT k <= 50 AS g, {avg_rank_sql('donor')} AS r, COUNT(*) OVER (PARTITION BY donor) AS t FROM rk WHERE donor IS NOT NULL),
ms AS (SELECT CAST(SUM(CASE WHEN g THEN 1 ELSE 0 END) AS DOUBLE) AS n1, CAST(SUM(CASE WHEN g THEN 0 ELSE 1 END) AS DOUBLE) AS n2, SUM(CASE WHEN g THEN r END) AS r1, SUM(CAST(t AS DOUBLE) * t - 1) AS ties FROM mw),
mz AS (SELECT (r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2 - 0.5) / NULLIF(SQRT(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))), 0) AS z FROM ms)"""


@query("concord_robust", f"WITH {ROBUST} SELECT (SELECT ROUND(CORR(rx, ry), 6) FROM s1) AS rho_response, (SELECT ROUND(CORR(rx, rz), 6) FROM s1) AS rho_support, (SELECT ROUND({normal_sf('z')}, 6) FROM mz) AS p_top, (SELECT CAST(COUNT(*) AS BIGINT) FROM rk WHERE k <= 30 AND robust) AS robust_of_30, (SELECT STRING_AGG(CAST(unit AS VARCHAR), ';' ORDER BY k) FROM rk WHERE k <= 60 AND NOT COALESCE(robust, FALSE)) AS failed_of_60")
def concord_robust(spark, sf_dir):
    """Replicate concordance in full: its rho with response and support, the top 50 against the rest, robust ones (least at 0.5) of 30 and failures of 60."""
    sig = contrast(spark, sf_dir).where("gate").join(replicates(spark, sf_dir).select("unit", "context", "donor_corr"), ["unit", "context"])
    first = F.max_by("donor_corr", F.when(F.col("donor_corr").isNotNull(), F.struct("response", "context")))
    per = sig.groupBy("unit").agg(first.alias("donor"), (F.min("donor_corr") >= 0.5).alias("robust"), F.max("response").alias("y"))
    leaders = per.orderBy(F.col("y").desc(), "unit").limit(60).select("unit", F.lit(True).alias("leads"))
    order = Window.orderBy(F.col("y").desc(), "unit")
    top = per.join(F.broadcast(leaders), "unit").withColumn("k", F.row_number().over(order))  # sixty rows
    placed = per.join(F.broadcast(top.select("unit", "k")), "unit", "left").withColumn("g", F.coalesce(F.col("k") <= 50, F.lit(False)))
    p = T.mann_whitney(placed, "donor", "g").select(F.col("p").alias("p_top"))
    failed = F.array_sort(F.collect_list(F.when(~F.coalesce("robust", F.lit(False)), F.struct("k", "unit"))))
    lists = top.agg(F.sum(((F.col("k") <= 30) & F.coalesce("robust", F.lit(False))).cast("long")).alias("robust_of_30"), F.concat_ws(";", F.transform(failed, lambda x: x["unit"].cast("string"))).alias("failed_of_60"))
    rho = lambda c: T.spearman(sig, "donor_corr", c).select(F.col("rho").alias(f"rho_{c}"))
    return rho("response").crossJoin(rho("support")).crossJoin(p).crossJoin(lists)


FAMILY = f"""{MEMBERSHIPS}, {CLASSES}, bg AS (SELECT DISTINCT o_custkey AS member FROM orders), s AS (SELECT DISTINCT set_name, m.member FROM memberships m JOIN bg ON m.member = bg.member), d AS (SELECT DISTINCT class, unit AS member FROM classes JOIN bg ON unit = bg.member),
sk AS (SELECT set_name, CAST(COUNT(*) AS BIGINT) AS K FROM s GROUP BY 1), dn AS (SELECT class, CAST(COUNT(*) AS BIGINT) AS n FROM d GROUP BY 1), hx AS (SELECT class, set_name, CAST(COUNT(*) AS BIGINT) AS x FROM s JOIN d ON s.member = d.member GROUP BY 1, 2),
pp AS (SELECT dn.class, sk.set_name, K, n, COALESCE(x, 0) AS x, (SELECT COUNT(*) FROM bg) AS M FROM dn CROSS JOIN sk LEFT JOIN hx ON hx.class = dn.class AND hx.set_name = sk.set_name),
tl AS (SELECT class, set_name, SUM({hypergeometric_pmf('i', 'M', 'K', 'n')}) AS t FROM (SELECT *, UNNEST(RANGE(x, LEAST(K, n) + 1)) AS i FROM pp WHERE x > 0) q WHERE n - i <= M - K GROUP BY 1, 2),
en AS (SELECT pp.class, pp.set_name, x AS n_overlap, K AS set_size, n AS n_drawn, ROUND(LEAST(COALESCE(t, 1), 1), 11) AS p FROM pp LEFT JOIN tl ON pp.class = tl.class AND pp.set_name = tl.set_name),
st AS (SELECT *, p * COUNT(*) OVER (PARTITION BY class) / ROW_NUMBER() OVER (PARTITION BY class ORDER BY p, set_name) AS q FROM en)"""


@query("graph_community_enrichment", f"WITH {FAMILY} SELECT class, set_name, n_overlap, set_size, n_drawn, ROUND(p, 8) AS p, ROUND(LEAST(MIN(q) OVER (PARTITION BY class ORDER BY p DESC, set_name DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1), 5) AS fdr FROM st")
def graph_community_enrichment(spark, sf_dir):
    """Every set in every community, a false discovery family of its own per community."""
    background = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("member"))
    drawn = classes(spark, sf_dir).select("class", F.col("unit").alias("member"))
    found = T.enrichment_by(drawn, memberships(spark, sf_dir), background, "class").withColumn("p", F.round("p", 11))
    return T.benjamini_hochberg(found, keys=("class",)).withColumns({"p": F.round("p", 8), "fdr": F.round("fdr", 5)})


FOLD = f"""{CONTRAST}, {CLASSES}, j AS (SELECT c.unit, class, context, response FROM contrast c JOIN classes k ON c.unit = k.unit),
md AS (SELECT class, MEDIAN(response) FILTER (WHERE context = 'A') AS a, MEDIAN(response) FILTER (WHERE context = 'R') AS r FROM j GROUP BY 1),
hi AS (SELECT class, unit, BOOL_OR(context = 'A') AS in_a, BOOL_OR(context = 'R') AS in_r FROM j WHERE response >= 5 AND context IN ('A', 'R') GROUP BY 1, 2),
jc AS (SELECT class, CAST(SUM(CASE WHEN in_a AND in_r THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) AS jac FROM hi GROUP BY 1)"""


@query("concord_condition_fold", f"WITH {FOLD} SELECT md.class, ROUND(CAST(r AS DOUBLE) / NULLIF(CAST(a AS DOUBLE), 0), 6) AS fold, ROUND(COALESCE(jac, 0), 6) AS self_jaccard FROM md LEFT JOIN jc ON md.class = jc.class")
def concord_condition_fold(spark, sf_dir):
    """Per class the fold of median breadth between two contexts, and how far its wide units are the same in both."""
    j = contrast(spark, sf_dir).join(classes(spark, sf_dir), "unit")
    of = lambda c: F.median(F.when(F.col("context") == c, F.col("response")))
    fold = j.groupBy("class").agg((of("R") / F.nullif(of("A"), F.lit(0.0))).alias("fold"))
    has = lambda c: F.bool_or(F.col("context") == c)
    wide = j.where("response >= 5 AND context IN ('A', 'R')").groupBy("class", "unit").agg((has("A") & has("R")).alias("both"))
    jac = wide.groupBy("class").agg(F.avg(F.col("both").cast("double")).alias("jac"))
    return fold.join(jac, "class", "left").select("class", F.round("fold", 6).alias("fold"), F.round(F.coalesce("jac", F.lit(0.0)), 6).alias("self_jaccard"))


SELECTED = f"""{CELLS}, {CONTRAST}, lg AS (SELECT unit, context, UNNEST(RANGE(5)) AS d, UNNEST(profile) AS x FROM cells), sc AS (SELECT d, AVG(x) AS mu, STDDEV_POP(x) AS sd FROM lg GROUP BY 1),
zs AS (SELECT unit, context, x, ROUND((x - mu) / sd, 9) AS z FROM lg JOIN sc ON lg.d = sc.d), ps AS (SELECT *, EXP(-z * z / 2) < 0.6 AS sig FROM zs),
sm AS (SELECT unit, context, CAST(SUM(CASE WHEN sig THEN 1 ELSE 0 END) AS DOUBLE) AS n_sig, SUM(CASE WHEN sig THEN ABS(x) ELSE 0 END) AS mag_sig, SUM(CASE WHEN sig THEN ABS(x) END) / NULLIF(SUM(CASE WHEN sig THEN 1 ELSE 0 END), 0) AS mean_sig, SQRT(SUM(CASE WHEN sig THEN x * x ELSE 0 END)) AS l2_sig, SQRT(SUM(z * z)) AS l2_z, SUM(ABS(z)) AS sabs_z, SQRT(SUM(x * x)) AS l2_all FROM ps GROUP BY 1, 2),
mt AS (SELECT s.*, response, c.support FROM sm s JOIN contrast c ON s.unit = c.unit AND s.context = c.context WHERE gate)"""
AUDITED = ("n_sig", "mag_sig", "mean_sig", "l2_sig", "l2_z", "sabs_z", "l2_all", "response")
LONG = " UNION ALL ".join(f"SELECT '{m}' AS metric, ROUND(CAST({m} AS DOUBLE), 6) AS x, response, support FROM mt WHERE {m} IS NOT NULL" for m in AUDITED)


@query("stat_effect_audit", f"WITH {SELECTED}, un AS ({LONG}), rk AS (SELECT metric, {avg_rank_sql('x', 'metric')} AS rx, {avg_rank_sql('response', 'metric')} AS r1, {avg_rank_sql('support', 'metric')} AS r2 FROM un) SELECT metric, CAST(COUNT(*) AS BIGINT) AS n, ROUND(CORR(rx, r1), 6) AS rho_response, ROUND(CORR(rx, r2), 6) AS rho_support FROM rk GROUP BY 1")
def stat_effect_audit(spark, sf_dir):
    """Eight effect metrics of gated rows, over the features whose p passes and over all, each against response and support."""
    from quillon.operators import profiles as P

    df = cells(spark, sf_dir)
    z = P.standardise(df.select("unit", "context", "profile")).select("unit", "context", F.transform("profile", lambda v: F.round(v, 9)).alias("z"))
    both = df.select("unit", "context", "profile").join(z, ["unit", "context"]).withColumn("p", F.transform("z", lambda v: F.exp(-v * v / 2)))
    s = P.selected_summary(both, 0.6).join(contrast(spark, sf_dir).where("gate").select("unit", "context", "response", "support"), ["unit", "context"])
    long_ = s.withColumn("y", F.col("response")).select("y", "support", *[F.round(F.col(m).cast("double"), 6).alias(m) for m in AUDITED]).unpivot(["y", "support"], list(AUDITED), "metric", "x").where("x IS NOT NULL")
    a = T.spearman(long_, "x", "y", ["metric"]).withColumnRenamed("rho", "rho_response")
    return a.join(T.spearman(long_, "x", "support", ["metric"]).select("metric", F.col("rho").alias("rho_support")), "metric")


BULK = """r AS (SELECT s_suppkey, s_suppkey || '_S' || (s_suppkey // 3) || '_promoter_ENSG' || LPAD(CAST(s_suppkey // 3 AS VARCHAR), 5, '0') AS id, s_suppkey % 5 = 0 AS control, s_acctbal AS x, 1 + s_suppkey % 7 AS n_cells FROM supplier)"""


@query("profile_bulk_collapse", f"WITH {BULK} SELECT REGEXP_EXTRACT(id, '(ENSG[^_]*)', 1) AS gene, ROUND(AVG(x), 6) AS mean, CAST(SUM(n_cells) AS BIGINT) AS n_cells FROM r WHERE NOT control GROUP BY 1")
def profile_bulk_collapse(spark, sf_dir):
    """Rows of an external bulk matrix without its controls, averaged per token of their ids, cells summed."""
    third = F.expr("s_suppkey DIV 3").cast("string")
    name = F.concat(F.col("s_suppkey").cast("string"), F.lit("_S"), third, F.lit("_promoter_ENSG"), F.lpad(third, 5, "0"))
    r = table(spark, sf_dir, "supplier").select(name.alias("id"), (F.col("s_suppkey") % 5 == 0).alias("control"), "s_acctbal", (1 + F.col("s_suppkey") % 7).alias("n_cells"))
    gene = F.regexp_extract("id", "(ENSG[^_]*)", 1)
    return r.where("NOT control").groupBy(gene.alias("gene")).agg(F.round(F.avg("s_acctbal"), 6).alias("mean"), F.sum("n_cells").alias("n_cells"))


@query("tensor_latest_cells", "WITH r AS (SELECT o_custkey AS unit, o_orderpriority AS context, o_orderkey AS row_id, o_totalprice AS v, ROW_NUMBER() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey DESC) AS k FROM orders) SELECT unit, context, row_id, ROUND(v, 2) AS v FROM r WHERE k = 1")
def tensor_latest_cells(spark, sf_dir):
    """Of repeated (unit, context) cells the later row wins."""
    from quillon.operators import profiles as P

    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("unit"), F.col("o_orderpriority").alias("context"), F.col("o_orderkey").alias("row_id"), F.array("o_totalprice").alias("profile"))
    return P.tensor_cells(o).select("unit", "context", "row_id", F.round(F.col("profile")[0], 2).alias("v"))


@query("stat_signature_overlap", f"WITH {MEMBERSHIPS}, bg AS (SELECT DISTINCT o_custkey AS member FROM orders), dr AS (SELECT DISTINCT o_custkey AS member FROM orders WHERE o_orderstatus = 'P'), sg AS (SELECT DISTINCT set_name, m.member FROM memberships m JOIN bg ON m.member = bg.member WHERE set_name IN (SELECT n_name FROM nation WHERE n_nationkey < 4)), kk AS (SELECT set_name, CAST(COUNT(*) AS BIGINT) AS k_all, CAST(COUNT(d.member) AS BIGINT) AS overlap FROM sg LEFT JOIN dr d ON sg.member = d.member GROUP BY 1), tt AS (SELECT (SELECT COUNT(*) FROM bg) AS M, (SELECT COUNT(*) FROM dr) AS n), q AS (SELECT set_name, k_all AS K, overlap AS x, M, n FROM kk, tt), tl AS (SELECT set_name, SUM({hypergeometric_pmf('i', 'M', 'K', 'n')}) AS t FROM (SELECT *, UNNEST(RANGE(x, LEAST(K, n) + 1)) AS i FROM q WHERE x > 0) w WHERE n - i <= M - K GROUP BY 1) SELECT q.set_name, K AS in_universe, n AS module_size, x AS overlap, ROUND((x / CAST(n AS DOUBLE)) / (K / CAST(M AS DOUBLE)), 1) AS fold, ROUND(LEAST(COALESCE(t, 1), 1), 9) AS p, q.set_name LIKE 'A%' AS is_contrast FROM q LEFT JOIN tl ON q.set_name = tl.set_name")
def stat_signature_overlap(spark, sf_dir):
    """Four signatures against a module within a universe; some signatures are contrasts and say so."""
    nation = table(spark, sf_dir, "nation").where("n_nationkey < 4").select(F.col("n_name").alias("set_name"))
    signatures = memberships(spark, sf_dir).join(F.broadcast(nation), "set_name")  # four rows
    orders = table(spark, sf_dir, "orders")
    e = T.enrichment(orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("member")), signatures, orders.select(F.col("o_custkey").alias("member")))
    fold = (F.col("n_overlap") / F.col("n_drawn")) / (F.col("set_size") / F.col("background_size"))
    return e.select("set_name", F.col("set_size").alias("in_universe"), F.col("n_drawn").alias("module_size"), F.col("n_overlap").alias("overlap"), F.round(fold, 1).alias("fold"), F.round("p", 9).alias("p"), F.col("set_name").startswith("A").alias("is_contrast"))
