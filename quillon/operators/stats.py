"""Rank statistics, enrichment, multiple testing and permutation nulls."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import exprs as X
from quillon.functions.kernels import hypergeometric_pmf, normal_sf
from quillon.operators import compact as C
from quillon.operators import draws as W
from quillon.operators import order as O
from quillon.operators.permuted import PART, partner_correlations
from quillon.sources.shared import Scratch


#: Leading hexadecimal digits of a hash that a seeded numbering is split by.
DIGITS = 3


def ranked(df: DataFrame, values: Sequence[str], keys: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """``df`` with, for each of its columns ``values``: {v}_below and {v}_ties, how many rows (of the same ``keys``) have a less and an equal value, and {v}_all, how many have one.

    No task holds all rows in order. Equal values are counted first, which is combined before the shuffle; distinct
    values are dealt to ranges at splitters taken from them (``order.cumulative``). Null values have null counts; values are finite numbers. With ``weight`` a row stands for so many.
    """
    base, splits = df, O.splitters(df, values)
    for v in values:
        counts = base.where(F.col(v).isNotNull()).groupBy(*keys, v).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("__n"))
        table = O.cumulative(counts, v, "__n", splits[v], keys).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(v).alias("__v"), F.col("__below").alias(f"{v}_below"), F.col("__n").alias(f"{v}_ties"), F.col("__all").alias(f"{v}_all"))
        same = F.col(v) == F.col("__v")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
        df = df.join(table, same, "left").drop("__v", *[f"__{k}" for k in keys])
    return df


def average_of_ties(v: str):
    """Average rank of a column that ``ranked`` has counted."""
    return F.col(f"{v}_below") + (F.col(f"{v}_ties") + 1) / 2.0


def numbered(df: DataFrame, order, ties: Sequence[str], keys: Sequence[str] = (), name: str = "pos") -> DataFrame:
    """``df`` with ``name``, 1.. within ``keys``, in the order of a hexadecimal hash and then of ``ties``.

    Hashes are even, so their leading DIGITS split the rows; each part is numbered by itself and moved up by the
    sizes of the parts before it.
    """
    df = df.withColumn("__h", order).withColumn("__part", F.substring("__h", 1, DIGITS))
    sizes = df.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"))
    run = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # 16 ** DIGITS rows a key
    before = sizes.select(*keys, "__part", F.coalesce(F.sum("__n").over(run), F.lit(0)).alias("__before"))
    local = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy("__h", *ties))
    placed = df.withColumn("__local", local).join(before, [*keys, "__part"])
    return placed.withColumn(name, (F.col("__before") + F.col("__local")).cast("long")).drop("__h", "__part", "__before", "__local")


def spearman(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Spearman correlation over rows where both are finite: Pearson of average ranks, null if either is constant."""
    both = df.where(X.finite(F.col(x).cast("double")) & X.finite(F.col(y).cast("double"))).select(*keys, x, y)
    # Equal pairs are counted once and for all; the mean of average ranks is (n + 1) / 2.
    pairs = Scratch(df.sparkSession, "spearman").save(both.groupBy(*keys, x, y).agg(F.count(F.lit(1)).alias("w")), "pairs")
    off = lambda v: average_of_ties(v) - (F.col(f"{v}_all") + 1) / 2.0
    ranks = ranked(pairs, [x, y], keys, "w").select(*keys, "w", off(x).alias("rx"), off(y).alias("ry"))
    total = lambda a, b: F.sum(F.col("w") * F.col(a) * F.col(b))
    rho = total("rx", "ry") / F.nullif(F.sqrt(total("rx", "rx")) * F.sqrt(total("ry", "ry")), F.lit(0.0))
    return ranks.groupBy(*keys).agg(F.coalesce(F.sum("w"), F.lit(0)).alias("n"), F.round(rho, 6).alias("rho"))


def mann_whitney(df: DataFrame, value: str, group: str) -> DataFrame:
    """One-sided U test that ``group`` (boolean) rows have greater values: tie-corrected normal tail with continuity."""
    placed = ranked(df.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).alias("v")), ["v"]).withColumn("r", average_of_ties("v"))
    ties = placed.groupBy("v").agg(F.count(F.lit(1)).alias("t")).agg(F.sum(F.col("t").cast("double") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    s = placed.agg(F.sum(F.col("g").cast("double")).alias("n1"), F.sum((~F.col("g")).cast("double")).alias("n2"), F.sum(F.when(F.col("g"), F.col("r"))).alias("r1")).crossJoin(ties)
    s = s.withColumn("u", F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2)
    n = F.col("n1") + F.col("n2")
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    s = s.withColumn("z", (F.col("u") - F.col("n1") * F.col("n2") / 2 - 0.5) / F.nullif(sd, F.lit(0.0)))
    return s.select("n1", "n2", F.round("u", 3).alias("u"), F.round("z", 6).alias("z"), F.round(F.expr(normal_sf("z")), 6).alias("p"))


def benjamini_hochberg(df: DataFrame, p: str = "p", keys: Sequence[str] = (), tie: str = "set_name") -> DataFrame:
    """Step-up false discovery rate within each family of ``keys``; a running minimum from the largest p down."""
    up = Window.partitionBy(*keys).orderBy(F.col(p).asc(), F.col(tie))
    down = Window.partitionBy(*keys).orderBy(F.col(p).desc(), F.col(tie).desc()).rowsBetween(Window.unboundedPreceding, 0)
    m = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    stepped = df.withColumn("__s", F.col(p) * m / F.row_number().over(up))
    return stepped.withColumn("fdr", F.least(F.min("__s").over(down), F.lit(1.0))).drop("__s")


def enrichment(drawn: DataFrame, sets: DataFrame, background: DataFrame) -> DataFrame:
    """Hypergeometric upper tail and fold of each set in the drawn members, all within the background.

    Sums of at most min(set, drawn) terms per set are exploded from their index, so nothing is collected.
    Sets without a member in the background, or an empty draw, give p = 1 and fold 0.
    """
    b = background.select("member").distinct()
    s = sets.join(b, "member", "left_semi").distinct()
    d = drawn.select("member").distinct().join(b, "member", "left_semi").withColumn("hit", F.lit(1))
    totals = b.agg(F.count(F.lit(1)).alias("M")).crossJoin(d.agg(F.count(F.lit(1)).alias("n")))
    per = sets.select("set_name").distinct().join(s.join(d, "member", "left").groupBy("set_name").agg(F.count(F.lit(1)).alias("K"), F.count("hit").alias("x")), "set_name", "left").na.fill(0, ["K", "x"])
    per = per.crossJoin(F.broadcast(totals))
    # x = 0 needs no sum: the tail is 1.
    open_ = per.where("x > 0").withColumn("i", F.explode(F.sequence("x", F.least("K", "n")))).where("n - i <= M - K")
    tail = open_.groupBy("set_name").agg(F.sum(F.expr(hypergeometric_pmf("i", "M", "K", "n"))).alias("tail"))
    out = per.join(tail, "set_name", "left")
    fold = (F.col("x") * F.col("M")) / F.nullif((F.col("n") * F.col("K")).cast("double"), F.lit(0.0))
    return out.select("set_name", F.col("x").alias("n_overlap"), F.col("K").alias("set_size"), F.col("n").alias("n_drawn"), F.col("M").alias("background_size"), F.least(F.coalesce("tail", F.lit(1.0)), F.lit(1.0)).alias("p"), F.round(F.coalesce(fold, F.lit(0.0)), 2).alias("fold"))


def enrichment_by(drawn: DataFrame, sets: DataFrame, background: DataFrame, key: str) -> DataFrame:
    """``enrichment`` of every set in every family of drawn members (``key``, member), all families in one job; sets without a background member are left out."""
    b = background.select("member").distinct()
    s, d = sets.join(b, "member", "left_semi").distinct(), drawn.select(key, "member").distinct().join(b, "member", "left_semi")
    size, n = s.groupBy("set_name").agg(F.count(F.lit(1)).alias("K")), d.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    hits = s.join(d, "member").groupBy(key, "set_name").agg(F.count(F.lit(1)).alias("x"))
    # Families times sets is the result's own size.
    per = n.crossJoin(size).crossJoin(F.broadcast(b.agg(F.count(F.lit(1)).alias("M")))).join(hits, [key, "set_name"], "left").na.fill(0, ["x"])
    open_ = per.where("x > 0").withColumn("i", F.explode(F.sequence("x", F.least("K", "n")))).where("n - i <= M - K")
    tail = open_.groupBy(key, "set_name").agg(F.sum(F.expr(hypergeometric_pmf("i", "M", "K", "n"))).alias("tail"))
    out = per.join(tail, [key, "set_name"], "left")
    return out.select(key, "set_name", F.col("x").alias("n_overlap"), F.col("K").alias("set_size"), F.col("n").alias("n_drawn"), F.least(F.coalesce("tail", F.lit(1.0)), F.lit(1.0)).alias("p"))


def load_layers(scores: DataFrame, members: DataFrame, draws: int, seed: str = "load") -> DataFrame:
    """``stratified_load`` in three layers: any units (uniform), units of the members' strata (matched), and matched without flagged units.

    scores: (unit, score, stratum, flagged). A draw's hashes serve all layers.
    """
    kind = F.concat(F.lit("s"), F.coalesce(F.col("stratum").cast("string"), F.lit("")))
    strata = {"uniform": F.lit("all"), "matched": kind, "matched_unflagged": F.when(~F.col("flagged"), kind)}
    found = _loads(scores.select("unit", "score", F.array(*strata.values()).alias("strata")), members, draws, seed)
    return found.withColumn("layer", F.element_at(F.array(*[F.lit(name) for name in strata]), F.col("layer") + 1)).select("set_name", "observed", "null_mean", "p", "layer")


def unit_concordance(a: DataFrame, b: DataFrame, draws: int, least: int = 100, seed: str = "partner") -> DataFrame:
    """Correlation of each unit's profiles in two data sets over the features finite in both, against those of other units.

    In a draw a unit's partner is the next one in a seeded ring, so no unit is its own. Units with fewer than
    ``least`` common features give no row, a draw's pair with fewer counts as 0. Classes: universal above
    the draws' 95 percentile with emp_p < 0.05, specific at or below their median, else intermediate.
    """

    finite = F.filter(F.arrays_zip(F.col("pa").alias("x"), F.col("pb").alias("y")), lambda t: X.finite(t["x"]) & X.finite(t["y"]))
    pair = a.select("unit", F.col("profile").cast("array<double>").alias("pa")).join(b.select("unit", F.col("profile").cast("array<double>").alias("pb")), "unit").where(F.size(finite) >= least)
    pair = O.ordinals(pair, [F.col("unit")], "pos", lambda df: Scratch(a.sparkSession, "concordance").save(df, "pair"))
    n, width = pair.agg(F.count(F.lit(1)), F.max(F.greatest(F.size("pa"), F.size("pb")))).first()
    if not n:
        return pair.select("unit", F.lit(0.0).alias("r"), F.lit(0).cast("long").alias("n_common"), F.lit(0.0).alias("emp_p"), F.lit("").alias("class"))
    own, counts, quantiles = partner_correlations(pair, n, width, draws, least, seed)
    q95, median = quantiles([0.95, 0.5])
    seen = own.join(counts, "pos").select("unit", (F.col("k") / F.lit(float(PART))).alias("r"), "n_common", (F.col("ge") / F.lit(float(draws))).alias("emp_p"))
    kind = F.when((F.col("r") > F.lit(q95)) & (F.col("emp_p") < 0.05), "universal").when(F.col("r") <= F.lit(median), "specific").otherwise("intermediate")
    return seen.select("unit", F.round("r", 6).alias("r"), "n_common", F.round("emp_p", 6).alias("emp_p"), kind.alias("class"))


def concordance(a: DataFrame, b: DataFrame, least: int = 20) -> DataFrame:
    """Rankings (unit, score) compared: shared units, rho, overlap of the top min(100, n / 3), its chance p; no row under ``least``."""
    both = a.select("unit", F.col("score").alias("x")).join(b.select("unit", F.col("score").alias("y")), "unit").dropna()
    n = both.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).withColumn("k", F.least(F.lit(100), F.floor(F.col("n") / 3)).cast("long"))
    # The first k are among the first 100, which no task orders more than.
    first = lambda c, at: both.orderBy(F.col(c).desc(), "unit").limit(100).select(F.col("unit").alias(f"{at}_unit"), F.row_number().over(Window.orderBy(F.col(c).desc(), "unit")).alias(at))
    tops = first("x", "px").join(first("y", "py"), F.col("px_unit") == F.col("py_unit")).select("px", "py")
    inside = (F.col("px") <= F.col("k")) & (F.col("py") <= F.col("k"))
    hit = n.join(F.broadcast(tops), inside, "left").groupBy("n", "k").agg(F.count("px").alias("overlap"))
    open_ = hit.where("overlap > 0").withColumn("i", F.explode(F.sequence("overlap", "k"))).where("k - i <= n - k")
    tail = open_.groupBy("n").agg(F.sum(F.expr(hypergeometric_pmf("i", "n", "k", "k"))).alias("t"))
    return hit.join(tail.withColumnRenamed("n", "tn"), F.col("n") == F.col("tn"), "left").crossJoin(spearman(both, "x", "y").select("rho")).select("n", "k", "overlap", "rho", F.round(F.least(F.coalesce("t", F.lit(1.0)), F.lit(1.0)), 6).alias("p"))


def cohesion_draws(profiles: DataFrame, members: DataFrame, draws: int, seed: str, strata: str | None = None) -> DataFrame:
    """(set_name, m, observed, v): mean pairwise cosine of each set and, a row a draw, of its seeded draws.

    The mean over pairs is (|sum of unit vectors|^2 - m) / (m (m - 1)), so no pair is formed: per draw and
    dimension the vectors are summed. Sets with fewer than two present members give no row.
    """
    part = [strata] if strata else []
    kind = F.col(strata).cast("string") if strata else F.lit("")
    units = profiles.select("unit", *part, X.unit_vector(F.col("profile")).alias("v"))
    unit = units.select("unit", F.posexplode("v").alias("d", "v")).where("v IS NOT NULL")
    present = members.join(profiles.select(F.col("unit")), "unit", "left_semi")
    size = present.groupBy("set_name").agg(F.count(F.lit(1)).alias("m")).where("m >= 2")
    present = present.join(F.broadcast(size.select("set_name")), "set_name", "left_semi")
    mean = (F.col("q") - F.col("m")) / (F.col("m") * (F.col("m") - 1))
    sums = present.join(unit, "unit").groupBy("set_name", "d").agg(F.sum("v").alias("s"))
    seen = sums.groupBy("set_name").agg(F.sum(F.col("s") * F.col("s")).alias("q")).join(F.broadcast(size), "set_name").select("set_name", "m", F.round(mean, 9).alias("observed"))
    need = present.join(profiles.select("unit", *part), "unit").groupBy("set_name", kind.alias("stratum")).agg(F.count(F.lit(1)).alias("need"))
    asked = Asked(units.withColumn("strata", F.array(kind)), need.withColumn("layer", F.lit(0)), members.schema["set_name"].dataType.simpleString())
    width = units.agg(F.max(F.size("v"))).first()[0] or 1
    null = asked.sums(units.withColumn("strata", F.array(kind)), width, draws, seed)
    null = null.withColumn("q", F.aggregate("total", F.lit(0.0), lambda a, x: a + x * x))
    return null.join(F.broadcast(seen), "set_name").select("set_name", "m", "observed", F.round(mean, 9).alias("v"))


class Asked:
    """What sets ask of every draw: for each of their strata how many of its first units. A row a set and stratum is collected.

    units: (unit, strata), a value or null per layer; need: (set_name, layer, stratum, need).
    """

    def __init__(self, units: DataFrame, need: DataFrame, kind: str):
        self.spark, self.kind = units.sparkSession, kind
        counted = units.select(F.posexplode("strata").alias("layer", "stratum")).groupBy("layer", "stratum").agg(F.count(F.lit(1)).alias("n"))
        have = {(r["layer"], r["stratum"]): r["n"] for r in counted.collect()}
        self.codes = {key: k for k, key in enumerate(sorted(have, key=str))}
        self.have = {self.codes[key]: n for key, n in have.items()}
        takes: dict[tuple, list[tuple[int, int]]] = {}
        for r in need.collect():
            takes.setdefault((r["layer"], r["set_name"]), []).append((self.codes[r["layer"], r["stratum"]], r["need"]))
        self.names, self.takes = list(takes), list(takes.values())

    def coded(self, units: DataFrame) -> DataFrame:
        """``units`` with ``groups``, the codes of their strata."""
        named = F.create_map(*[F.lit(x) for (layer, stratum), code in self.codes.items() if stratum is not None for x in (f"{layer}:{stratum}", code)])
        null = F.create_map(*[F.lit(x) for layer in sorted({key[0] for key in self.codes}) for x in (layer, self.codes.get((layer, None), -1))])
        code = F.transform("strata", lambda s, k: F.when(s.isNull(), null[k]).otherwise(named[F.concat_ws(":", k.cast("string"), s)]))
        return units.withColumn("groups", F.filter(code, lambda c: c >= 0)).drop("strata")

    def named(self, df: DataFrame) -> DataFrame:
        """``df`` with layer and set_name for ``s``, the place of a set."""
        names = self.spark.createDataFrame([(k, layer, name) for k, (layer, name) in enumerate(self.names)], f"s int, layer int, set_name {self.kind}")
        return df.join(F.broadcast(names), "s").drop("s")

    def sums(self, units: DataFrame, width: int, draws: int, seed: str) -> DataFrame:
        """(layer, set_name, b, total) of units with vectors ``v``."""
        if not self.takes:
            return self.spark.createDataFrame([], f"b int, total array<double>, layer int, set_name {self.kind}")
        return self.named(W.prefix_sums(self.coded(units), self.have, self.takes, width, draws, seed))


def cohesion_null(profiles: DataFrame, members: DataFrame, draws: int, seed: str = "cohesion", strata: str | None = None) -> DataFrame:
    """Cohesion of each set against seeded draws: of any units, or with ``strata`` of units with its members' mix of strata."""
    both = cohesion_draws(profiles, members, draws, seed, strata)
    return both.groupBy("set_name", "m", "observed").agg(F.avg("v").alias("a"), F.stddev_pop("v").alias("s"), F.sum((F.col("v") >= F.col("observed")).cast("long")).alias("ge"), F.count(F.lit(1)).alias("B")).select(
        "set_name", "m", F.round("observed", 6).alias("observed"), F.round("a", 6).alias("null_mean"), F.round((F.col("observed") - F.col("a")) / (F.col("s") + 1e-9), 3).alias("z"), F.round((F.col("ge") + 1) / (F.col("B") + 1.0), 6).alias("p")
    )


def module_null(profiles: DataFrame, members: DataFrame, draws: int, seed: str = "module") -> DataFrame:
    """Mean pairwise correlation of each module against same-size draws; p is the plain share of draws at least as large.

    Correlation is the cosine of centred rows.
    """
    mean = X.array_sum(F.col("profile")) / F.size("profile")
    centred = profiles.withColumn("profile", F.transform(F.array(mean), lambda m: F.transform("profile", lambda x: x - m))[0])
    both = cohesion_draws(centred, members, draws, seed)
    return both.groupBy("set_name", "m", "observed").agg(F.avg("v").alias("a"), F.stddev_samp("v").alias("s"), F.avg((F.col("v") >= F.col("observed")).cast("double")).alias("p")).select(
        "set_name", "m", F.round("observed", 6).alias("observed"), F.round("a", 6).alias("null_mean"), F.round((F.col("observed") - F.col("a")) / (F.col("s") + 1e-12), 3).alias("z"), F.round("p", 6).alias("p")
    )


#: Times that draws compare the same pair on average, above which all units are compared once instead of each draw's own.
OFTEN = 2


def compactness_null(profiles: DataFrame, members: DataFrame, draws: int, seed: str = "compact", block: int = C.BLOCK, often: float = OFTEN) -> DataFrame:
    """Mean pairwise distance of each set under three metrics against same-size draws; small p is compact.

    A set is a subset whose members are compared in cells of blocks. So is a draw, for the sizes of all sets at once, while draws
    are few; where they meet each pair more than ``often`` times, distances are made once and taken for every draw.
    Whitened rows have columns of mean 0 and deviation 1; a sum of cosines is that of the summed rows.
    """
    from quillon.operators.profiles import long_form

    spark = profiles.sparkSession
    columns = long_form(profiles).groupBy("feature").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s")).orderBy("feature").collect()  # two numbers a column
    scale = (np.array([r["m"] for r in columns]), np.array([r["s"] or 1.0 for r in columns]))
    units = profiles.select(F.col("unit").cast("string").alias("unit"), F.col("profile").cast("array<double>").alias("profile"))
    present = members.join(profiles.select("unit", "profile"), "unit")
    present = present.select("set_name", F.col("unit").cast("string").alias("unit"), F.lit(0).alias("band"), F.col("profile").cast("array<double>").alias("profile"))
    sizes = present.groupBy("set_name").agg(F.count(F.lit(1)).alias("need"))

    def mean(df: DataFrame, *keys: str) -> DataFrame:
        found = df.groupBy(*keys).agg(F.sum("m").alias("m"), *[(F.sum(k) / F.nullif(F.sum("pairs").cast("double"), F.lit(0.0))).alias(k) for k in C.METRICS]).where("m >= 2")
        return found.unpivot([*keys, "m"], list(C.METRICS), "metric", "v").withColumn("v", F.round("v", 9))

    seen = mean(C.subset_sums(present, "set_name", 1, scale, block), "set_name").select("set_name", "metric", F.col("v").alias("observed"))

    n = profiles.count()
    wanted = [(0, r[0]) for r in sizes.select("need").distinct().orderBy("need").collect()]  # at most a number a set
    null = spark.createDataFrame([], "b int, need long, m long, metric string, v double")
    for k in range(0, len(wanted), C.NEEDS):
        part = wanted[k : k + C.NEEDS]
        cut = W.cuts(profiles.select("unit", F.array(F.lit(0)).alias("groups")), {0: n}, part, draws, seed)
        most = min(part[-1][1], n)
        if draws * (most / n) ** 2 > often:
            sums = C.drawn_sums(units, n, cut, most, len(part), draws, seed, scale, block)
        else:
            sums = C.subset_sums(C.drawn_members(units, n, cut, len(part), draws, seed), "b", len(part), scale, block)
        need = F.get(F.lit([p[1] for p in part]), F.col("band")).cast("long")
        null = null.unionByName(mean(sums.withColumn("need", need), "b", "need"))
    per = null.select("b", "need", "m", "metric", "v").join(F.broadcast(sizes), "need").join(F.broadcast(seen), ["set_name", "metric"])  # rows a set
    return per.groupBy("set_name", "metric", "m", "observed").agg(F.avg("v").alias("a"), F.stddev_pop("v").alias("s"), F.sum((F.col("v") <= F.col("observed")).cast("long")).alias("le"), F.count(F.lit(1)).alias("B")).select(
        "set_name", "metric", "m", F.round("observed", 6).alias("observed"), F.round("a", 6).alias("null_mean"), F.round((F.col("a") - F.col("observed")) / (F.col("s") + 1e-9), 3).alias("z"), F.round((F.col("le") + 1) / (F.col("B") + 1.0), 6).alias("p")
    )


def decile_edges(df: DataFrame, value: str, parts: int = 10) -> DataFrame:
    """Adds stratum 0..parts-1 by exact quantile edges (right-closed; equal edges merge)."""
    cuts = F.lit(sorted({q for q in O.quantiles(df, value, [k / parts for k in range(1, parts)]) if q is not None})).cast("array<double>")
    return df.withColumn("stratum", F.size(F.filter(cuts, lambda c: c < F.col(value))))


def stratified_load(scores: DataFrame, members: DataFrame, draws: int, seed: str = "load") -> DataFrame:
    """Summed score of each set against seeded draws that match its members' strata; p counts draws at least as large.

    scores: (unit, score, stratum). A set with more members in a stratum than there are units gives null.
    """
    kind = F.concat(F.lit("s"), F.coalesce(F.col("stratum").cast("string"), F.lit("")))
    return _loads(scores.select("unit", "score", F.array(kind).alias("strata")), members, draws, seed).drop("layer")


def _loads(scores: DataFrame, members: DataFrame, draws: int, seed: str) -> DataFrame:
    """(layer, set_name, observed, null_mean, p) of units whose ``strata`` has a stratum a layer; null is out of the layer."""
    units = scores.select("unit", "score", "strata")
    inside = members.join(units.select("unit", "score", F.posexplode("strata").alias("layer", "stratum")).where("stratum IS NOT NULL"), "unit")
    need = inside.groupBy("set_name", "layer", "stratum").agg(F.count(F.lit(1)).alias("need"), F.sum("score").alias("load"))
    have = units.select(F.posexplode("strata").alias("layer", "stratum")).groupBy("layer", "stratum").agg(F.count(F.lit(1)).alias("have"))
    need = Scratch(scores.sparkSession, "load").save(need.join(have, ["layer", "stratum"]), "need")
    seen = need.groupBy("layer", "set_name").agg(F.sum("load").alias("observed"), F.bool_or(F.col("need") > F.col("have")).alias("short"))
    asked = Asked(units, need.select("set_name", "layer", "stratum", "need"), members.schema["set_name"].dataType.simpleString())
    null = asked.sums(units.select("unit", "strata", F.array(F.col("score").cast("double")).alias("v")), 1, draws, seed)
    both = null.withColumn("v", F.round(F.col("total")[0], 4)).join(F.broadcast(seen), ["layer", "set_name"])
    return both.groupBy("layer", "set_name", "observed", "short").agg(F.avg("v").alias("a"), F.avg((F.col("v") >= F.round("observed", 4)).cast("double")).alias("p")).select(
        "layer", "set_name", F.round("observed", 4).alias("observed"), F.when(~F.col("short"), F.round("a", 4)).alias("null_mean"), F.when(~F.col("short"), F.round("p", 6)).alias("p")
    )
