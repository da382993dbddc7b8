"""Profile vectors: panels, standardisation, cosine neighbours, leave-one-out programs, markers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import exprs as X
from quillon.operators import order as O
from quillon.sources.shared import Scratch

#: Units of a block, where the best of each are given out and where all pairs are.
BLOCK, ALL_PAIRS_BLOCK = 2_048, 4_096
#: Numbers of a block of units whose best are given out: a unit is sent to every block, so blocks of short profiles are wider.
NUMBERS = 1_000_000
#: Rows of a block whose pairs are given out at once, and how many pairs that may be.
STRIPE, GIVEN = 128, 524_288


def clean(df: DataFrame) -> DataFrame:
    """V3: non-finite elements become 0."""
    return df.withColumn("profile", X.finite_or_zero(F.col("profile")))


def long_form(df: DataFrame) -> DataFrame:
    """(unit, feature index, value); a per-row explode, no shuffle."""
    return df.select("unit", F.posexplode("profile").alias("feature", "value"))


def top_variance(df: DataFrame, n: int) -> DataFrame:
    """V4: the n features of largest population variance, constant ones never; the index breaks ties."""
    v = long_form(df).groupBy("feature").agg(F.round(F.var_pop("value"), 9).alias("variance")).where("variance > 0")
    return v.orderBy(F.col("variance").desc(), "feature").limit(n)


def standardise(df: DataFrame) -> DataFrame:
    """V5: columns to mean 0 and population deviation 1 (a constant column is only centred): one aggregate of arrays' length."""
    stats = long_form(df).groupBy("feature").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    arrays = stats.agg(F.array_sort(F.collect_list(F.struct("feature", "m", F.when(F.col("s") == 0, 1.0).otherwise(F.col("s")).alias("s")))).alias("stats"))
    scaled = F.zip_with("profile", "stats", lambda x, t: (x - t["m"]) / t["s"])
    return df.crossJoin(F.broadcast(arrays)).withColumn("profile", scaled).drop("stats")


def similarities(df: DataFrame, queries: DataFrame | None = None, once: bool = False) -> DataFrame:
    """Cosine of each query unit with every other unit, rounded to 6 digits so that ties are ties.

    All pairs within a panel; ``queries`` narrows one side to blocks of it. Zero vectors have cosine 0, units
    without a profile take no part. The pairs are the result; ``neighbours`` makes none but those it returns. With
    ``once`` a pair is made in one direction alone, a < b. Blocks are wide, the wider the shorter profiles are, because a unit
    is sent to every block, and a cell gives its pairs out by stripes of rows, so that a task holds no more than its two blocks and a stripe.
    """
    return _all_pairs(df, queries, ALL_PAIRS_BLOCK, once)


def _all_pairs(df: DataFrame, queries: DataFrame | None, block: int, once: bool) -> DataFrame:
    units = df.where(F.col("profile").isNotNull()).select("unit", F.col("profile").cast("array<double>").alias("v"))
    n, width = units.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    block = max(block, NUMBERS // max(width or 1, 1))
    blocks = max(-(-n // block), min(8, -(-n // 512)), 1)  # few units are still dealt to several tasks
    dealt = units.withColumn("g", F.pmod(F.xxhash64("unit"), F.lit(blocks)).cast("int"))
    asks = F.lit(True) if queries is None else F.col("asks").isNotNull()
    if queries is not None:
        dealt = dealt.join(queries.select("unit", F.lit(True).alias("asks")).distinct(), "unit", "left")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    # A pair of blocks is one cell, which makes both directions.
    cells = dealt.select("unit", "v", asks.alias("asks"), "g", other.alias("other")).select("unit", "v", "asks", "g", F.least("g", "other").alias("i"), F.greatest("g", "other").alias("j"))

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        unit = t.column("unit").combine_chunks()
        x = np.stack(t.column("v").to_numpy())
        norm = np.sqrt((x * x).sum(axis=1))
        x = x / np.where(norm == 0, 1, norm)[:, None]
        asked = t.column("asks").to_numpy()
        g, i, j = (t.column(c).to_numpy() for c in ("g", "i", "j"))
        place = pc.rank(unit, tiebreaker="dense").to_numpy()
        first, second = np.flatnonzero(g == i[0]), np.flatnonzero(g == j[0])
        for rows, columns in ((first, second),) if i[0] == j[0] else ((first, second), (second, first)):
            rows, other = rows[asked[rows]], x[columns].T
            stripe = max(min(STRIPE, GIVEN // max(len(columns), 1)), 1)
            for k in range(0, len(rows), stripe):
                a = rows[k : k + stripe]
                sim = np.round(x[a] @ other, 6)
                fits = place[a][:, None] < place[columns] if once else place[a][:, None] != place[columns]
                r, s = np.nonzero(fits & np.isfinite(sim))
                if len(r):
                    yield pa.RecordBatch.from_pydict({"a": unit.take(pa.array(a[r])), "b": unit.take(pa.array(columns[s])), "similarity": pa.array(sim[r, s])})

    kind = df.schema["unit"].dataType.simpleString()
    tasks = min(2 * blocks * (blocks + 1), 2_000)  # a number of its own: the work is the pairs, not what is shuffled
    return cells.repartition(tasks, "i", "j").groupBy("i", "j").applyInArrow(product, f"a {kind}, b {kind}, similarity double")


def neighbours(df: DataFrame, k: int = 8, queries: DataFrame | None = None) -> DataFrame:
    """The k most similar units of each unit by ``similarities``, ranks from 1; the unit breaks ties."""
    order = Window.partitionBy("a").orderBy(F.col("similarity").desc(), "b")
    return _cell_products(df, queries, BLOCK, k).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def _cell_products(df: DataFrame, queries: DataFrame | None, block: int, k: int) -> DataFrame:
    """(a, b, similarity) of the ``k`` best of each unit in each cell, a block of units by a block of units in one task.

    Units are dealt to blocks by hash; a pair of blocks is one cell, which makes both directions, stripe by stripe. A cell gives
    out the k best of each of its units alone, so that only these are shuffled and merged.
    """
    units = df.where(F.col("profile").isNotNull()).select("unit", F.col("profile").cast("array<double>").alias("v"))
    n, width = units.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    block = max(block, NUMBERS // max(width or 1, 1))
    blocks = max(-(-n // block), min(6, -(-n // 512)), 1)  # few units are still dealt to several tasks
    dealt = units.withColumn("g", F.pmod(F.xxhash64("unit"), F.lit(blocks)).cast("int"))
    asks = F.lit(True) if queries is None else F.col("asks").isNotNull()
    if queries is not None:
        dealt = dealt.join(queries.select("unit", F.lit(True).alias("asks")).distinct(), "unit", "left")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    cells = dealt.select("unit", "v", asks.alias("asks"), "g", other.alias("other")).select("unit", "v", "asks", "g", F.least("g", "other").alias("i"), F.greatest("g", "other").alias("j"))

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        unit = t.column("unit").combine_chunks()
        x = np.stack(t.column("v").to_numpy())
        norm = np.sqrt((x * x).sum(axis=1))
        x = x / np.where(norm == 0, 1, norm)[:, None]
        asked = t.column("asks").to_numpy()
        g, i, j = (t.column(c).to_numpy() for c in ("g", "i", "j"))
        place = pc.rank(unit, tiebreaker="dense").to_numpy()
        first, second = np.flatnonzero(g == i[0]), np.flatnonzero(g == j[0])
        for rows, columns in ((first, second),) if i[0] == j[0] else ((first, second), (second, first)):
            rows = rows[asked[rows]]
            for start in range(0, len(rows), STRIPE):
                a = rows[start : start + STRIPE]
                sim = np.round(x[a] @ x[columns].T, 6)
                sim[place[a][:, None] == place[columns]] = -np.inf
                if 0 < k < len(columns):
                    least = np.partition(sim, len(columns) - k, axis=1)[:, len(columns) - k]
                    r, s = np.nonzero(sim >= least[:, None])
                    best = np.lexsort((place[columns[s]], -sim[r, s], r))  # ties of the k-th: the least unit
                    r, s = r[best], s[best]
                    keep = np.arange(len(r)) - np.searchsorted(r, np.arange(len(a)))[r] < k
                    r, s = r[keep], s[keep]
                else:
                    r, s = np.indices(sim.shape).reshape(2, -1)
                found = sim[r, s]
                r, s, found = (v[np.isfinite(found)] for v in (r, s, found))
                if len(r):
                    yield pa.RecordBatch.from_pydict({"a": unit.take(pa.array(a[r])), "b": unit.take(pa.array(columns[s])), "similarity": pa.array(found)})

    kind = df.schema["unit"].dataType.simpleString()
    tasks = min(max(blocks * (blocks + 1) // 2, 1), 2_000)
    return cells.repartition(tasks, "i", "j").groupBy("i", "j").applyInArrow(product, f"a {kind}, b {kind}, similarity double")


def neighbour_edges(knn: DataFrame) -> DataFrame:
    """Undirected union of the neighbour lists, largest similarity of both directions."""
    return knn.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.max("similarity").alias("weight"))


def coherence(knn: DataFrame, programs: DataFrame) -> DataFrame:
    """V8: mean neighbour similarity, nearest neighbour and the share of neighbours in the unit's own program."""
    own = programs.select(F.col("unit").alias("a"), F.col("program").alias("pa"))
    other = programs.select(F.col("unit").alias("b"), F.col("program").alias("pb"))
    joined = knn.join(own, "a").join(other, "b")
    return joined.groupBy(F.col("a").alias("unit")).agg(
        F.round(F.avg("similarity"), 9).alias("mean_similarity"), F.min_by("b", "rank").alias("nearest"), F.round(F.avg((F.col("pa") == F.col("pb")).cast("double")), 6).alias("own_share")
    )


def leave_one_out(df: DataFrame, least: float = 0.45, margin: float = 0.05) -> DataFrame:
    """V9: cosine to each program's centroid (without the unit itself), best program or "mixed".

    A centroid without its member is (sum - x) / (n - 1): program sums are aggregated once per dimension, so
    work is units times programs, never units squared. With one program the margin is against -1.
    """
    long_ = df.select("unit", "program", F.posexplode("profile").alias("d", "x"))
    sums = long_.groupBy("program", "d").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    arrays = sums.groupBy("program", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "s"))), lambda t: t["s"]).alias("sum"))
    c = df.crossJoin(F.broadcast(arrays.withColumnRenamed("program", "candidate")))  # programs are few
    own = F.col("program") == F.col("candidate")
    c = c.where(~own | (F.col("n") > 1))
    centre = F.when(own, F.zip_with("sum", "profile", lambda s, x: (s - x) / (F.col("n") - 1))).otherwise(F.transform("sum", lambda s: s / F.col("n")))
    c = c.withColumn("centre", centre)
    cos = X.dot(F.col("centre"), F.col("profile")) / F.nullif(X.norm(F.col("centre")) * X.norm(F.col("profile")), F.lit(0.0))
    scored = c.select("unit", "program", "candidate", F.round(F.coalesce(cos, F.lit(0.0)), 6).alias("cosine"))
    order = Window.partitionBy("unit").orderBy(F.col("cosine").desc(), "candidate")
    first = scored.withColumns({"k": F.row_number().over(order), "second": F.lead("cosine").over(order)}).where("k = 1")
    gap = F.round(F.col("cosine") - F.coalesce("second", F.lit(-1.0)), 6)
    fits = (F.col("cosine") >= least) & (gap >= margin)
    return first.select("unit", "program", F.col("candidate").alias("best"), "cosine", gap.alias("margin"), F.when(fits, F.col("candidate")).otherwise("mixed").alias("assigned"))


def markers(df: DataFrame, k: int = 12, consistency: float = 0.7) -> DataFrame:
    """Features of a program by mean raw value whose sign most members share; k positive, k negative."""
    long_ = df.select("program", F.posexplode("profile").alias("feature", "x"))
    m = long_.groupBy("program", "feature").agg(F.round(F.avg("x"), 9).alias("mean"), F.avg(F.signum("x")).alias("lean"), F.count(F.lit(1)).alias("n"), F.sum((F.col("x") > 0).cast("long")).alias("up"), F.sum((F.col("x") < 0).cast("long")).alias("down"))
    same = F.when(F.col("mean") > 0, F.col("up")).otherwise(F.col("down")) / F.col("n")
    m = m.where("mean <> 0").withColumns({"direction": F.when(F.col("mean") > 0, "up").otherwise("down"), "consistency": F.round(same, 6)}).where(F.col("consistency") >= consistency)
    order = Window.partitionBy("program", "direction").orderBy(F.abs("mean").desc(), "feature")
    return m.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("program", "direction", "rank", "feature", F.round("mean", 6).alias("mean"), "consistency")


def balanced_panel(ranked: DataFrame, classes: DataFrame, moves: DataFrame, per_class: int = 75, per_move: int = 25) -> DataFrame:
    """V1: the best units of each class, then the largest risers and fallers; the first source wins a unit."""
    from quillon.operators.sets import first_wins

    order = Window.partitionBy("regulator_class").orderBy("rank")
    best = ranked.join(classes, "unit").withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_class)
    up = moves.orderBy(F.col("rank_shift").desc(), "unit").limit(per_move).select("unit", F.lit("promoted").alias("source"))
    down = moves.orderBy("rank_shift", "unit").limit(per_move).select("unit", F.lit("demoted").alias("source"))
    return first_wins(best.select("unit", F.concat(F.lit("top_"), "regulator_class").alias("source")), up, down)


def expanded_panel(df: DataFrame, contexts: int = 3, top: int | None = 50) -> DataFrame:
    """V2: units gated in all contexts, mean support at least the median of unit means, then the ``top`` largest responses, or all."""
    g = df.where("gate").groupBy("unit").agg(F.countDistinct("context").alias("n"), F.avg("support").alias("s"), F.max("response").alias("m")).where(F.col("n") == contexts)
    g = Scratch(df.sparkSession, "panel").save(g, "units")
    floor = O.quantiles(g, "s", [0.5])[0]
    kept = g.where(F.col("s") >= F.lit(floor).cast("double"))
    kept = kept if top is None else kept.orderBy(F.col("m").desc(), "unit").limit(top)
    return kept.select("unit", F.round("s", 6).alias("mean_support"), F.col("m").alias("max_response"))


def block_summary(df: DataFrame, threshold: float = 0.2) -> DataFrame:
    """Per row over features, in one pass: counts and norms, of all elements and of those beyond the threshold."""
    p = F.col("profile")
    big = F.filter(p, lambda x: F.abs(x) > threshold)
    return df.select(
        "unit",
        F.size(big).cast("long").alias("n_sig"),
        F.round(X.array_sum(F.transform(p, F.abs)), 6).alias("l1"),
        F.round(X.norm(p), 6).alias("l2"),
        F.round(X.norm(big), 6).alias("l2_sig"),
        F.round(X.array_sum(p) / F.size(p), 6).alias("mean"),
    )


def selected_summary(df: DataFrame, fdr: float = 0.1) -> DataFrame:
    """Per row over features, in one pass: counts and norms over the features whose p is under ``fdr``, norms of z and of all.

    df has arrays profile, z and p; mean_sig is null where no feature passes.
    """
    both = F.arrays_zip("profile", "z", "p")
    passed = F.transform(F.filter(both, lambda t: t["p"] < fdr), lambda t: t["profile"])
    magnitude = X.array_sum(F.transform(passed, F.abs))
    return df.select(
        *[c for c in df.columns if c not in ("profile", "z", "p")],
        F.size(passed).cast("double").alias("n_sig"),
        magnitude.alias("mag_sig"),
        (magnitude / F.nullif(F.size(passed), F.lit(0))).alias("mean_sig"),
        X.norm(passed).alias("l2_sig"),
        X.norm(F.col("z")).alias("l2_z"),
        X.array_sum(F.transform("z", F.abs)).alias("sabs_z"),
        X.norm(F.col("profile")).alias("l2_all"),
    )


def tensor_cells(df: DataFrame) -> DataFrame:
    """One profile per (unit, context); of repeated cells the greatest row_id wins; a missing row is the mask."""
    order = Window.partitionBy("unit", "context").orderBy(F.col("row_id").desc())
    return df.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def rms_normalise(cells: DataFrame) -> DataFrame:
    """Each context's slab to root-mean-square 1 over observed entries; a zero slab stays."""
    squares = F.aggregate("profile", F.lit(0.0), lambda s, x: s + x * x)
    scale = cells.groupBy("context").agg(F.sqrt(F.sum(squares) / F.sum(F.size("profile"))).alias("rms"))
    safe = F.when(F.col("rms") == 0, 1.0).otherwise(F.col("rms"))
    return cells.join(F.broadcast(scale), "context").withColumn("profile", F.transform(F.array(safe), lambda s: F.transform("profile", lambda x: x / s))[0])


def confound_meter(cells: DataFrame) -> DataFrame:
    """Spearman of slab norm and support; no rho under three cells."""
    from quillon.operators.stats import spearman

    out = spearman(cells.select(F.round(X.norm(F.col("profile")), 6).alias("norm"), "support"), "norm", "support")
    return out.withColumn("rho", F.when(F.col("n") >= 3, F.col("rho")))
