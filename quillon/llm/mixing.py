"""Mixing sources to target weights by capped water-filling.

Sources in code-point order (null last) get weights from a repeating pattern and share ``share`` of all
sizes. A source's target stops at ``max_epochs`` times its size; what it cannot take is shared again by
weight until no target is above its cap. That fixed point is one water level: with sources ordered by
cap / weight, the level is where the rest of the budget divided by the rest of the weight no longer
exceeds the next cap, which prefix sums over the table of sources give without a loop.

The repetition rate target / size is a whole number of passes and a fraction. Whole passes take every
document; the fraction takes documents in a seeded order until the source's target is met to the word: the
document at the border is taken in part (its first words). The seeded order is never sorted as a whole:
documents fall into hash buckets, bucket sums give the bucket the border lies in, and only that bucket's
rows of each source are ordered. All other rows are decided by their source's plan and their own bucket, so
the mixed corpus is made without a shuffle of texts but for the border buckets.

Defined results: null text has size 0; a text without words takes no words, and comes with each whole pass of
its source and never with the part; null source is a source; a source without words gets target 0 and no
pass; repeated rows are documents of their own, of which as many are taken as the border leaves; null doc_ids
are put in order by their texts; an empty table gives no rows. Other columns pass through ``mix`` untouched,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import Scratch, word_count

WEIGHTS = (5, 2, 1)
#: Most sources whose plan is sent to every task; with more, Spark chooses the join.
FEW_SOURCES = 50_000
ROW = ["source", "key", "size", "doc_id", "text_key"]


def water_fill(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_pct: int = 150, max_epochs: int = 2) -> DataFrame:
    """(source, source_size) -> the same with weight, target. One row per source; sources are few."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    ranked = sources.withColumn("__i", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("__i") % len(weights) + 1).cast("int")).cast("long")
    s = ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * max_epochs).alias("__cap"))
    s = s.withColumn("__budget", F.sum("source_size").over(everything) * (share_pct / 100.0)).withColumn("__all_w", F.sum("weight").over(everything))
    fill = Window.orderBy((F.col("__cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("__before_cap", F.coalesce(F.sum("__cap").over(fill), F.lit(0))).withColumn("__before_w", F.coalesce(F.sum("weight").over(fill), F.lit(0)))
    left, left_w = F.col("__budget") - F.col("__before_cap"), F.col("__all_w") - F.col("__before_w")
    open_ = F.col("__cap") * left_w > F.col("weight") * left
    # The first open source's rest and weight define the level for it and all that follow.
    s = s.withColumn("__open", open_).withColumn("__level", F.max(F.when(open_, F.struct(-F.col("__before_w"), left.alias("l"), left_w.alias("w")))).over(everything))
    target = F.when(F.col("__open"), F.col("weight") * F.col("__level.l") / F.col("__level.w")).otherwise(F.col("__cap").cast("double"))
    return s.select("source", "source_size", "weight", target.alias("target"))


def _sized(docs: DataFrame, seed: int, *keep) -> DataFrame:
    """doc_id, source, size, text_key and the seeded order's key of every row, and columns to keep."""
    text_key = F.xxhash64("text")
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text#"), text_key.cast("string")))
    key = F.substring(F.md5(F.concat_ws("#", F.lit(str(seed)), name).cast("binary")), 1, 15)
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), text_key.alias("text_key"), F.conv(key, 16, 10).cast("long").alias("key"), *keep)


def _planned(rows: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    """Rows with their source's plan, their bucket and whether it is before the border's (1), the border's (0) or behind it (-1)."""
    p = plan.withColumnRenamed("source", "p_source")
    joined = rows.join(F.broadcast(p) if few else p, rows["source"].eqNullSafe(p["p_source"])).drop("p_source")
    bucket = F.floor(F.col("key") / F.col("width")).cast("long")
    return joined.withColumn("side", F.coalesce(F.signum(F.col("border") - bucket), F.lit(-1)).cast("int"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Border rows (with rid, numbers that rise within a task's rows) with ``nth``, from 0, among the rows of their source that share one border.

    Per-task counts are summed to offsets, so that very many equal rows need no common task.
    """
    task = F.shiftright("rid", 33)
    rows = rows.withColumn("task", task)
    counts = rows.groupBy(F.col("source").alias("t_source"), F.col("task").alias("t_task")).agg(F.count(F.lit(1)).alias("n"))
    run = Window.partitionBy("t_source").orderBy("t_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("t_source", "t_task", F.coalesce(F.sum("n").over(run), F.lit(0)).alias("offset"))
    joined = rows.join(offsets, rows["source"].eqNullSafe(offsets["t_source"]) & (F.col("task") == F.col("t_task")))
    local = F.row_number().over(Window.partitionBy("source", "task").orderBy("rid")) - 1
    return joined.withColumn("nth", F.col("offset") + local).drop("t_source", "t_task", "offset", "task")


def _extras(rows: DataFrame, rooms: DataFrame, few: bool) -> DataFrame:
    """Border rows with ``extra``, the words that the part takes of each."""
    r = rooms.select(*[F.col(c).alias(f"r_{c}") for c in ROW], "room", "rows")
    same = F.lit(True)
    for c in ROW:
        same = same & rows[c].eqNullSafe(r[f"r_{c}"])
    held = rows.join(r, same).drop(*[f"r_{c}" for c in ROW])
    split = (F.col("rows") > 1) & (F.col("room") > 0) & (F.col("room") < F.col("size") * F.col("rows"))  # one set of equal rows a source at most
    even = held.where(~split).withColumn("extra", F.when(F.col("room") > 0, F.least("room", "size")).otherwise(F.lit(0)).cast("long"))
    dealt = _numbered(held.where(split)).withColumn("extra", F.least(F.greatest(F.col("room") - F.col("nth") * F.col("size"), F.lit(0)), F.col("size")).cast("long")).drop("nth")
    return even.unionByName(dealt).drop("room", "rows")


def _plan(docs: DataFrame, scratch: Scratch, weights, share_pct, max_epochs, seed, rows_per_bucket) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
    """The sized rows, the plan of every source, the words each set of equal border rows takes, and whether sources are few."""
    sized = scratch.save(_sized(docs, seed, F.monotonically_increasing_id().alias("rid")), "sizes")
    width = F.lit((1 << 60) // max(16, sized.count() // rows_per_bucket) + 1)
    sums = scratch.save(sized.groupBy("source", F.floor(F.col("key") / width).cast("long").alias("bucket")).agg(F.sum("size").alias("words")), "buckets")
    sources = sums.groupBy("source").agg(F.sum("words").cast("long").alias("source_size"))
    goals = scratch.save(water_fill(sources, weights, share_pct, max_epochs), "targets")
    goals = goals.withColumn("goal", F.floor("target").cast("long"))
    passes = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.floor(F.col("goal") / F.greatest(F.col("source_size"), F.lit(1))))
    goals = goals.withColumn("passes", passes.cast("long")).withColumn("rest", F.col("goal") - F.col("passes") * F.col("source_size"))
    run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(F.col("source").alias("b_source"), "bucket", "words", F.coalesce(F.sum("words").over(run), F.lit(0)).alias("before"))
    g = goals.withColumnRenamed("source", "g_source")
    lies = (F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words"))
    borders = before.join(g.select("g_source", "rest"), before["b_source"].eqNullSafe(g["g_source"])).where(lies).select("b_source", F.col("bucket").alias("border"), (F.col("rest") - F.col("before")).alias("left"))
    plan = goals.join(borders, goals["source"].eqNullSafe(borders["b_source"]), "left")
    plan = scratch.save(plan.select("source", "source_size", "target", "passes", "border", "left", width.alias("width")), "plan")
    few = plan.count() <= FEW_SOURCES
    equal = _planned(sized, plan, few).where("side = 0").groupBy(*ROW).agg(F.count(F.lit(1)).alias("rows"), F.first("left").alias("left"))
    order = Window.partitionBy("source").orderBy("key", "size", "doc_id", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum(F.col("size") * F.col("rows")).over(order), F.lit(0))
    rooms = equal.select(*ROW, "rows", F.least(F.greatest(F.col("left") - ahead, F.lit(0)), F.col("size") * F.col("rows")).cast("long").alias("room"))
    return sized, plan, scratch.save(rooms, "rooms"), few


def assign(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_pct: int = 150, max_epochs: int = 2, seed: int = 11, rows_per_bucket: int = 4096) -> DataFrame:
    """doc_id, size, source, source_size, target, passes, extra, taken per document row."""
    sized, plan, rooms, few = _plan(docs, Scratch(docs.sparkSession, "mixing"), weights, share_pct, max_epochs, seed, rows_per_bucket)
    rows = _planned(sized, plan, few)
    common = ["doc_id", "source", "size", "source_size", "target", "passes"]
    plain = rows.where("side <> 0").select(*common, F.when(F.col("side") > 0, F.col("size")).otherwise(F.lit(0)).cast("long").alias("extra"))
    out = plain.unionByName(_extras(rows.where("side = 0"), rooms, few).select(*common, "extra"))
    return out.select("doc_id", "size", "source", "source_size", "target", "passes", "extra", (F.col("passes") * F.col("size") + F.col("extra")).cast("long").alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_pct: int = 150, max_epochs: int = 2, seed: int = 11, rows_per_bucket: int = 4096) -> DataFrame:
    """The mixed corpus: every document row as often as it is taken, columns as in ``docs``.

    Whole repetitions repeat the row; the one part repetition of a source is a row of its own whose text
    ends after the words taken.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    _, plan, rooms, few = _plan(docs, scratch, weights, share_pct, max_epochs, seed, rows_per_bucket)
    # The input's columns travel in a struct, where no name of theirs clashes.
    rows = _planned(_sized(docs, seed, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), plan, few)
    border = scratch.save(rows.where("side = 0").withColumn("rid", F.monotonically_increasing_id()), "border")
    whole, part = F.col("passes"), F.lit(0).cast("long")
    plain = rows.where("side <> 0").select("row", (whole + F.when((F.col("side") > 0) & (F.col("size") > 0), 1).otherwise(0)).alias("copies"), part.alias("part"))
    full = (F.col("extra") == F.col("size")) & (F.col("size") > 0)
    cut = F.when(~full, F.col("extra")).otherwise(0).cast("long")
    edge = _extras(border, rooms, few).select("row", (whole + F.when(full, 1).otherwise(0)).alias("copies"), cut.alias("part"))
    dealt = plain.unionByName(edge).withColumn("times", F.col("copies") + F.when(F.col("part") > 0, 1).otherwise(0)).where("times > 0")
    dealt = dealt.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    # Split before the white space behind each word, so that a chunk is one word and what stands before it.
    chunks = F.split("row.text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    head = F.array_join(F.slice(chunks, F.lit(1), F.col("part").cast("int")), "")
    text = F.when(F.col("copy") > F.col("copies"), head).otherwise(F.col("row.text"))
    return dealt.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


#: DuckDB SQL of ``assign`` as op9 returns it.
SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('11#' || doc_id::VARCHAR), 1, 15))::BIGINT AS k
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (ARRAY[5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1]::BIGINT AS weight
  FROM sized GROUP BY source),
b AS (
  SELECT *, 2 * source_size AS cap, (sum(source_size) OVER ())::BIGINT * 1.5::DOUBLE AS budget, (sum(weight) OVER ())::BIGINT AS all_w FROM s),
p AS (
  SELECT *, coalesce(sum(cap) OVER w, 0)::BIGINT AS before_cap, coalesce(sum(weight) OVER w, 0)::BIGINT AS before_w FROM b
  WINDOW w AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (
  SELECT *, cap * (all_w - before_w) > weight * (budget - before_cap) AS is_open FROM p),
lv AS (
  SELECT arg_min(budget - before_cap, before_w) AS l, arg_min(all_w - before_w, before_w) AS w FROM l WHERE is_open),
t AS (
  SELECT source, source_size, CASE WHEN is_open THEN weight * lv.l / lv.w ELSE cap::DOUBLE END AS target FROM l LEFT JOIN lv ON true),
g AS (
  SELECT *, floor(target)::BIGINT AS goal, CASE WHEN source_size = 0 THEN 0 ELSE floor(target)::BIGINT // greatest(source_size, 1) END AS passes FROM t),
o AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, g.passes, g.goal - g.passes * g.source_size AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM sized d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, (passes * size + least(greatest(rest - ahead, 0), size))::BIGINT AS taken FROM o
"""
