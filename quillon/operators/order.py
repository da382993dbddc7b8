"""Orders over whole tables without one task that holds them: splitters, ordinals, cumulative counts, exact quantiles.

Ranges are cut at splitters taken from the values themselves (a mergeable quantile sketch, or Spark's sampled
range partitioner), so that concentrated and heavy-tailed columns give ranges of like size. Sketches and
samples decide only where ranges end: results are exact whatever the splitters are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that values are split into.
PARTS = 256
#: Splitters in a group of them: a value is compared with the first of every group, then within one group.
GROUP = 16


def ordinals(df: DataFrame, order: Sequence[Column], name: str, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``df`` with ``name``: 1, 2, ... in ``order``, which should be total.

    Rows are dealt to ranges by sampled splitters of all order columns, sorted within each, and written with their range and
    place by ``save`` (a range partition made anew may be cut elsewhere; a written one is not). A row a range of
    sizes is summed to offsets and joined.
    """
    place = "__place"
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.monotonically_increasing_id().alias(place))
    written = save(placed)
    task = F.shiftright(place, 33)
    sizes = written.groupBy(task.alias("__task")).agg(F.count(F.lit(1)).alias("__n"))
    run = Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)  # a row a task of the write
    offsets = sizes.select("__task", F.coalesce(F.sum("__n").over(run), F.lit(0)).alias("__offset"))
    joined = written.join(F.broadcast(offsets), task == F.col("__task"))
    local = F.col(place).bitwiseAND((1 << 33) - 1)
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__offset") + local + 1).cast("long").alias(name))


def _numbers(values: Sequence[float], suffix: str = "D") -> str:
    """An array as SQL text: one literal to parse, where a column per number would be a call each."""
    return f"array({', '.join(f'{v!r}{suffix}' for v in values)})"


def splitters(df: DataFrame, values: Sequence[str], parts: int = PARTS) -> dict[str, list[float]]:
    """For each column, at most parts - 1 ascending values that cut it into like shares: one pass, a row to the driver."""
    at = F.expr(_numbers([i / parts for i in range(1, parts)]))
    row = df.agg(*[F.percentile_approx(F.col(v).cast("double"), at, 8 * parts).alias(f"s{k}") for k, v in enumerate(values)]).first()
    return {v: sorted({float(x) for x in row[k] or [] if math.isfinite(x)}) for k, v in enumerate(values)}


def range_of(value: Column, splits: Sequence[float]) -> Column:
    """The number of splitters that do not exceed ``value``: never falls as the value rises. Null values: null."""
    v = value.cast("double")
    if not splits:
        return F.when(v.isNotNull(), F.lit(0))
    groups = F.expr(f"array({', '.join(_numbers(splits[k : k + GROUP]) for k in range(0, len(splits), GROUP))})")
    heads = F.expr(_numbers(splits[::GROUP]))
    group = F.greatest(F.size(F.filter(heads, lambda x: x <= v)) - 1, F.lit(0))
    return F.when(v.isNotNull(), group * GROUP + F.size(F.filter(F.element_at(groups, group + 1), lambda x: x <= v)))


def cumulative(counts: DataFrame, value: str, n: str, splits: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """``counts`` (a row a value and key, ``n`` rows each) with __below, the rows of the key with a less value, and __all, its rows.

    Values are dealt to ranges, summed within each, and moved up by the sums of the ranges below.
    """
    placed = counts.withColumn("__range", range_of(F.col(value), splits))
    sums = placed.groupBy(*keys, "__range").agg(F.sum(n).alias("__m"))
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range and key
    o = sums.select(*[F.col(k).alias(f"__o_{k}") for k in keys], F.col("__range").alias("__o_range"), F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__before"), F.sum("__m").over(Window.partitionBy(*keys)).alias("__all"))
    within = Window.partitionBy(*keys, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("__range") == F.col("__o_range")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__o_{k}"))
    joined = placed.withColumn("__within", F.coalesce(F.sum(n).over(within), F.lit(0))).join(o, same)
    return joined.select(*[F.col(f"`{c}`") for c in counts.columns], (F.col("__before") + F.col("__within")).cast("long").alias("__below"), F.col("__all").cast("long").alias("__all"))


def _sizes(df: DataFrame, key: Column, count: Column) -> list[tuple[int, int]]:
    """(range, rows) in order; a row a range comes to the driver."""
    return sorted((r[0], r[1]) for r in df.groupBy(key.alias("r")).agg(count).collect())


def row_numbers(df: DataFrame, value: str, ties: Sequence[str], name: str, descending: bool = False, parts: int = PARTS) -> DataFrame:
    """``df`` with ``name``: 1, 2, ... by ``value``, equal ones by ``ties``; null values come last, as one range.

    A range of values is numbered by a task and moved up by the sizes of the ranges before it. Equal values share a range: where
    one value may hold more rows than a task can sort, use ``ordinals``. ``df`` is read three times: hand over a written table.
    """
    splits = splitters(df, [value], parts)[value]
    at = range_of(F.col(value), splits)
    at = F.coalesce(len(splits) - at if descending else at, F.lit(len(splits) + 1))
    before, total = [], 0
    sizes = dict(_sizes(df, at, F.count(F.lit(1))))
    for r in range(len(splits) + 2):
        before.append(total)
        total += sizes.get(r, 0)
    order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    placed = df.withColumn("__range", at)
    local = F.row_number().over(Window.partitionBy("__range").orderBy(order, *ties))
    return placed.withColumn(name, (local + F.element_at(F.expr(_numbers(before, "L")), F.col("__range") + 1)).cast("long")).drop("__range")


def min_ranks(df: DataFrame, values: dict[str, str], parts: int = PARTS) -> DataFrame:
    """``df`` with a column per name in ``values`` (name: value): one more than the rows of a greater value; null values get null.

    Equal values are counted before they are dealt to ranges. ``df`` is read more than once: hand over a written table.
    """
    splits, out = splitters(df, list(values.values()), parts), df
    for name, value in values.items():
        counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
        below = cumulative(counts, "__v", "__n", splits[value]).select("__v", (F.col("__all") - F.col("__below") - F.col("__n") + 1).alias(name))
        out = out.join(below, F.col(value) == F.col("__v"), "left").drop("__v")
    return out


def quantiles(df: DataFrame, value: str, fractions: Sequence[float], parts: int = PARTS, weight: str | None = None) -> list[float | None]:
    """The exact quantiles of ``value`` at ``fractions`` with linear interpolation, null without values.

    Rows are counted a range of values; only the ranges that hold a wanted order statistic are read again, their
    equal values counted before they are shuffled, and each range is searched by a task of its own. ``df`` is read three
    times: hand over a written table. With ``weight`` a row stands for so many.
    """
    count = (F.sum(weight) if weight else F.count(F.lit(1))).cast("long")
    some = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("__v"), *([weight] if weight else []))
    splits = splitters(some, ["__v"], parts)["__v"]
    at = range_of(F.col("__v"), splits)
    sizes = _sizes(some, at, count)
    total = sum(n for _, n in sizes)
    if not total:
        return [None] * len(fractions)
    places = sorted({int(f(q * (total - 1))) for q in fractions for f in (math.floor, math.ceil)})
    wanted, before = [], 0
    for r, n in sizes:
        wanted += [(r, p, p - before) for p in places if before <= p < before + n]
        before += n
    inner = Window.partitionBy("__range").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    equal = some.withColumn("__range", at).where(F.col("__range").isin([w[0] for w in wanted])).groupBy("__range", "__v").agg(count.alias("__n"))
    cells = equal.withColumn("__first", F.coalesce(F.sum("__n").over(inner), F.lit(0)))
    found: dict[int, float] = {}
    hit = F.array(*[F.when((F.col("__range") == r) & (F.col("__first") <= k) & (F.lit(k) < F.col("__first") + F.col("__n")), F.lit(p)) for r, p, k in wanted])
    for v, held in cells.select("__v", F.array_compact(hit).alias("p")).where(F.size("p") > 0).collect():  # at most two rows a fraction
        found |= dict.fromkeys(held, v)
    out = []
    for q in fractions:
        h = q * (total - 1)
        low, high = found[math.floor(h)], found[math.ceil(h)]
        out.append(low + (high - low) * (h - math.floor(h)))
    return out
