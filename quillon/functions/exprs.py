"""Column expressions shared by the operators: null-safe arithmetic, ranks, seeded order, array algebra."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.kernels import normal_sf


def to_bool(c: Column) -> Column:
    """Text, number or boolean to boolean: true, 1 and 1.0 (any case, blanks around) are true, null is null."""
    return F.lower(F.trim(c.cast("string"))).isin("true", "1", "1.0")


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """c held between low and high; null stays null (greatest and least alone would skip it)."""
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(c.isNotNull(), out)


def safe_ratio(a: Column, b: Column, default: float | None = 0.0) -> Column:
    """a / b, or ``default`` where b is 0 or null."""
    ratio = a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))
    return ratio if default is None else F.coalesce(ratio, F.lit(default))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def average_rank(c: Column, keys: Sequence[str] = (), descending: bool = False) -> Column:
    """Mean rank of ties, as a double; null values get null. ``keys`` partition the ranking."""
    order = c.desc_nulls_last() if descending else c.asc_nulls_last()
    ties = Window.partitionBy(*keys, c)
    return F.when(c.isNotNull(), F.rank().over(Window.partitionBy(*keys).orderBy(order)) + (F.count(F.lit(1)).over(ties) - 1) / 2.0)


def percentile_rank(c: Column, keys: Sequence[str] = ()) -> Column:
    """Average rank over the number of values."""
    return average_rank(c, keys) / F.count(c).over(Window.partitionBy(*keys))


def seeded(*parts: Column | str | int) -> Column:
    """md5 of the parts: a deterministic order that any engine reproduces."""
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws("#", *[c.cast("string") for c in columns]).cast("binary"))


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def finite_or_zero(a: Column) -> Column:
    return F.transform(a, lambda x: F.when(finite(x), x.cast("double")).otherwise(F.lit(0.0)))


def unit_vector(a: Column) -> Column:
    """a / |a|; a zero vector stays as it is."""
    return F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n)))[0]


def pearson(x: Column, y: Column) -> Column:
    """Aggregate correlation; null where either side does not vary (the built-in one divides by zero there in ANSI mode)."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def whole_pearson(x: Column, y: Column, digits: int = 6) -> Column:
    """Aggregate correlation of whole numbers to ``digits``, over rows that have both; null where either side does not vary.

    Sums of whole numbers below 2^53 are exact in any order, and one division gives the value to be rounded, so that equal
    rows give equal correlations in any engine, those on the border of two roundings too.
    """
    both = lambda c: F.sum(F.when(x.isNotNull() & y.isNotNull(), c))
    n, sx, sy = both(F.lit(1.0)), both(x), both(y)
    spread = F.greatest((n * both(x * x) - sx * sx) * (n * both(y * y) - sy * sy), F.lit(0.0))
    scale = F.lit(float(10**digits))
    return F.round(scale * (n * both(x * y) - sx * sy) / F.nullif(F.sqrt(spread), F.lit(0.0))) / scale


def whole_pearson_sql(x: str, y: str, digits: int = 6) -> str:
    """``whole_pearson`` as SQL text."""
    both = lambda c: f"SUM({c}) FILTER (WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"
    n, sx, sy = both("1::DOUBLE"), both(x), both(y)
    spread = f"GREATEST(({n} * {both(f'{x} * {x}')} - {sx} * {sx}) * ({n} * {both(f'{y} * {y}')} - {sy} * {sy}), 0)"
    return f"ROUND(1e{digits} * ({n} * {both(f'{x} * {y}')} - {sx} * {sy}) / NULLIF(SQRT({spread}), 0)) / 1e{digits}"


def with_normal_tails(df: DataFrame, **arguments: Column) -> DataFrame:
    """``df`` with a column per argument: P(Z > argument).

    Arguments are bound by a generator of one row: the optimizer would paste a projected expression, or one that
    a later filter uses, back into each of its hundred places, and the code would grow beyond what compiles.
    """
    parts = []
    for name, x in arguments.items():
        x = x.cast("double")
        parts += [x.alias(f"{name}_x"), (F.abs(x) / math.sqrt(2)).alias(f"{name}_z"), (x * x / 2).alias(f"{name}_w")]
    bound = df.select("*", F.explode(F.array(F.struct(*parts))).alias("__at"))
    return bound.select(*df.columns, *[F.expr(normal_sf(f"__at.{n}_x", f"__at.{n}_z", f"__at.{n}_w")).alias(n) for n in arguments])
