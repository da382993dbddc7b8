"""Inductive prediction of profiles from unit features: design matrix, folds, ridge by leave-one-out error."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizerModel, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from quillon.functions import exprs as X
from quillon.operators.lowrank import gram
from quillon.operators.order import quantiles
from quillon.operators.stats import numbered, ranked

ALPHAS = tuple(float(a) for a in np.logspace(-2, 4, 13))


def _listed(column):
    return F.array_remove(F.array_distinct(F.transform(F.split(column, ";"), lambda t: F.trim(t))), "")


def tokens(df: DataFrame, column: str, least: int = 10, cap: int = 500) -> DataFrame:
    """(token, n) of a ;-list column: tokens of at least ``least`` rows, the ``cap`` most frequent, ties to the lesser token."""
    counts = df.select(F.explode(_listed(F.col(column))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return counts.orderBy(F.col("n").desc(), "token").limit(cap)


def design(df: DataFrame, numeric: list[str], category: str, lists: Mapping[str, tuple[int, int]], sparse: bool = False) -> DataFrame:
    """(unit, x): median-imputed numbers, one-hot category with a "None" level, multi-hot tokens of every ;-list column.

    ``lists`` gives each list column its (least rows, most tokens); tokens are in the order of ``tokens``. x is an array, or
    with ``sparse`` an ML vector that names only its entries. A number without any value is 0; a row without tokens has none.
    """
    centre = {c: quantiles(df, c, [0.5])[0] or 0.0 for c in numeric}
    filled = df.withColumns({f"__{c}": F.coalesce(F.col(c).cast("double"), F.lit(float(v))) for c, v in centre.items()})
    filled = filled.withColumn("__level", F.coalesce(category, F.lit("None")))
    indexed = StringIndexer(inputCol="__level", outputCol="__i", stringOrderType="alphabetAsc").fit(filled).transform(filled)
    hot = OneHotEncoder(inputCol="__i", outputCol="__c", dropLast=False).fit(indexed).transform(indexed)
    parts = [f"__{c}" for c in numeric] + ["__c"]
    for k, (listed, (least, cap)) in enumerate(lists.items()):
        vocabulary = [r["token"] for r in tokens(df, listed, least, cap).collect()]  # at most cap of them
        if vocabulary:
            hot = hot.withColumn(f"__t{k}", _listed(F.coalesce(listed, F.lit(""))))
            model = CountVectorizerModel.from_vocabulary(vocabulary, inputCol=f"__t{k}", outputCol=f"__l{k}").setBinary(True)
            hot = model.transform(hot)
            parts.append(f"__l{k}")
    x = VectorAssembler(inputCols=parts, outputCol="__x").transform(hot)
    return x.select("unit", F.col("__x").alias("x") if sparse else vector_to_array("__x").alias("x"))


def folds(df: DataFrame, k: int = 5, seed: str = "fold") -> DataFrame:
    """M2: fold of each unit by its place in md5 order: equal sizes, the same in every engine."""
    placed = numbered(df, X.seeded(seed, F.col("unit")), ["unit"], name="__place")
    return placed.withColumn("fold", ((F.col("__place") - 1) % k).cast("int")).drop("__place")


def shuffled(df: DataFrame, column: str, seed: str = "shuffle") -> DataFrame:
    """M5: the column's values handed to other units, by joining positions of two orders."""
    a = ranked(df, ["unit"])
    b = numbered(df.select("unit", F.col(column).alias("__v")), X.seeded(seed, F.col("unit")), ["unit"], name="__q").select("__q", "__v")
    return a.join(b, F.col("unit_below") + 1 == F.col("__q")).select(*[F.col("__v").alias(c) if c == column else F.col(c) for c in df.columns])


def coordinates(column: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, value) of the entries of a column of ML vectors, sparse or dense."""
    indices, values = column.field("indices"), column.field("values")
    size = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    named = indices.is_valid().to_numpy(zero_copy_only=False)
    place[named[row]] = indices.flatten().to_numpy(zero_copy_only=False)
    return row, place, values.flatten().to_numpy(zero_copy_only=False)


#: Products of entries that a task holds at a time, and rows of a dense block.
PRODUCTS, BLOCK = 1_000_000, 512


def sparse_gram(df: DataFrame, p: int, q: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, sums, Gram matrix) of vectors x beside arrays y: outer products of the named entries alone, as coordinates (sums have j = -1, the rows i = -1 too) that Spark adds up.

    A row of m entries costs m squared, not p squared. Rows whose x or y is null count for nothing.
    """

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, g = 0, np.zeros(p + q), np.zeros((p + q, p + q))
        for batch in batches:
            row, at, v = coordinates(batch.column(0))
            y = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, q)
            n, sums[p:] = n + len(y), sums[p:] + y.sum(axis=0)
            sums[:p] += np.bincount(at, v, p)
            g[p:, p:] += y.T @ y
            size = np.bincount(row, minlength=len(y))
            start, spent = np.cumsum(size) - size, np.cumsum(size**2) // PRODUCTS
            for part in np.unique(spent):
                rows = np.flatnonzero(spent == part)
                a, b = start[rows[0]], start[rows[-1]] + size[rows[-1]]
                own = row[a:b]
                left = np.repeat(np.arange(a, b), size[own])
                within = np.arange(len(left)) - np.repeat(np.cumsum(size[own]) - size[own], size[own])
                right = np.repeat(start[own], size[own]) + within
                g[:p, :p] += np.bincount(at[left] * p + at[right], v[left] * v[right], p * p).reshape(p, p)
                for k in range(q):
                    g[:p, p + k] += np.bincount(at[a:b], v[a:b] * y[own, k], p)
        g[p:, :p] = g[:p, p:].T
        i, j = np.nonzero(g)
        sum_of, none = np.arange(p + q), np.full(p + q, -1)
        columns = np.concatenate([i, sum_of, [-1]]), np.concatenate([j, none, [-1]]), np.concatenate([g[i, j], sums, [float(n)]])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["i", "j", "v"])

    known = df.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select("x", "y")
    found = known.mapInArrow(fold, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    i, j, v = (found.column(c).to_numpy() for c in "ijv")
    g, sums, single = np.zeros((p + q, p + q)), np.zeros(p + q), (j < 0) & (i >= 0)
    g[i[j >= 0], j[j >= 0]] = v[j >= 0]
    sums[i[single]] = v[single]
    return int(v[i < 0].sum()), sums, g


def blocks(batch: pa.RecordBatch, p: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, end, rows of x in full) of a batch whose first column is vectors or arrays, a bounded block at a time."""
    for a in range(0, batch.num_rows, BLOCK):
        part = batch.column(0).slice(a, BLOCK)
        if pa.types.is_struct(part.type):
            x = np.zeros((len(part), p))
            row, at, v = coordinates(part)
            x[row, at] = v
        else:
            x = np.asarray(part.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, p)
        yield a, a + len(part), x


def ridge(df: DataFrame, p: int, q: int, alphas: tuple[float, ...] = ALPHAS, scaled: int = 0) -> tuple[np.ndarray, np.ndarray, float]:
    """M3: (coefficients p x q, intercept, alpha) of y on x from one distributed Gram matrix of (x, y).

    alpha has the least leave-one-out error: a second pass adds up each row's squared residual over
    (1 - leverage)^2 for every alpha. M2: the first ``scaled`` features are standardised by these rows' own
    means and deviations, and the coefficients given back for the features as they are.
    """
    df = df.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    sparse = isinstance(df.schema["x"].dataType, VectorUDT)
    n, sums, g = sparse_gram(df, p, q) if sparse else gram(df.select(F.concat("x", "y").alias("profile")), p + q)
    mean = sums / max(n, 1)
    g = g - n * np.outer(mean, mean)
    unit = np.ones(p)
    unit[:scaled] = np.sqrt(np.diag(g)[:scaled].clip(0) / max(n, 1))
    unit[unit == 0] = 1
    values, vectors = np.linalg.eigh(g[:p, :p] / np.outer(unit, unit))
    values, z = values.clip(0), vectors.T @ (g[:p, p:] / unit[:, None])
    into = vectors / unit[:, None]
    shrink = np.array([1 / (values + a) for a in alphas])

    def left_out(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        total = np.zeros(len(alphas))
        for batch in batches:
            y = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, q) - mean[p:]
            for a, end, x in blocks(batch, p):
                t = (x - mean[:p]) @ into
                for k, s in enumerate(shrink):
                    leverage = 1 / n + (t**2 * s).sum(axis=1)
                    total[k] += ((y[a:end] - t @ (z * s[:, None])) ** 2 / np.maximum(1 - leverage, 1e-9)[:, None] ** 2).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(alphas)), pa.int32()), pa.array(total)], names=["k", "e"])

    errors = df.select("x", "y").mapInArrow(left_out, "k int, e double").groupBy("k").agg(F.sum("e").alias("e")).collect()  # a row an alpha
    best = min(errors, key=lambda r: (r["e"], r["k"]))["k"]
    coef = into @ (z * shrink[best][:, None])
    return coef, mean[p:] - mean[:p] @ coef, alphas[best]


def predict(df: DataFrame, coef: np.ndarray, intercept: np.ndarray) -> DataFrame:
    """Adds ``prediction``: x, an array or an ML vector without nulls, times the coefficients; columns besides x stay."""
    p, others = len(coef), [c for c in df.columns if c not in ("x", "prediction")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x @ coef + intercept for _, _, x in blocks(batch, p)]
            rows = np.concatenate(found) if found else np.zeros((0, len(intercept)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(list(rows), pa.list_(pa.float64()))], names=[*others, "prediction"])

    kept = df.where(F.col("x").isNotNull())
    return kept.select("x", *others).mapInArrow(run, kept.select(*others).schema.add("prediction", ArrayType(DoubleType())))


def row_r2(df: DataFrame, mean: np.ndarray) -> DataFrame:
    """M4: R2 of each row's prediction against the training mean."""
    m = F.array(*[F.lit(float(v)) for v in mean])
    sq = lambda a, b: X.array_sum(F.zip_with(a, b, lambda u, v: (u - v) * (u - v)))
    return df.withColumn("r2", 1 - sq(F.col("y"), F.col("prediction")) / F.nullif(sq(F.col("y"), m), F.lit(0.0)))


def verdict(real, control, margin: float = 0.005):
    """M7: informative if better than the mean and than shuffled features by a margin."""
    return F.when((real > 0) & (real - control > margin), "informative").when(real > 0, "not above control").otherwise("not informative")
