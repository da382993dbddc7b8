"""Boosted symmetric trees of many outputs at once: every level of every output's tree comes from one aggregate.

A tree splits all nodes of a level at the same feature and cut, so that a leaf is a number of ``depth`` bits. Rows
are cut into bins once and written; what reaches the driver are cuts and histograms, whose size is outputs times
nodes times bins, whatever the number of rows.

Rows whose x or y is null take no part in the fit; a null or NaN feature lies below all cuts; an unknown (null, NaN or
infinite) output of a row makes the row take no part. Without training rows the forest has no trees and predicts 0.
Ties of gain go to the smaller feature and cut. Columns besides ``x``, ``y`` and ``fold`` are not read in the fit.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from quillon.sources.shared import Scratch

#: Bins a feature: quantiles between them, of a mergeable sketch.
BINS = 32
#: Rounds after which predictions are written with the rows, so that a pass applies this many trees at most.
FRESH = 25


@dataclass(frozen=True)
class Tree:
    """Row goes to the leaf whose bit d says if its bin of ``features[d]`` is above ``bins[d]``."""

    features: np.ndarray
    bins: np.ndarray
    leaves: np.ndarray
    gains: np.ndarray

    def place(self, x: np.ndarray) -> np.ndarray:
        return ((x[:, self.features] > self.bins) << np.arange(len(self.features))).sum(axis=1)


@dataclass(frozen=True)
class Forest:
    """``trees[k]`` of output k up to its best round; ``base`` is the mean of the training rows."""

    cuts: list[np.ndarray]
    base: np.ndarray
    trees: list[list[Tree]]

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction``, an array over outputs; null where x is null."""
        cuts, base, trees = self.cuts, self.base, self.trees
        columns = [c for c in df.columns if c != "prediction"]

        def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            for batch in batches:
                x = batch.column(batch.num_columns - 1)
                known = np.array(x.is_valid())
                out = base + added(trees, into_bins(matrix(x.drop_null(), len(cuts)), cuts)) if known.any() else np.zeros((0, len(base)))
                rows = iter(out.tolist())
                found = pa.array([next(rows) if k else None for k in known], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], names=[*columns, "prediction"])

        schema = df.select(*columns).schema.add("prediction", ArrayType(DoubleType()))
        return df.select(*columns, F.col("x").alias("__x")).mapInArrow(run, schema)

    def importances(self) -> np.ndarray:
        """Outputs times features: the share of each feature in the gains of an output's trees."""
        out = np.zeros((len(self.trees), len(self.cuts)))
        for k, own in enumerate(self.trees):
            for t in own:
                np.add.at(out[k], t.features, t.gains)
        return out / np.maximum(out.sum(axis=1, keepdims=True), 1e-300)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a column of number lists, nulls within as NaN."""
    if not width:
        return np.zeros((len(column), 0))
    return np.asarray(column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, width)


def into_bins(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """How many of its feature's cuts are below each value."""
    filled = np.where(np.isnan(x), -np.inf, x)
    return np.stack([np.searchsorted(c, filled[:, f], side="left") for f, c in enumerate(cuts)], axis=1).astype(np.uint8) if cuts else np.zeros((len(x), 0), np.uint8)


def added(trees: list[list[Tree]], bins: np.ndarray) -> np.ndarray:
    out = np.zeros((len(bins), len(trees)))
    for k, own in enumerate(trees):
        for t in own:
            out[:, k] += t.leaves[t.place(bins)]
    return out


def feature_cuts(df: DataFrame) -> list[np.ndarray]:
    """Distinct quantiles of every feature below its greatest value: a feature of two values has one cut, however rare one of them."""
    each = df.select(F.posexplode("x").alias("f", "v")).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    levels = F.array(*[F.lit(k / BINS) for k in range(BINS)])
    found = each.groupBy("f").agg(F.percentile_approx("v", levels, 10_000).alias("q"), F.max("v").alias("top")).collect()  # a row a feature
    return [np.unique([q for q in r["q"] or [] if q < r["top"]]) for r in sorted(found, key=lambda r: r["f"])]


def boost(spark: SparkSession, df: DataFrame, outputs: int, rounds: int = 500, depth: int = 6, rate: float = 0.1, l2: float = 3.0, patience: int | None = 30) -> Forest:
    """M6: a forest for the ``outputs`` numbers of ``y`` from features ``x``, both arrays, all outputs in each pass.

    Rows of ``fold`` 0 are held out, those of fold 1 stop each output after ``patience`` rounds without a smaller
    squared error (None: all rounds are kept), the others train.
    """
    usable = F.forall("y", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = df.where("fold > 0").where(F.col("x").isNotNull() & F.col("y").isNotNull()).where(usable)
    rows = rows.select(F.col("x").cast("array<double>").alias("x"), F.col("y").cast("array<double>").alias("y"), (F.col("fold") == 1).alias("checks"))
    scratch = Scratch(spark, "boost")
    rows = scratch.save(rows, "rows")
    train = rows.where("NOT checks")
    means = train.agg(*[F.avg(F.col("y")[k]).alias(f"m{k}") for k in range(outputs)]).first()
    if means[0] is None:
        scratch.drop("rows")
        return Forest([], np.zeros(outputs), [[] for _ in range(outputs)])
    base = np.array(means, dtype=np.float64)
    cuts = feature_cuts(train)
    if not cuts:
        scratch.drop("rows")
        return Forest([], base, [[] for _ in range(outputs)])

    def prepare(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            bins = into_bins(matrix(batch.column("x"), len(cuts)), cuts)
            left = matrix(batch.column("y"), outputs) - base
            yield pa.RecordBatch.from_arrays([pa.array([b.tobytes() for b in bins], pa.binary()), pa.array(list(left), pa.list_(pa.float64())), batch.column("checks")], names=["bins", "left", "checks"])

    shape = "bins binary, left array<double>, checks boolean"
    state = scratch.save(rows.mapInArrow(prepare, shape), "state0")
    scratch.drop("rows")
    trees: list[list[Tree]] = [[] for _ in range(outputs)]
    best, kept, active, written = np.full(outputs, np.inf), np.zeros(outputs, dtype=int), np.arange(outputs), 0
    for turn in range(rounds + 1):
        if turn and turn % FRESH == 0:
            older = state
            state = scratch.save(older.mapInArrow(_subtract([t[written:] for t in trees], len(cuts)), shape), f"state{turn}")
            scratch.drop(f"state{written}")
            written = turn
        recent = [t[written:] for t in trees]
        grown: dict[int, list[tuple[int, int, float]]] = {int(k): [] for k in active}
        for level in range(depth):
            hist, errors = _level(state, cuts, recent, grown, level, depth)
            if level == 0:
                for k in list(grown):
                    if patience is None or errors[k] is None:
                        kept[k] = turn
                    elif errors[k] < best[k] * (1 - 1e-12):
                        best[k], kept[k] = errors[k], turn
                    elif turn - kept[k] >= patience:
                        del grown[k]
                active = np.array(sorted(grown), dtype=int)
                if not len(active) or turn == rounds:
                    break
            for k in grown:
                feature, at, gain, n, s = _split(hist[k], cuts, l2)
                grown[k].append((feature, at, gain))
                if level == depth - 1:
                    f, b, gains = (np.array(v) for v in zip(*grown[k], strict=True))
                    trees[k].append(Tree(f, b, rate * s / (n + l2), gains))
        if not len(active) or turn == rounds:
            break
    scratch.drop(f"state{written}")
    return Forest(cuts, base, [own[: kept[k]] for k, own in enumerate(trees)])


def _subtract(recent: list[list[Tree]], width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            bins = _bins(batch, width)
            left = matrix(batch.column("left"), len(recent)) - added(recent, bins)
            yield pa.RecordBatch.from_arrays([batch.column("bins"), pa.array(list(left), pa.list_(pa.float64())), batch.column("checks")], names=["bins", "left", "checks"])

    return run


def _bins(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("bins").to_pylist()), dtype=np.uint8).reshape(batch.num_rows, width)


def _level(state: DataFrame, cuts: list[np.ndarray], recent: list[list[Tree]], grown: dict[int, list[tuple[int, int, float]]], level: int, depth: int):
    """({output: counts and sums by (node, slot)}, {output: squared error of the checking rows}) of one pass over the rows.

    A slot is a bin of a feature, all features end to end. Errors are taken at level 0.
    """
    starts = np.concatenate([[0], np.cumsum([len(c) + 1 for c in cuts])]).astype(np.int64)
    slots, width, outputs = int(starts[-1]), len(cuts), len(recent)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        n, s = {k: np.zeros(slots << level) for k in grown}, {k: np.zeros(slots << level) for k in grown}
        wrong, checked = np.zeros(outputs), 0
        for batch in batches:
            bins = _bins(batch, width)
            left = matrix(batch.column("left"), outputs) - added(recent, bins)
            checks = batch.column("checks").to_numpy(zero_copy_only=False).astype(bool)
            wrong, checked = wrong + (left[checks] ** 2).sum(axis=0), checked + int(checks.sum())
            bins, left = bins[~checks], left[~checks]
            at = bins + starts[:-1]
            for k, path in grown.items():
                node = np.zeros(len(bins), dtype=np.int64)
                for d, (f, b, _) in enumerate(path):
                    node |= (bins[:, f] > b).astype(np.int64) << d
                where = (at + node[:, None] * slots).ravel()
                n[k] += np.bincount(where, minlength=slots << level)
                s[k] += np.bincount(where, weights=np.repeat(left[:, k], width), minlength=slots << level)
        for k in grown:
            filled = np.flatnonzero(n[k])
            place, count, total = filled, n[k][filled], s[k][filled]
            if level == 0 and checked:
                place, count, total = np.append(place, -1), np.append(count, checked), np.append(total, wrong[k])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), k, np.int32)), pa.array(place.astype(np.int64)), pa.array(count), pa.array(total)], names=["k", "place", "n", "s"])

    found = state.mapInArrow(run, "k int, place long, n double, s double").groupBy("k", "place").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).toArrow()
    k, place, n, s = (found.column(c).to_numpy() for c in ("k", "place", "n", "s"))
    hist, errors = {}, {}
    for o in grown:
        own = (k == o) & (place >= 0)
        h = np.zeros((2, slots << level))
        h[0, place[own]], h[1, place[own]] = n[own], s[own]
        hist[o] = h.reshape(2, 1 << level, slots)
        said = s[(k == o) & (place < 0)]
        errors[o] = float(said[0]) if len(said) else None
    return hist, errors


def _split(hist: np.ndarray, cuts: list[np.ndarray], l2: float):
    """(feature, bin, gain, counts, sums) of the cut with the greatest gain over all nodes; counts and sums of the leaves: below first, then above."""
    best, at, start = None, (0, 0), 0
    whole = hist[:, :, : len(cuts[0]) + 1].sum(axis=2)
    before = float((whole[1] ** 2 / (whole[0] + l2)).sum())
    below = whole
    for f, c in enumerate(cuts):
        sums = hist[:, :, start : start + len(c) + 1].cumsum(axis=2)
        start += len(c) + 1
        if not len(c):
            continue
        low, high = sums[:, :, :-1], sums[:, :, -1:] - sums[:, :, :-1]
        gain = (low[1] ** 2 / (low[0] + l2) + high[1] ** 2 / (high[0] + l2)).sum(axis=0) - before
        top = float(gain.max())
        slack = 1e-9 * max(abs(top), before, 1e-300)
        if best is None or top > best + slack:
            b = int(np.flatnonzero(gain >= top - slack)[0])
            best, at, below = top, (f, b), low[:, :, b]
    above = whole - below
    return at[0], at[1], max(best or 0.0, 0.0), np.concatenate([below[0], above[0]]), np.concatenate([below[1], above[1]])
