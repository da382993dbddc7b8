"""Boosted symmetric trees against loops over rows, early stops and planted signals."""

import itertools

import numpy as np
import pytest

from quillon.operators import boosting as B


def table(spark, x, y, fold, parts=3):
    rows = [(a.tolist(), b.tolist(), int(f), i) for i, (a, b, f) in enumerate(zip(x, y, fold))]
    return spark.createDataFrame(rows, "x array<double>, y array<double>, fold int, unit int").repartition(parts)


def planted(n=240, seed=3):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 4, n), rng.random(n) < 0.05, np.zeros(n)]).astype(float)
    y = np.column_stack([np.where(x[:, 0] > 0.2, 3.0, -1.0) + x[:, 1], 4 * x[:, 2] + rng.normal(scale=0.1, size=n), rng.normal(size=n)])
    return x, y, np.arange(n) % 5


def plain(x, y, cuts, rounds, depth, rate, l2):
    """(features, cuts, leaves) of every round by loops over rows, features, cuts and nodes."""
    left, out = y - y.mean(), []
    for _ in range(rounds):
        path, node = [], np.zeros(len(x), dtype=int)
        for d in range(depth):
            gains = {}
            for f, c in itertools.chain.from_iterable(((f, c) for c in own) for f, own in enumerate(cuts)):
                total = 0.0
                for v in range(1 << d):
                    for side in (x[:, f] <= c, x[:, f] > c):
                        own = left[(node == v) & side]
                        total += own.sum() ** 2 / (len(own) + l2)
                gains[f, c] = total
            top = max(gains.values())
            f, c = next(k for k, g in gains.items() if g >= top - 1e-9 * max(top, 1))
            path.append((f, c))
            node |= (x[:, f] > c).astype(int) << d
        leaves = np.array([rate * left[node == v].sum() / ((node == v).sum() + l2) for v in range(1 << depth)])
        left = left - leaves[node]
        out.append((path, leaves))
    return out


def test_trees_equal_plain_growth(spark, monkeypatch):
    monkeypatch.setattr(B, "BINS", 6)
    monkeypatch.setattr(B, "FRESH", 2)  # predictions are written between the rounds
    x, y, fold = planted()
    forest = B.boost(spark, table(spark, x, y, fold), 3, rounds=5, depth=2, rate=0.3, patience=None)
    train = fold > 1
    assert [len(c) for c in forest.cuts][2:] == [1, 0]  # a rare value has its cut, a constant none
    for k in range(3):
        want = plain(x[train], y[train, k], forest.cuts, 5, 2, 0.3, 3.0)
        assert len(forest.trees[k]) == 5
        for tree, (path, leaves) in zip(forest.trees[k], want):
            assert [(f, forest.cuts[f][b]) for f, b in zip(tree.features, tree.bins)] == path
            assert tree.leaves == pytest.approx(leaves)
    got = {r.unit: r.prediction for r in forest.predict(table(spark, x, y, fold)).collect()}
    for k in range(3):
        value = np.full(len(x), y[train, k].mean())
        for path, leaves in plain(x[train], y[train, k], forest.cuts, 5, 2, 0.3, 3.0):
            value += leaves[sum((x[:, f] > c).astype(int) << d for d, (f, c) in enumerate(path))]
        assert [got[i][k] for i in range(len(x))] == pytest.approx(value)


def test_outputs_stop_each_for_itself(spark):
    x, y, fold = planted(600, 5)
    df = table(spark, x, y, fold)
    forest = B.boost(spark, df, 3, rounds=40, depth=3, rate=0.3, patience=4)
    rows = forest.predict(df).collect()
    held = [r for r in rows if r.fold == 0]
    r2 = [1 - sum((r.y[k] - r.prediction[k]) ** 2 for r in held) / sum((r.y[k] - forest.base[k]) ** 2 for r in held) for k in range(3)]
    assert r2[0] > 0.9 and r2[1] > 0.8 and r2[2] < 0.1
    assert len(forest.trees[2]) < len(forest.trees[0]) <= 40  # noise stops first
    share = forest.importances()
    assert share[0, :2].sum() > 0.9 and share[1, 2] > 0.9
    # The kept rounds are those of the least error of the checking rows.
    checks = [r for r in rows if r.fold == 1]
    error = lambda trees: sum((r.y[2] - forest.base[2] - B.added([trees], B.into_bins(np.array([r.x]), forest.cuts))[0, 0]) ** 2 for r in checks)
    full = B.boost(spark, df, 3, rounds=len(forest.trees[2]) + 4, depth=3, rate=0.3, patience=None).trees[2]
    errors = [error(full[:t]) for t in range(len(full) + 1)]
    assert len(forest.trees[2]) == int(np.argmin(errors))


def test_unknown_values(spark):
    rows = [([1.0, None], [1.0], 2, 0), ([2.0, 5.0], [2.0], 2, 1), (None, [1.0], 2, 2), ([1.0, 1.0], None, 2, 3), ([1.0, 1.0], [float("nan")], 2, 4), ([float("nan"), 1.0], [None], 0, 5), ([3.0, 1.0], [9.0], 0, 6)]
    df = spark.createDataFrame(rows, "x array<double>, y array<double>, fold int, unit int")
    forest = B.boost(spark, df, 1, rounds=2, depth=1)
    assert forest.base.tolist() == [1.5] and len(forest.trees[0]) == 2
    got = {r.unit: r.prediction for r in forest.predict(df.withColumn("prediction", df.unit)).collect()}
    assert got[2] is None and all(len(v) == 1 for k, v in got.items() if k != 2) and got[6] == got[1] and got[5] == got[0]
    for nothing in (df.limit(0), df.where("fold = 0")):
        empty = B.boost(spark, nothing, 1)
        assert empty.trees == [[]] and not empty.importances().size
