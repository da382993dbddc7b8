"""Orders and quantiles over ranges, the bootstrap by replicate vectors, compactness in cells, tensors whose units are rows."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import bootstrap, imputation, lowrank, order, stats, tensor_fit
from quillon.sources.shared import Scratch

SHAPES = {
    "concentrated": lambda k: 100_000 + (k * 7919 % 2001) / 10,
    "heavy": lambda k: math.exp(k * 7919 % 997 / 40) * (-1 if k % 3 else 1),
    "tied": lambda k: float(k % 3),
    "one": lambda k: 5.0,
}


def column(spark, shape, n=3000):
    return spark.createDataFrame([(k, None if k % 50 == 7 else SHAPES[shape](k), k % 4) for k in range(n)], "id long, v double, key int").repartition(5)


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("parts", [2, 40])
def test_quantiles_and_ranks_of_any_shape(spark, shape, parts):
    df = column(spark, shape)
    v = sorted(r.v for r in df.collect() if r.v is not None)
    at = [0.0, 0.01, 0.3, 0.5, 0.99, 1.0]
    assert np.allclose(order.quantiles(df, "v", at, parts), np.quantile(v, at), rtol=1e-12)
    for descending in (False, True):
        got = {r.id: r.n for r in order.row_numbers(df, "v", ["id"], "n", descending, parts).collect()}
        sign = -1 if descending else 1
        want = sorted(df.collect(), key=lambda r: (r.v is None, sign * (r.v or 0), r.id))
        assert [got[r.id] for r in want] == list(range(1, len(want) + 1))
    ranks = order.min_ranks(df, {"r": "v"}, parts).collect()
    assert all((r.r is None) if r.v is None else r.r == 1 + sum(x > r.v for x in v) for r in ranks[::97])
    for r in stats.ranked(df, ["v"], ["key"]).collect()[::97]:
        own = [x for k in range(3000) if k % 4 == r.key and k % 50 != 7 for x in [SHAPES[shape](k)]]
        assert r.v is None or (r.v_below, r.v_ties, r.v_all) == (sum(x < r.v for x in own), own.count(r.v), len(own))


def test_ranges_are_even_where_values_are_not(spark):
    for shape in ("concentrated", "heavy"):
        df = column(spark, shape, 20_000).where("v IS NOT NULL")
        splits = order.splitters(df, ["v"], 16)["v"]
        sizes = [r["count"] for r in df.groupBy(order.range_of(F.col("v"), splits)).count().collect()]
        assert max(sizes) < 2 * np.median(sizes), shape


def test_ordinals_split_ties_and_empty(spark):
    df = column(spark, "one").where("v IS NOT NULL")
    scratch = Scratch(spark, "test")
    got = order.ordinals(df, [F.col("v").desc(), F.col("id")], "n", lambda d: scratch.save(d, "n")).collect()
    assert [r.n for r in sorted(got, key=lambda r: r.id)] == list(range(1, len(got) + 1))
    assert order.ordinals(df.limit(0), [F.col("id")], "n", lambda d: scratch.save(d, "none")).count() == 0
    assert order.quantiles(df.limit(0), "v", [0.5]) == [None] and order.row_numbers(df.limit(0), "v", ["id"], "n").count() == 0


def plain_bootstrap(rows, draws, top, seed="boot"):
    """Replicate by replicate with lists."""
    n, ranks = len(rows), {}
    for b in range(draws):
        sample = [rows[int.from_bytes(hashlib.md5(f"{seed}#{b}#{i}".encode()).digest()[:6], "big") % n] for i in range(n)]
        noise = np.var([r[4] for r in sample])
        units = {}
        for r in sample:
            if r[3]:
                units.setdefault(r[2], []).append(r[4])
        d = {u: np.mean(v) for u, v in units.items()}
        tau2 = max(np.var(list(d.values())) - np.mean([noise / len(v) for v in units.values()]), 1e-6)
        u = {k: round(d[k] * tau2 / (tau2 + noise / len(units[k])), 9) for k in d}
        for place, k in enumerate(sorted(u, key=lambda k: (-u[k], k)), 1):
            ranks.setdefault(k, []).append(place)
    return {k: (len(r), round(sum(x <= top for x in r) / len(r), 6), float(np.median(r)), float(np.percentile(r, 75) - np.percentile(r, 25))) for k, r in ranks.items()}


@pytest.mark.parametrize("block", [1 << 16, 16])
def test_bootstrap_equals_plain_replicates(spark, monkeypatch, block):
    monkeypatch.setattr(bootstrap, "BLOCK", 32)
    rng = np.random.default_rng(4)
    rows, at = [], 0
    for u in range(60):
        first = at
        for _ in range(rng.integers(1, 4)):
            rows.append((at, first, f"u{u:03}", bool(rng.random() < 0.8), float(np.round(rng.normal(u % 7 / 5), 3))))
            at += 1
    df = spark.createDataFrame(rows, "row_id long, uid long, unit string, gate boolean, work double").repartition(3)
    got = {r.unit: tuple(r)[1:] for r in bootstrap.stability(df, 12, 10, block=block).collect()}
    want = plain_bootstrap(rows, 12, 10)
    assert got.keys() == want.keys()
    for k in want:
        assert np.allclose(got[k], want[k], atol=1e-6), k
    assert bootstrap.stability(df.limit(0), 3).count() == 0


def test_compactness_in_cells(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 4)).round(3)
    x[:30] += 3
    x[5] = x[6]
    profiles = spark.createDataFrame([(k, [float(v) for v in p]) for k, p in enumerate(x)], "unit long, profile array<double>").repartition(4)
    members = spark.createDataFrame([("near", k) for k in range(30)] + [("far", k) for k in range(20, 70)] + [("single", 1)], "set_name string, unit long")
    whole, cells = (sorted(map(tuple, stats.compactness_null(profiles, members, 6, block=b).collect())) for b in (512, 7))
    assert whole == cells and {r[0] for r in cells} == {"near", "far"}
    d = np.linalg.norm(x[:30][:, None] - x[:30], axis=2)[np.triu_indices(30, 1)].mean()
    assert math.isclose(next(r[3] for r in cells if r[:2] == ("near", "euclidean")), d, abs_tol=1e-6)


def test_compactness_of_a_large_set(spark):
    profiles = spark.range(20_000).select(F.col("id").alias("unit"), F.array(*[F.sin(F.col("id") * (k + 1)) for k in range(3)]).alias("profile"))
    got = stats.compactness_null(profiles, profiles.select(F.lit("all").alias("set_name"), "unit"), 1, block=4096).collect()
    assert {r.m for r in got} == {20_000} and all(abs(r.observed - r.null_mean) < 1e-6 for r in got)


def planted(n, width, rank, seed, noise=0.02):
    rng = np.random.default_rng(seed)
    f = [rng.normal(size=(k, rank)) for k in (n, width, 3)]
    t = np.einsum("ir,jr,kr->ijk", *f) + noise * rng.normal(size=(n, width, 3))
    seen = rng.random((n, 3)) > 0.25
    seen[~seen.any(1), 0] = True
    return f, t, seen


def test_tensor_fit_equals_the_dense_one(spark):
    f, t, seen = planted(120, 6, 2, 0)
    rows = spark.createDataFrame([(i, [t[i, :, c].tolist() if seen[i, c] else None for c in range(3)]) for i in range(len(t))], "unit long, t array<array<double>>").repartition(3)
    fit = tensor_fit.best_by_rank(tensor_fit.cp_fits(rows, 6, 3, [(2, 0), (2, 1)]))[2]
    dense, error = lowrank.cp(t, np.broadcast_to(seen[:, None, :], t.shape), 2, 2)
    assert fit.error <= error * 1.01
    assert lowrank.match(f[1], fit.features)[1] > 0.999 and lowrank.match(f[2], fit.contexts)[1] > 0.999
    assert np.allclose(fit.weights, lowrank.gauge(dense)[1], rtol=0.01) and abs(fit.degeneracy() - lowrank.degeneracy(dense)) < 0.01
    a = np.array([r.loadings for r in tensor_fit.unit_factors(rows, fit, 6).orderBy("unit").collect()])
    assert lowrank.match(f[0], a)[1] > 0.999
    assert tensor_fit.cp_fits(rows.limit(0), 6, 3, [(1, 0)])[0].error == 0


def test_tensor_of_many_units(spark, monkeypatch):
    """No tensor on the driver: rows are made in tasks, and only factors come back."""
    monkeypatch.setattr(tensor_fit, "GROUPS", 2)  # tasks' sums are added in stages of their own
    b, c = [0.9, -0.3, 0.3], [0.2, 0.5, 0.84]
    load = F.sin(F.col("id")) * 3
    t = F.array(*[F.array(*[load * x * y for x in b]) if k != 1 else F.when(F.col("id") % 3 > 0, F.array(*[load * x * y for x in b])) for k, y in enumerate(c)])
    rows = Scratch(spark, "test").save(spark.range(0, 200_000, 1, 4).select(F.col("id").alias("unit"), t.alias("t")), "rows")
    fit = tensor_fit.best_by_rank(tensor_fit.cp_fits(rows, 3, 3, [(1, 0)], steps=8))[1]
    assert fit.error < 1e-5 * np.trace(fit.gram) and abs(lowrank.match(np.array([b]).T, fit.features)[1] - 1) < 1e-9


@pytest.mark.parametrize("replay", [2, 16])
def test_completion_equals_the_dense_one(spark, monkeypatch, replay):
    monkeypatch.setattr(imputation, "REPLAY", replay)
    _, t, seen = planted(60, 4, 2, 3)
    rows = spark.createDataFrame([(i, [t[i, :, c].tolist() if seen[i, c] else None for c in range(3)]) for i in range(len(t))], "unit long, t array<array<double>>").repartition(3)
    got = imputation.entry_scores(rows, 4, 3, [1, 3], [5], share=0.15, steps=10)
    x, mask = lowrank._flat(np.where(seen[:, None, :], t, 0)), np.repeat(seen, 4, axis=1)
    test = mask & (imputation.uniform(np.arange(60), 12, 5) < 0.15)
    train = mask & ~test
    y = x - lowrank.train_centre(x, train)
    for rank, seed, r2, rounds in got:
        fit = lowrank.complete(np.where(train, y, 0), train, rank, steps=10)
        assert math.isclose(r2, 1 - ((fit - y)[test] ** 2).sum() / (y[test] ** 2).sum(), rel_tol=1e-6) and rounds <= 10
    assert imputation.entry_scores(rows.limit(0), 4, 3, [1], [5])[0][2] == 1.0


def test_held_out_shares_are_even():
    u = imputation.uniform(np.arange(20_000), 15, 3)
    assert abs((u < 0.1).mean() - 0.1) < 0.005 and abs(np.corrcoef(u[:, 0], u[:, 1])[0, 1]) < 0.03
