"""Numeric kernels on planted data and against plain computations."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions.kernels import hypergeometric_pmf, log_factorial, normal_sf
from quillon.operators import lowrank as L
from quillon.operators import ranking as R


def value(sql):
    return duckdb.execute(f"SELECT {sql}").fetchall()[0][0]


def test_normal_tail():
    for x in np.linspace(-8, 8, 81):
        assert value(normal_sf(repr(float(x)))) == pytest.approx(0.5 * math.erfc(x / math.sqrt(2)), abs=1e-15)
    assert value(normal_sf("NULL")) is None


def test_counting():
    for n in (0, 1, 7, 60, 4000):
        assert value(log_factorial(str(n))) == pytest.approx(math.lgamma(n + 1), abs=1e-9)
    want = math.comb(11, 4) * math.comb(1989, 36) / math.comb(2000, 40)
    assert value(hypergeometric_pmf("4", "2000", "11", "40")) == pytest.approx(want, rel=1e-9)
    assert R.hypergeometric_p(2000, 11, 40, 0) == pytest.approx(1.0)


def test_count_glm_recovers_a_planted_model(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(3000):
        c, g, f = "ANR"[i % 3], bool(rng.integers(2)), bool(rng.integers(2))
        rows.append((i, c, g, f, int(rng.poisson(np.exp(1 + 0.5 * (c == "R") + 0.7 * g - 0.3 * f)))))
    df = spark.createDataFrame(rows, "unit long, context string, gate boolean, penalty_flag boolean, response long")
    fitted, alpha = R.count_glm(df)
    assert alpha < 0.05
    mu = {(r.context, r.gate, r.penalty_flag): r.mu for r in fitted.select("context", "gate", "penalty_flag", "mu").distinct().collect()}
    assert mu["R", True, False] == pytest.approx(math.exp(2.2), rel=0.1)
    assert mu["A", False, True] == pytest.approx(math.exp(0.7), rel=0.1)


def test_shrinkage_bounds_and_gate(spark):
    rng = np.random.default_rng(1)
    rows = [(u, c, u != 3, False, int(rng.poisson(3 + u))) for u in range(12) for c in "ANR"]
    df = spark.createDataFrame(rows, "unit long, context string, gate boolean, penalty_flag boolean, response long")
    post = R.shrink(R.log_deviation(R.cell_mean_baseline(df))).collect()
    assert 3 not in {r.unit for r in post}
    assert all(0 < r.shrinkage < 1 and abs(r.u) <= abs(r.d) for r in post)
    moved = R.shrink(R.log_deviation(R.cell_mean_baseline(df.repartition(7, "response")))).collect()
    assert {r.unit: round(r.u, 9) for r in post} == {r.unit: round(r.u, 9) for r in moved}


def test_principal_axes_from_a_distributed_gram(spark):
    x = np.random.default_rng(2).normal(size=(300, 6)) @ np.diag([5, 3, 1, 1, 1, 1])
    df = spark.createDataFrame([(r.tolist(),) for r in x], "profile array<double>").repartition(5)
    share, axes = L.principal_axes(*L.gram(df, 6), 2)
    s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[1:]
    assert share == pytest.approx(s[:2] ** 2 / (s**2).sum())
    assert np.abs(np.sum(axes * vt[:2], axis=1)) == pytest.approx([1, 1])


def test_varimax_finds_simple_structure():
    rng = np.random.default_rng(3)
    simple = np.zeros((14, 4))
    simple[np.arange(14), np.arange(14) % 4] = rng.uniform(0.3, 2, 14)
    mixed = np.vstack([simple @ np.linalg.qr(rng.normal(size=(4, 4)))[0], np.zeros((1, 4))])
    rotated, r = L.varimax(mixed)
    assert r.T @ r == pytest.approx(np.eye(4), abs=1e-9) and mixed @ r == pytest.approx(rotated)
    assert np.sort(np.abs(rotated), axis=1)[:14, :3] == pytest.approx(np.zeros((14, 3)), abs=1e-6)

    def criterion(x):
        s = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)) ** 2
        return s.var(axis=0).sum()

    noisy = rng.normal(size=(25, 3))
    best = criterion(L.varimax(noisy)[0])
    for _ in range(300):
        assert criterion(noisy @ np.linalg.qr(rng.normal(size=(3, 3)))[0]) <= best + 1e-9


def test_angles():
    a = np.linalg.qr(np.random.default_rng(4).normal(size=(50, 4)))[0]
    assert L.principal_angles(a, a[:, ::-1]) == pytest.approx(np.ones(4))
    assert L.principal_angles(np.eye(20)[:, :2], np.eye(20)[:, 5:7]) == pytest.approx(np.zeros(2))


def test_linkage_separates_blobs():
    x = np.concatenate([np.random.default_rng(k).normal(size=(6, 2)) * 0.1 + 10 * k for k in range(3)])
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    assert L.average_linkage(d, 3).tolist() == [0] * 6 + [1] * 6 + [2] * 6


def test_cp_recovers_a_planted_tensor():
    rng = np.random.default_rng(15)
    planted = [rng.normal(size=(n, 2)) for n in (70, 25, 4)]
    clean = L.rebuild(planted)
    seen = np.broadcast_to(rng.random((70, 1, 4)) < 0.8, clean.shape)
    found, _ = L.cp(clean + rng.normal(scale=0.05, size=clean.shape), seen, 2, 4)
    hidden = ~seen
    assert np.corrcoef(L.rebuild(found)[hidden], clean[hidden])[0, 1] > 0.99  # fibres that no fit saw
    order, cosine = L.match(planted[1], found[1])
    assert cosine > 0.99 and sorted(order) == [0, 1]
    unit, weight = L.gauge(found)
    assert (np.diff(weight) <= 0).all() and L.rebuild([unit[0] * weight, *unit[1:]]) == pytest.approx(L.rebuild(found))
    assert (unit[2][np.abs(unit[2]).argmax(axis=0), [0, 1]] > 0).all()
    twins = [np.repeat(f[:, :1], 2, axis=1) for f in found]
    assert L.degeneracy(twins) == pytest.approx(1) and L.component_congruence(twins) == pytest.approx([1, 1])
    assert L.feature_cosines(found)[0, 1] < 0.9


def test_bootstrap_gate_tells_a_flat_component_from_a_moving_one(spark):
    """T9 on its own: the 2.5 percentile of the replicates' relative ranges over contexts."""
    from quillon.plans import kernel_queries as K

    rows = [(b, 0, [1.0, 1.02 + 0.001 * b, 0.99]) for b in range(40)] + [(b, 1, [0.1, 0.5 + 0.01 * b, -0.2]) for b in range(40)]
    df = spark.createDataFrame(rows, "b int, component int, loadings array<double>")
    got = {r.component: r.lo for r in df.groupBy("component").agg(F.percentile(K.relative_range(), F.lit(0.025)).alias("lo")).collect()}
    want = [np.percentile([(max(x) - min(x)) / max(map(abs, x)) for _, c, x in rows if c == k], 2.5) for k in (0, 1)]
    assert [got[0], got[1]] == pytest.approx(want) and got[0] < K.GATED < got[1]


def test_completion_and_centring():
    rng = np.random.default_rng(26)
    for shape in ((90, 16), (16, 90)):
        x = rng.normal(size=(shape[0], 3)) @ rng.normal(size=(3, shape[1]))
        known = rng.random(shape) < 0.75
        fit = L.complete(x, known, 3, steps=500, tol=1e-9)
        assert fit[known] == pytest.approx(x[known])  # what is known stays
        assert np.corrcoef(fit[~known], x[~known])[0, 1] > 0.99
        assert np.linalg.matrix_rank(L._projected(fit, 3), tol=1e-6) == 3
        assert L.complete(x, np.ones(shape, dtype=bool), 3) == pytest.approx(x)
    held = np.array([[True, False], [True, True], [False, True]])
    assert L.train_centre(np.array([[4.0, -7], [8, 1], [-7, 5]]), held).tolist() == [6, 3]


def test_blocks_strata_and_ranks():
    rng = np.random.default_rng(31)
    n = 160
    strength = rng.uniform(0, 10, n)
    base = rng.normal(size=(n, 2)) * strength[:, None]
    t = np.stack([base @ rng.normal(size=(2, 6)) for _ in range(3)], axis=2) + rng.normal(scale=0.3, size=(n, 6, 3))
    mask, panel = np.ones(t.shape, dtype=bool), strength > 7
    found = L.fibre_strata(t, mask, panel, strength, 2, 0, 2, 1)
    sizes = {name: k for name, k, *_ in found}
    held = L.held_units(mask, 0, 2, 1, ~panel)
    assert not panel[held].any() and len(held) == max(20, (~panel).sum() // 5)
    assert sizes["strong"] + sizes["weak"] == sizes["all"] == len(held)
    assert sizes.get("panel_matched", 0) == (strength[held] >= np.median(strength[panel])).sum()
    assert all(model > 0.5 > persistence for name, _, model, persistence in found if name in ("all", "strong"))
    rank, r2, k = L.block_ranks(t, mask, ~panel, 2, 0.3, range(1, 6), 4)
    assert rank == 2 and r2 > 0.8 and k == int(0.3 * (~panel).sum())


def test_ridge_leaves_one_out(spark):
    """alpha and coefficients against fits without each row in turn."""
    from quillon.operators import learn as M

    rng = np.random.default_rng(41)
    x, w = rng.normal(size=(40, 3)) * [5, 1, 1], rng.normal(size=(3, 2))
    y = x @ w + rng.normal(scale=2.0, size=(40, 2))
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y)], "x array<double>, y array<double>").repartition(3)
    coef, intercept, alpha = M.ridge(df, 3, 2, scaled=1)

    def fit(a, b, penalty, unit):
        m, c = a.mean(axis=0), b.mean(axis=0)
        u = (a - m) / unit
        beta = np.linalg.solve(u.T @ u + penalty * np.eye(3), u.T @ (b - c)) / unit[:, None]
        return beta, c - m @ beta

    unit = np.array([x[:, 0].std(), 1, 1])

    def error(penalty):
        out = 0.0
        for i in range(40):
            beta, c = fit(np.delete(x, i, 0), np.delete(y, i, 0), penalty, unit)
            out += ((y[i] - x[i] @ beta - c) ** 2).sum()
        return out

    assert alpha == min(M.ALPHAS, key=error)
    assert coef == pytest.approx(fit(x, y, alpha, unit)[0]) and intercept == pytest.approx(fit(x, y, alpha, unit)[1])


def test_sparse_design_equals_dense(spark, monkeypatch):
    """Entries, Gram matrix, ridge and predictions of sparse vectors against arrays of the same rows."""
    from quillon.operators import learn as M

    monkeypatch.setattr(M, "PRODUCTS", 40)
    monkeypatch.setattr(M, "BLOCK", 7)
    rng = np.random.default_rng(61)
    pick = lambda names, k: ";".join(rng.choice(names, size=rng.integers(0, k), replace=False))
    rows = [(i, float(rng.normal()) if i % 9 else None, [None, "b", "a"][i % 3], pick(list("pqrstuv"), 5) if i % 7 else None, f" {pick(list('PQR'), 3)} ;PQ; PQ") for i in range(60)]
    df = spark.createDataFrame(rows, "unit int, size double, category string, long string, short string").repartition(3)
    lists = {"long": (2, 5), "short": (2, 3)}
    dense = {r.unit: r.x for r in M.design(df, ["size"], "category", lists).collect()}
    sparse = M.design(df, ["size"], "category", lists, sparse=True)
    assert {r.unit: r.x.toArray().tolist() for r in sparse.collect()} == dense
    split = lambda text: {t.strip() for t in (text or "").split(";")} - {""}
    keep = []
    for place, (_, cap) in ((3, lists["long"]), (4, lists["short"])):
        every = [t for r in rows for t in split(r[place])]
        keep.append(sorted((t for t in set(every) if every.count(t) >= 2), key=lambda t: (-every.count(t), t))[:cap])
    middle = float(np.median([r[1] for r in rows if r[1] is not None]))
    for unit, size, category, long_, short in rows:
        want = [middle if size is None else size] + [float((category or "None") == c) for c in ("None", "a", "b")]
        want += [float(t in split(text)) for names, text in zip(keep, (long_, short)) for t in names]
        assert dense[unit] == pytest.approx(want)
    p = len(dense[0])
    y = spark.createDataFrame([(i, rng.normal(size=2).tolist()) for i in range(60)] + [(99, None)], "unit int, y array<double>")
    both = sparse.join(y, "unit")
    n, sums, g = M.sparse_gram(both, p, 2)
    full = np.array([dense[r.unit] + r.y for r in both.select("unit", "y").orderBy("unit").collect()])
    assert n == 60 and sums == pytest.approx(full.sum(axis=0)) and g == pytest.approx(full.T @ full)
    arrays = both.select("unit", "y").join(M.design(df, ["size"], "category", lists), "unit")
    one, two = M.ridge(both, p, 2, scaled=1), M.ridge(arrays, p, 2, scaled=1)
    assert one[0] == pytest.approx(two[0]) and one[1] == pytest.approx(two[1]) and one[2] == two[2]
    got = {r.unit: r.prediction for r in M.predict(both, *one[:2]).collect()}
    assert all(got[u] == pytest.approx(np.array(x) @ two[0] + two[1]) for u, x in dense.items())
    assert M.sparse_gram(both.limit(0), p, 2)[0] == 0


def test_neighbours_and_consensus_in_blocks(spark, monkeypatch):
    from quillon.operators import graph as G
    from quillon.operators import profiles as P

    monkeypatch.setattr(P, "BLOCK", 13)
    monkeypatch.setattr(P, "ALL_PAIRS_BLOCK", 11)
    rng = np.random.default_rng(51)
    x = rng.integers(-2, 3, size=(60, 4)).astype(float)  # many ties, some zero vectors
    x[7] = 0
    df = spark.createDataFrame([(f"u{i:02d}", r.tolist()) for i, r in enumerate(x)] + [("none", None)], "unit string, profile array<double>")
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    sim = np.round(unit @ unit.T, 6) + 0.0
    want = {(f"u{i:02d}", k + 1): (f"u{j:02d}", sim[i, j]) for i in range(60) for k, j in enumerate(sorted((j for j in range(60) if j != i), key=lambda j: (-sim[i, j], j))[:5])}
    got = {(r.a, r["rank"]): (r.b, r.similarity + 0.0) for r in P.neighbours(df, 5).collect()}
    assert got == want
    pairs = P.similarities(df, df.where("unit < 'u10'")).collect()
    assert len(pairs) == 10 * 59 and all(r.similarity + 0.0 == sim[int(r.a[1:]), int(r.b[1:])] for r in pairs)
    labels = rng.integers(0, 3, size=(4, 30))
    runs = spark.createDataFrame([(r, i, int(labels[r, i])) for r in range(4) for i in range(30) if (r, i) != (0, 3)], "run_id int, node long, label long")
    alike = lambda i, j: sum(labels[r, i] == labels[r, j] and (r, 3) not in ((0, i), (0, j)) for r in range(4))
    for least in (0.0, 0.5):
        want = {(i, j): alike(i, j) / 4 for i in range(30) for j in range(i + 1, 30) if alike(i, j) and alike(i, j) >= 4 * least}
        assert {(r.src, r.dst): r.p for r in G.consensus(runs, least, block=7).collect()} == want
    own = spark.createDataFrame([(i, int(labels[0, i]) if i else 99) for i in range(30)], "node long, label long")
    of = {r.node: r.label for r in own.collect()}
    for r in G.stability(runs, own).collect():
        others = [j for j in range(30) if j != r.node and of[j] == r.label]
        assert r.stability == (round(sum(alike(r.node, j) for j in others) / 4 / len(others), 6) if others else None)


def test_rmt_keeps_planted_modes():
    rng = np.random.default_rng(7)
    n, t = 60, 600
    group = np.repeat(np.arange(3), 20)
    x = rng.normal(size=(t, n)) + rng.normal(size=(t, 3))[:, group] + rng.normal(size=(t, 1))
    cleaned, edge, kept = L.rmt_clean(np.corrcoef(x, rowvar=False), t)
    assert kept == 2 and edge < 2
    assert cleaned[:20, :20].mean() > cleaned[:20, 20:].mean()
    with pytest.raises(ValueError):
        L.rmt_clean(np.eye(5), 4)


def test_communities_of_two_cliques():
    edges = [(i, j) for b in (0, 5) for i in range(b, b + 5) for j in range(i + 1, b + 5)] + [(0, 5)]
    s, d = np.array(edges).T
    for seed in range(4):
        assert L.communities(10, s, d, np.ones(len(s)), seed=seed).tolist() == [0] * 5 + [1] * 5
    # A community is connected: its pieces are told apart.
    assert L._connected(np.array([0, 0, 0, 1]), np.array([0, 2]), np.array([1, 3])).tolist() == [0, 0, 1, 2]


def test_deconvolution_of_nothing():
    direct, condition = L.deconvolve(np.zeros((3, 3)))
    assert direct == pytest.approx(np.zeros((3, 3))) and condition == pytest.approx(1)
