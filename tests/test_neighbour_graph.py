"""The neighbour graph is made once, and its cells give what plain comparison gives."""

import numpy as np

from quillon.operators import profiles as P
from quillon.plans import kernel_queries as K


def test_edges_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    edges = spark.createDataFrame([(k, k + 1, 1.0) for k in range(40)], "src long, dst long, weight double").mapInArrow(counted, "src long, dst long, weight double")
    nodes, src, _, _ = K._graph(edges)
    assert len(nodes) == 41 and len(src) == 40 and made.value == 40


def test_cells_of_wide_blocks_give_the_nearest(spark, monkeypatch):
    x = np.round(np.random.default_rng(6).normal(size=(1_300, 3)), 1)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "unit long, profile array<double>")
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    sim = np.round(u @ u.T, 6)
    np.fill_diagonal(sim, -np.inf)
    want = {a: np.lexsort((np.arange(1_300), -sim[a]))[:8].tolist() for a in range(1_300)}
    for numbers in (1_000_000, 0):
        monkeypatch.setattr(P, "NUMBERS", numbers)
        got: dict[int, dict] = {}
        for r in P.neighbours(df).collect():
            got.setdefault(r.a, {})[r["rank"]] = r.b
        assert all(np.array_equal(sim[a, [got[a][k] for k in range(1, 9)]], sim[a, want[a]]) for a in range(1_300))


def test_fits_get_their_edges_without_the_driver(spark, monkeypatch):
    from quillon.operators import lowrank as L

    rng = np.random.default_rng(3)
    e = sorted({(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 90, (400, 2)) // 30 * 30 + rng.integers(0, 30, (400, 2)) if a != b})
    edges = spark.createDataFrame([(a * 7, b * 7, float(w)) for (a, b), w in zip(e, rng.random(len(e)), strict=True)], "src long, dst long, weight double")
    nodes, src, dst, w = K._graph(edges)

    def never(*_):
        raise AssertionError("edges of the neighbour graph on the driver")

    monkeypatch.setattr(K, "_graph", never)
    monkeypatch.setattr(type(edges), "toPandas", never)
    monkeypatch.setattr(P, "neighbour_edges", lambda _: edges)
    got: dict[tuple, dict] = {}
    for r in K.kernel_communities(spark, "/root/testdata/sf0.001").collect():
        got.setdefault((r.resolution, r.seed), {})[r.node] = r.label
    assert len(got) == 6
    for (resolution, seed), labels in got.items():
        want = L.communities(len(nodes), src, dst, w, resolution, seed)
        assert labels == dict(zip(nodes.tolist(), want.tolist(), strict=True))
