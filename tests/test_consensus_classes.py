"""Consensus communities without the pairs of nodes that are alike in every run, and without edges on the driver."""

import numpy as np

from quillon.operators import graph as G
from quillon.operators import lowrank as L
from quillon.plans import kernel_queries as K


def rows(n=240, groups=6):
    rng = np.random.default_rng(5)
    base = np.arange(n) % groups
    labels = [np.where(rng.random(n) < 0.03 * r, rng.integers(0, groups, n), base) for r in range(6)]
    return [(r, k, int(labels[r][k])) for r in range(6) for k in range(n)]


def test_classes_stand_for_their_nodes(spark):
    runs = spark.createDataFrame(rows(), "run_id int, node long, label long").cache()
    edges, classes = K.alike(runs)
    full = G.consensus(runs, least=K.TAU).toPandas()
    e = edges.toPandas()
    assert len(e) < len(full) / 3
    assert abs(e["weight"].sum() - full["p"].sum()) < 1e-6
    head = {r.node: r["head"] for r in classes.collect()}
    assert len(head) == 240 and set(e["src"]) | set(e["dst"]) <= set(head.values())
    label = {r["head"]: r.label for r in K.fitted(edges).collect()}
    got = {n: label[h] for n, h in head.items() if h in label}
    nodes = np.unique(full[["src", "dst"]].to_numpy())
    want = L.communities(len(nodes), np.searchsorted(nodes, full["src"]), np.searchsorted(nodes, full["dst"]), full["p"].to_numpy())
    assert got == dict(zip(nodes.tolist(), want.tolist(), strict=True))


def test_no_edge_reaches_the_driver(spark, monkeypatch):
    def never(*_):
        raise AssertionError("edges of the consensus graph on the driver")

    edges, _ = K.alike(spark.createDataFrame(rows(60, 3), "run_id int, node long, label long"))
    monkeypatch.setattr(K, "_graph", never)
    near = {r["head"]: r.label for r in K.fitted(edges).collect()}
    monkeypatch.setattr(K, "TASK_EDGES", 0)
    far = {r["head"]: r.label for r in K.fitted(edges).collect()}
    pairs = lambda found: {(a, b) for a in found for b in found if found[a] == found[b]}
    assert pairs(near) == pairs(far)


def test_cells_of_a_small_table_are_tasks_of_their_own(spark):
    pairs = G.consensus(spark.createDataFrame(rows(), "run_id int, node long, label long"), block=20)
    assert pairs.count() == G.consensus(spark.createDataFrame(rows(), "run_id int, node long, label long")).count() > 0
    assert pairs.rdd.getNumPartitions() == 12 * 13 // 2  # few bytes, many pairs: not put together by size
    assert "InArrow" not in pairs._jdf.queryExecution().toString()
    assert G.consensus(spark.createDataFrame([], "run_id int, node long, label long")).count() == 0
