"""Kernel queries use all their rows, pairs and units."""

import numpy as np
import pytest

from quillon.operators import lowrank as L
from quillon.plans import registered

SF = "/root/testdata/sf0.001"
QUERIES = dict(registered().QUERIES)


def test_scattered_positions_are_a_permutation():
    for n in (1, 2, 7, 500, 2049):
        for key in (0, 5):
            assert sorted(L.scattered(np.arange(n), n, key)) == list(range(n))
    assert (L.scattered(np.arange(500), 500, 0) != L.scattered(np.arange(500), 500, 1)).any()


def test_noise_edge_of_all_rows(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2500, 10)) + 2 * rng.normal(size=(2500, 1))
    df = spark.createDataFrame([(r.tolist(),) for r in x], "profile array<double>").repartition(3).cache()
    got = [r.edge for r in L.null_edges(df, 10, draws=40, block=600).collect()]
    full = [np.linalg.eigvalsh(np.corrcoef([rng.permutation(c) for c in x.T]))[-1] for _ in range(40)]
    assert len(got) == 40
    assert np.mean(got) == pytest.approx(np.mean(full), abs=0.02)


def test_both_edges_have_the_same_rows(spark):
    row = QUERIES["kernel_rmt"](spark, SF).first()
    assert row.empirical_edge == pytest.approx(row.theory_edge, abs=0.1)


def test_tensor_has_the_whole_panel(spark):
    from quillon.operators import profiles as P
    from quillon.plans.bindings import contrast
    from quillon.plans.kernel_queries import dense

    sf = "/root/testdata/sf0.1"
    df = contrast(spark, sf).where("gate").toPandas()
    by = df.groupby("unit").agg(n=("context", "nunique"), s=("support", "mean"))
    by = by[by["n"] == 3]
    want = int((by["s"] >= by["s"].median()).sum())
    t, mask = dense(spark, sf)
    assert len(t) == want > 120 and mask.all()
    assert P.expanded_panel(contrast(spark, sf)).count() == 50


def test_angles_of_all_pairs_of_programs(spark):
    from quillon.plans.bindings import profiles

    rows = QUERIES["kernel_principal_angles"](spark, SF).collect()
    df = profiles(spark, SF).toPandas()
    names = sorted(df["program"].unique())
    assert {(r.a, r.b) for r in rows} == {(a, b) for a in names for b in names if a < b} and len(names) > 4
    x = {n: np.stack(df[df["program"] == n]["profile"]) for n in (names[0], names[-1])}
    a, b = (np.linalg.svd(v - v.mean(axis=0), full_matrices=False)[2][:3].T for v in x.values())
    got = [r.cos2 for r in sorted(rows, key=lambda r: r.k) if (r.a, r.b) == (names[0], names[-1])]
    assert got == pytest.approx(L.principal_angles(a, b).tolist(), abs=1e-6)
    assert 0 < rows[0].null_mean < rows[0].null_p95 < 1
    assert L.random_subspace_null(64, 3)[0] == pytest.approx(3 / 64, abs=0.005)


def test_full_draw_counts(spark):
    p = [r.p for r in QUERIES["stat_stratified_load_full"](spark, SF).collect() if r.p is not None]
    assert p and all(abs(v * 10000 - round(v * 10000)) < 1e-6 for v in p) and any(abs(v * 20 - round(v * 20)) > 1e-6 for v in p)
    p = QUERIES["concord_permutation_full"](spark, SF).first().p
    assert p * 301 == pytest.approx(round(p * 301), abs=1e-3)
    assert QUERIES["graph_modularity_null_full"](spark, SF).count() == 100
    appearances = [r.n_appearances for r in QUERIES["rank_bootstrap_full"](spark, SF).collect()]
    assert 20 < max(appearances) <= 200


def test_full_draws_tell_a_strong_set(spark):
    from quillon.operators import stats as T

    rng = np.random.default_rng(9)
    x = rng.normal(size=(60, 8))
    x[:6, 0] += 6
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "unit long, profile array<double>")
    members = spark.createDataFrame([("strong", i) for i in range(6)], "set_name string, unit long")
    assert T.cohesion_null(df, members, 300).first().p == pytest.approx(1 / 301, abs=1e-6)


def test_stability_chooses_a_rank(spark):
    rows = QUERIES["kernel_cp_stability"](spark, SF).collect()
    stable = [r.rank for r in rows if r.stable]
    assert [r.rank for r in rows if r.chosen] == [max(stable) if stable else max(rows, key=lambda r: r.stability).rank]


def test_linkage_gives_each_unit_of_the_panel_a_cluster(spark):
    panel = {r.unit for r in QUERIES["profile_balanced_panel"](spark, SF).collect()}
    rows = QUERIES["kernel_linkage"](spark, SF).collect()
    assert sorted(r.unit for r in rows) == sorted(panel)
    assert len({r.cluster for r in rows}) == min(12, max(2, len(panel) // 15))
