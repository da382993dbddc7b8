"""Compactness: both ways of summing draws against plain sums, and the whole number of draws."""

import hashlib

import numpy as np
import pytest

from quillon.operators import compact as C
from quillon.operators import stats as T
from quillon.plans import registered

SF = "/root/testdata/sf0.001"


def plain(x, sets, draws):
    """(set, metric) to the observed mean and those of the draws."""
    white = (x - x.mean(axis=0)) / np.where(x.std(axis=0) == 0, 1, x.std(axis=0))
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def means(at):
        i, j = np.triu_indices(len(at), 1)
        a, b = np.array(at)[i], np.array(at)[j]
        return (1 - (unit[a] * unit[b]).sum(axis=1)).mean(), np.linalg.norm(x[a] - x[b], axis=1).mean(), np.linalg.norm(white[a] - white[b], axis=1).mean()

    orders = [sorted(range(len(x)), key=lambda u: hashlib.md5(f"compact#{b}#{u}".encode()).hexdigest()) for b in range(draws)]  # noqa: B023
    return {(name, metric): (means(at)[k], [means(o[: len(at)])[k] for o in orders]) for name, at in sets.items() for k, metric in enumerate(C.METRICS)}


@pytest.mark.parametrize("often", [0, 1e9])
@pytest.mark.parametrize("sizes", [{}, {"SLAB": 40, "NEEDS": 2}])
def test_draws_equal_plain_sums(spark, monkeypatch, often, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(C, name, value)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 5)).round(3)
    x[7], x[9], x[:, 4] = x[8], 0, 2.5  # equal units, one without length but for a constant column
    x[9] = 0
    sets = {"a": list(range(40)), "b": list(range(30, 55)), "c": [3, 9], "d": list(range(120)), "e": list(range(60, 99))}
    profiles = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "unit long, profile array<double>").repartition(3)
    members = spark.createDataFrame([(n, u) for n, at in sets.items() for u in at] + [("one", 5), ("gone", 999)], "set_name string, unit long")
    draws = 9
    want = plain(x, sets, draws)
    got = {(r.set_name, r.metric): r for r in T.compactness_null(profiles, members, draws, often=often).collect()}
    assert got.keys() == want.keys()
    for key, (seen, null) in want.items():
        assert got[key].m == len(sets[key[0]])
        assert got[key].observed == pytest.approx(seen, abs=2e-6) and got[key].null_mean == pytest.approx(np.mean(null), abs=2e-6)
        if key[0] != "d":
            assert got[key].p == pytest.approx((sum(v <= seen for v in null) + 1) / (draws + 1), abs=1e-6)


def test_blocks_of_several_tiles(spark):
    n, draws = 15_000, 2
    x = np.sin(np.arange(n)[:, None] * [1.0, 2.0, 3.0])
    profiles = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "unit long, profile array<double>")
    at = list(range(0, n, 11))
    members = spark.createDataFrame([("s", u) for u in at], "set_name string, unit long")
    want = plain(x, {"s": at}, draws)
    for r in T.compactness_null(profiles, members, draws, often=0).collect():
        seen, null = want[r.set_name, r.metric]
        assert (r.observed, r.null_mean) == pytest.approx((seen, np.mean(null)), abs=2e-6)


def test_full_compactness_has_all_draws(spark):
    p = [r.p for r in registered().QUERIES["stat_compactness_full"](spark, SF).collect()]
    assert p and all(abs(v * 5001 - round(v * 5001)) < 0.01 for v in p) and any(abs(v * 1001 - round(v * 1001)) > 0.01 for v in p)


def test_few_draws_shuffle_what_they_hold(spark):
    n = 4000
    rows = spark.range(n).selectExpr("id AS unit", "transform(sequence(1, 32), k -> sin(id * k)) AS profile")
    members = rows.selectExpr("CAST(unit % 20 AS STRING) AS set_name", "unit")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    assert T.compactness_null(rows, members, 5).count() == 60
    assert written() - before < 5_000_000  # vectors of all units are 1 MB; a set's members and each draw's tenth of them go once
