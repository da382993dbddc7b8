"""Seeded draws: exact cuts and sums, and no row a unit and draw in a shuffle."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quillon.operators import draws as W
from quillon.operators import stats as T


def shuffled(spark) -> int:
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


def test_hashes_are_md5():
    texts = ["0", "17", "x" * 60, "\u00e9" * 31, "", "y" * 130, *map(str, range(95, 130))]
    for prefix in ("load#1#", "load#1234#", "s" * 63 + "#"):
        high, low = W.Hashes(texts).of(prefix)
        assert [f"{a:016x}{b:016x}" for a, b in zip(high.tolist(), low.tolist(), strict=True)] == [hashlib.md5((prefix + t).encode()).hexdigest() for t in texts]


@pytest.mark.parametrize("deviations", [8.0, 0.01])
def test_sums_of_first_units(spark, monkeypatch, deviations):
    monkeypatch.setattr(W.cuts, "__defaults__", (deviations,))
    monkeypatch.setattr(W, "SLAB", 900)
    n, draws = 300, 7
    units = spark.range(n).select(F.col("id").alias("unit"), F.array((F.col("id") % 3).cast("int")).alias("groups"), F.array("id", F.col("id") * 2).cast("array<double>").alias("v"))
    takes = [[(0, 5), (1, 100)], [(2, 1)], [(0, 90), (2, 99)]]
    got = {(r.b, r.s): r.total for r in W.prefix_sums(units, {0: 100, 1: 100, 2: 100}, takes, 2, draws, "t").collect()}
    for b in range(draws):
        order = sorted(range(n), key=lambda u: hashlib.md5(f"t#{b}#{u}".encode()).hexdigest())  # noqa: B023
        for s, take in enumerate(takes):
            want = sum(sum([u for u in order if u % 3 == g][:need]) for g, need in take)
            assert got[b, s] == [want, 2 * want]
    assert len(got) == draws * len(takes)


def test_draws_are_not_shuffled_as_rows(spark):
    n, draws = 3000, 500  # 1,500,000 pairs of a unit and a draw
    scores = spark.range(n).select(F.col("id").alias("unit"), (F.col("id") % 97).cast("double").alias("score"), (F.col("id") % 4).alias("stratum"))
    members = scores.select(F.concat(F.lit("s"), (F.col("unit") % 2).cast("string")).alias("set_name"), "unit")
    before = shuffled(spark)
    rows = T.stratified_load(scores, members, draws).collect()
    assert len(rows) == 2 and all(0 < r.p <= 1 for r in rows)
    vectors = scores.select("unit", F.array("score", F.lit(1.0)).alias("profile"))
    assert T.cohesion_null(vectors, members, draws).count() == 2
    assert shuffled(spark) - before < 12_000_000


def test_compactness_does_not_shuffle_vectors_a_draw(spark):
    n = 600
    units = spark.range(n).select(F.col("id").alias("unit"), F.array(*[F.sin(F.col("id") * (k + 1)) for k in range(16)]).alias("profile"))
    members = units.select(F.lit("s").alias("set_name"), "unit").where("unit < 300")
    before = shuffled(spark)
    assert T.compactness_null(units, members, 100).count() == 3
    assert shuffled(spark) - before < 3_000_000  # 100 draws of 300 members are 8 MB of vectors
