"""All pairs of a panel: short profiles go to few, wide blocks."""

import numpy as np

from quillon.operators import profiles as P


def test_short_profiles_are_sent_to_few_blocks(spark):
    n, width = 2_000, 16
    x = np.random.default_rng(1).normal(size=(n, width))
    units = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "unit long, profile array<double>").cache()
    assert units.count() == n
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    pairs = P._all_pairs(units, None, 50, True)  # forty blocks of fifty
    got = pairs.selectExpr("count(*) AS n", "count(DISTINCT a, b) AS d", "sum(a) AS a", "sum(b) AS b", "bool_and(a < b) AS once").first()
    assert got.n == got.d == n * (n - 1) // 2 and got.once
    one = pairs.where("a = 3 AND b = 1999").first().similarity
    assert one == round(float(x[3] @ x[1999] / np.linalg.norm(x[3]) / np.linalg.norm(x[1999])), 6)
    before = written()
    assert P._all_pairs(units, None, 50, True).where("similarity > 2").isEmpty()
    assert written() - before < 12 * n * width * 8
