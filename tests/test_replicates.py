"""Correlations on the border of two roundings are the same in Spark and in SQL, whatever order rows come in."""

import duckdb
import pytest

from quillon.plans import bindings as B
from quillon.plans import registered

#: (quantity, discount) of a unit, and their correlation: odd multiples of 1/128, exact to the seventh digit, a five.
BORDER = [
    ([(9, 5), (26, 5), (19, 7), (11, 9), (11, 5)], -0.179688),  # -23/128
    ([(22, 2), (23, 8), (46, 5), (42, 2), (37, 7), (40, 6)], -0.070313),  # -9/128
    ([(38, 9), (40, 7), (25, 10), (36, 5), (10, 6), (23, 2), (12, 3), (39, 8), (3, 7)], 0.320313),  # 41/128
]


@pytest.fixture
def con(spark, tmp_path):
    lines, orders = [], []
    for unit, (rows, _) in enumerate(BORDER):
        for turn in range(4):
            orders.append((8 * unit + turn, 4 * unit + turn))
            lines += [(8 * unit + turn, "N", k, float(q), d / 100, 0.02 if k else 0.05) for k, (q, d) in enumerate(rows[turn:] + rows[:turn])]
    orders.append((99, 99))  # a line without a discount takes no part, and one number does not vary
    lines += [(99, "N", k, float(k), d, 0.01) for k, d in enumerate([0.01, 0.02, None, 0.05])]
    schema = "l_orderkey long, l_returnflag string, l_linenumber int, l_quantity double, l_discount double, l_tax double"
    spark.createDataFrame(lines, schema).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    c = duckdb.connect()
    for t in ("lineitem", "orders"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    return c, str(tmp_path)


def test_correlations_on_a_border_round_away_from_zero(spark, con):
    c, path = con
    got = {r.unit: (r.guide_corr, r.donor_corr, r.single) for r in B.replicates(spark, path).collect()}
    assert [got[u][0] for u in range(12)] == [v for _, v in BORDER for _ in range(4)]
    assert got[99] == (pytest.approx(round(19 / 364**0.5, 6), abs=1e-12), None, False)
    assert got == {r[0]: r[1:] for r in c.execute(f"WITH {B.REPLICATES} SELECT unit, guide_corr, donor_corr, single FROM replicates").fetchall()}


def test_least_of_ranks_equals_its_sql_on_borders(spark, con):
    c, path = con
    got = sorted(tuple(r) for r in registered().QUERIES["window_least_of_ranks"](spark, path).select("unit", "context", "best_rank").collect())
    assert got == sorted(c.execute(registered().SQL["window_least_of_ranks"]).fetchall())


def test_replicates_take_no_row_a_line_number(spark, con):
    _, path = con
    assert "distinct" not in B.replicates(spark, path)._jdf.queryExecution().toString().lower()
