"""Sources, sinks, lookups and the streaming extension on small files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import exprs as X
from quillon.operators import edges as D
from quillon.operators import sets as S
from quillon.operators import stats as T
from quillon.operators.atlas import Atlas
from quillon.sources import lookups, matrices, sinks, tables
from quillon.streaming import statistics as stream


def test_tolerant_tables(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "there.parquet"))
    t = tables.Tables(spark, str(tmp_path), ["there", "gone"])
    assert t.loaded == {"there": True, "gone": False} and t["gone"] is None
    with pytest.raises(Exception):
        tables.Tables(spark, str(tmp_path), ["gone"], required=["gone"])


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("unit,score\na,1.5\nb,x\n")
    assert [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "a.csv"), "unit string, score double").collect()] == [("a", 1.5), ("b", None)]
    (tmp_path / "s.gmt").write_text("one\td\tA\tB\ntwo\td\t\tC\n")
    assert sorted(map(tuple, tables.read_gene_sets(spark, str(tmp_path / "s.gmt")).collect())) == [("one", "A"), ("one", "B"), ("two", "C")]
    (tmp_path / "c.tsv").write_text("ComplexName\tOrganism\tsubunits(Gene name)\nx\tHuman\tA;B C\ny\tMouse\tA;B\nz\tHuman\tA\n")
    bg = spark.createDataFrame([("A",), ("C",)], "member string")
    assert sorted(map(tuple, tables.read_complexes(spark, str(tmp_path / "c.tsv"), bg).collect())) == [("x", "A"), ("x", "C")]
    (tmp_path / "d.json").write_text('{"a": 1,\n "b": [2]}')
    assert tables.read_documents(spark, str(tmp_path / "d.json")).first()["a"] == 1


def test_cached_slice_and_matrix_source(spark, tmp_path):
    np.save(tmp_path / "m.npy", np.arange(12).reshape(4, 3))
    spark.dataSource.register(matrices.MatrixSource)
    m = spark.read.format("matrix_rows").option("path", str(tmp_path / "m.npy")).option("block", 3).load()
    assert m.count() == 4
    for _ in range(2):
        got = tables.cached_slice(m, [2, 0], "m", str(tmp_path / "cache"))
        assert sorted((r.row_id, r.profile) for r in got.collect()) == [(0, [0, 1, 2]), (2, [6, 7, 8])]
    index = spark.createDataFrame([(0, 7, "A"), (3, 7, "N"), (1, 8, "A")], "row_id long, unit long, context string")
    asked = spark.createDataFrame([(7, "N"), (8, "A"), (9, "A"), (7, "N")], "unit long, context string")
    assert sorted((r.unit, r.context, r.profile) for r in matrices.rows_of(m, index, asked).collect()) == [(7, "N", [9, 10, 11]), (8, "A", [3, 4, 5])]
    assert matrices.probe(str(tmp_path / "m.npy"))["verdict"] == "ok"
    assert matrices.probe(str(tmp_path / "no.npy"))["verdict"].startswith("unreachable")
    assert ("profile", "array<float>") in matrices.inspect(m)


def test_lookups(spark, tmp_path):
    source = lookups.PaginatedSource.bound("pages_of_scores", lambda k: [(f"k{k}", 0.5), ("x", k / 10)] if k < 2 else [], pages=3)
    spark.dataSource.register(source)
    rows = spark.read.format("pages_of_scores").load()
    assert {r.key: r.score for r in lookups.best_scores(rows).collect()} == {"k0": 0.5, "k1": 0.5, "x": 0.1}
    keys = spark.createDataFrame([("a",), ("b",)], "key string")
    cache = str(tmp_path / "look")
    got = lookups.lookup(spark, keys, lambda ks: [(k, len(k)) for k in ks], "key string, n long", cache)
    assert got.count() == 2
    assert lookups.lookup(spark, keys, lambda ks: 1 / 0, "key string, n long", cache).count() == 2
    more = spark.createDataFrame([("a new key",)], "key string")
    assert lookups.lookup(spark, more, lambda ks: [(k, 9) for k in ks], "key string, n long", cache).count() == 1
    assert lookups.lookup(spark, keys.unionAll(more), lambda ks: 1 / 0, "key string, n long", cache).count() == 3  # earlier keys are kept
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    many = spark.range(25).select(F.col("id").cast("string").alias("key")).coalesce(1)
    got = lookups.lookup(spark, many, lambda ks: [(k, len(ks)) for k in ks], "key string, n long", str(tmp_path / "many"), batch=10)
    assert max(r.n for r in got.collect()) <= 10 and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    p = lookups.download_once(tmp_path / "f", lambda: b"x")
    assert lookups.download_once(tmp_path / "f", lambda: 1 / 0) == p and p.read_bytes() == b"x"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.123456)], "unit int, v double")
    sinks.write_table(df, str(tmp_path / "t"), ["unit"], 3)
    assert spark.read.parquet(str(tmp_path / "t")).first()["v"] == 0.123
    more = spark.createDataFrame([(1, True)], "unit int, flag boolean")
    twice = sinks.enrich(sinks.enrich(df, more, "unit"), more, "unit")
    assert twice.columns == ["unit", "v", "flag"]
    for bad in (0.2, None):
        with pytest.raises(ValueError):
            sinks.guarded_write(df, str(tmp_path / "g"), bad)
    assert not (tmp_path / "g").exists()
    sinks.guarded_write(df, str(tmp_path / "g"), -0.1)
    assert sinks.summary_document(df, rows=more).startswith('{"rows"')
    assert sinks.markdown(df).splitlines()[0] == "| unit | v |"
    text = sinks.report([("One", df, 5), ("Gone", None, 5), ("Empty", df.limit(0), 5), ("Two", more, 1)])
    assert [x for x in text.splitlines() if x.startswith("##")] == ["## One", "## Two"]
    out = str(tmp_path / "csv")
    sinks.export_csv(spark.createDataFrame([(2, ["x"]), (1, ["a", "b"])], "unit int, l array<string>"), out, ["unit"])
    assert [tuple(r) for r in spark.read.csv(out, header=True).collect()] == [("1", "a;b"), ("2", "x")]


def test_tensor_table_and_extraction(spark, tmp_path):
    cells = spark.createDataFrame([(1, "A", [1.0, 2.0], 3, True), (2, "N", [0.5, 0.0], 1, False)], "unit long, context string, profile array<double>, support long, in_panel boolean")
    sinks.write_tensor(cells, str(tmp_path / "t"))
    back = sinks.read_tensor(spark, str(tmp_path / "t"))
    assert sorted(map(tuple, back.collect())) == [(1, "A", [1.0, 2.0], 3.0, True), (2, "N", [0.5, 0.0], 1.0, False)]
    source, target = str(tmp_path / "t"), str(tmp_path / "few")
    assert tables.extract_columns(spark, source, target, ["unit", "support", "gone"]) == "extracted"
    assert spark.read.parquet(target).columns == ["unit", "support"]
    assert tables.extract_columns(spark, source, target, ["context"]) == "kept"
    assert tables.extract_columns(spark, source, target, ["context"], force=True) == "extracted"
    assert spark.read.parquet(target).columns == ["context"]
    assert tables.extract_columns(spark, source, target, ["gone"], force=True) == "none of the columns is there"
    assert tables.extract_columns(spark, str(tmp_path / "nowhere"), target, ["unit"], force=True).startswith("not extracted")


def test_documents_pass_through_clean():
    assert Atlas.document('{"a": NaN, "b": [1, Infinity, {"c": -Infinity}], "d": "x"}') == {"available": True, "a": None, "b": [1, None, {"c": None}], "d": "x"}
    assert Atlas.document(None) == Atlas.document("{broken") == {"available": False}


def test_profile_fields_without_tables(spark):
    ranking = spark.createDataFrame([(1, 5), (2, 6)], "rank long, unit long")
    row = Atlas(ranking=ranking, classes=spark.createDataFrame([(5, "global")], "unit long, regulator_class string")).fields().orderBy("unit").collect()
    assert [(r.unit, r.regulator_class, r.audit_status, r.in_program_panel) for r in row] == [(5, "global", None, False), (6, None, None, False)]


def test_ranks_and_numbers_without_one_task(spark):
    rng = np.random.default_rng(0)
    values = [float(v) for v in np.concatenate([rng.normal(size=300), rng.normal(size=50) * 1e-300, [0.0, -0.0, 1.0, 2.0, -2.0, 4.0], 2.0 ** np.arange(-40, 40), -(2.0 ** np.arange(-9, 9)), np.nextafter(2.0 ** np.arange(-5, 6), 0), np.repeat(3.5, 40)])]
    df = spark.createDataFrame([(i % 2, v) for i, v in enumerate(values)] + [(0, None)], "k int, v double")
    rows = T.ranked(df, ["v"], ["k"]).collect()
    for r in rows:
        if r.v is None:
            assert r.v_below is None
            continue
        own = [v for i, v in enumerate(values) if i % 2 == r.k]
        assert (r.v_below, r.v_ties, r.v_all) == (sum(v < r.v for v in own), own.count(r.v), len(own))
    numbers = T.numbered(spark.range(200).withColumn("k", F.col("id") % 3), X.seeded("t", F.col("id")), ["id"], ["k"]).collect()
    import hashlib

    for k in range(3):
        ids = sorted((i for i in range(200) if i % 3 == k), key=lambda i: (hashlib.md5(f"t#{i}".encode()).hexdigest(), i))
        assert {r.id: r.pos for r in numbers if r.k == k} == {i: n + 1 for n, i in enumerate(ids)}


def test_expressions_with_nulls_and_ties(spark):
    df = spark.createDataFrame([(1, 2.0, " TRUE"), (2, 2.0, "1.0"), (3, None, None), (4, float("nan"), "no"), (5, 1.0, "False")], "u int, x double, b string")
    rows = df.select("u", X.to_bool(F.col("b")).alias("b"), X.clip(F.col("x"), 1.5).alias("c"), X.average_rank(F.nullif(F.col("x"), F.lit(float("nan")))).alias("r")).orderBy("u").collect()
    assert [r.b for r in rows] == [True, True, None, False, False]
    assert rows[2].c is None and rows[4].c == 1.5
    assert [r.r for r in rows] == [2.5, 2.5, None, None, 1.0]


def test_degenerate_statistics(spark):
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert T.spearman(flat, "x", "y").first()["rho"] is None
    none = spark.createDataFrame([], "set_name string, member long")
    assert S.jaccard(none).count() == 0
    sets = spark.createDataFrame([("a", 1), ("b", 2)], "set_name string, member long")
    assert S.jaccard(sets).first()["jaccard"] == 0.0
    e = T.enrichment(spark.createDataFrame([], "member long"), sets, spark.createDataFrame([(1,)], "member long")).collect()
    assert all(r.p == 1 and r.fold == 0 for r in e)
    p = spark.createDataFrame([("a", 0.01), ("b", 0.02), ("c", 0.03), ("d", 0.9)], "set_name string, p double")
    assert [round(r.fdr, 4) for r in T.benjamini_hochberg(p).orderBy("p").collect()] == [0.04, 0.04, 0.04, 0.9]
    bad = spark.createDataFrame([(1, 1, 1.0, 0.0), (1, 2, None, 1.0), (1, 3, 2.0, float("nan")), (1, 4, 2.0, 0.1)], "unit int, feature int, y double, se double")
    assert [r.feature for r in D.edge_posterior(bad, keep=None).collect()] == [4]


def test_atlas_arguments(spark):
    a = Atlas(ranking=None)
    assert a.health()["status"] == "degraded"
    with pytest.raises(LookupError):
        a.units()
    with pytest.raises(ValueError):
        a.regulators(regulator_class="other")


def test_stream_equals_batch(spark, tmp_path):
    path = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(path)
    want = {(r.unit, r.context): (r.n, round(r.total, 6)) for r in stream.merged(stream.windowed(batch.withColumn("ts", F.col("ts").cast("timestamp"))), "unit", "context").collect()}
    batch.write.parquet(str(tmp_path / "in"))
    live = stream.windowed(stream.events_stream(spark, str(tmp_path / "in"), batch.schema), late="3650 days")
    q = live.writeStream.outputMode("complete").format("memory").queryName("stats").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.unit, r.context): (r.n, round(r.total, 6)) for r in stream.merged(spark.table("stats"), "unit", "context").collect()}
    assert got == want
