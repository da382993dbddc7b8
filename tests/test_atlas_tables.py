"""Endpoints make the tables that they join, and no others."""

from pyspark.sql import functions as F

from quillon.operators.atlas import Atlas
from quillon.plans import atlas_queries as A
from quillon.plans import bindings as B
from quillon.plans import registered

SF = "/root/testdata/sf0.001"


def test_an_endpoint_makes_only_its_tables(spark, monkeypatch):
    def never(*_args, **_kw):
        raise AssertionError("made without being asked for")

    for name in ("posterior", "effects", "knn", "enriched"):
        monkeypatch.setattr(A, name, never)
    for name in ("rank_bootstrap", "rank_review", "profile_loo_centroid", "profile_coherence"):
        monkeypatch.setitem(A.QUERIES, name, never)
    assert registered().QUERIES["atlas_class_targets"](spark, SF).count() > 0
    assert registered().QUERIES["atlas_coverage"](spark, SF).count() == 1


def test_a_table_is_made_once(spark):
    made = []
    a = Atlas(ranking=lambda: made.append(1) or spark.range(3).withColumnRenamed("id", "unit"), classes=None)
    assert not made and a.tables["ranking"] is not None
    assert a["ranking"].count() == a["ranking"].count() == 3 and made == [1]
    assert a.get("classes") is None


def test_a_program_without_markers_has_none(spark, monkeypatch):
    a = Atlas(programs=spark.createDataFrame([(1, "x"), (2, "y")], "unit long, program string"), markers=spark.createDataFrame([("x", "up", 1, 7, 0.5)], "program string, direction string, rank long, feature int, mean double"))
    monkeypatch.setattr(A, "atlas", lambda *_: a)
    rows = {r.program: r.markers for r in registered().QUERIES["atlas_program_summary"](spark, SF).collect()}
    assert rows == {"x": "up1=7", "y": None}


def test_edges_read_their_effects_from_one_written_table(spark):
    a = A.atlas(spark, SF)
    assert {f.rsplit("/", 2)[1] for f in a["edges"].inputFiles()} == {"valid"}
    assert {f.rsplit("/", 2)[1] for f in a["edge_summary"].inputFiles()} == {"valid"}


def test_contrasts_are_read_from_one_written_table(spark):
    a = A.atlas(spark, SF)
    read = {n: {f.rsplit("/", 2)[1] for f in a[n].inputFiles()} for n in ("contrast", "breadth", "classes", "peaks")}
    assert set(map(frozenset, read.values())) == {frozenset({"contrast"})}
    m = A.atlas(spark, SF, measured=True)
    assert m["contrast"].inputFiles() == m["replicates"].inputFiles() and "evidence" in m["contrast"].inputFiles()[0]


def test_evidence_of_one_pass_equals_its_two_tables(spark):
    for got, want in zip(B.written_evidence(spark, SF), (B.contrast(spark, SF), B.replicates(spark, SF)), strict=True):
        key = ["unit", "context"]
        assert got.columns == want.columns and got.count() == want.count() > 0
        assert got.exceptAll(want).isEmpty() and got.dropDuplicates(key).count() == got.count()


def test_a_class_has_all_its_units(spark):
    """More than the 2,000 that a lookup may ask for."""
    n = 2500
    ranking = spark.range(n).select(F.col("id").alias("unit"), (F.col("id") + 1).alias("rank"), F.lit(0.5).alias("eb_mean"))
    classes = ranking.select("unit", F.lit("global").alias("regulator_class"))
    a = Atlas(ranking=ranking, classes=classes, breadth=ranking.select("unit", F.lit("A").alias("peak"), F.lit(1).alias("n_contexts")))
    assert [r.core_rank for r in a.class_members("global").collect()] == list(range(1, n + 1))
    assert a.class_members("context_specific").isEmpty()
    assert a.class_members("global", 7).count() == 7 and a.regulators().count() == 50
