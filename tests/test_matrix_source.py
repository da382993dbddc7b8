"""The matrix source: filters, columns, chunks and sparse layers against the matrices themselves."""

import importlib.machinery
import sys
import types

import numpy as np
import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThanOrEqual, StringContains

from quillon.sources import matrices


@pytest.fixture
def matrix(tmp_path):
    rng = np.random.default_rng(1)
    m = np.where(rng.random((100, 6)) < 0.3, rng.normal(size=(100, 6)), 0).astype(np.float32)
    m[40] = 0  # a row without entries
    np.save(tmp_path / "m.npy", m)
    row, at = np.nonzero(m)
    folder = tmp_path / "sparse"
    folder.mkdir()
    for name, part in (("data", m[row, at]), ("indices", at), ("indptr", np.searchsorted(row, np.arange(101))), ("shape", np.array(m.shape))):
        np.save(folder / f"{name}.npy", part)
    return m, str(tmp_path / "m.npy"), str(folder)


def rows(reader):
    return [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]


def test_filters_reach_the_blocks(matrix):
    m, dense, folder = matrix
    for path in (dense, folder):
        reader = matrices.FilteredReader(path, None, 10)
        other = StringContains(("profile",), "x")
        assert list(reader.pushFilters([In(("row_id",), (3, 7, 41, 400, None)), IsNotNull(("row_id",)), other])) == [other]
        assert [(p.start, p.stop) for p in reader.partitions()] == [(0, 10), (40, 50)]
        got = rows(reader)
        assert [r["row_id"] for r in got] == [3, 7, 41] and all(r["profile"] == m[r["row_id"]].tolist() for r in got)
        reader = matrices.FilteredReader(path, None, 10)
        assert not list(reader.pushFilters([GreaterThan(("row_id",), 14), LessThanOrEqual(("row_id",), 31)]))
        assert [(p.start, p.stop) for p in reader.partitions()] == [(15, 20), (20, 30), (30, 32)]
        assert [r["row_id"] for r in rows(reader)] == list(range(15, 32))
        for filters in ([EqualTo(("row_id",), 5), EqualTo(("row_id",), 6)], [GreaterThan(("row_id",), 200)], [EqualTo(("row_id",), -1)]):
            reader = matrices.FilteredReader(path, None, 10)
            assert not list(reader.pushFilters(filters)) and not rows(reader)


def test_few_rows_read_few_values(matrix, monkeypatch):
    m, _, _ = matrix
    seen = []

    class Counted:
        shape, chunks = m.shape, (8, 6)

        def __getitem__(self, part):
            seen.append(part)
            return m[part]

    monkeypatch.setattr(matrices, "open_matrix", lambda path, layer: Counted())
    reader = matrices.FilteredReader("", None, 20)
    assert not list(reader.pushFilters([In(("row_id",), (1, 2, 30, 99))]))
    parts = reader.partitions()
    assert [(p.start, p.stop) for p in parts] == [(0, 24), (24, 48), (96, 100)]  # whole chunks of 8
    assert [r["row_id"] for r in rows(reader)] == [1, 2, 30, 99]
    assert seen == [slice(1, 3), slice(30, 31), slice(99, 100)]


def test_columns_and_sparse_form(matrix):
    m, dense, folder = matrix
    for path in (dense, folder):
        got = rows(matrices.MatrixReader(path, None, 30, [4, 0]))
        assert [r["profile"] for r in got] == m[:, [4, 0]].tolist()
        for columns in (None, [5, 2]):
            want = m if columns is None else m[:, columns]
            got = rows(matrices.MatrixReader(path, None, 30, columns, sparse=True))
            assert len(got) == 100 and got[40]["indices"] == []
            for r in got:
                full = np.zeros(want.shape[1], np.float32)
                full[r["indices"]] = r["values"]
                assert full.tolist() == want[r["row_id"]].tolist() and 0 not in r["values"]


def test_through_spark(spark, matrix):
    m, dense, folder = matrix
    spark.dataSource.register(matrices.MatrixSource)
    key = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(key, "false")
    wanted = [3, 4, 5, 6, 7, 60, 61, 62, 63, 64]
    try:
        for pushed in ("true", "false"):
            spark.conf.set(key, pushed)
            for path in (dense, folder):
                df = spark.read.format("matrix_rows").option("path", path).option("block", 10).option("pushdown", pushed).load().where(f"row_id IN ({','.join(map(str, wanted))})")
                assert {r.row_id: r.profile for r in df.collect()} == {i: m[i].tolist() for i in wanted}
                assert df.rdd.getNumPartitions() == (2 if pushed == "true" else 10)
                assert df.where("row_id < 0").count() == 0
        sparse = spark.read.format("matrix_rows").option("path", folder).option("form", "sparse").load()
        assert {r.row_id: dict(zip(r.indices, r["values"])) for r in sparse.collect()} == {i: {int(j): m[i, j].item() for j in np.flatnonzero(m[i])} for i in range(100)}
    finally:
        spark.conf.set(key, before)


def test_layers_of_a_file(matrix, monkeypatch, tmp_path):
    """Layers as h5py hands them out, by a stand-in that is sliced in the same way: h5py itself is not installed."""
    m, _, folder = matrix
    part = {n: np.load(f"{folder}/{n}.npy") for n in ("data", "indices", "indptr")}

    class Dataset:
        def __init__(self, values, chunks):
            self.values, self.shape, self.chunks, self.attrs = values, values.shape, chunks, {}

        def __getitem__(self, rows):
            return self.values[rows]

    class Group(dict):
        attrs = {"shape": m.shape}

    stand_in = types.ModuleType("h5py")
    stand_in.__spec__ = importlib.machinery.ModuleSpec("h5py", None)
    stand_in.File = lambda path, mode: {"X": Dataset(m, (16, 6)), "layers/counts": Group({n: Dataset(v, (9,)) for n, v in part.items()})}
    monkeypatch.setitem(sys.modules, "h5py", stand_in)
    dense, sparse = matrices.MatrixReader("a.h5ad", None, 20), matrices.MatrixReader("a.h5ad", "counts", 20)
    assert [p.stop for p in dense.partitions()] == [32, 64, 96, 100]
    assert [r["profile"] for r in rows(dense)] == m.tolist() == [r["profile"] for r in rows(sparse)]
