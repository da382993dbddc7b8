"""Rows of matrices as a Spark data source: dense or sparse layers of HDF5 files where h5py is installed, numpy files otherwise.

With the option ``pushdown`` filters on ``row_id`` reach the source: only blocks that hold a wanted row become partitions, and
of a block only the span of its wanted rows is read. Spark then asks for ``spark.sql.python.filterPushdown.enabled``, which is
false by default, so the option is off by default, and Spark filters what is read.
"""

from __future__ import annotations

import bisect
import importlib.util
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual


class Block(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class SparseMatrix:
    """A matrix of compressed rows: ``data``, ``indices`` and ``indptr`` are sliceable; a slice reads its rows' entries alone."""

    def __init__(self, data, indices, indptr, width: int):
        self.data, self.indices, self.indptr = data, indices, indptr
        self.shape = (indptr.shape[0] - 1, width)
        self.chunks = None

    def entries(self, start: int, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ends of the rows from 0, columns, values) of rows start to stop."""
        ends = np.asarray(self.indptr[start : stop + 1], dtype=np.int64)
        a, b = int(ends[0]), int(ends[-1])
        return ends - a, np.asarray(self.indices[a:b], dtype=np.int32), np.asarray(self.data[a:b], dtype=np.float32)

    def __getitem__(self, rows: slice | int) -> np.ndarray:
        start, stop, _ = rows.indices(self.shape[0]) if isinstance(rows, slice) else (rows, rows + 1, 1)
        ends, at, v = self.entries(start, max(start, stop))
        out = np.zeros((len(ends) - 1, self.shape[1]), dtype=np.float32)
        out[np.repeat(np.arange(len(out)), np.diff(ends)), at] = v
        return out if isinstance(rows, slice) else out[0]


def open_matrix(path: str, layer: str | None):
    """A sliceable matrix: a memory-mapped .npy, a folder of data, indices, indptr and shape as .npy, or a layer of an HDF5 file, dense or compressed."""
    if path.endswith(".npy"):
        return np.load(path, mmap_mode="r")
    if Path(path).is_dir():
        part = {n: np.load(Path(path) / f"{n}.npy", mmap_mode="r") for n in ("data", "indices", "indptr", "shape")}
        return SparseMatrix(part["data"], part["indices"], part["indptr"], int(part["shape"][1]))
    if importlib.util.find_spec("h5py") is None:
        raise RuntimeError("reading HDF5 needs h5py")
    import h5py

    node = h5py.File(path, "r")[f"layers/{layer}" if layer else "X"]
    if "shape" in node.attrs and hasattr(node, "keys"):  # a group of the parts of compressed rows
        return SparseMatrix(node["data"], node["indices"], node["indptr"], int(node.attrs["shape"][1]))
    return node


class MatrixSource(DataSource):
    """Options path, layer, block (rows a partition, 2000; rounded up to whole chunks), columns, form, pushdown.

    Rows (row_id, profile as float32), as Arrow batches. ``columns`` (numbers, comma-joined) keeps these columns in this
    order. ``form=sparse`` gives (row_id, indices, values): what compressed rows store, or the entries of dense ones that are not 0.
    """

    @classmethod
    def name(cls) -> str:
        return "matrix_rows"

    def schema(self) -> str:
        if self.options.get("form", "dense") == "sparse":
            return "row_id long, indices array<int>, values array<float>"
        return "row_id long, profile array<float>"

    def reader(self, schema) -> DataSourceReader:
        named = self.options.get("columns")
        columns = None if named is None else [int(c) for c in named.split(",") if c.strip()]
        kind = FilteredReader if self.options.get("pushdown", "false").lower() == "true" else MatrixReader
        return kind(self.options["path"], self.options.get("layer"), int(self.options.get("block", 2000)), columns, self.options.get("form", "dense") == "sparse")


class MatrixReader(DataSourceReader):
    def __init__(self, path: str, layer: str | None, block: int, columns: list[int] | None = None, sparse: bool = False):
        self.path, self.layer, self.block, self.columns, self.sparse = path, layer, block, columns, sparse
        self.low, self.high, self.wanted = 0, None, None

    def partitions(self) -> list[Block]:
        m = open_matrix(self.path, self.layer)
        chunk = (getattr(m, "chunks", None) or (1,))[0]
        step = -(-self.block // chunk) * chunk
        low, high = self.low, m.shape[0] if self.high is None else min(m.shape[0], self.high)
        if self.wanted is not None:
            firsts = sorted({r // step * step for r in self.wanted if low <= r < high})
        else:
            firsts = range(low // step * step, high, step) if low < high else []
        return [Block(max(a, low), min(high, a + step)) for a in firsts] or [Block(0, 0)]

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        start, stop, keep = partition.start, partition.stop, None
        if self.wanted is not None:
            rows = self.wanted[bisect.bisect_left(self.wanted, start) : bisect.bisect_left(self.wanted, stop)]
            start, stop = (rows[0], rows[-1] + 1) if rows else (0, 0)
            keep = pa.array(np.array(rows, dtype=np.int64) - start)
        if start >= stop:
            return
        m = open_matrix(self.path, self.layer)
        batch = (self._sparse if self.sparse else self._dense)(m, start, stop)
        yield batch if keep is None else batch.take(keep)

    def _dense(self, m, start: int, stop: int) -> pa.RecordBatch:
        rows = np.asarray(m[start:stop], dtype=np.float32)
        rows = rows if self.columns is None else rows[:, self.columns]
        ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1])
        profile = pa.ListArray.from_arrays(ends, pa.array(rows.ravel()))
        return pa.RecordBatch.from_arrays([pa.array(np.arange(start, stop)), profile], names=["row_id", "profile"])

    def _sparse(self, m, start: int, stop: int) -> pa.RecordBatch:
        if isinstance(m, SparseMatrix) and self.columns is None:
            ends, at, v = m.entries(start, stop)
        else:
            rows = np.asarray(m[start:stop], dtype=np.float32)
            rows = rows if self.columns is None else rows[:, self.columns]
            row, at = np.nonzero(rows)
            ends, v = np.searchsorted(row, np.arange(len(rows) + 1)), rows[row, at]
        ends = pa.array(ends.astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(c)) for c in (at.astype(np.int32), v)]
        return pa.RecordBatch.from_arrays([pa.array(np.arange(start, stop)), *lists], names=["row_id", "indices", "values"])


class FilteredReader(MatrixReader):
    """The reader that takes filters of rows."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes comparisons and lists of row_id; others go back to Spark."""
        for f in filters:
            if getattr(f, "attribute", None) != ("row_id",) or not self._take(f):
                yield f

    def _take(self, f: Filter) -> bool:
        match f:
            case EqualTo() | EqualNullSafe():
                rows = {f.value} - {None}
            case In():
                rows = set(f.value) - {None}
            case GreaterThan() | GreaterThanOrEqual() if f.value is not None:
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                return True
            case LessThan() | LessThanOrEqual() if f.value is not None:
                end = f.value + isinstance(f, LessThanOrEqual)
                self.high = end if self.high is None else min(self.high, end)
                return True
            case IsNotNull():
                return True
            case _:
                return False
        self.wanted = sorted(rows if self.wanted is None else rows & set(self.wanted))
        return True


def rows_of(matrix: DataFrame, index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(unit, context, row_id, profile) of the wanted (unit, context) pairs: ``index`` (row_id, unit, context) says where they are."""
    found = index.join(wanted.select("unit", "context").distinct(), ["unit", "context"])
    return matrix.join(found, "row_id").select("unit", "context", "row_id", "profile")


def inspect(df: DataFrame) -> list[tuple[str, str]]:
    """(field path, type) of every leaf of a table, structs opened."""

    def walk(fields, prefix: str) -> Iterator[tuple[str, str]]:
        for f in fields:
            inner = getattr(f.dataType, "fields", None)
            if inner:
                yield from walk(inner, f"{prefix}{f.name}.")
            else:
                yield f"{prefix}{f.name}", f.dataType.simpleString()

    return list(walk(df.schema.fields, ""))


def probe(path: str, layer: str | None = None, rows: int = 3, slow: float = 20.0) -> dict:
    """Shape and seconds a row of a few reads; never fails, the verdict says what happened."""
    import time

    try:
        m = open_matrix(path, layer)
        began = time.time()
        for k in range(min(rows, m.shape[0])):
            np.asarray(m[k])
        each = (time.time() - began) / max(1, min(rows, m.shape[0]))
        return {"shape": tuple(m.shape), "seconds_per_row": each, "verdict": "ok" if each < slow else "slow"}
    except (OSError, RuntimeError, KeyError) as problem:
        return {"shape": None, "seconds_per_row": None, "verdict": f"unreachable: {problem}"}
