"""Masked CP of unit x feature x context tensors whose units are rows of a table.

Given the feature and context factors, each unit's loadings are the least-squares solution over its observed
contexts, which its own row gives. A pass over the rows sums, per context, the outer products of loadings
(rank x rank) and of profiles with loadings (features x rank): the normal equations of both other factors. Tasks fold
their rows, a grouped sum adds the tasks up in two levels, and the driver solves systems of the size of the
rank. All fits of a grid (ranks, starts, replicates) share each pass.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: First-level groups that tasks' sums of one fit are added in.
GROUPS = 32
_RIDGE = 1e-10


@dataclass
class Fit:
    """Feature and context factors with unit columns, the squared error over observed entries, and the unit factors' Gram matrix."""

    features: np.ndarray
    contexts: np.ndarray
    error: float = np.inf
    gram: np.ndarray | None = None
    done: bool = False

    @property
    def weights(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.gram), 0))

    def degeneracy(self) -> float:
        """Largest triple congruence of two different components."""
        w = np.maximum(self.weights, 1e-12)
        c = np.abs(self.gram / np.outer(w, w) * (self.features.T @ self.features) * (self.contexts.T @ self.contexts))
        np.fill_diagonal(c, 0)
        return float(c.max(initial=0))


def unit_rows(cells: DataFrame, contexts: Sequence[str], value=lambda x: x) -> DataFrame:
    """(unit, t: array<array<double>>) from (unit, context, profile): a profile per context in the given order, null where unobserved."""
    profile = F.transform("profile", lambda x: value(x.cast("double")))
    wide = cells.groupBy("unit").pivot("context", list(contexts)).agg(F.first(profile))
    return wide.select("unit", F.array(*[F.col(f"`{c}`") for c in contexts]).alias("t"))


def _block(batch: pa.RecordBatch, at: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(units x contexts x features, units x contexts observed)."""
    rows = batch.column(at).to_pylist()
    seen = np.array([[p is not None for p in row] for row in rows], bool)
    zero = [0.0] * width
    return np.array([[zero if p is None else p for p in row] for row in rows], float), seen


def _loadings(x: np.ndarray, seen: np.ndarray, fit: Fit) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares loadings of each unit, and its squared error."""
    b, k = fit.features, fit.contexts
    rank = b.shape[1]
    gram = (b.T @ b) * (k[:, :, None] * k[:, None, :])  # a context each
    patterns, which = np.unique(seen, axis=0, return_inverse=True)
    right = np.einsum("ncg,gr,cr->nr", x, b, k)  # unobserved profiles are zero
    out = np.empty((len(x), rank))
    for p, pattern in enumerate(patterns):
        mine = which.ravel() == p
        g = gram[pattern].sum(0) if pattern.any() else np.zeros((rank, rank))
        out[mine] = np.linalg.solve(g + _RIDGE * (np.trace(g) / rank + 1) * np.eye(rank), right[mine].T).T
    model = np.einsum("nr,gr,cr->ncg", out, b, k) * seen[:, :, None]
    return out, ((x - model) ** 2).sum(axis=(1, 2))


def _sums(rows: DataFrame, fits: Sequence[tuple[int, Fit]], width: int, few: bool) -> dict[int, np.ndarray]:
    """Per fit the packed sums of one pass: error, Gram, Gram per context, profile products per context."""

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, seen = _block(batch, 0, width)
            for i, fit in fits:
                a, error = _loadings(x, seen, fit)
                s = np.einsum("nr,ns,nc->crs", a, a, seen.astype(float))
                m = np.einsum("ncg,nr->cgr", x, a)
                v = np.concatenate([[error.sum()], (a.T @ a).ravel(), s.ravel(), m.ravel()])
                total[i] = total.get(i, 0) + v
        group = TaskContext.get().partitionId() % GROUPS
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([group] * len(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["fit", "g", "v"])

    def add(t: pa.Table) -> pa.Table:
        v = np.sum([np.frombuffer(x) for x in t.column("v").to_pylist()], axis=0)
        return pa.table({"fit": t.column("fit")[:1], "g": t.column("g")[:1], "v": pa.array([v.tobytes()], pa.binary())})

    kind = "fit int, g int, v binary"
    folded = rows.select("t").mapInArrow(fold, kind)
    if few:  # a row a task and fit comes to the driver
        out: dict[int, np.ndarray] = {}
        for r in folded.collect():
            out[r["fit"]] = out.get(r["fit"], 0) + np.frombuffer(r["v"])
        return out
    summed = folded.groupBy("fit", "g").applyInArrow(add, kind).groupBy("fit").applyInArrow(add, kind)
    return {r["fit"]: np.frombuffer(r["v"]) for r in summed.collect()}  # a row a fit


def _unit_columns(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=0)
    return x / np.where(n == 0, 1, n)


def cp_fits(rows: DataFrame, width: int, contexts: int, grid: Sequence[tuple[int, int]], steps: int = 100, tol: float = 1e-6) -> list[Fit]:
    """T4: a masked CP fit for each (rank, seed) of the grid by alternating least squares; ``rows`` (unit, t) should be a written table.

    Fits end when their error no longer changes by ``tol`` of itself; passes go on for the others alone. Without rows
    the error is 0.
    """
    fits = []
    for rank, seed in grid:
        rng = np.random.default_rng(seed)
        fits.append(Fit(_unit_columns(rng.normal(size=(width, rank))), _unit_columns(rng.normal(size=(contexts, rank))), gram=np.zeros((rank, rank))))
    few = rows._jdf.rdd().getNumPartitions() <= GROUPS  # so many tasks' sums need no stage of their own
    for step in range(steps + 1):
        live = [(i, f) for i, f in enumerate(fits) if not f.done]
        if not live:
            break
        sums = _sums(rows, live, width, few)
        for i, fit in live:
            rank = fit.features.shape[1]
            v = sums.get(i)
            if v is None:
                fit.error, fit.done = 0.0, True
                continue
            error, gram, s, m = v[0], v[1 : 1 + rank**2], v[1 + rank**2 : 1 + rank**2 * (1 + contexts)], v[1 + rank**2 * (1 + contexts) :]
            before, fit.error, fit.gram = fit.error, float(error), gram.reshape(rank, rank).copy()
            # The sums belong to the factors that made them: a fit that ends keeps these.
            if abs(before - fit.error) <= tol * max(fit.error, 1e-12) or step == steps:
                fit.done = True
                continue
            s, m = s.reshape(contexts, rank, rank), m.reshape(contexts, width, rank)
            k = fit.contexts
            normal = (s * (k[:, :, None] * k[:, None, :])).sum(0)
            right = np.einsum("cgr,cr->gr", m, k)
            ridge = lambda n: n + _RIDGE * (np.trace(n) / rank + 1e-12) * np.eye(rank)  # noqa: E731, B023
            b = _unit_columns(np.linalg.solve(ridge(normal), right.T).T)
            own = b.T @ b
            k = np.stack([np.linalg.solve(ridge(s[c] * own), (m[c] * b).sum(0)) for c in range(contexts)])
            fit.features, fit.contexts = b, _unit_columns(k)
    return fits


def best_by_rank(fits: Sequence[Fit]) -> dict[int, Fit]:
    """Of each rank the fit of least error, components by falling weight and with their largest context loading positive (T5)."""
    out: dict[int, Fit] = {}
    for fit in fits:
        rank = fit.features.shape[1]
        if rank not in out or fit.error < out[rank].error:
            out[rank] = fit
    for rank, fit in out.items():
        sign = np.sign(fit.contexts[np.abs(fit.contexts).argmax(axis=0), np.arange(rank)])
        sign[sign == 0] = 1
        order = np.argsort(-fit.weights, kind="stable")
        out[rank] = Fit(fit.features[:, order], (fit.contexts * sign)[:, order], fit.error, (fit.gram * np.outer(sign, sign))[np.ix_(order, order)], True)
    return out


def unit_factors(rows: DataFrame, fit: Fit, width: int) -> DataFrame:
    """(unit, loadings) of every unit under a fit."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, _ = _loadings(*_block(batch, 1, width), fit)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a.tolist(), pa.list_(pa.float64()))], names=["unit", "loadings"])

    return rows.select("unit", "t").mapInArrow(each, f"unit {rows.schema['unit'].dataType.simpleString()}, loadings array<double>")
