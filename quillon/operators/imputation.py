"""Low-rank completion of tensors whose units are rows of a table, many fits (ranks, seeds) in each pass.

Hard imputation replaces the unknown entries of a row by its projection on the leading directions of all rows, time
and again. A row's state follows from its own entries and the directions of the rounds so far, which are small: tasks
replay them, so that a round is one pass that adds up a Gram matrix (entries of a unit squared) and how far the
unknown entries moved. After ``REPLAY`` rounds the states are written to the shared folder, and the replay starts anew.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.operators.tensor_fit import GROUPS
from quillon.sources.shared import Scratch

#: Rounds that are replayed before the rows' states are written.
REPLAY = 16


@dataclass
class Completion:
    """One fit: its rank and seed, the directions since the states were written, and how it ended."""

    rank: int
    seed: int
    axes: list[np.ndarray] = field(default_factory=list)
    rounds: int = 0
    done: bool = False


def uniform(unit: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A number in [0, 1) per unit and entry, fixed by the seed (splitmix64 of their place)."""
    with np.errstate(over="ignore"):
        x = unit.astype(np.uint64)[:, None] * np.uint64(width) + np.arange(width, dtype=np.uint64)
        x = x + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
    return (x >> np.uint64(11)).astype(float) / float(1 << 53)


def _entries(batch: pa.RecordBatch, width: int, contexts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit ids, entries (context by context) and which are observed."""
    unit = batch.column(0).to_numpy(zero_copy_only=False)
    rows = batch.column(1).to_pylist()
    zero = [0.0] * width
    x = np.array([[zero if p is None else p for p in row] for row in rows], float).reshape(len(rows), -1)
    seen = np.repeat(np.array([[p is not None for p in row] for row in rows], bool).reshape(-1, contexts), width, axis=1)
    return unit, x, seen


def _added(df: DataFrame, fold) -> dict[int, np.ndarray]:
    """Packed sums by key over all tasks: each task adds up its rows, Spark brings a row a task and key."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                for k, v in fold(batch):
                    total[k] = total.get(k, 0) + v
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.asarray(v, float).tobytes() for v in total.values()], pa.binary())], names=["k", "v"])

    def add(t: pa.Table) -> pa.Table:
        v = np.sum([np.frombuffer(x) for x in t.column("v").to_pylist()], axis=0)
        return pa.table({"k": t.column("k")[:1], "v": pa.array([v.tobytes()], pa.binary())})

    parts = df.mapInArrow(each, "k int, v binary")
    if df._jdf.rdd().getNumPartitions() > GROUPS:
        parts = parts.groupBy("k").applyInArrow(add, "k int, v binary")
    out: dict[int, np.ndarray] = {}
    for r in parts.collect():  # a row a fit, or of few tasks a row a fit and task
        out[r["k"]] = out.get(r["k"], 0) + np.frombuffer(r["v"])
    return out


def entry_scores(rows: DataFrame, width: int, contexts: int, ranks: Sequence[int], seeds: Sequence[int], share: float = 0.1, steps: int = 200, tol: float = 1e-5) -> list[tuple[int, int, float, int]]:
    """(rank, seed, held-out R2 against the training means, rounds) of completions from all but a ``share`` of the observed entries.

    ``rows`` (unit: whole number, t: a profile or null per context) should be a written table; what a seed holds out is
    fixed by unit and entry, whatever the partitions. Without held-out entries the R2 is 1.
    """
    size = width * contexts
    scratch = Scratch(rows.sparkSession, "imputation")
    fits = [Completion(rank, seed) for seed in seeds for rank in ranks]

    def split(unit: np.ndarray, seen: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
        test = seen & (uniform(unit, size, seed) < share)
        return seen & ~test, test

    def sums(batch: pa.RecordBatch):
        unit, x, seen = _entries(batch, width, contexts)
        for k, seed in enumerate(seeds):
            train, _ = split(unit, seen, seed)
            yield k, np.concatenate([np.where(train, x, 0).sum(0), train.sum(0)])

    base = rows.select("unit", "t")
    found = _added(base, sums)
    means = {seed: found[k][:size] / np.maximum(found[k][size:], 1) if k in found else np.zeros(size) for k, seed in enumerate(seeds)}

    def states(batch: pa.RecordBatch, chosen: Sequence[int]):
        """(fit, state, state before, training entries, held-out entries, entries) of the chosen fits."""
        unit, x, seen = _entries(batch, width, contexts)
        held = np.stack([np.frombuffer(v.as_py()) for v in batch.column(2)]).reshape(len(unit), len(fits), size) if batch.num_columns > 2 else None
        for i in chosen:
            fit = fits[i]
            train, test = split(unit, seen, fit.seed)
            y = x - means[fit.seed]
            before = now = np.where(train, y, 0.0 if held is None else held[:, i])
            for axes in fit.axes:
                before, now = now, np.where(train, now, now @ axes @ axes.T)
            yield i, now, before, train, test, y

    for _ in range(steps + 1):
        live = [i for i, f in enumerate(fits) if not f.done]
        if not live:
            break

        def gram(batch: pa.RecordBatch, live=live):
            for i, now, before, *_ in states(batch, live):
                yield i, np.concatenate([[((now - before) ** 2).sum(), (now**2).sum()], (now.T @ now).ravel()])

        got = _added(base, gram)
        for i in live:
            fit, v = fits[i], got.get(i)
            # Right after the states were written a pass has no move to measure.
            if v is None or fit.rounds >= steps or fit.axes and np.sqrt(v[0]) <= tol * max(np.sqrt(v[1]), 1e-12):
                fit.done = True
                continue
            fit.axes.append(np.linalg.eigh(v[2:].reshape(size, size))[1][:, -fit.rank :])
            fit.rounds += 1
        if max((len(f.axes) for f in fits if not f.done), default=0) >= REPLAY:

            def keep(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
                for batch in batches:
                    if batch.num_rows:
                        now = np.stack([s[1] for s in states(batch, range(len(fits)))], axis=1)
                        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([v.tobytes() for v in now], pa.binary())], names=["unit", "t", "held"])

            kind = f"unit {rows.schema['unit'].dataType.simpleString()}, t array<array<double>>, held binary"
            base = scratch.save(base.mapInArrow(keep, kind), f"states-{max(f.rounds for f in fits)}")
            for fit in fits:
                fit.axes = []

    def errors(batch: pa.RecordBatch):
        for i, now, _, _, test, y in states(batch, range(len(fits))):
            yield i, np.array([(((now - y) ** 2)[test]).sum(), (y[test] ** 2).sum()])

    e = _added(base, errors)
    return [(f.rank, f.seed, 1 - float(e[i][0]) / max(float(e[i][1]), 1e-12) if i in e else 1.0, f.rounds) for i, f in enumerate(fits)]
