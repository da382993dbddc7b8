"""Bootstrap of the shrunken ranking with replicate vectors: a row carries how often each replicate draws it.

Replicates are never rows. Slots are drawn in tasks and travel as packed numbers, one row a task and block of
``BLOCK`` facts; a unit's sums over all replicates are one vector; ranks are found in ranges of values, a range of one
replicate a task, and travel back packed. What the driver sees is of the size of the replicates (and, for tables of
many units, times the ranges): noise, prior, and how many units lie above each range.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.sources.shared import Scratch

#: Facts, and units, of one block; units of one replicate that a task puts into order.
BLOCK, SORTED = 4096, 1 << 16


def _slots(rows: DataFrame, draws: int, seed: str) -> DataFrame:
    """(block, packed): for each slot and replicate the fact that is drawn, as place in its block times ``draws`` plus replicate."""

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            total = batch.column(1)[0].as_py()
            slots = batch.column(0).to_pylist()
            heads = np.empty((draws, len(slots)), np.int64)
            for b in range(draws):
                lead = f"{seed}#{b}#"
                heads[b] = [int.from_bytes(hashlib.md5(f"{lead}{i}".encode()).digest()[:6], "big") for i in slots]
            at = heads % total
            block, place = np.divmod(at, BLOCK)
            packed = (place * draws + np.arange(draws)[:, None]).ravel().astype("<u4")
            order = np.argsort(block, axis=None, kind="stable")
            block, packed = block.ravel()[order], packed[order]
            first = np.flatnonzero(np.diff(block, prepend=-1))
            ends = [*first[1:], len(block)]
            yield pa.RecordBatch.from_arrays([pa.array(block[first]), pa.array([packed[s:e].tobytes() for s, e in zip(first, ends, strict=True)], pa.binary())], names=["block", "packed"])

    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.select("row_id").crossJoin(F.broadcast(total)).mapInArrow(drawn, "block bigint, packed binary")


def _vectors(rows: DataFrame, draws: int, seed: str, kind: str) -> DataFrame:
    """(uid, unit, w, s, q): counts, sums and, in the rows without unit, sums of squares over all facts of a block, a number a replicate each."""
    names = ["uid", "unit", "w", "s", "q"]

    def meet(_, slots: pa.Table, facts: pa.Table) -> pa.Table:
        out = {n: [] for n in names}
        n = facts.num_rows
        facts = facts.sort_by("row_id")
        if n:
            block = [np.frombuffer(x, "<u4") for x in slots.column("packed").to_pylist()]
            place = facts.column("row_id").to_numpy() % BLOCK
            counts = np.bincount(np.concatenate(block), minlength=BLOCK * draws).reshape(BLOCK, draws)[place] if block else np.zeros((n, draws), np.int64)
            work = facts.column("work").to_numpy()
            total = (counts.sum(0).astype(float), work @ counts, (work * work) @ counts)
            out["uid"].append(None)
            out["unit"].append(None)
            for name, v in zip("wsq", total, strict=True):
                out[name].append(v.tobytes())
            gate = facts.column("gate").to_numpy(zero_copy_only=False).astype(bool)
            units = np.array(facts.column("unit").to_pylist(), object)
            uid = facts.column("uid").to_numpy()
            kept = np.flatnonzero(gate)
            if len(kept):
                first = np.flatnonzero(np.diff(uid[kept], prepend=-1))
                w = np.add.reduceat(counts[kept], first, axis=0).astype(float)
                s = np.add.reduceat(counts[kept] * work[kept][:, None], first, axis=0)
                for k, at in enumerate(kept[first]):
                    out["uid"].append(int(uid[at]))
                    out["unit"].append(units[at])
                    out["w"].append(w[k].tobytes())
                    out["s"].append(s[k].tobytes())
                    out["q"].append(None)
        types = (pa.int64(), facts.schema.field("unit").type, pa.binary(), pa.binary(), pa.binary())
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), types, strict=True)})

    block = F.floor(F.col("row_id") / BLOCK).cast("long").alias("block")
    facts = rows.select(block, "row_id", "uid", "unit", F.col("gate").cast("boolean").alias("gate"), F.col("work").cast("double").alias("work"))
    return _slots(rows, draws, seed).groupBy("block").cogroup(facts.groupBy("block")).applyInArrow(meet, f"uid bigint, unit {kind}, w binary, s binary, q binary")


def _summed(df: DataFrame, column: str) -> np.ndarray:
    """Sum of packed vectors of doubles, added up within tasks first; the driver gets a vector a task."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for value in batch.column(0):
                v = np.frombuffer(value.as_py())
                total = v.copy() if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    parts = [np.frombuffer(r[0]) for r in df.select(column).mapInArrow(add, "v binary").collect()]
    return np.sum(parts, axis=0) if parts else np.zeros(0)


def _posterior(w: np.ndarray, s: np.ndarray, noise: np.ndarray, tau2: np.ndarray) -> np.ndarray:
    """Rounded posterior means, units by replicates; NaN where a replicate has no row of the unit."""
    with np.errstate(divide="ignore", invalid="ignore"):
        d, s2 = s / w, noise / w
        return np.round(d * tau2 / (tau2 + s2), 9)


def _stack(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.stack([np.frombuffer(x.as_py()) for x in batch.column(batch.schema.names.index(name))])


def _matrix_sums(units: DataFrame, what) -> np.ndarray:
    """Sum over all units of ``what(w, s)``, one vector a batch."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = np.ascontiguousarray(what(_stack(batch, "w"), _stack(batch, "s")), dtype=float).ravel()
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary())], names=["v"])

    return _summed(units.select("w", "s").mapInArrow(each, "v binary"), "v")


def stability(df: DataFrame, replicates: int = 20, top: int = 30, seed: str = "boot", block: int = SORTED) -> DataFrame:
    """Resample the rows with replacement, shrink and rank each replicate, count selections.

    ``df`` needs row_id 0..N-1 in the order of unit and context (R2), and uid, the row_id of the unit's first row; the
    row drawn for (replicate, i) is an md5 value modulo N. Frequencies are of the replicates a unit appears in.
    A tie of rounded means goes to the smaller unit. Without rows there is no result; a unit without gated rows has none.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "bootstrap")
    kind = df.schema["unit"].dataType.simpleString()
    facts = scratch.save(df.select("row_id", "uid", "unit", "gate", "work"), "facts")
    parts = scratch.save(_vectors(facts, replicates, seed, kind), "vectors")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [[np.sum([np.frombuffer(x) for x in v], axis=0).tobytes() for v in batch.column(k).to_pylist()] for k in (2, 3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, pa.binary()) for c in columns]], names=["uid", "unit", "w", "s"])

    # A unit's facts are neighbours by row_id: it has a vector or two.
    lists = parts.where("uid IS NOT NULL").groupBy("uid", "unit").agg(F.collect_list("w").alias("w"), F.collect_list("s").alias("s"))
    units = scratch.save(lists.mapInArrow(merge, f"uid bigint, unit {kind}, w binary, s binary"), "units")
    all_w, all_s, all_q = (_summed(parts.where("uid IS NULL"), c) for c in "wsq")
    if not len(all_w):
        all_w, all_s, all_q = (np.ones(replicates), np.zeros(replicates), np.zeros(replicates))
    noise = np.maximum(all_q / all_w - (all_s / all_w) ** 2, 0)

    def moments(w: np.ndarray, s: np.ndarray) -> np.ndarray:
        some = w > 0
        d = np.divide(s, w, out=np.zeros_like(s), where=some)
        return np.stack([some.sum(0), d.sum(0), (d * d).sum(0), np.divide(noise, w, out=np.zeros_like(w), where=some).sum(0)])

    sums = _matrix_sums(units, moments)
    n, d1, d2, s2 = sums.reshape(4, -1) if len(sums) else np.zeros((4, replicates))
    n = np.maximum(n, 1)
    tau2 = np.maximum(d2 / n - (d1 / n) ** 2 - s2 / n, 1e-6)

    # Ranges of posterior means: one where a task can hold a replicate's units, else cut at sampled means of the units.
    ranges = max(1, -(-int(n.max()) // block))
    cuts = np.zeros(0)
    if ranges > 1:

        def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    u = _posterior(_stack(batch, "w"), _stack(batch, "s"), noise, tau2)
                    yield pa.RecordBatch.from_arrays([pa.array(np.nanmean(np.c_[u, np.zeros(len(u))], axis=1))], names=["u"])

        got = units.mapInArrow(means, "u double").agg(F.percentile_approx("u", F.lit([k / ranges for k in range(1, ranges)]), 100 * ranges)).first()[0]
        cuts = np.unique(got)

    def above(w: np.ndarray, s: np.ndarray) -> np.ndarray:
        u = _posterior(w, s, noise, tau2)
        at = np.searchsorted(cuts, u, side="right")
        return np.stack([((at == r) & ~np.isnan(u)).sum(0) for r in range(len(cuts) + 1)])

    counted = _matrix_sums(units, above) if len(cuts) else np.zeros(0)
    held = counted.reshape(len(cuts) + 1, -1) if len(counted) else np.zeros((len(cuts) + 1, replicates))
    before = np.vstack([np.cumsum(held[::-1], axis=0)[::-1][1:], np.zeros((1, replicates))]).astype(np.int64)  # units in higher ranges

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            uid = batch.column(batch.schema.names.index("uid")).to_numpy()
            u = _posterior(_stack(batch, "w"), _stack(batch, "s"), noise, tau2)
            at = np.searchsorted(cuts, u, side="right")
            rows = []
            for b in range(replicates):
                for r in np.unique(at[:, b]):
                    mine = (at[:, b] == r) & ~np.isnan(u[:, b])
                    if mine.any():
                        rows.append((b, int(r), uid[mine].tobytes(), u[mine, b].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["b", "r", "uid", "u"])

    def place(t: pa.Table) -> pa.Table:
        b, r = t.column("b")[0].as_py(), t.column("r")[0].as_py()
        uid = np.concatenate([np.frombuffer(x, np.int64) for x in t.column("uid").to_pylist()])
        u = np.concatenate([np.frombuffer(x) for x in t.column("u").to_pylist()])
        order = np.lexsort((uid, -u))
        rank = np.empty(len(u), np.int64)
        rank[order] = np.arange(1, len(u) + 1) + before[r, b]
        home = uid // BLOCK
        by = np.argsort(home, kind="stable")
        first = np.flatnonzero(np.diff(home[by], prepend=-1))
        cut = [by[s:e] for s, e in zip(first, [*first[1:], len(by)], strict=True)]
        return pa.table({"home": pa.array([int(home[c[0]]) for c in cut], pa.int64()), "b": pa.array([b] * len(cut), pa.int32()), "uid": pa.array([uid[c].tobytes() for c in cut], pa.binary()), "rank": pa.array([rank[c].tobytes() for c in cut], pa.binary())})

    def gather(t: pa.Table) -> pa.Table:
        uid = [np.frombuffer(x, np.int64) for x in t.column("uid").to_pylist()]
        rank = [np.frombuffer(x, np.int64) for x in t.column("rank").to_pylist()]
        known = np.unique(np.concatenate(uid))
        table = np.full((len(known), replicates), np.nan)
        for b, i, r in zip(t.column("b").to_pylist(), uid, rank, strict=True):
            table[np.searchsorted(known, i), b] = r
        quarters = np.nanpercentile(table, [25, 50, 75], axis=1)
        seen = (~np.isnan(table)).sum(1)
        return pa.table({"uid": known, "n_appearances": seen.astype(np.int64), "selection_frequency": np.round((table <= top).sum(1) / seen, 6), "median_rank": quarters[1], "rank_iqr": quarters[2] - quarters[0]})

    dealt = units.select("uid", "w", "s").mapInArrow(deal, "b int, r int, uid binary, u binary")
    placed = dealt.groupBy("b", "r").applyInArrow(place, "home bigint, b int, uid binary, rank binary")
    found = placed.groupBy("home").applyInArrow(gather, "uid bigint, n_appearances bigint, selection_frequency double, median_rank double, rank_iqr double")
    return found.join(units.select("uid", "unit"), "uid").drop("uid").select("unit", "n_appearances", "selection_frequency", "median_rank", "rank_iqr")
