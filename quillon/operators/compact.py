"""Sums of pairwise distances within seeded draws and within sets, in cells of a block of units by a block of units.

Sets, and a few draws, are subsets: their members alone are dealt to blocks and compared. Where draws would compare the same pairs
over and over, all units are compared once: a task holds a tile of distances and takes from it what each draw holds, whose
members are hashed once, in a slab of their own, and sent to the cells as packed positions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import draws as W
from quillon.sources.shared import Scratch

METRICS = ("cosine", "euclidean", "whitened")
#: Units of a block, and of a tile, whose distances a task holds at once.
BLOCK, TILE = 16_384, 1_024
#: Rows of a tile that are worked on at once; blocks that units compared for draws are dealt to where there are enough for a tile each.
STRIPE, DEALT = 128, 12
#: Units that a task hashes at once.
SLAB = 65_536
#: Most blocks, unless one would have more than so many bytes of vectors or of drawn positions; sizes that draws are summed for at once.
BLOCKS, HELD, NEEDS = 16, 256_000_000, 24
_SUMS = "m long, pairs long, cosine double, euclidean double, whitened double"


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances between the rows of two blocks."""
    na, nb = (a * a).sum(1), (b * b).sum(1)
    left = np.concatenate([-2 * a, na[:, None], np.ones((len(a), 1))], axis=1)
    right = np.concatenate([b, np.ones((len(b), 1)), nb[:, None]], axis=1).T
    out = np.empty((len(a), len(b)))
    for k in range(0, len(a), STRIPE):
        square = np.matmul(left[k : k + STRIPE], right, out=out[k : k + STRIPE])
        if not (square >= 1e-6 * (na[k : k + STRIPE].max() + nb.max())).all():
            i, j = np.nonzero(square < 1e-6 * (na[k : k + STRIPE, None] + nb))  # differences that the products round away
            square[i, j] = ((a[k + i] - b[j]) ** 2).sum(1)
        np.sqrt(square, out=square)
    return out


class _Side:
    """The vectors of a block's units in the order of their names: as they are, of length 1, and whitened."""

    def __init__(self, t: pa.Table, mean: np.ndarray, deviation: np.ndarray):
        x = np.stack(t.column("profile").to_numpy()) if len(t) else np.zeros((0, len(mean)))
        self.n, self.x = len(x), x
        self.unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        self.white = (x - mean) / deviation

    def tiles(self) -> range:
        return range(0, self.n, TILE)


def _pairs(a: _Side, b: _Side, same: bool) -> Iterator[tuple[int, int, float, np.ndarray, np.ndarray]]:
    """(start in a, start in b, weight, distances, whitened distances) of every tile; within one block each pair of tiles once, and a tile with itself at half weight."""
    for k in a.tiles():
        for o in b.tiles():
            if same and o < k:
                continue
            found = [_distances(u[k : k + TILE], v[o : o + TILE]) for u, v in ((a.x, b.x), (a.white, b.white))]
            if same and o == k:
                for f in found:
                    np.fill_diagonal(f, 0)
            yield k, o, 0.5 if same and o == k else 1.0, found[0], found[1]


def _nested(sums: np.ndarray) -> np.ndarray:
    """Of a matrix of bands by bands, the sums of the first k of both."""
    return sums.cumsum(-2).cumsum(-1).diagonal(axis1=-2, axis2=-1)


def _cosines(ua: np.ndarray, ub: np.ndarray, own: np.ndarray, same: bool) -> np.ndarray:
    """Sums of cosines over the pairs of the first k bands, from the sums of the bands' vectors (and of their squared lengths)."""
    ua, ub = ua.cumsum(-2), ub.cumsum(-2)
    products = (ua * ub).sum(-1)
    return (products - own.cumsum(-1)) / 2 if same else products


def _counted(ma: np.ndarray, mb: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """How many units the first k bands have (0 between two blocks) and how many pairs."""
    ma, mb = ma.cumsum(-1), mb.cumsum(-1)
    return (ma, ma * (ma - 1) // 2) if same else (ma * 0, ma * mb)


def _grid(df: DataFrame, blocks, *columns: str) -> DataFrame:
    """Rows of block ``g`` sent to each cell (i, j), i <= j, that the block is in."""
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    return df.withColumn("other", other).select(*columns, "g", F.least("g", "other").alias("i"), F.greatest("g", "other").alias("j"))


def subset_sums(subsets: DataFrame, key: str, bands: int, scale: tuple[np.ndarray, np.ndarray], block: int) -> DataFrame:
    """(key, band, m, pairs, sums of the metrics) over the units of the first 0 to ``band`` bands of each subset, a row a cell.

    subsets: (key, unit, band, profile), a unit once a key; ``scale`` has the columns' means and deviations.
    """
    sizes = subsets.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = subsets.join(F.broadcast(sizes), key).withColumn("g", F.pmod(F.xxhash64("unit"), F.col("blocks")).cast("int"))

    def summed(t: pa.Table) -> pa.Table:
        g, i, j = (t.column(c).to_numpy() for c in ("g", "i", "j"))
        same = bool(i[0] == j[0])
        sides, held = [], []
        for at in (np.flatnonzero(g == i[0]), np.flatnonzero(g == j[0])):
            part = t.take(pa.array(at))
            sides.append(_Side(part, *scale))
            held.append((part.column("band").to_numpy()[:, None] == np.arange(bands)).astype(np.float64))
        (a, b), (ha, hb) = sides, held
        found = np.zeros((2, bands, bands))
        for k, o, weight, *tile in _pairs(a, b, same):
            for e, f in enumerate(tile):
                found[e] += weight * (ha[k : k + TILE].T @ f @ hb[o : o + TILE])
        m, pairs = _counted(ha.sum(0).astype(np.int64), hb.sum(0).astype(np.int64), same)
        cosine = _cosines(ha.T @ a.unit, hb.T @ b.unit, ha.T @ (a.unit**2).sum(1), same)
        sums = [pairs - cosine, *_nested(found)]
        return pa.table({key: pa.concat_arrays([t.column(key).slice(0, 1).combine_chunks()] * bands), "band": pa.array(range(bands), pa.int32()), "m": pa.array(m, pa.int64()), "pairs": pa.array(pairs, pa.int64()), **{c: pa.array(v, pa.float64()) for c, v in zip(METRICS, sums, strict=True)}})

    kind = subsets.schema[key].dataType.simpleString()
    return _grid(dealt, F.col("blocks"), key, "band", "profile").groupBy(key, "i", "j").applyInArrow(summed, f"{key} {kind}, band int, {_SUMS}")


def _edges(c: pa.Table, bands: int) -> dict[int, np.ndarray]:
    return dict(sorted(W.packed(c, bands).items()))


def _held(hashes: W.Hashes, edges: np.ndarray, prefix: str) -> tuple[np.ndarray, np.ndarray]:
    """Which texts a draw holds, and the first of its ascending cuts that lets each in."""
    high, low = hashes.of(prefix)
    at = np.flatnonzero(W.up_to(high, low, edges[-1]))
    h, rest = high[at], low[at]
    band = np.searchsorted(edges[:, 0], h, "left")
    for k in np.flatnonzero(np.isin(h, edges[:, 0])):  # halves decide between equal ones
        band[k] = next(e for e, cut in enumerate(edges) if (h[k], rest[k]) <= tuple(cut))
    return at, band


def _met(units: DataFrame, slabs: int, cut: DataFrame, draws: int, f, schema: str) -> DataFrame:
    """``f`` of every slab of units with the cuts of a turn of draws."""
    each = -(-draws // min(draws, max(-(-W.CELLS // slabs), 1)))
    turns = F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // each)))
    asked = cut.withColumn("turn", F.expr(f"CAST(b DIV {each} AS INT)")).withColumn("slab", F.explode(F.sequence(F.lit(0), F.lit(slabs - 1))))
    tasks = min(slabs * (-(-draws // each)), 2_000)
    left, right = (df.repartition(tasks, "turn", "slab").groupBy("turn", "slab") for df in (units.withColumn("turn", turns), asked))
    return left.cogroup(right).applyInArrow(f, schema)


def _table(rows: list[tuple], names: Sequence[str], kinds: Sequence[pa.DataType]) -> pa.Table:
    return pa.table({name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(zip(names, kinds, strict=True))})


def drawn_members(units: DataFrame, n: int, cut: DataFrame, bands: int, draws: int, seed: str) -> DataFrame:
    """(b, unit, band, profile) of what each draw holds: for draws that are few, or hold little."""
    slabs = max(-(-n // SLAB), 1)

    def members(t: pa.Table, c: pa.Table) -> pa.Table:
        out = [t.slice(0, 0).append_column("b", pa.array([], pa.int32())).append_column("band", pa.array([], pa.int32()))]
        if len(t) and len(c):
            hashes = W.Hashes(t.column("unit").to_pylist())
            for b, edges in _edges(c, bands).items():
                at, band = _held(hashes, edges, f"{seed}#{b}#")
                part = t.take(pa.array(at)).append_column("b", pa.array(np.full(len(at), b, np.int32)))
                out.append(part.append_column("band", pa.array(band.astype(np.int32))))
        return pa.concat_tables(out).select(["b", "unit", "band", "profile"])

    dealt = units.withColumn("slab", F.pmod(F.xxhash64("unit"), F.lit(slabs)).cast("int"))
    return _met(dealt, slabs, cut, draws, members, "b int, unit string, band int, profile array<double>")


def _starts(counts: np.ndarray) -> tuple[np.ndarray, list]:
    """Where the bands of each draw start in its tile, within its length, and which of them are empty (None: none is)."""
    starts = np.minimum(counts.cumsum(-1) - counts, np.maximum(counts.sum(-1, keepdims=True) - 1, 0))
    empty = counts == 0
    return starts, [e if e.any() else None for e in empty]


class _Draws:
    """What the draws hold of a block: positions tile by tile, each tile's in the order of bands."""

    def __init__(self, names: list[int], data: dict[int, pa.Scalar], n: int, bands: int):
        tiles = -(-n // TILE)
        packed = [np.frombuffer(data[b].as_buffer(), np.uint16) if b in data else np.zeros(tiles * bands, np.uint16) for b in names]
        self.counts = np.stack([p[: tiles * bands] for p in packed]).astype(np.int64).reshape(len(names), tiles, bands)
        at = np.concatenate([p[tiles * bands :] for p in packed])
        tile = np.repeat(np.tile(np.arange(tiles, dtype=np.uint16), len(names)), self.counts.sum(-1).ravel())
        self.places = [at[tile == q].astype(np.int64) for q in range(tiles)]
        self.ends = [np.concatenate([[0], self.counts[:, q].sum(-1).cumsum()]).tolist() for q in range(tiles)]
        self.starts = [_starts(self.counts[:, q]) for q in range(tiles)]

    def vectors(self, v: np.ndarray) -> np.ndarray:
        """Sums of rows of ``v`` by draw and band."""
        out = np.zeros((*self.counts.shape[::2], v.shape[1]))
        for q, (places, ends, (starts, empty)) in enumerate(zip(self.places, self.ends, self.starts, strict=True)):
            for d, at in enumerate(starts):
                rows = places[ends[d] : ends[d + 1]]
                if len(rows):
                    sums = np.add.reduceat(v[q * TILE + rows], at, axis=0)
                    if empty[d] is not None:
                        sums[empty[d]] = 0
                    out[d] += sums
        return out


def _taken(z: np.ndarray, rows: _Draws, k: int, columns: _Draws, o: int, out: np.ndarray) -> None:
    """Adds to every draw what it holds of a tile, by bands of both sides."""
    flat = z.ravel()
    a, b = rows.places[k] * z.shape[1], columns.places[o]
    (sa, na), (sb, nb), ea, eb = rows.starts[k], columns.starts[o], rows.ends[k], columns.ends[o]
    for d in range(len(out)):
        i, j = a[ea[d] : ea[d + 1]], b[eb[d] : eb[d + 1]]
        if len(i) and len(j):
            s = np.add.reduceat(flat.take(i[:, None] + j), sb[d], axis=1)
            if nb[d] is not None:
                s[:, nb[d]] = 0
            s = np.add.reduceat(s, sa[d], axis=0)
            if na[d] is not None:
                s[na[d]] = 0
            out[d] += s


def drawn_sums(units: DataFrame, n: int, cut: DataFrame, need: int, bands: int, draws: int, seed: str, scale: tuple[np.ndarray, np.ndarray], block: int) -> DataFrame:
    """(b, band, m, pairs, sums of the metrics) over the units that each draw's first 0 to ``band`` cuts let in, a row a cell; every distance is made once."""
    width = len(scale[0])
    least = -(-8 * max(3 * width * n, draws * min(need, n)) // HELD)
    blocks = max(min(DEALT, -(-n // (TILE - TILE // 16))), min(-(-n // block), BLOCKS), least, 1)
    dealt = units.withColumn("g", F.pmod(F.xxhash64("unit"), F.lit(blocks)).cast("int"))

    def packed(t: pa.Table, c: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if len(t) and len(c):
            t = t.sort_by([("g", "ascending"), ("unit", "ascending")])
            hashes, (named, first, sizes) = W.Hashes(t.column("unit").to_pylist()), np.unique(t.column("g").to_numpy(), return_index=True, return_counts=True)
            tiles = -(-sizes // TILE)
            ends = np.append(0, tiles.cumsum())
            local = np.arange(len(t)) - np.repeat(first, sizes)
            place = (np.repeat(ends[:-1], sizes) + local // TILE) * bands
            local = (local % TILE).astype(np.uint16)
            for b, edges in _edges(c, bands).items():
                at, band = _held(hashes, edges, f"{seed}#{b}#")
                where = place[at] + band
                held, counts = local[at[np.argsort(where, kind="stable")]], np.bincount(where, minlength=ends[-1] * bands)
                last = np.append(0, counts.cumsum())
                for k, g in enumerate(named.tolist()):
                    of = slice(ends[k] * bands, ends[k + 1] * bands)
                    rows.append((g, b, counts[of].astype(np.uint16).tobytes() + held[last[of.start] : last[of.stop]].tobytes()))
        return _table(rows, ("g", "b", "data"), (pa.int32(), pa.int32(), pa.binary()))

    def summed(t: pa.Table, c: pa.Table) -> pa.Table:
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.float64()] * 3]
        out: list[np.ndarray] = []
        if len(t) and len(c):
            first, last = (t.column(k)[0].as_py() for k in ("i", "j"))
            same, names = first == last, sorted(set(c.column("b").to_pylist()))
            sides, held, vectors = [], [], []
            for g in (first,) if same else (first, last):
                part = t.filter(pa.array(t.column("g").to_numpy() == g)).sort_by("unit")
                mine = c.filter(pa.array(c.column("g").to_numpy() == g))
                sides.append(_Side(part, *scale))
                held.append(_Draws(names, dict(zip(mine.column("b").to_pylist(), mine.column("data"), strict=True)), sides[-1].n, bands) if sides[-1].n else None)
            if all(s.n for s in sides) and len(sides) == 2 - same:
                for s, h in zip(sides, held, strict=True):
                    vectors.append(h.vectors(np.concatenate([s.unit, (s.unit**2).sum(1)[:, None]], axis=1)))
                z, found = np.zeros((TILE, TILE), np.complex128), np.zeros((len(names), bands, bands), np.complex128)
                for k, o, weight, plain, white in _pairs(sides[0], sides[-1], same):
                    z.real[: plain.shape[0], : plain.shape[1]] = weight * plain
                    z.imag[: plain.shape[0], : plain.shape[1]] = weight * white
                    _taken(z, held[0], k // TILE, held[-1], o // TILE, found)
            else:  # one of the blocks has no unit
                return summed(t.slice(0, 0), c)
            m, pairs = _counted(held[0].counts.sum(1), held[-1].counts.sum(1), same)
            cosine = _cosines(vectors[0][..., :-1], vectors[-1][..., :-1], vectors[0][..., -1], same)
            out = [np.repeat(names, bands), np.tile(np.arange(bands), len(names)), m, pairs, pairs - cosine, _nested(found.real), _nested(found.imag)]
        return pa.table({name: pa.array(np.asarray(v).ravel().astype(k.to_pandas_dtype()), k) for name, k, v in zip(("b", "band", "m", "pairs", *METRICS), kinds, out or [[]] * 7, strict=True)})

    each = max(SLAB * blocks // max(n, 1), 1)  # whole blocks of a slab
    slabs = dealt.select("unit", "g", F.expr(f"CAST(g DIV {each} AS INT)").alias("slab"))
    sent = Scratch(units.sparkSession, "compact").save(_met(slabs, -(-blocks // each), cut, draws, packed, "g int, b int, data binary"), "held")
    tasks = min(blocks * (blocks + 1) // 2, 2_000)
    left, right = (df.repartition(tasks, "i", "j").groupBy("i", "j") for df in (_grid(dealt, F.lit(blocks), "unit", "profile"), _grid(sent, F.lit(blocks), "b", "data")))
    return left.cogroup(right).applyInArrow(summed, f"b int, band int, {_SUMS}")
