"""Exact Jaccard self-join on word shingles by parity sketches.

A document's distinct shingles are hashed to 64 bits and XORed into sketches; XOR keeps the parity of what
falls into a place, so equal tokens of two documents cancel and only their symmetric difference shows.

1. Equal sets (128-bit fingerprints) collapse to one node: copies cost nothing further.
2. Sizes form bands. Two linked sets of one band differ in at most d shingles. A set's hash range is cut into
   more than d segments, each with the XOR of its shingles' codes: a differing shingle spoils one segment, so
   linked sets agree in all but d of them (pigeonhole). The pair (segment, code) is the join key. Keys have one
   order for all sets, fullest segments first, and a set takes its first d + 1, d being what it can differ by
   from its largest partner in the band: the first key two linked sets agree in is among these of both. Full
   segments rarely agree by chance, so few keys are shared by sets that do not link.
3. Keys of two sets or more are found by an aggregate that is combined before its shuffle (least and greatest
   node of the key), then joined back; each key's nodes are paired with its least node only. Pairs are
   verified on the shingle sets and give components.
4. A key whose three or more nodes still lie in several components may hide links between nodes other than
   its least one. Nodes that such keys connect form a cluster. A cluster of bounded size is compared in one
   task, each of its sets sent once; the keys of larger clusters, once per distinct membership, are dealt in
   square cells of bounded blocks, where bit sketches are compared: their Hamming distance never exceeds the
   symmetric difference, so pairs that it leaves between components are all that can link. They are verified
   on the sets, at most ROUND_PAIRS of two components a round, nearest first, and rounds go on until none is
   left. Every linked pair agrees in some key, so afterwards linked nodes share a component: no partner or
   candidate is capped.

A node is named by the first half of its fingerprint, so that copies name it alike without a join. Should two
different sets get one name, which the second half and the size show, all is begun again with other
fingerprints. Hash values stand for shingles; two different shingles of one comparison fall together with
probability under 1e-12.

Defined results: null and wordless texts are empty sets and linked with nothing; texts with fewer words than
a shingle are one shingle; repeated rows are documents of their own with equal sets; null doc_ids take part
and are never a component's name unless all are null; an empty table gives no rows; other columns are
ignored by ``components`` and kept by ``distinct_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import Scratch, bounded_batches
from quillon.llm.components import roots

U64 = np.uint64
# Odd 64-bit multipliers.
ODD_A, ODD_B, ODD_C = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
#: Words whose hash a worker remembers; nodes and shingle bytes of one block of a cell.
REMEMBERED, BLOCK_NODES, BLOCK_BYTES = 200_000, 2_048, 128 << 20
#: Nodes and shingle bytes of a cluster that one task compares, and pairs of two components that a cell gives out in a round.
CLUSTER_NODES, CLUSTER_BYTES, ROUND_PAIRS = 6_144, 24 << 20, 64
#: Bits a wanted text of the filter that turns away the others, the most bits it may have, and bits of one part of it.
BITS_EACH, MOST_BITS, PART_BITS = 16, 1 << 28, 1 << 15
#: Names of sets that one task remembers, so that copies there send their keys once.
NAMES = 1 << 20
#: Bits of a set's name: not the sign's, for -1 is a mark below.
NAME_BITS = 63


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * ODD_B
        x = (x ^ (x >> U64(27))) * ODD_C
        return x ^ (x >> U64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < REMEMBERED and len(word) <= 48:
            self[word] = value
        return value


@lru_cache(maxsize=1)
def _words() -> _Words:
    return _Words()


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; A-Z lower-cased, words split at \\x20 and \\x09-\\x0D."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, dtype=U64)
    w = np.fromiter(map(_words().__getitem__, words), dtype=U64, count=n)
    size = min(n, width)
    with np.errstate(over="ignore"):
        h = np.full(n - size + 1, U64(size) * ODD_A, dtype=U64)
        for k in range(size):
            h = _mix((h + w[k : n - size + 1 + k]) * ODD_A)
    return np.unique(h)


@dataclass(frozen=True)
class Threshold:
    """Sets link if den * |A & B| >= num * |A | B|."""

    num: int
    den: int

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        if not self.sizes_fit(len(a), len(b)):
            return False
        small, large = (a, b) if len(a) <= len(b) else (b, a)
        at = np.searchsorted(large, small)
        both = int(np.count_nonzero(large[np.minimum(at, len(large) - 1)] == small))
        return self.den * both >= self.num * (len(a) + len(b) - both)

    def sizes_fit(self, a, b):
        return (self.num * a <= self.den * b) & (self.num * b <= self.den * a)

    def most_different(self, total):
        """Largest symmetric difference of linked sets with ``total`` elements in both together."""
        return total * (self.den - self.num) // (self.den + self.num)

    def bands(self, top: int) -> list[int]:
        """Least sizes of the bands, up to one beyond ``top``; a set's partners lie in its band or the next."""
        out = [1]
        while out[-1] <= top:
            s = out[-1]
            out.append(max(s + 1, -(-s * 3 // 2), -(-s * self.den // self.num)))
        return out


def segments(most: int) -> int:
    """Number of segments for sets that differ in at most ``most`` shingles: an eighth more than a key has to be found in."""
    return most + 1 + -(-(most + 1) // 8)


def join_keys(h: np.ndarray, t: Threshold) -> np.ndarray:
    """Keys of a set in its own band and, if it can link upwards, in the next one."""
    n = len(h)
    if not n:
        return np.zeros(0, dtype=U64)
    bands = t.bands(n)
    own = len(bands) - 2
    out = []
    codes = _mix(h + ODD_C)
    for g in (own, own + 1):
        low, high = (bands + t.bands(bands[-1])[len(bands) :])[g : g + 2]
        if n < low and t.num * low > t.den * n:
            continue
        most = int(t.most_different(2 * (high - 1)))
        if not most:
            continue  # only equal sets link, and these are one node
        count = segments(most)
        place = ((h >> U64(32)) * U64(count) >> U64(32)).astype(np.int64)  # ascending, as h is
        starts = np.flatnonzero(np.diff(place, prepend=-1))
        held, code = np.zeros(count, dtype=U64), np.zeros(count, dtype=U64)
        held[place[starts]] = np.diff(starts, append=n)
        code[place[starts]] = np.bitwise_xor.reduceat(codes, starts)
        with np.errstate(over="ignore"):
            key = _mix(code + _mix((np.arange(count) + (g << 40)).astype(U64) * ODD_A) + held * ODD_B)
        take = 1 + int(t.most_different(n + min(high - 1, n * t.den // t.num)))
        if take < count:
            order = (U64(255) - np.minimum(held, U64(255))) << U64(56) | key >> U64(8)
            key = key[order <= np.partition(order, take - 1)[take - 1]]
        out.append(key)
    return np.concatenate(out) if out else np.zeros(0, dtype=U64)


def parity_sketch(h: np.ndarray, bits: int) -> np.ndarray:
    """The parity of the number of shingles in each of ``bits`` places, packed to 64-bit words."""
    odd = (np.bincount((_mix(h) & U64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(U64)


def sketch_bits(n: int) -> int:
    """Places of the sketch that a set carries into the join: a power of two, at least four a shingle."""
    return max(64, 1 << max(4 * n - 1, 0).bit_length())


def links_between(sets: list[np.ndarray], roots_: np.ndarray, sides: np.ndarray, t: Threshold) -> list[tuple[int, int]]:
    """Positions of linked pairs that join what ``roots_`` keeps apart: a spanning set, not all of them.

    ``sides`` is 0 or 1 for the two blocks of a cell and 2 throughout for a cell of one block with itself:
    pairs within one block of two are another cell's.
    """
    size = np.array([len(s) for s in sets])
    bits = 64
    while bits < 4 * size.max(initial=1):
        bits *= 2
    sketch = np.stack([parity_sketch(s, bits) for s in sets])
    comp = np.unique(roots_, return_inverse=True)[1]
    out = []
    for i in range(len(sets) - 1):
        rest = np.arange(i + 1, len(sets))
        rest = rest[(comp[rest] != comp[i]) & t.sizes_fit(size[rest], size[i]) & ((sides[rest] != sides[i]) | (sides[rest] == 2))]
        if not len(rest):
            continue
        apart = np.bitwise_count(sketch[rest] ^ sketch[i]).sum(axis=1)
        for j in rest[apart <= t.most_different(size[rest] + size[i])]:
            if comp[j] != comp[i] and t.linked(sets[i], sets[j]):
                out.append((i, int(j)))
                comp[comp == comp[j]] = comp[i]
    return out


def pairs_between(size: np.ndarray, sketches: list[np.ndarray], comp: np.ndarray, sides: np.ndarray, t: Threshold) -> np.ndarray:
    """Rows (Hamming distance, i, j) of all pairs in different components that may link by size and sketch.

    ``sides`` is 0 or 1 for the two blocks of a cell and 2 throughout for a cell of one block with itself:
    pairs within one block of two are another cell's. Sizes that fit differ by one sketch length at most:
    the longer sketch is folded by XOR of its halves.
    """
    words = np.array([len(x) for x in sketches])
    out = []
    for w in np.unique(words):
        own, longer = np.flatnonzero(words == w), np.flatnonzero(words == 2 * w)
        where = np.concatenate([own, longer])
        matrix = np.stack([sketches[i] for i in own] + [sketches[i][:w] ^ sketches[i][w:] for i in longer])
        for k, i in enumerate(own):
            rest = np.arange(k + 1, len(where))
            at = where[rest]
            fits = (comp[at] != comp[i]) & t.sizes_fit(size[at], size[i]) & ((sides[at] != sides[i]) | (sides[at] == 2))
            rest = rest[fits]
            if not len(rest):
                continue
            apart = np.bitwise_count(matrix[rest] ^ matrix[k]).sum(axis=1, dtype=np.int64)
            near = apart <= t.most_different(size[where[rest]] + size[i])
            if near.any():
                out.append(np.stack([apart[near], np.full(near.sum(), i), where[rest[near]]], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 3), dtype=np.int64)


def components(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, scratch: Scratch | None = None) -> DataFrame:
    """uid, doc_id, text_key, n_shingles, root, component_id for every row of ``docs``.

    uid numbers the rows, root names the component (null for empty sets), text_key is xxhash64 of the text.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = scratch or Scratch(spark, "jaccard")
    t = Threshold(num, den)
    kind = docs.schema["doc_id"].dataType.simpleString()

    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    columns = ["uid", "doc_id", "text_key", "n", "f1", "f2"]

    def sketched(seed: int):
        one_by, two_by = (_mix(np.array([2 * seed + k], dtype=U64) * ODD_A)[0] | U64(1) for k in (1, 2))

        def fingerprint(h: np.ndarray, by: U64) -> U64:
            with np.errstate(over="ignore"):
                return np.add.reduce(_mix(h * by)) if len(h) else U64(0)

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, named = TaskContext.get().partitionId() << 36, set()
            for batch in batches:
                sizes, one, two, keys = [], [], [], []
                for text in batch.column("text").to_pylist():
                    h = shingle_set(text, width)
                    sizes.append(len(h))
                    one.append(fingerprint(h, one_by) >> U64(64 - NAME_BITS))
                    two.append(fingerprint(h, two_by))
                    keys.append(np.zeros(0, dtype=np.int64) if one[-1] in named else join_keys(h, t).view(np.int64))
                    if len(named) < NAMES:
                        named.add(one[-1])
                uid = pa.array(np.arange(at, at + len(sizes), dtype=np.int64))
                at += len(sizes)
                values = [uid, batch.column("doc_id"), batch.column("text_key"), pa.array(sizes, pa.int32()), *(pa.array(np.array(x, dtype=U64).view(np.int64)) for x in (one, two)), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(values, names=[*columns, "keys"])

        return of

    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid", "text_key"))
    mixed = (F.min("f2") < F.max("f2")) | (F.min("n") < F.max("n"))
    seed, apart = 0, False
    while not apart:
        sketches = scratch.save(keyed.mapInArrow(sketched(seed), f"uid long, doc_id {kind}, text_key long, n int, f1 long, f2 long, keys array<long>"), "sketches")
        rows = scratch.save(sketches.select(*columns), "rows")
        nodes = scratch.save(rows.where(F.col("n") > 0).groupBy("f1").agg(first.alias("r"), mixed.alias("mixed")).select(F.col("f1").alias("node"), F.col("r.doc_id").alias("least_id"), F.col("r.text_key").alias("rep_key"), "mixed"), "nodes")
        seed, apart = seed + 1, nodes.where("mixed").isEmpty()
    keys = sketches.select(F.col("f1").alias("node"), F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where(F.col("low") < F.col("high"))
    # Written first, so that the shuffle of all keys that found the shared ones is gone before the next begins.
    shared = scratch.save(shared.select(F.col("key").alias("s_key"), "low"), "shared")
    stars = scratch.save(keys.join(shared, F.col("key") == F.col("s_key")).select("key", "node", "low").distinct(), "stars")
    scratch.drop("sketches", "shared")
    sets = _sets(docs, nodes, stars, width, scratch)
    pairs = stars.where(F.col("node") != F.col("low")).select(F.col("low").alias("a"), F.col("node").alias("b")).distinct()
    links = scratch.save(_verified(pairs, sets, t), "links")
    tied = scratch.save(roots(links, scratch, "first"), "tied")
    small, cells = _cells(stars, tied, sets, scratch)
    scratch.drop("stars", "links")
    within = scratch.save(_cluster_links(small, tied, sets, t), "within")
    if not within.isEmpty():
        stems = tied.select(F.col("root").alias("a"), F.col("node").alias("b"))
        tied = scratch.save(roots(stems.unionByName(within), scratch, "inner"), "inner")
    turn, again = 0, True
    while again:
        offered = scratch.save(_offered(cells, tied, sets, t, turn * ROUND_PAIRS), f"offered{turn}")
        more = scratch.save(_verified(offered.where("a >= 0").distinct(), sets, t), f"more{turn}")
        again = not offered.where("a < 0").isEmpty()
        if not more.isEmpty():
            stems = tied.select(F.col("root").alias("a"), F.col("node").alias("b"))
            tied = scratch.save(roots(stems.unionByName(more), scratch, f"again{turn}"), f"tied{turn}")
        scratch.drop(f"offered{turn}", f"more{turn}")
        turn += 1
    scratch.drop("sets", "cells", "placed", "within")
    home = nodes.join(tied.withColumnRenamed("node", "t_node"), F.col("node") == F.col("t_node"), "left").select(F.col("node").alias("h_node"), "least_id", F.coalesce("root", "node").alias("root"))
    names = home.groupBy("root").agg(F.min("least_id").alias("component_id")).withColumnRenamed("root", "n_root")
    home = scratch.save(home.join(names, F.col("root") == F.col("n_root")).select("h_node", "root", "component_id"), "home")
    found = rows.join(home, (F.col("f1") == F.col("h_node")) & (F.col("n") > 0), "left")
    return found.select("uid", "doc_id", "text_key", F.col("n").cast("long").alias("n_shingles"), "root", F.coalesce("component_id", F.when(F.col("n") == 0, F.col("doc_id"))).alias("component_id"))


def _bitmap(keys: DataFrame, key: str) -> np.ndarray:
    """Bits of the hashed keys, BITS_EACH for each but never more than MOST_BITS: OR-ed in Spark in parts, at most 32 MB at the driver."""
    bits = PART_BITS
    wanted = min(MOST_BITS, BITS_EACH * keys.count())
    while bits < wanted:
        bits *= 2
    place = F.pmod(key, F.lit(bits))
    parts = keys.select((place / PART_BITS).cast("int").alias("part"), (place % PART_BITS).alias("bit")).groupBy("part").agg(F.expr("bitmap_construct_agg(bit)").alias("bits")).collect()
    out = np.zeros(bits // 8, dtype=np.uint8)
    for row in parts:
        found = np.frombuffer(row["bits"], dtype=np.uint8)[: PART_BITS // 8]
        out[row["part"] * PART_BITS // 8 :][: len(found)] = found
    return out


def _sets(docs: DataFrame, nodes: DataFrame, stars: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """(node, s, sketch, shingles as bytes) of the nodes that share a key, from their whole texts.

    A bitmap of bounded size turns away most other texts before they are shingled and shuffled; those that
    pass by chance are dropped by the join, so it decides nothing.
    """
    spark = docs.sparkSession
    asked = stars.select(F.col("node").alias("w")).distinct()
    wanted = nodes.join(asked, F.col("node") == F.col("w"), "left_semi").select("node", F.col("least_id").alias("w_id"), F.col("rep_key").alias("w_key"))
    wanted = scratch.save(wanted, "wanted")
    bitmap = spark.sparkContext.broadcast(_bitmap(wanted, "w_key"))
    texts = docs.select(F.col("doc_id").alias("t_id"), F.xxhash64("text").alias("t_key"), "text")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for batch in batches:
            place = batch.column("t_key").to_numpy(zero_copy_only=False) % (8 * len(bits))
            batch = batch.filter(pa.array((bits[place >> 3] >> (place & 7) & 1).astype(bool)))
            sets = [shingle_set(x, width) for x in batch.column("text").to_pylist()]
            sketches = [parity_sketch(x, sketch_bits(len(x))).view(np.int64) for x in sets]
            columns = [batch.column("t_id"), batch.column("t_key"), pa.array([len(x) for x in sets], pa.int32()), pa.array(sketches, pa.list_(pa.int64())), pa.array([x.tobytes() for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["t_id", "t_key", "s", "sketch", "shingles"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = texts.mapInArrow(shingled, f"t_id {kind}, t_key long, s int, sketch array<long>, shingles binary")
    found = found.join(wanted, (F.col("t_key") == F.col("w_key")) & F.col("t_id").eqNullSafe(F.col("w_id")))
    sets = scratch.save(found.select("node", "s", "sketch", "shingles"), "sets")
    if sets.count() > wanted.count():  # repeated rows: the same text found more than once
        once = scratch.save(sets.dropDuplicates(["node"]), "sets1")
        scratch.drop("sets")
        scratch.rename("sets1", "sets")
        sets = once
    scratch.drop("wanted")
    return sets


def _hamming(a: str, b: str):
    """Hamming distance of two sketches; the longer one (twice as long at most) is folded by XOR of its halves first."""

    def folded(x):
        half = (F.size(x) / 2).cast("int")
        return F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda u, v: u.bitwiseXOR(v))

    def apart(x, y):
        return F.aggregate(F.zip_with(x, y, lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda s, n: s + n)

    n, m = F.size(a), F.size(b)
    return F.when(n == m, apart(F.col(a), F.col(b))).when(n == 2 * m, apart(folded(F.col(a)), F.col(b))).when(m == 2 * n, apart(F.col(a), folded(F.col(b)))).otherwise(F.lit(0))


def _verified(pairs: DataFrame, sets: DataFrame, t: Threshold) -> DataFrame:
    """Those of the pairs (a, b) whose sets link: by size, by Hamming distance of the sketches, then on the sets."""
    small = sets.select("node", "s", "sketch")

    def side(df: DataFrame, c: str) -> DataFrame:
        return df.select([F.col(x).alias(f"{x}_{c}") for x in df.columns])

    sized = pairs.join(side(small, "a"), F.col("a") == F.col("node_a")).join(side(small, "b"), F.col("b") == F.col("node_b"))
    sized = sized.where((t.num * F.col("s_a") <= t.den * F.col("s_b")) & (t.num * F.col("s_b") <= t.den * F.col("s_a")))
    total = (F.col("s_a") + F.col("s_b")).cast("long")
    sized = sized.where(_hamming("sketch_a", "sketch_b") <= F.floor(total * (t.den - t.num) / (t.den + t.num))).select("a", "b")
    full = sets.select("node", "shingles")
    both = sized.join(side(full, "a"), F.col("a") == F.col("node_a")).join(side(full, "b"), F.col("b") == F.col("node_b")).select("a", "b", "shingles_a", "shingles_b")

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [t.linked(np.frombuffer(x.as_buffer(), dtype=U64), np.frombuffer(y.as_buffer(), dtype=U64)) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(checked, "a long, b long")


def _cells(stars: DataFrame, tied: DataFrame, sets: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """What has to be compared for links that no star shows: (cluster, node) of bounded clusters, (key, i, j, block, node) of others."""
    held = stars.join(tied.withColumnRenamed("node", "t_node"), F.col("node") == F.col("t_node"), "left").select("key", "node", "low", F.coalesce("root", "node").alias("root"))
    held = scratch.save(held, "held")
    # The only pair of a key with two nodes was verified.
    split = held.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("members")).where((F.col("lo") < F.col("hi")) & (F.col("members") > 2)).select(F.col("key").alias("s_key"))
    held = scratch.save(held.join(split, F.col("key") == F.col("s_key"), "left_semi"), "split")
    scratch.drop("held")
    near = roots(held.select(F.col("low").alias("a"), F.col("node").alias("b")), scratch, "near").withColumnsRenamed({"node": "c_node", "root": "cluster"})
    sizes_ = sets.select(F.col("node").alias("z_node"), F.col("s").alias("n"))
    held = held.join(sizes_, F.col("node") == F.col("z_node")).drop("z_node")
    inside = held.select("node", "n").distinct().join(near, F.col("node") == F.col("c_node")).drop("c_node")
    inside = scratch.save(inside, "inside")
    fits = (F.count(F.lit(1)) <= CLUSTER_NODES) & (F.sum("n") * 8 <= CLUSTER_BYTES)
    sizes = inside.groupBy("cluster").agg(fits.alias("fits")).withColumnRenamed("cluster", "z_cluster")
    placed = scratch.save(inside.join(sizes, F.col("cluster") == F.col("z_cluster")).drop("z_cluster"), "placed")
    scratch.drop("inside")
    small = placed.where("fits").select("cluster", "node")
    large = held.join(placed.where("NOT fits").select(F.col("node").alias("l_node")), F.col("node") == F.col("l_node"), "left_semi")
    whole = large.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("total"), F.bit_xor(F.xxhash64("node")).alias("x1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x2"))
    once = whole.groupBy("members", "x1", "x2").agg(F.min(F.struct("key", "total")).alias("k"))
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK_NODES), F.ceil(F.col("k.total") * 8 / BLOCK_BYTES)).cast("int")
    chosen = once.select(F.col("k.key").alias("c_key"), blocks.alias("blocks"))
    dealt = large.join(chosen, F.col("key") == F.col("c_key")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    crossed = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    crossed = crossed.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node")
    cells = scratch.save(crossed, "cells")
    scratch.drop("split")
    return small, cells


def _cluster_links(small: DataFrame, tied: DataFrame, sets: DataFrame, t: Threshold) -> DataFrame:
    """Links (a, b) that join components within each bounded cluster: a spanning set, verified in its task."""
    now = tied.select(F.col("node").alias("t_node"), "root")
    full = small.join(now, F.col("node") == F.col("t_node"), "left").select("cluster", "node", F.coalesce("root", "node").alias("root"))
    full = full.join(sets.select(F.col("node").alias("s_node"), "shingles"), F.col("node") == F.col("s_node")).drop("s_node")

    def compared(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        node = pdf["node"].to_numpy()
        got = links_between([np.frombuffer(x, dtype=U64) for x in pdf["shingles"]], pdf["root"].to_numpy(), np.full(len(pdf), 2), t)
        return pd.DataFrame({"a": [node[i] for i, _ in got], "b": [node[j] for _, j in got]}, dtype="int64")

    return full.groupBy("cluster").applyInPandas(compared, "a long, b long")


def _offered(cells: DataFrame, tied: DataFrame, sets: DataFrame, t: Threshold, skip: int) -> DataFrame:
    """Pairs (a, b) of cells that may link components; for every two components those of rank skip to skip + ROUND_PAIRS.

    A row (-1, -1) says that a cell has more. When components merge between rounds, the first ``skip`` pairs
    of the merged ones are among those already given out, so none is passed over.
    """
    now = tied.select(F.col("node").alias("t_node"), "root")
    full = cells.join(now, F.col("node") == F.col("t_node"), "left").select("key", "i", "j", "block", "node", F.coalesce("root", "node").alias("root"))
    full = full.join(sets.select(F.col("node").alias("s_node"), "s", "sketch"), F.col("node") == F.col("s_node")).drop("s_node")

    def compared(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        one = pdf["i"].iloc[0] == pdf["j"].iloc[0]
        sides = np.full(len(pdf), 2) if one else (pdf["block"] == pdf["j"]).to_numpy(dtype=np.int64)
        node, comp = pdf["node"].to_numpy(), np.unique(pdf["root"].to_numpy(), return_inverse=True)[1]
        got = pairs_between(pdf["s"].to_numpy(dtype=np.int64), [np.asarray(x, dtype=np.int64).view(U64) for x in pdf["sketch"]], comp, sides, t)
        low, high = (f(comp[got[:, 1]], comp[got[:, 2]]) for f in (np.minimum, np.maximum))
        order = np.lexsort((node[got[:, 2]], node[got[:, 1]], got[:, 0], high, low))
        got, low, high = got[order], low[order], high[order]
        starts = np.flatnonzero((np.diff(low, prepend=-1) != 0) | (np.diff(high, prepend=-1) != 0))
        rank = np.arange(len(got)) - np.repeat(starts, np.diff(np.append(starts, len(got))))
        take = (rank >= skip) & (rank < skip + ROUND_PAIRS)
        a, b = node[got[take, 1]], node[got[take, 2]]
        rest = [-1] if (rank >= skip + ROUND_PAIRS).any() else []
        return pd.DataFrame({"a": [*np.minimum(a, b), *rest], "b": [*np.maximum(a, b), *rest]}, dtype="int64")

    return full.groupBy("key", "i", "j").applyInPandas(compared, "a long, b long")


def distinct_documents(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one row of each component: the one with its least doc_id. Rows with empty sets all stay."""
    scratch = Scratch(docs.sparkSession, "distinct")
    found = scratch.save(components(docs, width, num, den, scratch), "found")
    leader = found.where(F.col("root").isNotNull()).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("l")).select(F.col("l.uid").alias("l_uid"))
    rest = found.where(F.col("root").isNotNull()).join(leader, F.col("uid") == F.col("l_uid"), "left_anti")
    dropped = scratch.save(rest.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("d_rows")).withColumnsRenamed({"doc_id": "d_id", "text_key": "d_key"}), "dropped")
    leaders = found.join(leader, F.col("uid") == F.col("l_uid"), "left_semi").select("doc_id", "text_key")
    same = (F.col("key") == F.col("d_key")) & F.col("id").eqNullSafe(F.col("d_id"))
    # The input's columns travel in a struct, where no name of theirs clashes.
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    marked = marked.select("row", F.col("row.doc_id").alias("id"), F.xxhash64("row.text").alias("key"))
    kept = marked.join(dropped, same, "left_anti")
    # A leader that has twins (rows with its doc_id and text) is dropped with them above: one of them comes back.
    twins = leaders.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).join(dropped, same, "left_semi")
    twins = scratch.save(twins.select(F.col("id").alias("t_id"), F.col("key").alias("t_key")), "twins")
    if not twins.isEmpty():
        back = marked.join(twins, (F.col("key") == F.col("t_key")) & F.col("id").eqNullSafe(F.col("t_id")), "left_semi").dropDuplicates(["id", "key"])
        kept = kept.unionByName(back)
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
