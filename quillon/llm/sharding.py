"""Sharding by a hierarchical weighted hash tree of regions, racks and shards.

Weights are summed up the tree: a rack weighs what its shards weigh, a region what its racks weigh. Each key
descends by one weighted hash draw a level: every child bids -ln(u) / weight, u being the hash of key and
child's name, and the least bid wins, so P(child) = weight / total. A descent costs one draw a child of the
three nodes it passes, whatever the weights. A bid depends on key, name and own weight alone, so when
weights below a node change, movement is confined: no key moves between two regions whose weights stay, nor
between two racks of a region, or two shards of a rack, whose weights stay.

A shard that is added opens a region of its own (``Tree.grown``): nothing else changes weight, so it takes rows
from everywhere and only into itself. Thus law ``key`` holds for every planned tree and any number of added shards;
a shard that is added within an old region would let that region's other shards gain rows as well.

Slots (gapless numbers inside a shard) come from per-task counters written with the rows: the shared table
fixes them, counts per (task, shard) are summed to offsets, and no shard is gathered in one task.

Defined results: null doc_id is a key of its own (all such rows share a shard); null text has size 1 and
crc32 0; repeated rows share a shard and get slots of their own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import Scratch, bounded_batches

U64 = np.uint64
# Constants of the splitmix64 generator.
GAMMA, MIX_A, MIX_B = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + GAMMA
        x = (x ^ (x >> U64(30))) * MIX_A
        x = (x ^ (x >> U64(27))) * MIX_B
        return x ^ (x >> U64(31))


def _unit(x: np.ndarray) -> np.ndarray:
    """Hashes as doubles in (0, 1)."""
    return ((x >> U64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def _total(node) -> float:
    return node if isinstance(node, float) else sum(map(_total, node))


def _leaves(node) -> int:
    return 1 if isinstance(node, float) else sum(map(_leaves, node))


@dataclass(frozen=True)
class Tree:
    """weights[region][rack][slot] >= 0 (0: a shard that takes nothing). Shards are numbered in this order."""

    weights: tuple[tuple[tuple[float, ...], ...], ...]

    def __post_init__(self):
        if not 0 < _total(self.weights) < np.inf or any(w < 0 for region in self.weights for rack in region for w in rack):
            raise ValueError("weights must be finite, not negative and not all 0")

    @classmethod
    def of(cls, shards: int, racks: int = 2, slots: int = 2) -> Tree:
        """Planned tree of equal shards: regions of ``racks`` racks of ``slots`` shards; the last may be smaller."""
        if shards < 1:
            raise ValueError("a tree needs at least one shard")
        split = lambda n, by: [by] * (n // by) + [n % by] * (n % by > 0)
        return cls(tuple(tuple((1.0,) * rack for rack in split(region, slots)) for region in split(shards, racks * slots)))

    def grown(self, weight: float = 1.0) -> Tree:
        """With one more shard, in a region of its own, behind the others."""
        return Tree((*self.weights, ((float(weight),),)))

    def place(self, keys: np.ndarray) -> np.ndarray:
        """Shard number of each uint64 key."""
        shard = np.zeros(len(keys), dtype=np.int32)

        def descend(node, at: np.ndarray, name: U64, base: int) -> None:
            if isinstance(node, float):
                shard[at] = base
                return
            bids = np.full((len(node), len(at)), np.inf)
            names = mix64(name + np.arange(1, len(node) + 1, dtype=U64))
            for k, child in enumerate(node):
                if (weight := _total(child)) > 0:
                    bids[k] = -np.log(_unit(mix64(keys[at] ^ names[k]))) / weight
            won = bids.argmin(axis=0)
            for k, child in enumerate(node):
                if (won == k).any():
                    descend(child, at[won == k], names[k], base)
                base += _leaves(child)

        if len(keys):
            with np.errstate(over="ignore"):
                descend(self.weights, np.arange(len(keys)), mix64(np.zeros(1, dtype=U64))[0], 0)
        return shard


def shard(docs: DataFrame, shards: int = 8, tree: Tree | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``; ``tree`` stands for the planned one of ``shards``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "shards")
    now = tree or Tree.of(shards)
    shards, grown = _leaves(now.weights), now.grown()
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    light = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64("doc_id").alias("key"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(shards, dtype=np.int64)
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False).view(U64)
            home, later = now.place(keys), grown.place(keys)
            order = np.argsort(home, kind="stable")
            counts = np.bincount(home, minlength=shards)
            local = np.empty(len(keys), dtype=np.int64)
            local[order] = np.arange(len(keys)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(seen, counts)
            seen += counts
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("size"), batch.column("text_crc32"), pa.array(home, pa.int32()), pa.array(later, pa.int32()), pa.array(np.full(len(keys), task, dtype=np.int32)), pa.array(local)],
                names=["doc_id", "size", "text_crc32", "shard", "grown_shard", "task", "local"],
            )

    schema = f"doc_id {kind}, size long, text_crc32 long, shard int, grown_shard int, task int, local long"
    rows = scratch.save(light.mapInArrow(numbered, schema), "rows")
    run = Window.partitionBy("o_shard").orderBy("o_task").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(F.col("shard").alias("o_shard"), F.col("task").alias("o_task")).agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("o_shard", "o_task", F.coalesce(F.sum("n").over(run), F.lit(0)).alias("offset"))
    joined = rows.join(offsets, (rows["shard"] == offsets["o_shard"]) & (rows["task"] == offsets["o_task"]))
    return joined.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("local")).alias("slot"), "grown_shard")
