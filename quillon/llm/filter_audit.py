"""Audit of how text filters interact, over a packed bitmap index.

The index has a row per block of documents and part: the number of documents, a bitset per filter (which of
them fail it) and one per label, made by each task from its own rows. It is a table that can be kept: any order of any of
its filters is counted from it alone. For each subset of the filters, the documents that pass all of them are
AND-NOT of the bitsets; popcounts of the survivors, and of the survivors with a label, are summed over
blocks by Spark. Every figure of every order follows from these 2 ** filters sums a part:

- kept after a step: survivors of the filters so far; removed: the difference to the step before;
- redundant: all that fail the filter, less removed; unique_fails: what only this filter removes;
- a label's loss: its survivors before less those after the step; shapley: removed, over all orders at any step, summed.

The one filter that needs other rows, repetition, is decided before: the least doc_id of each text is found by a
combining aggregation over digests of 128 bits, and joined back on digest and doc_id together, so that thousands of copies
of a text are not one key.

Defined results: null text is empty; part is the lang, null lang the empty string; a null doc_id is never a
repetition and has no label; of rows with one doc_id and text none repeats another; a doc_id labelled more than
once has a label if any of its rows gives it; empty tables give no rows; columns besides those named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import Scratch, bounded_batches

FILTERS = "ABCDE"
LABELS = ("good", "toxic")
#: Documents of a part in one block of the index.
BLOCK = 1 << 16
_UPPER = bytes(range(65, 91))
_TAIL = bytes(range(0x80, 0xC0))


@dataclass(frozen=True)
class Rules:
    """What fails a document: A few words, B few distinct ones, C many capitals, D marks; E, repetition, has no figure."""

    min_words: int = 200
    distinct_pct: int = 50
    upper_pct: int = 3
    marks: str = "#$%&*|"


def _fails(text: bytes, rules: Rules, marks: bytes) -> int:
    """Bits 0 to 3: A to D."""
    words = text.split()  # of bytes: at the six white spaces of the contract
    chars = len(text.translate(None, _TAIL))
    capitals = len(text) - len(text.translate(None, _UPPER))
    a = len(words) < rules.min_words
    b = 100 * len(set(words)) < rules.distinct_pct * len(words)
    c = 100 * capitals > rules.upper_pct * chars
    d = len(text.translate(None, marks)) != len(text)
    return a | b << 1 | c << 2 | d << 3


def flags(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """doc_id, part, fails (bits A to D) and a digest of the text, per document row."""
    bounded_batches(docs.sparkSession)
    marks = rules.marks.encode()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fails, digests = [], []
            for value in batch.column(2).cast(pa.binary()):
                text = value.as_py() or b""
                fails.append(_fails(text, rules, marks))
                digests.append(hashlib.blake2b(text, digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fails, pa.int32()), pa.array(digests, pa.binary())], names=["doc_id", "part", "fails", "digest"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), "text")
    return rows.mapInArrow(judge, "doc_id bigint, part string, fails int, digest binary")


def judged(found: DataFrame, labels: DataFrame) -> DataFrame:
    """part and bits of every row: fails with E, then a bit a label."""
    first = found.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL").withColumn("first", F.lit(True))
    marked = found.join(first, ["digest", "doc_id"], "left")
    again = F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), 1 << 4).otherwise(0)
    given = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    bits = F.col("fails") + again
    for k, label in enumerate(LABELS):
        bits = bits + F.when(F.col(label), 1 << (len(FILTERS) + k)).otherwise(0)
    return marked.join(given, "doc_id", "left").select("part", bits.cast("int").alias("bits"))


def bitmap_index(rows: DataFrame, filters: int = len(FILTERS), labels: int = len(LABELS), block: int = BLOCK) -> DataFrame:
    """(part, bits) -> part, n, filters and labels (arrays of packed bitsets): a row per block of a task's documents of a part."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        count: dict[str, int] = {}

        def row(part: str) -> pa.RecordBatch:
            bits = np.concatenate(held.pop(part))
            sets = [np.packbits((bits >> k & 1).astype(bool), bitorder="little").tobytes() for k in range(filters + labels)]
            count.pop(part)
            return pa.RecordBatch.from_arrays(
                [pa.array([part]), pa.array([len(bits)], pa.int64()), pa.array([sets[:filters]], pa.list_(pa.binary())), pa.array([sets[filters:]], pa.list_(pa.binary()))],
                names=["part", "n", "filters", "labels"],
            )

        for batch in batches:
            parts, codes = np.unique(np.array(batch.column(0).to_pylist(), object), return_inverse=True)
            bits = batch.column(1).to_numpy(zero_copy_only=False)
            for k, part in enumerate(parts):
                mine = bits[codes == k]
                held.setdefault(part, []).append(mine)
                count[part] = count.get(part, 0) + len(mine)
                if count[part] >= block:
                    yield row(part)
            while sum(count.values()) >= 16 * block:  # very many parts: the fullest are given out, so that memory is bounded
                yield row(max(count, key=count.get))
        for part in list(held):
            yield row(part)

    return rows.select("part", "bits").mapInArrow(pack, "part string, n bigint, filters array<binary>, labels array<binary>")


def subset_counts(index: DataFrame, filters: int = len(FILTERS), labels: int = len(LABELS)) -> DataFrame:
    """part, mask, and how many documents fail none of the mask's filters: all (n0) and those with label k (n{k + 1})."""
    names = [f"n{k}" for k in range(labels + 1)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, n, failing, marked in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                every = np.packbits(np.ones(n, bool), bitorder="little")
                failing, marked = ([np.frombuffer(x, np.uint8) for x in sets] for sets in (failing, marked))
                alive, out = [every], []
                for mask in range(1 << filters):
                    if mask:  # the survivors of the mask without its highest filter, AND NOT that filter's
                        top = mask.bit_length() - 1
                        alive.append(alive[mask ^ 1 << top] & ~failing[top])
                    out.append([int(np.bitwise_count(s).sum(dtype=np.int64)) for s in (alive[mask], *[alive[mask] & m for m in marked])])
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(out)), pa.array(range(len(out)), pa.int32()), *[pa.array(x, pa.int64()) for x in zip(*out, strict=True)]], names=["part", "mask", *names])

    schema = "part string, mask int, " + ", ".join(f"{x} bigint" for x in names)
    return index.mapInArrow(count, schema).groupBy("part", "mask").agg(*[F.sum(x).cast("long").alias(x) for x in names])


def orders(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row per part, order of the filters and step, from the sums of the subsets."""
    size = len(filters)
    everything = (1 << size) - 1
    names = [c for c in counted.columns if c not in ("part", "mask")]
    part = counted.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("mask", *names))).alias("s"))  # 2 ** filters sums a part
    ways = ["".join(p) for p in permutations(filters)]
    steps = part.withColumn("filter_order", F.explode(F.lit(ways)))
    steps = steps.select("part", "s", "filter_order", F.posexplode(F.split("filter_order", "")).alias("k", "letter"))
    bit = F.lit(1)
    powers = F.create_map(*[x for i, f in enumerate(filters) for x in (F.lit(f), F.lit(1 << i))])
    before = F.aggregate(F.slice(F.split("filter_order", ""), bit, F.col("k")), F.lit(0), lambda a, f: a + powers[f])
    steps = steps.withColumn("before", before).withColumn("own", powers[F.col("letter")]).withColumn("after", F.col("before") + F.col("own"))

    def n(mask, name="n0"):
        return F.element_at("s", mask + 1)[name]

    removed = n(F.col("before")) - n(F.col("after"))
    fails = n(F.lit(0)) - n(F.col("own"))
    # A subset of s filters comes first, in any order, s! times, and the rest after the filter (size - s - 1)! times.
    factorial = [int(np.prod(range(1, k + 1))) for k in range(size)]
    share = F.lit(0).cast("long")
    for mask in range(everything + 1):
        held = bin(mask).count("1")
        if held < size:
            times = factorial[held] * factorial[size - held - 1]
            share = share + F.when(F.lit(mask).bitwiseAND(F.col("own")) == 0, (n(F.lit(mask)) - n(F.lit(mask) + F.col("own"))) * times).otherwise(0)
    losses = [(n(F.col("before"), f"n{k + 1}") - n(F.col("after"), f"n{k + 1}")).alias(f"{label}_lost") for k, label in enumerate(LABELS[: len(names) - 1])]
    return steps.select(
        "part",
        "filter_order",
        (F.col("k") + 1).cast("int").alias("step"),
        n(F.col("after")).alias("kept"),
        removed.alias("removed"),
        (fails - removed).alias("redundant"),
        (n(everything - F.col("own")) - n(F.lit(everything))).alias("unique_fails"),
        *losses,
        share.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Every order of the five filters, step by step, per part of ``docs``."""
    scratch = Scratch(docs.sparkSession, "filter_audit")
    found = scratch.save(flags(docs, rules), "flags")
    index = scratch.save(bitmap_index(judged(found, labels)), "index")
    return orders(subset_counts(index))


#: DuckDB SQL of op12: the orders come from a recursion, every step is counted anew.
SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
least_id AS (SELECT coalesce(text, '') AS t, min(doc_id) AS first_id FROM documents GROUP BY 1),
given AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * len(t) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN first_id < doc_id THEN 16 ELSE 0 END) AS fails
  FROM words JOIN least_id USING (t) LEFT JOIN given USING (doc_id)),
one AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM f GROUP BY 1, 2),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit),
perms AS (
  SELECT letter AS filter_order, bit AS mask, 1 AS k FROM letters
  UNION ALL SELECT filter_order || letter, mask + bit, k + 1 FROM perms, letters WHERE mask & bit = 0),
steps AS (
  SELECT o.filter_order, l.letter, l.bit, s.i AS step,
    (SELECT coalesce(sum(p.bit), 0) FROM letters p WHERE position(p.letter IN o.filter_order) < s.i)::BIGINT AS before
  FROM (SELECT filter_order FROM perms WHERE k = 5) o, (SELECT unnest([1, 2, 3, 4, 5]) AS i) s, letters l WHERE substr(o.filter_order, s.i, 1) = l.letter),
counted AS (
  SELECT part, filter_order, step, letter,
    sum(CASE WHEN fails & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN fails & before = 0 AND fails & bit <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN fails & before <> 0 AND fails & bit <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN fails = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN fails & before = 0 AND fails & bit <> 0 THEN g ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN fails & before = 0 AND fails & bit <> 0 THEN x ELSE 0 END)::BIGINT AS toxic_lost
  FROM one, steps GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM counted
"""
