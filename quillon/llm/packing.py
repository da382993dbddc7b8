"""Best-two-fit packing of tokenised documents into sequences of fixed length.

Each document is tokenised whole, ended by an end id and, if longer than a sequence, cut into full pieces
behind a first piece that takes the remainder. Lengths are whole numbers up to the sequence length, so the
packing problem is a histogram of at most that many counts, whatever the corpus: only it goes to the driver.

There, best-two-fit runs on counts: a bin is filled greedily, largest fitting length first; then its
smallest document gives way to the two unpacked documents that fill the widened gap most tightly, if they
fill it better. The same bin is repeated while its lengths last, so a plan is a list of (pattern, repeats).
Each pattern gives, per length, the interval of that length's documents it takes; a document finds its
sequence and offset from its rank among the documents of its length. Ranks come from per-task counters
written with the rows and summed counts per (task, length): no length's documents are ever gathered.

Defined results: null text is an empty document of one end id; repeated rows are packed as often as they
occur; null ids pass through; an empty table gives no rows; extra columns are ignored. The literal text of
the vocabulary's special token is that token's one id, as the tokenizer has it by default.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import Scratch, bounded_batches

VOCABULARY = "byte_bpe_50k.tiktoken"
LENGTH = 2048
#: Space-delimited words whose ids a worker remembers, and the longest word that it does.
REMEMBERED, LONGEST = 120_000, 40
#: The added token of the vocabulary's tokenizer file, and its id.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
SPECIAL_BYTES = SPECIAL_ID.to_bytes(4, "little")
#: White space on both sides of a space, or before one at the end, is one token there: such texts are encoded whole.
_MIXED_SPACE = re.compile(r"\s \s|\s \Z")


class Encoder:
    """Byte-level BPE ids of texts as little-endian uint32 bytes, with the ids of words remembered.

    A token never reaches over a space into the word before it, so a text's ids are those of its words,
    each with the space before it, end to end; ``_MIXED_SPACE`` texts are the exception.
    """

    def __init__(self, vocabulary: str = VOCABULARY):
        import public_tokenizers
        import tiktoken

        path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._plain = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        plain = self._plain

        class Known(dict):
            def __missing__(self, word: str) -> bytes:
                ids = np.array(plain(" " + word), dtype="<u4").tobytes()
                if len(word) <= LONGEST and len(self) < REMEMBERED:
                    self[word] = ids
                return ids

        self._known = Known()

    def document(self, text: str) -> bytes:
        """Ids of a document: the literal of the special token is its id, and the texts around it are encoded each by itself."""
        if SPECIAL not in text:
            return self.ids(text)
        return SPECIAL_BYTES.join(self.ids(part) if part else b"" for part in text.split(SPECIAL))

    def ids(self, text: str) -> bytes:
        """Ids of ordinary text."""
        if _MIXED_SPACE.search(text):
            return np.array(self._plain(text), dtype="<u4").tobytes()
        first, *words = text.split(" ")
        return np.array(self._plain(first), dtype="<u4").tobytes() + b"".join(map(self._known.__getitem__, words))


@lru_cache(maxsize=2)
def _encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


def pieces(ids: bytes, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of a document's pieces: a first one with the remainder, then full ones."""
    total = len(ids) // 4
    first = total % length or min(total, length)
    cuts = [0, *range(first, total + 1, length)]
    return [(a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for a, b in zip(cuts, cuts[1:], strict=False)]


def best_two_fit(counts: np.ndarray) -> list[tuple[int, list[tuple[int, int]]]]:
    """(repeats, [(length, how many), ...]) until every document is packed. counts[n]: documents of length n; bins hold len(counts) - 1."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    size = len(left) - 1
    plan = []
    while True:
        lengths = np.flatnonzero(left)
        if not len(lengths):
            return plan
        gap, bin_, k = size, {}, len(lengths) - 1
        while gap and k >= 0:
            k = min(k, int(np.searchsorted(lengths, gap, side="right")) - 1)
            if k < 0:
                break
            n = int(lengths[k])
            take = min(int(left[n]), gap // n)
            bin_[n] = take
            gap -= take * n
            k -= 1
        if gap and len(bin_):
            smallest = min(bin_)
            room = gap + smallest
            rest = left[lengths].copy()
            rest[np.searchsorted(lengths, list(bin_))] -= list(bin_.values())
            free = lengths[rest > 0]
            a = free[free < room]
            if len(a):
                at = np.searchsorted(free, room - a, side="right") - 1
                fits = at >= 0
                b = free[np.maximum(at, 0)]
                twice = (b == a) & (rest[np.searchsorted(lengths, a)] < 2)
                # The only free document of its length cannot be taken twice: the next smaller one stands in.
                at = np.where(twice, at - 1, at)
                b, fits = free[np.maximum(at, 0)], fits & (at >= 0)
                sums = np.where(fits, a + b, 0)
                best = int(sums.argmax())
                if sums[best] > smallest:
                    for n, step in ((smallest, -1), (int(a[best]), 1), (int(b[best]), 1)):
                        bin_[n] = bin_.get(n, 0) + step
                    bin_ = {n: c for n, c in bin_.items() if c}
        repeats = min(int(left[n]) // c for n, c in bin_.items())
        for n, c in bin_.items():
            left[n] -= repeats * c
        plan.append((repeats, sorted(bin_.items(), reverse=True)))


def places(plan: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """Where the documents of each length go: (length, first rank, end rank, sequence base, how many a sequence, offset).

    The document of rank r in an interval goes to sequence base + (r - first) // many, at
    offset + (r - first) % many * length. Intervals are as many as there are lengths in the plan's patterns.
    """
    rows, used, base = [], {}, 0
    for repeats, bin_ in plan:
        offset = 0
        for n, c in bin_:
            first = used.get(n, 0)
            used[n] = first + repeats * c
            rows.append((n, first, used[n], base, c, offset))
            offset += n * c
        base += repeats
    return rows


def pack(docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row of ``docs``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "packing")
    end = int(end_id).to_bytes(4, "little")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = _encoder(vocabulary).document, TaskContext.get().partitionId()
        seen = np.zeros(length + 1, dtype=np.int64)
        for batch in batches:
            index, found = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                got = pieces((encode(text) if text else b"") + end, length)
                index += [i] * len(got)
                found += [(k, *piece) for k, piece in enumerate(got)]
            t = np.array(found, dtype=np.int64).reshape(-1, 4)
            n = t[:, 2]
            order = np.argsort(n, kind="stable")
            counts = np.bincount(n, minlength=length + 1)
            local = np.empty(len(n), dtype=np.int64)
            local[order] = np.arange(len(n)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(seen, counts)
            seen += counts
            ids = batch.column("doc_id").take(pa.array(index, pa.int64()))
            columns = [ids, pa.array(t[:, 0].astype(np.int32)), pa.array(t[:, 1]), pa.array(n), pa.array(t[:, 3]), pa.array(np.full(len(n), task, dtype=np.int32)), pa.array(local)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "local"])

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, local long"
    rows = scratch.save(docs.select("doc_id", "text").mapInArrow(cut, schema), "pieces")
    per_task = rows.groupBy(F.col("length").alias("o_length"), F.col("task").alias("o_task")).agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(length + 1, dtype=np.int64)
    for n, c in rows.groupBy("length").agg(F.count(F.lit(1))).collect():  # at most ``length`` rows
        counts[n] = c
    intervals = spark.createDataFrame(places(best_two_fit(counts)), "p_length long, first long, end long, base long, many long, at long")
    run = Window.partitionBy("o_length").orderBy("o_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.select("o_length", "o_task", F.coalesce(F.sum("n").over(run), F.lit(0)).alias("before"))
    ranked = rows.join(offsets, (rows["length"] == offsets["o_length"]) & (rows["task"] == offsets["o_task"]))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("local")).alias("rank"))
    # The plan is bounded by the sequence length, whatever the corpus, so it may be broadcast.
    placed = ranked.join(F.broadcast(intervals), (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
    nth = F.col("rank") - F.col("first")
    sequence = F.col("base") + F.floor(nth / F.col("many")).cast("long")
    offset = F.col("at") + nth % F.col("many") * F.col("length")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), offset.alias("offset"))
