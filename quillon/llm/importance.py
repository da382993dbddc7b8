"""Resampling of documents towards a target distribution, by an external sort-count of hashed features.

Features of a text are its runs of 1 to ``max_n`` words, hashed to fewer than 65,537 buckets. One pass over the
texts writes packed streams: a block has the buckets of its documents' features as uint16 in reading order, and
each document's place in the stream. Counting reads the streams alone: each block is sorted and run-length
encoded, and Spark sums the runs of a bucket. From the counts of all documents and of all target texts comes
a gain a bucket (``buckets`` numbers, the one thing that goes to every task); a second pass over the streams looks the
gains up and sums them a document with ``np.add.reduceat``. No text is read twice and no feature is a row.

A document's weight is the floored mean of its gains, its score the weight plus seeded Gumbel noise, so that the
highest scores are a sample without replacement in proportion to exp(weight / 1000). The draw finds the score
at the border from the counts of the scores (integers within 35,000 of each side of zero), and numbers
what lies above it with ``ordinals``: rows dealt to ranges of (score, doc_id), never sorted in one task.

Defined results: null and empty texts have no features, weight 0, and are never drawn when ``min_words`` > 0; a null
doc_id has noise of the seed alone and comes last among equal scores; repeated rows are documents of their own;
ties go to the smaller doc_id; without documents or target texts the counts are zero and nothing fails; columns
besides doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import Scratch, bounded_batches
from quillon.operators.order import ordinals

#: Words of a text whose A-Z are lower-cased, as UTF-8 bytes: digits, a-z and all that is not ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: So many words' hashes are remembered by a task.
REMEMBERED = 1 << 18
_STREAMS = "doc_ids array<bigint>, words array<bigint>, starts array<bigint>, stream binary"
_SCORED = "doc_id bigint, n_features bigint, n_words bigint, weight bigint, score bigint"


def _hashed(text: bytes, max_n: int, buckets: int, known: dict[bytes, int]) -> tuple[int, np.ndarray]:
    """Number of words of a text and the buckets of its features."""
    words = WORD.findall(text.lower())
    if len(known) > REMEMBERED:
        known.clear()
    out = []
    for n in range(1, max_n + 1):
        runs = words if n == 1 else [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
        for run in runs:
            at = known.get(run)
            if at is None:
                at = known[run] = zlib.crc32(run) % buckets
            out.append(at)
    return len(words), np.array(out, np.uint16)


def streams(docs: DataFrame, text_id: str = "doc_id", max_n: int = 1, buckets: int = 10_000) -> DataFrame:
    """Blocks of documents: their ids, word counts, first places in the block's stream, and the stream of uint16 buckets."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets must fit 16 bits")
    bounded_batches(docs.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            counts, parts = [], []
            for text in batch.column(1).cast(pa.binary()):
                n, found = _hashed(text.as_py() or b"", max_n, buckets, known)
                counts.append(n)
                parts.append(found)
            starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]]).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())),
                    pa.array([counts], pa.list_(pa.int64())),
                    pa.array([starts.tolist()], pa.list_(pa.int64())),
                    pa.array([np.concatenate(parts).astype("<u2").tobytes()], pa.binary()),
                ],
                names=["doc_ids", "words", "starts", "stream"],
            )

    return docs.select(F.col(text_id).cast("long").alias("doc_id"), "text").mapInArrow(pack, _STREAMS)


def counts(packed: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """How often each bucket stands in all streams."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                ordered = np.sort(np.frombuffer(value.as_py(), "<u2"))
                first = np.flatnonzero(np.diff(ordered, prepend=-1)) if len(ordered) else np.zeros(0, np.int64)
                n = np.diff(np.append(first, len(ordered)))
                yield pa.RecordBatch.from_arrays([pa.array(ordered[first].astype(np.int32)), pa.array(n.astype(np.int64))], names=["bucket", "n"])

    summed = packed.select("stream").mapInArrow(runs, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in summed.collect():  # at most ``buckets`` rows
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandths of the log ratio of smoothed bucket shares, target to source."""
    size, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    ratio = [float((t + 1) * (s_all + size)) / float((s + 1) * (t_all + size)) for s, t in zip(source.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Floored thousandths of Gumbel noise, fixed by seed and id."""
    head = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8]
    return math.floor(-1000 * math.log(-math.log((int(head, 16) + 0.5) / 4294967296)))


def scores(packed: DataFrame, gain: np.ndarray, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, n_words, weight, score of every document of the streams."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, words, starts, stream in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                buckets = np.frombuffer(stream, "<u2")
                first = np.array(starts, np.int64)
                size = np.diff(np.append(first, len(buckets)))
                total, some = np.zeros(len(first), np.int64), size > 0
                if some.any():  # empty documents have no place of their own, which reduceat would not allow
                    total[some] = np.add.reduceat(gain[buckets], first[some])
                weight = total // np.maximum(size, 1)
                score = weight + np.array([noise(i, seed) for i in ids], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, size, words, weight, score)], names=["doc_id", "n_features", "n_words", "weight", "score"])

    return packed.select("doc_ids", "words", "starts", "stream").mapInArrow(gather, _SCORED)


def draw(scored: DataFrame, scratch: Scratch, pct: int = 10, min_words: int = 20) -> DataFrame:
    """``scored`` with rank: 1, 2, ... of the drawn documents, null of all others."""
    fit = F.col("n_words") >= min_words
    rows = np.array([tuple(r) for r in scored.where(fit).groupBy("score").count().collect()], np.int64).reshape(-1, 2)
    rows = rows[np.argsort(-rows[:, 0])]
    size = pct * int(rows[:, 1].sum()) // 100
    if not size:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    border = int(rows[np.searchsorted(np.cumsum(rows[:, 1]), size), 0])
    above = fit & (F.col("score") >= border)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("n_words")]
    numbered = ordinals(scored.where(above), order, "rank", lambda df: scratch.save(df, "drawn"))
    numbered = numbered.withColumn("rank", F.when(F.col("rank") <= size, F.col("rank")))
    return numbered.unionByName(scored.where(~above).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, target_id: str = "item_id", max_n: int = 1, buckets: int = 10_000, pct: int = 10, min_words: int = 20, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, n_words, weight, score and rank of every document; drawn are floor(pct / 100) of those with ``min_words``."""
    scratch = Scratch(docs.sparkSession, "importance")
    packed = scratch.save(streams(docs, "doc_id", max_n, buckets), "streams")
    gain = gains(counts(packed, buckets), counts(streams(target, target_id, max_n, buckets), buckets))
    return draw(scratch.save(scores(packed, gain, seed), "scores"), scratch, pct, min_words)


#: DuckDB SQL of op11. The crc32 table comes from its polynomial; words are hashed once each.
SQL = r"""
WITH RECURSIVE poly AS (
  SELECT i::BIGINT AS i, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM poly WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM poly WHERE k = 8),
low AS (
  SELECT doc_id, true AS is_doc, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
  UNION ALL
  SELECT item_id, false, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
word AS (SELECT doc_id, is_doc, unnest(ws) AS w FROM low),
hashed AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(encode(w)) + 1), lambda j: ('0x' || substr(hex(encode(w)), (2 * j - 1)::BIGINT, 2))::BIGINT)),
    lambda a, b: xor(t[(xor(a, b) % 256) + 1], a >> 8)), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT w FROM word), crc),
n AS (SELECT bucket, count(*) FILTER (is_doc) AS s, count(*) FILTER (NOT is_doc) AS t FROM word JOIN hashed USING (w) GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln(((t + 1) * ((sum(s) OVER ()) + 10000))::DOUBLE / ((s + 1) * ((sum(t) OVER ()) + 10000))::DOUBLE))::BIGINT AS g FROM n),
weighed AS (
  SELECT d.doc_id, len(d.ws)::BIGINT AS n_features, floor(coalesce(x.g, 0) / greatest(len(d.ws), 1))::BIGINT AS weight
  FROM (SELECT * FROM low WHERE is_doc) d LEFT JOIN (SELECT doc_id, sum(g)::BIGINT AS g FROM word JOIN hashed USING (w) JOIN gain USING (bucket) WHERE is_doc GROUP BY doc_id) x USING (doc_id)),
scored AS (
  SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM weighed),
drawn AS (
  SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS r,
    (10 * (count(*) FILTER (n_features >= 20) OVER ())) // 100 AS k FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= k THEN r END AS rank FROM drawn
"""
