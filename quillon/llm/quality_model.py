"""Quality classifier: histogram gradient-boosted trees over document statistics.

``document_statistics`` turns a whole text into a fixed row of numbers (nothing but the text goes in).
``fit`` bins every statistic at its training quantiles and grows depth-limited trees level by level from
gradient histograms of the logistic loss. A fitted ``Forest`` is three arrays (feature, threshold, leaf
value) of complete binary trees, so scoring walks all trees of a batch at once with array lookups.

Training rows are a bounded sample: labelled ids are ordered by hash and at most ``sample`` of them kept, so
what is broadcast, and what comes to the driver (statistics, never texts), has a fixed bound.

Defined results: null text counts as empty; an empty text is scored like any other; rows with null
doc_id are scored but never learnt from; labels with null doc_id or quality are ignored and repeated
labels each count; with labels of one kind or none, every score is the share of that kind (0.5 if none);
clashing extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import bounded_batches, first_rows

SAMPLE = 12_000

#: Byte classes that are counted; classes may overlap.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "space": b" \t\n\r\x0b\x0c",
    "newline": b"\n",
    "stop": b".,;:",
    "shout": b"!?",
    "symbol": b"#*$%&|<>@^~\\/=+_{}[]",
    "high": bytes(range(128, 256)),
}
_CLASS = np.array([[b in members for members in CLASSES.values()] for b in range(256)], dtype=np.float64)
STATISTICS = (
    *[f"{name}_share" for name in CLASSES],
    "log_words", "mean_word", "sd_word", "long_words", "distinct_words", "same_next",
    "log_lines", "distinct_lines", "words_per_line", "top_word", "deflate", "byte_entropy", "marked_words", "worst_part_marks", "worst_part_upper",
)
_MARK = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>!?^~", dtype=np.uint8))
_SPACE = np.isin(np.arange(256), np.frombuffer(CLASSES["space"], dtype=np.uint8))
_UPPER = np.isin(np.arange(256), np.frombuffer(CLASSES["upper"], dtype=np.uint8))
PARTS = 8


def document_statistics(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    n, size = len(words), max(len(raw), 1)
    bytes_ = np.frombuffer(raw, dtype=np.uint8)
    counts = np.bincount(bytes_, minlength=256)
    shares = (counts @ _CLASS / size).tolist()
    if not n:
        return shares + [0.0] * (len(STATISTICS) - len(shares))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    tally = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    p = counts[counts > 0] / size
    # A word is marked if its last byte is a symbol or a mark of shouting.
    ends = np.flatnonzero(_SPACE[bytes_[1:]] & ~_SPACE[bytes_[:-1]]) if len(raw) > 1 else np.array([], dtype=np.int64)
    marks = _MARK[bytes_[ends]]
    share = lambda x: float(x.mean()) if len(x) else 0.0
    parts = min(PARTS, max(1, n // 20))
    return shares + [
        math.log1p(n),
        float(lengths.mean()),
        float(lengths.std()),
        float((lengths > 12).mean()),
        len(tally) / n,
        sum(map(eq, words[1:], words)) / n,
        math.log1p(len(lines)),
        len(set(lines)) / max(len(lines), 1),
        n / max(len(lines), 1),
        max(tally.values()) / n,
        len(zlib.compress(raw, 1)) / size,
        float(-(p * np.log2(p)).sum()),
        share(marks),
        max(share(x) for x in np.array_split(marks, parts)),
        max(share(_UPPER[x]) for x in np.array_split(bytes_, parts)),
    ]


@dataclass(frozen=True)
class Forest:
    """Complete binary trees of one depth: node k of tree t asks x[feature[t, k]] > threshold[t, k]."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        margin = np.full(len(x), self.base)
        if len(x) and len(self.feature):
            trees, inner = self.feature.shape
            node = np.zeros((len(x), trees), dtype=np.int64)
            tree = np.arange(trees)
            rows = np.arange(len(x))[:, None]
            for _ in range(int(math.log2(inner + 1))):
                node = 2 * node + 1 + (x[rows, self.feature[tree, node]] > self.threshold[tree, node])
            margin = margin + self.value[tree, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-margin))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, bins: int = 64, rate: float = 0.1, penalty: float = 2.0, least: float = 3.0) -> Forest:
    """Boosted trees on binned statistics; ``least`` is the smallest hessian sum of a leaf, in rows of a coin flip / 4."""
    x, y = np.asarray(x, dtype=np.float64), np.asarray(y, dtype=np.float64)
    inner = (1 << depth) - 1
    p = y.mean() if len(y) else 0.5
    empty = Forest(0.0 if not len(y) else float(np.clip(np.log((p + 1e-6) / (1 - p + 1e-6)), -8, 8)), np.zeros((0, inner), dtype=np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if not len(y) or p in (0.0, 1.0):
        return empty
    rows, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    flat = binned + np.arange(width) * bins
    limit = np.array([len(e) for e in edges])  # bin b of f holds x <= edges[f][b]
    margin = np.full(rows, empty.base)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-margin))
        g, h = prob - y, prob * (1 - prob)
        node = np.zeros(rows, dtype=np.int64)
        feature, threshold = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        for level in range(depth):
            count, first = 1 << level, (1 << level) - 1
            index = ((node - first)[:, None] * (width * bins) + flat).ravel()
            hist = [np.bincount(index, weights=np.repeat(v, width), minlength=count * width * bins).reshape(count, width, bins).cumsum(axis=2) for v in (g, h)]
            left_g, left_h = hist
            all_g, all_h = left_g[:, :1, -1:], left_h[:, :1, -1:]
            right_g, right_h = all_g - left_g, all_h - left_h
            gain = left_g**2 / (left_h + penalty) + right_g**2 / (right_h + penalty) - all_g**2 / (all_h + penalty)
            allowed = (left_h >= least / 4) & (right_h >= least / 4) & (np.arange(bins)[None, None, :] < limit[None, :, None])
            gain = np.where(allowed, gain, -np.inf).reshape(count, -1)
            best = gain.argmax(axis=1)
            for k in range(count):
                if gain[k, best[k]] > 1e-6:
                    f, b = divmod(int(best[k]), bins)
                    feature[first + k], threshold[first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(rows), feature[node]] > threshold[node])
        leaf = node - inner
        sums = [np.bincount(leaf, weights=v, minlength=inner + 1) for v in (g, h)]
        value = -rate * sums[0] / (sums[1] + penalty)
        margin += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Forest(empty.base, np.stack(features), np.stack(thresholds), np.stack(values))


def training_rows(docs: DataFrame, labels: DataFrame, learn_from=None, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """(statistics, label) of at most ``sample`` labelled documents, in an order that reruns keep.

    Rows of one doc_id, label and text count once; of labelled doc_ids with several texts no more than ``sample`` rows come.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    usable = usable.where(learn_from(F.col("doc_id"))) if learn_from is not None else usable
    chosen = usable.select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("__y")).orderBy(F.xxhash64("__id"), "__y").limit(sample)
    texts = docs.select("doc_id", "text")  # alone: no other column's name can clash
    joined = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select("text", F.col("__y").alias("y"), F.col("__id").alias("id"), F.xxhash64("text").alias("h"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [document_statistics(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("id"), batch.column("h"), pa.array(x, pa.list_(pa.float64()))], names=["y", "id", "h", "x"])

    kind = chosen.schema["__id"].dataType.simpleString()
    rows = joined.mapInArrow(measured, f"y int, id {kind}, h bigint, x array<double>").dropDuplicates(["id", "y", "h"])
    table = first_rows(rows, ["id"], "h", sample).select("y", "x").toArrow()
    y = np.array(table.column("y").to_pylist(), dtype=np.float64)
    x = np.array(table.column("x").to_pylist(), dtype=np.float64).reshape(len(y), len(STATISTICS))
    order = np.lexsort(np.column_stack([x, y]).T) if len(y) else []
    return x[order], y[order]


def score(docs: DataFrame, forest: Forest, column: str = "score") -> DataFrame:
    """``docs`` with one more column: the probability that a whole text is good."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index("text")
    schema = docs.drop(column).withColumn(column, F.lit(0.0)).schema
    dropped = [i for i, c in enumerate(docs.columns) if c != column]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([document_statistics(t) for t in batch.column(at).to_pylist()], dtype=np.float64).reshape(batch.num_rows, len(STATISTICS))
            columns = [batch.column(i) for i in dropped]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(forest.score(x))], names=schema.names)

    return docs.mapInArrow(scored, schema)


def classify(docs: DataFrame, labels: DataFrame, learn_from=None, sample: int = SAMPLE, column: str = "score", **options) -> DataFrame:
    """Fit on the labelled documents that ``learn_from`` allows and score every document into ``column``."""
    return score(docs, fit(*training_rows(docs, labels, learn_from, sample), **options), column)
