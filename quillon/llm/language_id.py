"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

A text's subwords are all runs of 1 to 4 bytes of its lower-cased UTF-8 form, white space reduced to one
mark. Each run is hashed into one of ``buckets`` embeddings; a text is the mean of its embeddings and a
softmax over it gives the language. Training visits documents in a seeded order, one SGD step each. A part
of the sample that is never trained on sets a temperature (least log loss) and, per language, the
confidence below which a prediction is rejected (``reject_share`` of right predictions would fall under it).

Scoring folds embeddings and softmax weights into one table of logits per bucket, exact because nothing
nonlinear lies between, and sums its rows over all subwords of the whole text in blocks of fixed size.

Training rows are a bounded sample, ``per_language`` rows of each language and ``sample`` in all, taken by
hash order; only bucket counts of these rows come to the driver.

Defined results: null text, or text without a letter, gives ``und`` with score 0 and is rejected; null lang
is never learnt; with no language to learn from all is ``und``; repeated rows are predicted alike; an
empty table gives no rows. Input columns pass through; clashing output names are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import bounded_batches, first_rows

UNKNOWN = "und"
BUCKETS = 1 << 15
ORDERS = (1, 2, 3, 4)
PER_LANGUAGE, SAMPLE = 400, 4_000
#: Bytes of text hashed at a time.
BLOCK = 1 << 18
LETTER = re.compile(r"[^\W\d_]")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[[9, 10, 11, 12, 13]] = 32
# Odd multipliers of the rolling hash.
_MULTIPLY = np.uint32(0x01000193)
_FINISH = np.uint32(0x9E3779B1)


def _plain(text: str) -> np.ndarray:
    return _LOWER[np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)]


def _hashes(b: np.ndarray, order: int, shift: int) -> np.ndarray:
    """Buckets of the runs of ``order`` bytes that start at each byte."""
    h = b[: len(b) - order + 1].astype(np.uint32) + np.uint32(order << 8)
    for k in range(1, order):
        h = h * _MULTIPLY + b[k : len(b) - order + 1 + k]
    return ((h * _FINISH) >> np.uint32(shift)).astype(np.int32)


def subword_counts(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in the whole text."""
    b, shift = _plain(text), 33 - buckets.bit_length()
    out = np.zeros(buckets, dtype=np.int64)
    for at in range(0, max(len(b), 1), BLOCK):
        for order in ORDERS:
            part = b[at : at + BLOCK + order - 1]
            if len(part) >= order:
                out += np.bincount(_hashes(part, order, shift), minlength=buckets)
    return out


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    logits: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float
    reject_under: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, calibrated probability, rejected) of a whole text."""
        if not self.languages or text is None or not LETTER.search(text):
            return UNKNOWN, 0.0, True
        b, shift = _plain(text), 33 - len(self.logits).bit_length()
        total, seen = np.zeros(len(self.languages)), 0
        for at in range(0, len(b), BLOCK):
            for order in ORDERS:
                part = b[at : at + BLOCK + order - 1]
                if len(part) >= order:
                    h = _hashes(part, order, shift)
                    total += np.take(self.logits, h, axis=0).sum(axis=0, dtype=np.float64) if len(h) < 1024 else np.bincount(h, minlength=len(self.logits)) @ self.logits
                    seen += len(h)
        z = (total / max(seen, 1) + self.bias) / self.temperature
        e = np.exp(z - z.max())
        p = e / e.sum()
        k = int(p.argmax())
        return self.languages[k], float(p[k]), bool(p[k] < self.reject_under[k])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(bags: list[tuple[np.ndarray, np.ndarray]], langs: list[str], buckets: int = BUCKETS, width: int = 16, epochs: int = 6, rate: float = 0.5, seed: int = 7, reject_share: float = 0.002) -> Model:
    """Train on (bucket indices, counts) bags; every fifth row of each language calibrates."""
    names = tuple(sorted(set(langs)))
    if not names:
        return Model((), np.zeros((buckets, 0), dtype=np.float32), np.zeros(0), 1.0, np.zeros(0))
    target = np.array([names.index(x) for x in langs])
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1, 1, (buckets, width)).astype(np.float32) / width
    weight, bias = np.zeros((width, len(names)), dtype=np.float32), np.zeros(len(names), dtype=np.float32)
    nth = np.zeros(len(target), dtype=np.int64)
    for k in range(len(names)):
        nth[target == k] = np.arange((target == k).sum())
    held = (nth % 5 == 4) if len(target) >= 50 else np.zeros(len(target), dtype=bool)
    train = np.flatnonzero(~held)
    shares = [(i, (c / c.sum()).astype(np.float32)) if len(i) else (i, c.astype(np.float32)) for i, c in bags]
    steps, done = epochs * len(train), 0
    for _ in range(epochs):
        for r in rng.permutation(train):
            lr = rate * (1 - done / steps)
            done += 1
            index, part = shares[r]
            if not len(index):
                continue
            hidden = part @ emb[index]
            err = _softmax(hidden @ weight + bias)
            err[target[r]] -= 1
            back = weight @ err
            weight -= lr * np.outer(hidden, err)
            bias -= lr * 0.1 * err
            # A mean's gradient is spread over its members: scaled up so that rare subwords move too.
            emb[index] -= (lr * 16) * np.outer(np.minimum(part * 4, 0.05), back)
    table = (emb.astype(np.float64) @ weight).astype(np.float32)
    check = np.flatnonzero(held) if held.any() else train
    z = np.array([(shares[r][1] @ table[shares[r][0]] if len(shares[r][0]) else np.zeros(len(names))) + bias for r in check])
    right = target[check]
    loss = lambda t: -np.log(_softmax(z / t)[np.arange(len(z)), right] + 1e-12).mean()
    temperature = float(min(np.geomspace(0.05, 8, 60), key=loss))
    p = _softmax(z / temperature)
    guess = p.argmax(axis=1)
    under = np.array([np.quantile(p[(guess == k) & (right == k), k], reject_share) if ((guess == k) & (right == k)).any() else 0.0 for k in range(len(names))])
    return Model(names, table, bias.astype(np.float64), temperature, under * (1 - 1e-9))


def _first_by_key(rows: DataFrame, least: int) -> DataFrame:
    """Rows that hold the ``least`` first of each language by key, and few more: a language may hold a third of all rows.

    Keys are hashes, so a share of their range that holds eight times as many rows on average nearly always
    holds enough; a language of which it does not (it has few ids) is passed on whole. ``rows`` are distinct.
    """
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("all_rows"))
    place = (F.col("key").cast("double") / float(1 << 63) + 1) / 2
    low = place * F.col("all_rows") <= 8.0 * least + 64
    placed = rows.join(counts.withColumnRenamed("lang", "c_lang"), F.col("lang") == F.col("c_lang")).drop("c_lang").withColumn("low", low)
    short = placed.groupBy("lang").agg((F.count_if("low") < F.least(F.lit(least), F.first("all_rows"))).alias("short")).where("short").select(F.col("lang").alias("s_lang"), "short")
    return placed.join(short, F.col("lang") == F.col("s_lang"), "left").where(F.col("low") | F.coalesce("short", F.lit(False))).select("doc_id", "lang", "key")


def training_bags(docs: DataFrame, learn_from=None, per_language: int = PER_LANGUAGE, sample: int = SAMPLE, buckets: int = BUCKETS):
    """Bags and languages of a bounded, seeded sample of documents with a language.

    Repeated ids are drawn once; rows of one id, language and text count once, and no more than ``sample`` rows come.
    """
    bounded_batches(docs.sparkSession)
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    usable = usable.where(learn_from(F.col("doc_id"))) if learn_from is not None else usable
    key = F.xxhash64("doc_id")
    first = _first_by_key(usable.select("doc_id", "lang", key.alias("key")).distinct(), per_language)
    ranked = first.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("key", "doc_id")))
    chosen = ranked.where(F.col("nth") <= per_language).orderBy("nth", "key").limit(sample).select(F.col("doc_id").alias("__id")).distinct()
    texts = docs.select("doc_id", "lang", "text")  # alone: no other column's name can clash
    rows = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"), "left_semi").where(F.col("lang").isNotNull())

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, count = [], []
            for text in batch.column("text").to_pylist():
                c = subword_counts(text or "", buckets) if text and LETTER.search(text) else np.zeros(buckets, dtype=np.int64)
                at = np.flatnonzero(c)
                index.append(at.astype(np.int32))
                count.append(c[at].astype(np.int32))
            ids = batch.column("doc_id").cast(pa.string())
            yield pa.RecordBatch.from_arrays([ids, batch.column("lang"), batch.column("h"), pa.array(index, pa.list_(pa.int32())), pa.array(count, pa.list_(pa.int32()))], names=["id", "lang", "h", "at", "n"])

    once = rows.withColumn("h", F.xxhash64("text")).mapInArrow(bags, "id string, lang string, h bigint, at array<int>, n array<int>").dropDuplicates(["id", "lang", "h"])
    t = first_rows(once, ["id", "lang"], "h", sample).select("id", "lang", "at", "n").toArrow()
    got = sorted(zip(t.column("id").to_pylist(), t.column("lang").to_pylist(), (np.asarray(x) for c in t.column("at").chunks for x in (c[i].values.to_numpy() for i in range(len(c)))), (np.asarray(x) for c in t.column("n").chunks for x in (c[i].values.to_numpy() for i in range(len(c)))), strict=True), key=lambda r: (r[0], r[1], len(r[2]), int(r[3].sum())))
    got = [r for r in got if len(r[2])]
    return [(r[2], r[3]) for r in got], [r[1] for r in got]


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score and rejected."""
    bounded_batches(docs.sparkSession)
    added = ("lang_pred", "score", "rejected")
    kept = [c for c in docs.columns if c not in added]
    at, keep = docs.columns.index("text"), [docs.columns.index(c) for c in kept]
    schema = docs.select(*kept, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected")).schema

    sent = docs.sparkSession.sparkContext.broadcast(model)  # buckets times languages, whatever the corpus

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            got = [model.predict(t) for t in batch.column(at).to_pylist()]
            columns = [batch.column(i) for i in keep]
            new = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*columns, *new], names=schema.names)

    return docs.mapInArrow(predicted, schema)


def learn(docs: DataFrame, learn_from=None, **options) -> Model:
    return fit(*training_bags(docs, learn_from), **options)
