"""What the corpus operators share: shared-folder tables, Arrow batch limits, table reading, fixed patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.sources.shared import Scratch, shared_root

__all__ = ["Scratch", "shared_root", "table", "bounded_batches", "fold", "words_of", "word_count", "first_rows"]

#: White space that separates words, and words, as every contract of this package has them.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\u000b\u000c\r"

#: Rows and bytes of one Arrow batch: bounds a Python worker's memory when texts are long.
BATCH_ROWS = 256
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Lower (never raise) the session's Arrow batch size so that a batch of long texts fits a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def fold(column, parts: int):
    """crc32 of an id as text, modulo parts: the held-out rule of the contracts (null ids: null)."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(parts)


def words_of(text):
    """Array of the words of a text; null text has none. Splits: replacing by pattern costs ten times as much."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"{SPACE}+"))


def word_count(text):
    """Number of maximal runs of non-space characters; null text has none."""
    return F.size(words_of(text)).cast("long")


def first_rows(rows: DataFrame, keys: list[str], order: str, most: int) -> DataFrame:
    """At most ``most`` rows: every key's first by ``order``, then every key's second, and so on.

    Spark cuts each key to ``most`` rows before and after its shuffle, so that no key is held whole.
    """
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("__nth", nth).where(F.col("__nth") <= most).orderBy("__nth", order, *keys).limit(most).drop("__nth")
