"""Incremental sufficient statistics (an extension; nothing else here streams).

Counts, sums and sums of squares merge, so windows of a stream add up to what a batch would compute.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MERGE = ("n", "total", "squares")


def events_stream(spark, path: str, schema) -> DataFrame:
    """A file stream of events; ts becomes a timestamp that watermarks accept."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """n, sum and sum of squares per (window, unit, context); rows later than the watermark are left out."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    stats = marked.groupBy(F.window("ts", width), F.col("user_id").alias("unit"), F.col("event_type").alias("context")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.sum(F.col("value") * F.col("value")).alias("squares")
    )
    return stats.select(F.col("window.start").alias("start"), "unit", "context", *MERGE)


def merged(parts: DataFrame, *keys: str) -> DataFrame:
    """Statistics added up over windows; mean and population variance follow from them."""
    out = parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in MERGE])
    mean = F.col("total") / F.col("n")
    return out.withColumns({"mean": F.round(mean, 6), "variance": F.round(F.col("squares") / F.col("n") - mean * mean, 4)})
