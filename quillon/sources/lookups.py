"""Lookups of remote annotation: paginated and batched fetchers with caches, and downloads that happen once.

The fetch function is a parameter, so that no address is built in and tests need no network.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


class PaginatedSource(DataSource):
    """Pages of (key, score) rows from a fetch function; one partition a page, each retried.

    ``PaginatedSource.bound(fetch, pages)`` gives a class to register; fetch(page) returns rows.
    """

    fetch: Callable[[int], Sequence[tuple[str, float]]]
    pages, tries, wait = 8, 3, 0.0

    @classmethod
    def bound(cls, source: str, fetch: Callable[[int], Sequence[tuple[str, float]]], pages: int = 8, tries: int = 3, wait: float = 0.0) -> type[DataSource]:
        return type("Bound", (cls,), {"fetch": staticmethod(fetch), "pages": pages, "tries": tries, "wait": wait, "name": classmethod(lambda _: source)})

    def schema(self) -> str:
        return "key string, score double"

    def reader(self, schema) -> DataSourceReader:
        return PageReader(type(self).fetch, self.pages, self.tries, self.wait)


class PageReader(DataSourceReader):
    def __init__(self, fetch, pages: int, tries: int, wait: float):
        self.fetch, self.pages, self.tries, self.wait = fetch, pages, tries, wait

    def partitions(self) -> list[Page]:
        return [Page(k) for k in range(self.pages)]

    def read(self, partition: Page):
        for attempt in range(self.tries):
            try:
                yield from list(self.fetch(partition.number))
                return
            except OSError:
                if attempt + 1 == self.tries:
                    raise
                time.sleep(self.wait)


def best_scores(rows: DataFrame) -> DataFrame:
    """The greatest score of each key."""
    return rows.groupBy("key").agg(F.max("score").alias("score"))


def lookup(spark: SparkSession, keys: DataFrame, fetch: Callable[[Sequence[str]], Iterable[tuple]], schema: str, cache: str, batch: int = 900) -> DataFrame:
    """Attributes of keys in batches; only keys that the cache lacks are fetched, and added to it. A key without attributes aborts the whole fetch.

    ``schema`` starts with the key column. Batches are fetched by tasks, and a fetch that fails adds nothing.
    """
    key = schema.split()[0]
    wanted = keys.select(F.col(keys.columns[0]).alias(key)).distinct()
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        known = spark.read.schema(schema).parquet(cache)
        lacking = wanted.join(known, key, "left_anti")
        if lacking.isEmpty():
            return wanted.join(known, key)
    else:
        lacking = wanted

    def pull(batches):
        import pandas as pd

        names = [c.split()[0] for c in schema.split(", ")]
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                asked = pdf[key].iloc[at : at + batch].tolist()
                found = pd.DataFrame(list(fetch(asked)), columns=names)
                if missing := set(asked) - set(found[key]):
                    raise LookupError(f"{len(missing)} keys have no attributes, nothing is made up for them")
                yield found

    lacking.mapInPandas(pull, schema).write.mode("append").parquet(cache)
    return wanted.join(spark.read.schema(schema).parquet(cache), key)


def download_once(path: str | Path, fetch: Callable[[], bytes]) -> Path:
    """The local copy, fetched if absent; written aside and renamed, so a broken download leaves nothing."""
    path = Path(path)
    if not path.exists():
        part = path.with_suffix(path.suffix + ".part")
        part.write_bytes(fetch())
        part.rename(path)
    return path


def hits_table(rows: DataFrame, least: float = 0.01) -> DataFrame:
    """Per key the number of groups scoring at least ``least`` and the greatest score, in rank order."""
    per = rows.groupBy("key").agg(F.sum((F.col("score") >= least).cast("long")).alias("n_groups"), F.max("score").alias("best"))
    return per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("n_groups").desc(), F.col("best").desc(), "key")).cast("long"))
