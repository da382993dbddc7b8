"""Writers: tables, one-row summaries, enrichment in a new version, fail-closed guards, text tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, order: Sequence[str] = (), digits: int | None = None) -> None:
    """B1: overwrite a Parquet table, sorted within files by ``order``, doubles rounded to ``digits``."""
    if digits is not None:
        df = df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})
    (df.sortWithinPartitions(*order) if order else df).write.mode("overwrite").parquet(path)


def export_csv(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """B1: one CSV with a header in total order; lists are joined by ;."""
    flat = df.select(*[F.concat_ws(";", c).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])
    flat.orderBy(*order).coalesce(1).write.mode("overwrite").csv(path, header=True)


def summary_document(df: DataFrame, **nested: DataFrame) -> str:
    """B2: a one-row table and lists of rows as one JSON object."""
    import json

    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a summary is one row")
    return json.dumps(rows[0].asDict(True) | {k: [r.asDict(True) for r in v.collect()] for k, v in nested.items()}, default=str, sort_keys=True)


def enrich(table: DataFrame, columns: DataFrame, key: str) -> DataFrame:
    """Columns annotated by a left join, dropped first if there already: doing it twice changes nothing. Order is data."""
    new = [c for c in columns.columns if c != key]
    return table.drop(*new).join(columns, key, "left")


def guarded_write(df: DataFrame, path: str, rho: float | None, limit: float = 0.15) -> None:
    """Refuse to write unless |rho| is known and under the limit."""
    if rho is None or not abs(rho) < limit:
        raise ValueError(f"confound meter {rho} is not under {limit}: nothing is written")
    df.write.mode("overwrite").parquet(path)


def write_tensor(cells: DataFrame, path: str) -> None:
    """The tensor as rows (unit, context, profile, support, in_panel), overwritten; an absent row is the mask."""
    cells.select("unit", "context", F.col("profile").cast("array<float>").alias("profile"), F.col("support").cast("double").alias("support"), F.col("in_panel").cast("boolean").alias("in_panel")).write.mode("overwrite").parquet(path)


def read_tensor(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_tensor`` wrote."""
    return spark.read.schema("unit long, context string, profile array<float>, support double, in_panel boolean").parquet(path)


def report(sections: Sequence[tuple[str, DataFrame | None, int]]) -> str:
    """A text of titled tables (title, table, most rows); a section whose table is missing or empty is left out."""
    parts = [f"## {title}\n\n{markdown(df, limit)}" for title, df, limit in sections if df is not None and not df.isEmpty()]
    return "\n\n".join(parts)


def markdown(df: DataFrame, limit: int = 30) -> str:
    """The first rows as a text table."""
    rows = df.limit(limit).collect()
    lines = [df.columns, ["---"] * len(df.columns), *[[str(v) for v in r] for r in rows]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)
