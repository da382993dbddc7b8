"""How the operators' schema (unit, context, response, gate, ...) binds to the star-schema tables.

The same bindings are given as SQL common table expressions for the equivalents in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.exprs import whole_pearson, whole_pearson_sql
from quillon.sources.shared import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str, *measures: Column | str) -> DataFrame:
    """Lines with unit and context; their measures are made before the join, which moves small whole numbers."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("context"), *measures)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("unit"))
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).drop("l_orderkey", "o_orderkey")


def _hundredths(c: str) -> Column:
    return F.round(F.col(c) * 100).alias(c)


def _large() -> Column:
    return F.when(F.col("l_quantity") > 25, 1).otherwise(0).alias("large")


def _contrast_columns() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("support"),
        F.sum("large").cast("long").alias("response"),
        (F.sum(F.col("l_discount").cast("long")) >= 5 * F.count(F.lit(1))).alias("gate"),
        ((F.max(F.col("l_tax").cast("long")) >= 8) & (F.count(F.lit(1)) >= 6)).alias("penalty_flag"),
    ]


def contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (unit, context): customers and return flags. The gate is integer arithmetic, so no rounding order matters."""
    cents = [_hundredths(c).cast("long").alias(c) for c in ("l_discount", "l_tax")]
    return _lines(spark, sf_dir, _large(), *cents).groupBy("unit", "context").agg(*_contrast_columns())


def written_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``contrast`` written once, for what reads it more than once."""
    return Scratch(spark, "contrast").save(contrast(spark, sf_dir), "contrast")


CONTRAST = """contrast AS (
  SELECT o.o_custkey AS unit, l.l_returnflag AS context, CAST(COUNT(*) AS BIGINT) AS support,
         CAST(SUM(CASE WHEN l.l_quantity > 25 THEN 1 ELSE 0 END) AS BIGINT) AS response,
         SUM(CAST(ROUND(l.l_discount * 100) AS BIGINT)) >= 5 * COUNT(*) AS gate,
         MAX(CAST(ROUND(l.l_tax * 100) AS BIGINT)) >= 8 AND COUNT(*) >= 6 AS penalty_flag
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY 1, 2)"""


def replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reproducibility metadata per (unit, context): correlations of quantity with two other measures, to six digits (null below three lines).

    Measures are whole hundredths, so the sums are exact in any order: a correlation that ends in a half at the seventh
    digit (23/128) is rounded away from zero by every engine, whichever way its rows come.
    """
    lines = _lines(spark, sf_dir, "l_linenumber", *map(_hundredths, ("l_quantity", "l_discount", "l_tax")))
    return lines.groupBy("unit", "context").agg(*_replicate_columns())


def _replicate_columns() -> list[Column]:
    corr = lambda c: F.when(F.count(F.lit(1)) >= 3, whole_pearson(F.col("l_quantity"), F.col(c)))
    return [
        corr("l_discount").alias("guide_corr"),
        corr("l_tax").alias("donor_corr"),
        F.coalesce(F.min("l_linenumber") == F.max("l_linenumber"), F.lit(False)).alias("single"),
    ]


def written_evidence(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``contrast`` and ``replicates`` from one pass over the lines, written once.

    A unit has few lines in a context and fifteen sums of them: lines go to their unit as they are, not as sums of one line each.
    """
    lines = _lines(spark, sf_dir, "l_linenumber", _large(), *map(_hundredths, ("l_quantity", "l_discount", "l_tax")))
    both = lines.repartition("unit", "context").groupBy("unit", "context").agg(*_contrast_columns(), *_replicate_columns())
    both = Scratch(spark, "contrast").save(both, "evidence")
    return both.select("unit", "context", "support", "response", "gate", "penalty_flag"), both.select("unit", "context", "guide_corr", "donor_corr", "single")


REPLICATES = f"""replicates AS (
  SELECT unit, context, CASE WHEN COUNT(*) >= 3 THEN {whole_pearson_sql('q', 'd')} END AS guide_corr,
         CASE WHEN COUNT(*) >= 3 THEN {whole_pearson_sql('q', 't')} END AS donor_corr, COUNT(DISTINCT l_linenumber) = 1 AS single
  FROM (SELECT o.o_custkey AS unit, l.l_returnflag AS context, l_linenumber, ROUND(l_quantity * 100) AS q, ROUND(l_discount * 100) AS d, ROUND(l_tax * 100) AS t
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey) GROUP BY 1, 2)"""


def effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long effect table (unit, feature, y, se): customers and part types, log2 quantity against its mean."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    mean = lines.agg(F.avg(F.log2("l_quantity")).alias("m"))
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(parts, lines["l_partkey"] == parts["p_partkey"])
    n = F.count(F.lit(1))
    grouped = joined.groupBy(F.col("o_custkey").alias("unit"), F.col("p_type").alias("feature"))
    out = grouped.agg(n.alias("n"), F.avg(F.log2("l_quantity")).alias("a"), (F.stddev_samp(F.log2("l_quantity")) / F.sqrt(n)).alias("se")).where("n >= 2")
    return out.crossJoin(F.broadcast(mean)).select("unit", "feature", (F.col("a") - F.col("m")).alias("y"), "se")


EFFECTS = """effects AS (
  SELECT o.o_custkey AS unit, p.p_type AS feature, AVG(LOG2(l.l_quantity)) - (SELECT AVG(LOG2(l_quantity)) FROM lineitem) AS y,
         STDDEV_SAMP(LOG2(l.l_quantity)) / SQRT(COUNT(*)) AS se
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey
  GROUP BY 1, 2 HAVING COUNT(*) >= 2)"""


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unit, program, profile): embedding vectors and their labels."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("unit"), F.col("label").cast("string").alias("program"), F.col("embedding").cast("array<double>").alias("profile"))


PROFILES = """profiles AS (
  SELECT vec_id AS unit, CAST(label AS VARCHAR) AS program, CAST(embedding AS DOUBLE[]) AS profile FROM embeddings)"""


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unit, class): customers and their market segments."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("unit"), F.col("c_mktsegment").alias("class"))


CLASSES = "classes AS (SELECT c_custkey AS unit, c_mktsegment AS class FROM customer)"


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(set_name, member): distinct customers of each nation."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("set_name"), F.col("c_custkey").alias("member"))


MEMBERSHIPS = "memberships AS (SELECT n_name AS set_name, c_custkey AS member FROM customer JOIN nation ON c_nationkey = n_nationkey)"
