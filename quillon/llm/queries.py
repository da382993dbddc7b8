"""The registered opN_<name> queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import filter_audit, importance, jaccard_join, license_scan, mixing, topk
from quillon.llm.common import fold, table
from quillon.llm.language_id import identify, learn
from quillon.llm.packing import pack
from quillon.llm.pii import BASE_KINDS, KINDS, find
from quillon.llm.quality_model import classify
from quillon.llm.quality_rules import quality_rules
from quillon.llm.sharding import shard
from quillon.llm.warc import page_derivatives


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from the folds other than 2 of 4."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = classify(docs, table(spark, sf_dir, "labels"), learn_from=lambda i: fold(i, 4) != 2)
    return scored.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best inner products of every hundredth vector with all others."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0, k=10)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from the folds other than 1 of 3."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.select("doc_id", "lang", "text"), learn_from=lambda i: fold(i, 3) != 1)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op4_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts and digest of the base kinds, and all spans."""
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")

    def named(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def of(*kinds):
        return F.filter("pii", lambda x: x["kind"].isin(*kinds))

    base = of(*BASE_KINDS)
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in KINDS]
    any_ = F.size("pii").cast("long").alias("n_any")
    return found.select("doc_id", *counts, any_, F.sha2(named(base), 256).alias("base_sha256"), named(F.col("pii")).alias("spans"))


def op5_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard, slot and next shard of every document, by the weighted hash tree."""
    return shard(table(spark, sf_dir, "documents"), shards=8)


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of the response record of every page."""
    return page_derivatives(table(spark, sf_dir, "pages"))


def op7_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence and offset of every piece of every document."""
    return pack(table(spark, sf_dir, "documents"))


def op8_parity_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of 3-word shingle sets with Jaccard similarity of at least 0.9."""
    found = jaccard_join.components(table(spark, sf_dir, "documents"), width=3, num=90, den=100)
    return found.select("doc_id", "n_shingles", "component_id")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that the mix takes, and its source's target."""
    return mixing.assign(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and adaptive verdict of every document."""
    return quality_rules(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document for a draw towards the benchmark's words."""
    found = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes, in all of their orders, per language."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates found in every document."""
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_classifier": op1_quality_classifier,
        "op2_exact_top_k": op2_exact_top_k,
        "op3_language_id": op3_language_id,
        "op4_pii_anchors": op4_pii_anchors,
        "op5_hash_tree_sharding": op5_hash_tree_sharding,
        "op6_warc_derivatives": op6_warc_derivatives,
        "op7_best_two_fit": op7_best_two_fit,
        "op8_parity_jaccard_join": op8_parity_jaccard_join,
        "op9_source_mixing": op9_source_mixing,
        "op10_quality_rules": op10_quality_rules,
        "op11_importance_resampling": op11_importance_resampling,
        "op12_filter_audit": op12_filter_audit,
        "op13_license_scan": op13_license_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_top_k": topk.SQL,
        "op9_source_mixing": mixing.SQL,
        "op11_importance_resampling": importance.SQL,
        "op12_filter_audit": filter_audit.SQL,
        "op13_license_scan": license_scan.SQL,
    }
