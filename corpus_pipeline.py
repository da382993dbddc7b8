"""From raw documents to packed training sequences, in five stages that each call one corpus operator.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet to the
shared folder and rereads it as the next stage's docs. All stages but the last keep the columns of documents,
whatever further columns there are and whatever their names. Empty tables give empty tables; nulls in any
column pass; each stage's docstring says what becomes of null, empty and repeated rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm.common import Scratch, table
from quillon.llm.jaccard_join import distinct_documents
from quillon.llm.mixing import mix
from quillon.llm.packing import pack
from quillon.llm.pii import redact
from quillon.llm.quality_model import classify

#: Documents that score at least this are kept.
KEEP_SCORE = 0.7

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the boosted-tree classifier does not reject.

    Null and empty texts are scored like others, repeated rows alike; rows with null doc_id are scored and never
    learnt from. With labels of one kind every score is its share: all stay if all labels are good.
    """
    name = "__quality_score"
    scored = classify(docs, table(spark, sf_dir, "labels"), column=name)
    return scored.where(scored[name] >= KEEP_SCORE).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of 5-word shingle sets with Jaccard similarity of at least 0.8: that of least doc_id, null last.

    Null and wordless texts are no one's copies and all stay; of repeated rows one stays.
    """
    return distinct_documents(docs, width=5, num=80, den=100)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by marks of its kind; null and empty texts stay as they are, no row is dropped."""
    return redact(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, or cut, as the water-filled mix takes them.

    A wordless text comes with each whole pass of its source; null sources are a source; repeated rows are
    documents of their own.
    """
    return mix(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and offset; a null text is an empty document of one end id."""
    return pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: The stages train a model, join sketches and tokenise: SQL cannot express them.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"{k}-{name}")
    return docs
