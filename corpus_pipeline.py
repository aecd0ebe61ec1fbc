"""From raw documents to packed training sequences, a stage at a time.

Each stage works on all rows that it is given and passes on all of their columns, whatever their names; an empty table gives
none. Null and empty texts: the classifier scores them as empty (labels say whether these are good), the rules let none
through, since they have fewer than 50 words; later stages would keep each (no text is a copy of none) and pack its
end-of-document id. Rows with a null doc_id are judged by the classifier and the rules; as copies they are not judged, and stay. Of rows equal in
id and text the near-duplicate stage keeps one, different texts under one id are judged each by itself, and of a class the
smallest id stays. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronofold.llm import neardup, quality_classifier, quality_rules, queries
from chronofold.scratch import Scratch


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones of the raw table, predicts good."""
    return quality_classifier.filter_documents(docs, quality_classifier.train(*_labelled(spark, sf_dir)))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base limits and the n-gram model, fitted on the labelled ones of the raw table (few bad ones are left among its own)."""
    return quality_rules.filter_documents(docs, quality_rules.train(*_labelled(spark, sf_dir)))


def _labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one with the smallest id. Rows that repeat it go as well."""
    return neardup.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences' pieces of the documents that remain."""
    return queries.pack_digest(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_good),
    ("quality rules", apply_rules),
    ("minhash near-dedup", drop_near_duplicates),
    ("packing", pack),
]

#: The stages hold trained models and a tokenizer, which SQL doesn't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again before the next."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
