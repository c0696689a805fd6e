"""A corpus from raw documents: quality rules, near-dedup, substring dedup, mixing, packing.

Every stage but the last returns the columns of its documents; other columns
than its own pass through, whatever their names. A null text counts as an empty
one and so fails the quality rules; rows of a null doc_id are kept by both
dedup stages, as nothing says which document they are; repeated rows share
their fate; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lithoscan.llm.common import materialize
from lithoscan.llm.mixing import mixed_documents
from lithoscan.llm.packing import pack
from lithoscan.llm.quality_rules import keep_good
from lithoscan.llm.simhash import keep_one
from lithoscan.llm.substrings import remove_repeats
from lithoscan.plans.stage import sweep


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep: those that pass the base rules and lie near their language's and source's others."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, the smallest doc_id: links are SimHashes of 3 differing bits and five-word Jaccard of 0.8."""
    return keep_one(docs, similarity=0.8)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without paragraphs that an earlier document has; one of which no word is left goes."""
    return remove_repeats(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by target weights; one that several epochs take comes as often."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and offset."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: Three of the stages aren't SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
            sweep(spark, docs)  # what the stage has written on its way
    return docs
