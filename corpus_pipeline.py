"""The corpus pipeline: language, quality, near copies, repeated passages, packing.

Every stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame that is written as Parquet and
read again as the next stage's input.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobmill.llm import jaccard, langid, packing, quality, repeats
from jobmill.session import fresh_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose main languages are known and have most of their letters stay."""
    return langid.accepted(docs)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the plain rules and lie in their language's perplexity bands stay."""
    return quality.accepted(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies stays."""
    return jaccard.one_of_each_group(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings that occurred before are cut out of the texts."""
    return repeats.without_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequences and offsets."""
    return packing.pack_documents(docs)


STAGES = [("language_id", language), ("quality_rules", rules), ("ngram_jaccard", near_copies), ("suffix_dedup", passages), ("best_fit_packing", packed)]

#: The stages' models and packing cannot be said in SQL; tests compare the pipeline with plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents table, each one's result written to the shared folder in between."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = fresh_dir(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
