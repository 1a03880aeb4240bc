"""Stages of the training-text pipeline: (spark, docs, sf_dir) to the documents that stay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm.common import table
from jobloom.llm.decontaminate import decontaminate
from jobloom.llm.exact import exact_dedup
from jobloom.llm.mixing import mix_sources
from jobloom.llm.near import near_dedup
from jobloom.llm.toxicity import score_toxicity, train


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    scored = score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.where(F.col("predicted") == 0).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup(docs, single=True).where("kept").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, over five-word shingles."""
    return near_dedup(docs).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document appears as often as it is taken, with its output shard and copy number."""
    return mix_sources(docs)
