"""The training-text pipeline: each stage works on the documents its predecessor kept.

Every stage takes (spark, docs, sf_dir), its result is written as Parquet to the shared folder and
read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobloom.llm import stages
from jobloom.llm.common import table
from jobloom.session import saved

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("exact dedup", stages.drop_exact_copies),
    ("near dedup", stages.drop_near_copies),
    ("decontamination", stages.drop_contaminated),
    ("mixing", stages.mix),
]
#: A trained classifier decides the first stage, so SQL cannot express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
