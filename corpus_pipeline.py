"""The corpus pipeline: quality, near copies, repeated passages, source weights, tokens.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and
read again as the next one's docs. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import stages
from millrace.llm.shared import written

STAGES = [
    ("quality_rules", stages.quality_stage),
    ("near_dedup", stages.near_dedup_stage),
    ("suffix_dedup", stages.suffix_dedup_stage),
    ("mixing", stages.mixing_stage),
    ("byte_bpe", stages.bpe_stage),
]

#: Near-duplicate classes and byte pair merges are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
