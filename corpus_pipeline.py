"""The corpus pipeline: its stages in order, each a (name, function) of (spark, docs, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import stages
from brindle.llm.common import table, written

STAGES = [
    ("language_id", stages.language_id_stage),
    ("near_dedup", stages.near_dedup_stage),
    ("substring_dedup", stages.substring_dedup_stage),
    ("decontaminate", stages.decontaminate_stage),
    ("pack", stages.pack_stage),
]

#: SQL can express neither the network of the first stage nor the sampling of the second; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
