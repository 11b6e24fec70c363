"""The corpus pipeline: toxicity, exact and near copies, benchmark passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trellium.llm import stages
from trellium.llm.scratch import Scratch

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("exact_dedup", stages.drop_copies),
    ("near_dedup", stages.drop_near_copies),
    ("decontamination", stages.drop_contaminated),
    ("packing", stages.pack),
]
#: Classifying, linking and packing have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each one's rows are written and read again as the next one's docs."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
