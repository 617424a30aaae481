"""A corpus pipeline: language, exact copies, near copies, mixture, packing. Each stage reads what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftplan.llm import stages
from driftplan.storage import scope

STAGES = [
    ("language", stages.language_stage),
    ("exact_dedup", stages.exact_dedup_stage),
    ("near_dedup", stages.near_dedup_stage),
    ("mixing", stages.mixing_stage),
    ("packing", stages.packing_stage),
]

#: Compression, MinHash and a tokenizer are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's result written to the shared folder and read again. What a stage writes on its way is deleted when its result is there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scope(spark):
            docs = stages.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
