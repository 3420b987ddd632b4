"""The training-data pipeline: each stage's rows are written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridlode.llm import decontaminate, line_dedup, mixing, near_duplicates, toxicity
from gridlode.llm.storage import written

STAGES = [
    ("toxicity", toxicity.stage),
    ("line dedup", line_dedup.stage),
    ("near dedup", near_duplicates.stage),
    ("decontamination", decontaminate.stage),
    ("mixing", mixing.stage),
]

#: A trained model and fuzzy matches are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
