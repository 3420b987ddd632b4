"""Tables between the stages of a pipeline."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from gridlode.plans.materialize import ensure_checkpoint_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """Write the rows as Parquet beside the session's checkpoints, which all executors share, and read them again."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stages/{name.replace(' ', '_')}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)
