"""Stage tables: results written once to the cluster's shared folder, from where later jobs and retries read them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from strata.session import ensure_checkpoint_dir


def stage(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the session's checkpoint folder: compact, columnar, and safe from lost executors."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
