"""Cutting lineage where all executors can read: the folder of spark.checkpoint.dir, or one of the session's own."""

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder; a temporary one only where the session has none (tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="echoline-"))
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Written once to the checkpoint folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
