"""Folders that all executors share, for results that are written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; set here only where the session names none, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        spark.sparkContext.setCheckpointDir("/tmp/checkpoints/quoin")
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A new folder's path."""
    return f"{shared_dir(spark)}/quoin-{name}-{uuid.uuid4().hex}"
