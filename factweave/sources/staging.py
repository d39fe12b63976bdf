"""Intermediates of iterative operators as Parquet in the folder that all executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="factweave-stage-")


def stage_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; a local one only on a local master without that setting."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return f"{named.rstrip('/')}/stage-{uuid.uuid4().hex}"
    if spark.sparkContext.master.startswith("local"):
        return f"{_own_folder()}/{uuid.uuid4().hex}"
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written and read again: its lineage ends, and a lost executor costs only its tasks."""
    path = f"{stage_folder(df.sparkSession)}-{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
