"""Cutting lineage in iterations, and folders that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder's name in the folder that the cluster names in spark.checkpoint.dir; below a new one where that is unset and all runs on this machine, as in tests."""
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or (held.get() if held.isDefined() else None)
    if not where and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if held.isEmpty():
        where = where or tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(where)
    return f"{where.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder."""
    shared_folder(df.sparkSession, "")
    return df.checkpoint()
