"""Cutting the lineage of tables that several later steps read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that driver and executors share."""
    _checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/tessella/{name}-{uuid.uuid4().hex}"


def _checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if not context.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="tessella-checkpoint-"))


def written(df: DataFrame) -> DataFrame:
    """``df`` checkpointed at once, so plans that call this run jobs when they are made.

    The folder is the session's (``spark.checkpoint.dir``, which driver and executors share);
    where none is set, a temporary one is made for a local master, else it is an error."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint()
