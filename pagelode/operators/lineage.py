"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; one is set only where the session has none: a temporary one where
    driver and executors are one process, else one in the warehouse, if that isn't on a local disk."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        own = spark.conf.get("spark.checkpoint.dir", None)
        if own is None:
            own = tempfile.mkdtemp() if context.master == "local" or context.master.startswith("local[") else in_warehouse(spark.conf.get("spark.sql.warehouse.dir"))
        context.setCheckpointDir(own)
    return context._jsc.sc().getCheckpointDir().get()


def in_warehouse(warehouse: str) -> str:
    """The checkpoint folder in a warehouse that executors on other machines can reach."""
    if ":" not in warehouse or warehouse.startswith("file:"):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share; {warehouse} is local to a machine")
    return f"{warehouse}/_checkpoints"


def checkpoint(df: DataFrame) -> DataFrame:
    """df written to that folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df as a compressed table in that folder, for what is read by columns or more than once."""
    folder = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
