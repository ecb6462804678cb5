"""Cutting lineage: long compositions are written to the checkpoint folder, so plans stay small and lost executors cost one step."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def shared_dir(df: DataFrame) -> str:
    """The folder in spark.checkpoint.dir; a temporary folder stands in where none is set on one machine."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="gleaner-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df read back from the shared folder."""
    shared_dir(df)
    return df.checkpoint()


def write(df: DataFrame, *partitions: str, path: str | None = None) -> str:
    """df as Parquet at path, or at a new one in the shared folder; gives the path."""
    path = path or f"{shared_dir(df)}/gleaner-{uuid.uuid4().hex}"
    df.write.mode("overwrite").partitionBy(*partitions).parquet(path)
    return path
