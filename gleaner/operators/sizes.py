"""Broadcasts behind a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes up to which a side is broadcast, and how much larger than its files a table may be in memory.
BROADCAST_BYTES, DECODED = 32 << 20, 4


def bounded_bytes(df: DataFrame) -> int | None:
    """An upper estimate of the bytes of df, or None if there is no such estimate.

    What was written before is counted.  Of a plan over files the optimizer's estimate is taken, but only if no
    operator in it makes more rows than it reads unnoticed: the estimate of joins is a product, that of generators is not.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    text = str(plan.toString())
    if "Generate " in text:
        return None
    if "LogicalRDD" in text:
        return None if "Join " in text else df.count() * max(64, int(plan.output().size()) * 48)
    return int(str(plan.stats().sizeInBytes())) * DECODED


def bounded(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its size is known to be within the limit; else as it is: adaptive execution sees how large it gets."""
    size = bounded_bytes(df)
    return F.broadcast(df) if size is not None and size <= limit else df
