"""What the corpus operators share: reading, cutting lineage, bounded broadcasts and batch handling."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Kernel = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows up to which a table whose rows are narrow (a few dozen bytes) is broadcast.
BROADCAST_ROWS = 500_000

#: Bytes of text and rows that a Python kernel works on at once: both bound what it holds beside them.
SLICE_BYTES, SLICE_ROWS = 1 << 20, 512

#: Rows of the Arrow batches that go to a kernel: JVM and worker hold a few batches each, of whole texts.
BATCH_ROWS = 1024
_BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where the session names none."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_dir(spark.sparkContext.applicationId)


@lru_cache
def _own_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="gleaner-")


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: later steps neither recompute it nor lose it with an executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gleaner/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: The folders that `materialize` wrote and nobody released yet.
_WRITTEN: list[str] = []


def written() -> int:
    """How many folders `materialize` has written so far, for `release`."""
    return len(_WRITTEN)


def release(spark: SparkSession, result: DataFrame | None = None, since: int = 0) -> None:
    """Delete what `materialize` wrote since then, but for the files of a materialized result: to be called when all else is done with."""
    files = result.inputFiles() if result is not None else []
    own = _WRITTEN[since:]
    keep = [p for p in own if any(p.rpartition("/")[2] in f for f in files)]
    for path in own:
        if path not in keep:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    _WRITTEN[since:] = keep


def small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if df, already materialized, has few rows; otherwise df as it is, for a shuffled join."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= limit else df


def text_slices(batch: pa.RecordBatch, column: int = 0, limit: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part has at most `rows` rows, and at most `limit` bytes of text or one row."""
    for at in range(0, batch.num_rows, rows):
        waiting = [batch.slice(at, rows)]
        while waiting:
            part = waiting.pop()
            if part.num_rows <= 1 or part.column(column).nbytes <= limit:
                yield part
                continue
            half = part.num_rows // 2
            waiting += [part.slice(half), part.slice(0, half)]


def fresh(name: str, *frames: DataFrame) -> str:
    """The name, longer by underscores until no column of the frames has it."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def column(name: str) -> Column:
    """A column by its plain name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def release_memory() -> None:
    """Give freed memory back: workers live on between stages, and what one stage held would narrow the next."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


#: What this worker keeps from one task to the next, by the name of the kernel that it is for.
_KEPT: dict[str, Any] = {}


def keep(name: str, value: Any) -> Any:
    """Keep a value in this worker for later tasks of the kernel of that name."""
    _KEPT.clear()
    _KEPT[name] = value
    return value


def kept(name: str) -> Any:
    """What is kept under a name, or None."""
    return _KEPT.get(name)


def tidy(kernel: Kernel, keeps: str | None = None) -> Kernel:
    """The kernel, with its memory released when a task has ended; what the worker keeps for other kernels goes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _KEPT and keeps not in _KEPT:
            _KEPT.clear()
            release_memory()
        try:
            yield from kernel(batches)
        finally:
            release_memory()

    return run


def map_arrow(df: DataFrame, kernel: Kernel, schema: str | StructType, keeps: str | None = None) -> DataFrame:
    """df through a tidy kernel, in batches of BATCH_ROWS unless the session's setting is another than Spark's default."""
    conf = df.sparkSession.conf
    if conf.get(_BATCHES, "10000") == "10000":
        conf.set(_BATCHES, str(BATCH_ROWS))
    return df.mapInArrow(tidy(kernel, keeps), schema)


def as_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
