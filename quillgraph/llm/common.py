"""Helpers shared by the training-data operators.

Nothing here keeps driver-side copies of a corpus: what crosses a lineage cut
is a Parquet table in the folder that the session names in
``spark.checkpoint.dir``.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators.cut import shared_folder

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


#: What a Python worker gets at once: rows, and bytes (texts can be very long).
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; from here on Python workers of the session get small batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def discard(spark: SparkSession) -> None:
    """Removes what the application has written to the shared folder; results that were not written elsewhere can no longer be read."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it again.

    A lost executor then costs a re-read, never a recomputation of what stands
    before the cut, and no single copy of a block is held by one machine. A
    result is lazy and may read the table at any later time, so it stays until
    ``discard``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_resident: dict = {}


def resident(name, make):
    """What a worker process keeps between tasks (a model, caches): one thing at a time, whatever operators share the worker."""
    if name not in _resident:
        release()
        _resident[name] = make()
    return _resident[name]


def release() -> None:
    """Before a task that builds large tables of its own."""
    _resident.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library can hand memory back
        ctypes.CDLL(None).malloc_trim(0)


def ascii_lower(text):
    """Lower-case A-Z alone. ``lower`` does that, and faster, where the text has no other letters."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, ASCII_UPPER, ASCII_LOWER)
    )


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ranges_for(df: DataFrame, each: int = 32 << 20) -> int:
    """Into how many ranges a table is cut: as many as shuffle partitions, more where one would have over ``each`` bytes of input."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return max(partitions(df), -(-size // each) if size < 1 << 55 else 0)  # a table that is not a file has no known size
