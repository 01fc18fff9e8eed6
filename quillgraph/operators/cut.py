"""Cutting a plan where several later parts read the same rows."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits for each hash by which rows are sifted, and words of 64 bits at most (8 MB).
MARKS, MARK_WORDS = 16, 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The application's own folder in the one that ``spark.checkpoint.dir`` names; a fresh local one only in local mode where none is named (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        own = tempfile.mkdtemp(prefix="quill-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        named = "file://" + own
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named.rstrip('/')}/quill-{spark.sparkContext.applicationId}"


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that grows with the data: neither side is broadcast, at planning or at run time.

    Spark goes by compressed sizes, and of ids and labels a broadcast takes many times those of the driver.
    """
    return df.hint("merge")


def cut(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read again: readers share one computation, and a lost executor costs a re-read."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def marked(hashes: DataFrame, code: Column) -> Column:
    """May ``code`` be among ``hashes`` (hash; a table that is written)? By a bit for each, of which there are ``MARKS`` times as many, up to a fixed size; all of ``hashes`` pass."""
    words, n = 1, hashes.count()
    while words < MARK_WORDS and 64 * words < MARKS * n:
        words *= 2
    word, bit = (lambda h: F.shiftright(h.bitwiseAND(64 * words - 1), 6).cast("int")), (lambda h: h.bitwiseAND(63).cast("int"))
    used = hashes.select(word(F.col("hash")).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col("hash"))).alias("bits"))
    none = hashes.sparkSession.range(words).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("bits"))
    each = used.unionByName(none).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    marks = each.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("marks")).scalar()
    return F.getbit(F.get(marks, word(code)), bit(code)) == 1
