"""Weighted rendezvous sharding by a stable record key, in DataFrame operations only.

Every (key, shard) pair gets a hash h in (0, 1) and the score ``-weight / ln h``;
the shard with the highest score takes the key. A new shard adds one score and
changes none of the others, so it only takes rows into itself: about
``w_new / sum(w)`` of them.

Slots are numbered without gaps inside each shard. A shard can hold any share
of the rows (a hot key, unequal weights), so it is never sorted in one task:
rows are numbered inside (shard, bucket) cells, and the cells of a shard are
laid one after another. The number of buckets follows the row count, so a cell
has about ``CELL`` rows at any size. The bucket hashes key, content and the
partition that a row was read from, so even equal rows spread; the placed rows
are written before they are numbered, which fixes their buckets.

Defined results: a null key is a key like any other; a null text has no bytes
and the checksum 0; repeated rows get slots of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import table, written

#: Rows of a cell, about.
CELL = 20_000


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0 to len(weights) - 1) of a key; ties go to the higher number."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a weight above 0")
    text = F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("n"))
    one = F.xxhash64(text)
    scores = []
    for shard, weight in enumerate(weights):
        # 52 bits: the halves of a double's mantissa that are never 0 nor 1
        unit = (F.shiftrightunsigned(F.xxhash64(one, F.lit(shard)), 12).cast("double") + F.lit(0.5)) / F.lit(2.0**52)
        scores.append(F.struct((F.lit(-float(weight)) / F.ln(unit)).alias("score"), F.lit(shard).alias("shard")))
    return F.greatest(*scores)["shard"] if len(scores) > 1 else F.lit(0)


def place(docs: DataFrame, key: str, content: str, weights: Sequence[float]) -> DataFrame:
    """(key, size, text_crc32, shard, slot, grown_shard) of each row; ``grown_shard`` is its place were one more shard of mean weight added."""
    text = F.col(content)
    grown = [*weights, sum(weights) / len(weights)]
    buckets = max(1, -(-docs.count() // (CELL * len(weights))))
    rows = docs.select(
        F.col(key).alias("key"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.pmod(F.xxhash64(F.col(key), text, F.spark_partition_id()), F.lit(buckets)).alias("bucket"),
    ).select("*", rendezvous(F.col("key"), weights).alias("shard"), rendezvous(F.col("key"), grown).alias("grown_shard"))
    rows = written(rows, "placed")
    cells = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    cell = Window.partitionBy("shard", "bucket").orderBy("key", "text_crc32", "size")
    numbered = rows.withColumn("at", F.row_number().over(cell) - 1)
    return numbered.join(cells, ["shard", "bucket"]).select(
        "key", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("base") + F.col("at")).cast("long").alias("slot"), F.col("grown_shard").cast("int").alias("grown_shard")
    )


def op5_shard(spark, sf_dir) -> DataFrame:
    placed = place(table(spark, sf_dir, "documents"), "doc_id", "text", [1.0] * 24)
    return placed.select(F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
