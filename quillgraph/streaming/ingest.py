"""Streaming ingest: new text files or candidate rows become triples as they arrive.

An extension: the same stage functions over a stream. State is bounded by the
watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.text import triple_id
from quillgraph.operators.triples import KEY, accepted


def text_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(document_id, text, arrived) of text files as they appear."""
    raw = spark.readStream.format("text").option("wholetext", True).load(folder)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return raw.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("document_id"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("arrived"))


def triple_stream(candidates: DataFrame, event_time: str, lateness: str = "10 minutes") -> DataFrame:
    """Accepted candidates, each triple once within the watermark."""
    rows = accepted(candidates).withColumn("triple_id", triple_id(*(F.col(c) for c in KEY)))
    return rows.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark(["triple_id"])


def relation_counts(candidates: DataFrame, event_time: str, window: str = "5 minutes", lateness: str = "10 minutes") -> DataFrame:
    """(window, relation, n): accepted candidates per tumbling window."""
    rows = accepted(candidates).withWatermark(event_time, lateness)
    return rows.groupBy(F.window(event_time, window), "relation").agg(F.count("*").alias("n"))
