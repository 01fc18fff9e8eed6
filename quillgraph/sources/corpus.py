"""Text corpora: scanning, salvage of bad bytes, integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.errors import CorpusError


def scan(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """(document_id, filename, text, sha256, character_count, read_warnings); files of white space alone are left out.

    Bytes that are not UTF-8 become U+FFFD, with a warning.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.make_valid_utf8(F.col("content").cast("string"))
    warnings = F.filter(F.array(F.when(~valid, "decoded with replacement characters"), F.when(F.contains(text, F.lit("�")), "text contains replacement characters")), lambda w: w.isNotNull())
    docs = raw.select(
        F.regexp_replace(name, r"\.[^.]*$", "").alias("document_id"), name.alias("filename"), text.alias("text"), F.sha2("content", 256).alias("sha256"),
        F.char_length(text).cast("long").alias("character_count"), warnings.alias("read_warnings"),
    )
    return docs.where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "")


def checked(docs: DataFrame) -> DataFrame:
    if docs.isEmpty():
        raise CorpusError("the corpus has no text")
    return docs


def integrity_diff(manifest: DataFrame, actual: DataFrame, key: str = "filename") -> DataFrame:
    """(key, problem): MISSING, EXTRA or DRIFTED files, by digest."""
    a = manifest.select(key, F.col("sha256").alias("__want"))
    b = actual.select(key, F.col("sha256").alias("__have"))
    both = a.join(b, key, "full")
    problem = F.when(F.col("__have").isNull(), "MISSING").when(F.col("__want").isNull(), "EXTRA").when(F.col("__have") != F.col("__want"), "DRIFTED")
    return both.select(key, problem.alias("problem")).where("problem IS NOT NULL")


def verify(manifest: DataFrame, docs: DataFrame) -> DataFrame:
    """(filename, problem) of a corpus against its manifest: files missing, extra or drifted, and files that are empty or have several lines."""
    own = docs.select("filename", "sha256", F.trim(F.regexp_replace("text", r"^\s+|\s+$", "")).alias("__t"))
    text = F.when(F.col("__t") == "", "EMPTY").when(F.contains("__t", F.lit("\n")), "MULTILINE")
    return integrity_diff(manifest, own).unionByName(own.select("filename", text.alias("problem")).where("problem IS NOT NULL"))
