"""The graph of a folder of tables, built once and then only read.

Triples are written to the shared folder under the fingerprint of the tables
that they come from, in folders by relation and sorted by subject. So a query's
relation filter prunes folders, a constant subject prunes row groups and pages,
and no query of triples joins the raw tables again. Changed tables have another
fingerprint and are built anew. What follows from the rest of a row is not
written but made when it is read; candidates are a plan over the tables.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators import triples
from quillgraph.operators.cut import shared_folder
from quillgraph.sources import relational


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """A digest of the name, modification time and size of every file below some paths; what is missing counts as such."""
    seen = []
    for path in paths:
        files, at = _files(spark, path)
        if not files.exists(at):
            seen.append((path, "missing"))
            continue
        found = files.listFiles(at, True)
        while found.hasNext():
            f = found.next()
            seen.append((str(f.getPath()), f.getModificationTime(), f.getLen()))
    return hashlib.sha256(repr(sorted(seen)).encode()).hexdigest()


def _kept(spark: SparkSession, name: str, make) -> DataFrame:
    """The table of this name, made and written if it is not there; a table that is being written has another name until it is whole."""
    path = f"{shared_folder(spark)}/{name}"
    files, at = _files(spark, path)
    if not files.exists(at):
        df = make()
        schema = df.schema
        new = f"{path}-{uuid.uuid4().hex}"
        df.sortWithinPartitions("relation", "subject_id").write.option("compression", "zstd").partitionBy("relation").parquet(new)
        if not files.rename(_files(spark, new)[1], at) and not files.exists(at):
            raise OSError(f"{new} cannot be renamed")
        _schemas[path] = schema
    return (spark.read.schema(_schemas[path]) if path in _schemas else spark.read).parquet(path)


_schemas: dict = {}


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.candidates(spark, sf_dir)


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All triples."""
    key = fingerprint(spark, [f"{sf_dir}/{t}.parquet" for t in relational.TABLES])
    return _whole(_kept(spark, f"triples-{key}", lambda: _slim(grouped(relational.candidates(spark, sf_dir)))))


def grouped(found: DataFrame) -> DataFrame:
    """The triples of candidates; relations whose candidates stand by document are grouped where they are."""
    there = F.coalesce(F.col("relation").isin(*relational.BY_DOCUMENT), F.lit(False))
    return triples.grouped(found.where(~there)).unionByName(triples.grouped(found.where(there)))


def _plain_sentence() -> Column:
    return relational.sentence(F.col("subject"), F.col("relation"), F.col("object"))


def _slim(rows: DataFrame) -> DataFrame:
    """Without sentences that only say the triple; any other, null too, stands in a struct."""
    own = F.when(~F.col("sentence").eqNullSafe(_plain_sentence()), F.struct("sentence"))
    return rows.withColumn("own", own).drop("sentence")


def _whole(rows: DataFrame) -> DataFrame:
    said = F.when(F.col("own").isNull(), _plain_sentence()).otherwise(F.col("own.sentence"))
    return triples.completed(rows.withColumn("sentence", said).drop("own"))
