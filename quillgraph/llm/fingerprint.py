"""Document fingerprints by a threshold-scaled sketch, in DataFrame operations only.

A fingerprint keeps the hash of every five-word shingle (all words of a shorter
text) that is below a fixed fraction of the hash range, and the smallest hash
whatever its value, so that short texts are not empty. Both rules depend on the
set alone: the fingerprint of a union is the union of the fingerprints (with
the same rules applied), and sketches of very unequal texts compare, as each
holds the same fraction of its own shingles. The exception is a sketch that
holds nothing but a least hash beyond the fraction: a larger sketch keeps that
value only as its own least one, so likeness is 0 whatever the texts share.
With half of the range kept this befalls texts of a few shingles alone (chance
1 in 1024 at ten); the README has the measured error.

Likeness is the containment of the smaller sketch in the larger: the shared
hashes over the hashes of the smaller one. Equal sketches have 1, and so have
two empty ones (texts without words); a sketch is unlike an empty one.

Neighbours by descending id come from ranges: ids are cut at quantiles, each
range also takes the first row of the next one as a guest, and a window runs
over every range alone. The text is shuffled once.

Defined results: a null text is empty; ids that repeat are ordered by the hash
of the text; null ids come last; a table of one row is its own next document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import ranges_for, table
from quillgraph.llm.packing import id_ranges, range_of

SHINGLE = 5
#: One in so many shingles is kept: dense, as a text of n shingles has none of them below the fraction with chance (1 - 1 / SCALE) ** n.
SCALE = 2


def shingle_hashes(text: Column) -> Column:
    """The hash of each run of SHINGLE words; of all words where there are fewer; none without words."""
    w = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")
    return F.transform(
        F.array(w),
        lambda v: F.when(
            F.size(v) >= SHINGLE,
            F.transform(F.sequence(F.lit(0), F.size(v) - SHINGLE), lambda i: F.xxhash64(*(F.get(v, i + k) for k in range(SHINGLE)))),
        )
        .when(F.size(v) > 0, F.array(F.xxhash64(F.array_join(v, " "))))
        .otherwise(F.array().cast("array<long>")),
    )[0]


def sketch(text: Column, scale: int = SCALE) -> Column:
    """Sorted distinct hashes of the text's fingerprint."""
    limit = -(1 << 63) + (1 << 64) // scale
    # one lambda, so that the hashes are made once
    kept = F.transform(F.array(shingle_hashes(text)), lambda h: F.array_union(F.filter(h, lambda x: x < limit), F.slice(F.array_compact(F.array(F.array_min(h))), 1, 1)))[0]
    return F.array_sort(F.array_distinct(kept))


def likeness(a: Column, b: Column) -> Column:
    small = F.least(F.size(a), F.size(b))
    return F.when(a == b, F.lit(1.0)).when(small == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / small)


def merged(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of both texts' shingles together."""
    limit = -(1 << 63) + (1 << 64) // scale
    both = F.array_sort(F.array_union(a, b))
    return F.filter(both, lambda x, i: (x < limit) | (i == 0))


def shown(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), " ")


def with_next(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, sketch) with next_text and next_sketch of the next document by descending id, the first after the last."""
    docs = docs.withColumn("tie", F.xxhash64("text"))
    bounds = id_ranges(docs, "doc_id", ranges_for(docs))
    parts = len(bounds) + 1
    # the highest ids are in range 0; null ids are in the last
    rows = docs.withColumn("part", F.when(F.col("doc_id").isNull(), F.lit(parts - 1)).otherwise(F.lit(parts - 1) - range_of(F.col("doc_id"), bounds)).cast("int"))
    firsts = rows.groupBy("part").agg(F.max(F.struct("doc_id", "tie")).alias("m")).orderBy("part").collect()  # a row per range
    heads = [(r["m"]["doc_id"], r["m"]["tie"], firsts[i - 1]["part"]) for i, r in enumerate(firsts)]
    spark = docs.sparkSession
    guests = spark.createDataFrame(heads, "head_id long, head_tie long, host int")
    same = F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("tie") == F.col("head_tie"))
    guests = docs.join(F.broadcast(guests), same).select("doc_id", "text", "sketch", "tie", F.col("host").alias("part"), F.lit(True).alias("guest"))
    rows = rows.select("doc_id", "text", "sketch", "tie", "part", F.lit(False).alias("guest")).unionByName(guests)
    order = Window.partitionBy("part").orderBy("guest", F.desc_nulls_last("doc_id"), F.desc("tie"))
    return rows.withColumns({"next_text": F.lead("text").over(order), "next_sketch": F.lead("sketch").over(order)}).where("NOT guest")


def op7_fingerprint(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs.withColumn("sketch", sketch(F.col("text"))))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", edited)
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "sketch", "next_sketch", sketch(F.col("edited")).alias("edited_sketch"))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        shown(F.col("sketch")).alias("fingerprint"),
        shown(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
