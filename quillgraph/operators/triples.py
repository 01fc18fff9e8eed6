"""From relation candidates to triples, edges and nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import triple_id

KEY = ("subject_id", "relation", "object_id", "document_id")


def rejection(subject_id: Column, object_id: Column, object_type: Column, relation: Column) -> Column:
    """The first reason against a candidate, or null."""
    return (
        F.when(subject_id.isNull() | object_id.isNull(), "unresolved_endpoint")
        .when(subject_id == object_id, "self_loop")
        .when((object_type == "LITERAL") & (relation != "focuses_on"), "literal_endpoint")
    )


def accepted(candidates: DataFrame) -> DataFrame:
    c = F.col
    return candidates.where(rejection(c("subject_id"), c("object_id"), c("object_type"), c("relation")).isNull())


def rejected_counts(candidates: DataFrame) -> DataFrame:
    c = F.col
    why = rejection(c("subject_id"), c("object_id"), c("object_type"), c("relation"))
    return candidates.select(why.alias("reason")).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


def build(candidates: DataFrame) -> DataFrame:
    return completed(grouped(candidates))


def grouped(candidates: DataFrame) -> DataFrame:
    """One triple per (subject, relation, object, document): the first candidate, and how many there were.

    First is by sentence, then by rule order (where there is one), then by ``seq``. An
    aggregate of the least struct, so partial results combine before the shuffle.
    """
    fixed = ["sentence_index", "seq", "subject", "object", "subject_type", "object_type", "sentence", "confidence", "coref_resolved", "inferred", "rule_id"]
    own = [x for x in ("original_subject", "original_object", "context_entity") if x in candidates.columns]
    rank = [x for x in ("rule_ord",) if x in candidates.columns]
    order = ["sentence_index", *rank, *fixed[1:], *own]
    first = accepted(candidates).groupBy(*KEY).agg(F.min(F.struct(*order)).alias("f"), F.count("*").alias("duplicate_count"))
    return first.select(*KEY, *(F.col(f"f.{x}").alias(x) for x in [*fixed, *own] if x != "seq"), "duplicate_count")


def completed(grouped: DataFrame) -> DataFrame:
    """Rows of ``grouped`` with what follows from a row: its id, and the originals where none are given."""
    out = grouped.withColumn("triple_id", triple_id(F.col("subject_id"), F.col("relation"), F.col("object_id"), F.col("document_id")))
    for name, default in (("original_subject", "subject"), ("original_object", "object")):
        if name not in out.columns:
            out = out.withColumn(name, F.col(default))
    return out if "context_entity" in out.columns else out.withColumn("context_entity", F.lit(None).cast("string"))


def edges(triples: DataFrame) -> DataFrame:
    """One edge per triple; parallel edges stay."""
    return triples.select(
        F.col("subject_id").alias("src"), F.col("object_id").alias("dst"), "relation", "confidence", "coref_resolved", "document_id",
        F.col("sentence_index").alias("sentence_id"), "sentence", "inferred", "rule_id", "original_subject", "original_object",
        F.col("subject").alias("canonical_subject"), F.col("object").alias("canonical_object"), "triple_id", "duplicate_count",
    )


def endpoints(triples: DataFrame) -> DataFrame:
    """(entity_id, label, type, is_in, is_out): two rows per triple."""
    sides = F.array(
        F.struct(F.col("subject_id").alias("entity_id"), F.col("subject").alias("label"), F.col("subject_type").alias("type"), F.lit(0).alias("is_in"), F.lit(1).alias("is_out")),
        F.struct(F.col("object_id").alias("entity_id"), F.col("object").alias("label"), F.col("object_type").alias("type"), F.lit(1).alias("is_in"), F.lit(0).alias("is_out")),
    )
    return triples.select(F.inline(sides))


def degrees(triples: DataFrame) -> DataFrame:
    """Degrees with parallel edges counted, in one aggregate over both ends."""
    return endpoints(triples).groupBy("entity_id").agg(
        F.sum("is_in").alias("in_degree"), F.sum("is_out").alias("out_degree"), F.count("*").alias("degree"), F.first("label").alias("label"), F.first("type").alias("type")
    )


def nodes(triples: DataFrame, stats: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """Entities with an edge, with mention counts and (where a lexicon is given) aliases."""
    out = degrees(triples).join(stats, "entity_id", "left").withColumn("mention_count", F.coalesce("mention_count", F.lit(0)))
    if lexicon is not None:
        out = out.join(lexicon.select("entity_id", "aliases"), "entity_id", "left")
    return out


def mention_stats(resolutions: DataFrame) -> DataFrame:
    """Resolved mentions and documents of each entity."""
    known = resolutions.where("entity_id IS NOT NULL")
    return known.groupBy("entity_id").agg(F.count("*").alias("mention_count"), F.count_distinct("document_id").alias("n_documents"))


def mention_documents(resolutions: DataFrame) -> DataFrame:
    return resolutions.where("entity_id IS NOT NULL").groupBy("entity_id").agg(F.sort_array(F.collect_set("document_id")).alias("documents"))


def relation_histogram(triples: DataFrame) -> DataFrame:
    return triples.groupBy("relation").agg(F.count("*").alias("n"))


def counters(triples: DataFrame, candidates: DataFrame) -> DataFrame:
    """Run counters, one row."""
    c = F.col
    why = rejection(c("subject_id"), c("object_id"), c("object_type"), c("relation"))
    a = candidates.select(why.alias("why")).agg(
        F.count("*").alias("relation_candidates"), *(F.count_if(c("why") == r).alias(f"rejected_{r}") for r in ("unresolved_endpoint", "self_loop", "literal_endpoint"))
    )
    b = triples.agg(F.count("*").alias("triples"), F.count_if("inferred").alias("inferred_triples"), F.count_if("coref_resolved").alias("coref_triples"), F.sum("duplicate_count").alias("support"))
    n = degrees(triples).agg(F.count("*").alias("nodes"), F.count_if(c("type") != "LITERAL").alias("entities"), F.max("degree").alias("largest_degree"))
    return a.crossJoin(b).crossJoin(n)
