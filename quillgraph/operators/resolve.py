"""Dictionary resolution: from surfaces to entities.

A lexicon is a DataFrame (entity_id, label, type, aliases, anaphors, decl_ord),
with literals as rows of type LITERAL. The indexes are aggregates over its
exploded surfaces; look-ups are equi-joins on normal forms, which Spark
broadcasts while the lexicon is below its threshold and shuffles beyond.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import is_ambiguous_pronoun, surface_form, without_determiner, without_possessive
from quillgraph.operators.cut import cut, shuffled


def alias_index(lexicon: DataFrame) -> DataFrame:
    """(surface, entity_id): a surface that several claim goes to the longest spelling, then the first declared."""
    rows = lexicon.where("type <> 'LITERAL'").select("entity_id", "decl_ord", F.explode(F.array_union(F.col("aliases"), F.array("label"))).alias("spelling"))
    rows = rows.withColumn("surface", surface_form(F.col("spelling"))).where("surface <> ''")
    rank = F.struct((-F.length("spelling")).alias("l"), "decl_ord", "entity_id")
    return rows.groupBy("surface").agg(F.min(rank).alias("m")).select("surface", F.col("m.entity_id").alias("entity_id"))


def description_index(lexicon: DataFrame) -> DataFrame:
    """(surface, entity_id) of descriptions that exactly one entity declares; pronouns never count."""
    rows = lexicon.where("type <> 'LITERAL'").select("entity_id", F.explode("anaphors").alias("a")).withColumn("surface", surface_form(F.col("a")))
    rows = rows.where(~is_ambiguous_pronoun(F.col("surface")))
    grouped = rows.groupBy("surface").agg(F.count_distinct("entity_id").alias("n"), F.min("entity_id").alias("entity_id"))
    return grouped.where("n = 1").select("surface", "entity_id")


def pronoun_index(lexicon: DataFrame) -> DataFrame:
    """(surface, entity_ids) for diagnostics; a pronoun is never resolved from it."""
    rows = lexicon.select("entity_id", F.explode("anaphors").alias("a")).withColumn("surface", surface_form(F.col("a")))
    return rows.where(is_ambiguous_pronoun(F.col("surface"))).groupBy("surface").agg(F.sort_array(F.collect_set("entity_id")).alias("entity_ids"))


def literal_index(lexicon: DataFrame) -> DataFrame:
    return lexicon.where("type = 'LITERAL'").groupBy(surface_form(F.col("label")).alias("surface")).agg(F.min("entity_id").alias("entity_id"))


def resolve_surface(rows: DataFrame, lexicon: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with ``entity_id``: by alias, by alias without the possessive, by unique description, else null.

    The three indexes become one table with a rank, so there is a single join.
    """
    index = alias_index(lexicon).select("surface", "entity_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("step"))
    index = index.unionByName(description_index(lexicon).withColumn("step", F.lit(2)))
    distinct = rows.select(F.col(text).alias("__text")).distinct()
    found = distinct.select("__text", F.inline(_keys(F.col("__text")))).join(shuffled(index), ["surface", "step"]).groupBy("__text").agg(F.min(F.struct("step", "entity_id")).alias("m"))
    return rows.join(shuffled(found.select("__text", F.col("m.entity_id").alias("entity_id"))), F.col(text).eqNullSafe(F.col("__text")), "left").drop("__text")


def _keys(t):
    """What a text is looked up as, in this order."""
    forms = (surface_form(t), surface_form(without_possessive(t)), surface_form(t))
    return F.array(*(F.struct(form.alias("surface"), F.lit(step).alias("step")) for step, form in enumerate(forms)))


def resolve_literal(rows: DataFrame, lexicon: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with ``literal_id``: exact on the normal form, then without a leading article."""
    index = literal_index(lexicon)
    first = index.select(F.col("surface").alias("__a"), F.col("entity_id").alias("__ida"))
    second = index.select(F.col("surface").alias("__b"), F.col("entity_id").alias("__idb"))
    out = rows.join(first, surface_form(F.col(text)) == F.col("__a"), "left").join(second, surface_form(without_determiner(F.trim(F.col(text)))) == F.col("__b"), "left")
    return out.withColumn("literal_id", F.coalesce("__ida", "__idb")).drop("__a", "__b", "__ida", "__idb")


def longest_in_text(docs: DataFrame, lexicon: DataFrame, text: str = "text") -> DataFrame:
    """(document_id, surface, entity_id): the longest lexicon surface that stands alone in a text; of several as long, the first in the alphabet.

    Texts are cut into word runs, of the word counts that surfaces have, which
    meet the surfaces in an equi-join, so texts and lexicon never meet pairwise.
    """
    split = lambda c: F.filter(F.split(c, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    index = cut(alias_index(lexicon).withColumn("run", F.array_join(split("surface"), " ")))
    sizes = sorted(r["n"] for r in index.select(F.size(F.split("run", " ")).alias("n")).distinct().collect())  # a lexicon has few
    counts = F.filter(F.array(*map(F.lit, sizes)).cast("array<int>"), lambda n: n <= F.size("__w"))
    runs = F.array_distinct(F.flatten(F.transform(counts, lambda n: F.transform(F.sequence(F.lit(0), F.size("__w") - n), lambda i: F.array_join(F.slice("__w", i + 1, n), " ")))))
    rows = docs.select("document_id", split(surface_form(F.col(text))).alias("__w")).where(F.size("__w") > 0).select("document_id", F.explode(runs).alias("run"))
    best = F.min(F.struct((-F.length("surface")).alias("l"), "surface", "entity_id"))
    return rows.join(shuffled(index), "run").groupBy("document_id").agg(best.alias("m")).select("document_id", "m.surface", "m.entity_id")


def annotate(mentions: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Mentions with entity id, label and type; what is unresolved passes through."""
    out = resolve_surface(mentions, lexicon)
    record = lexicon.select("entity_id", F.col("label").alias("canonical_label"), F.col("type").alias("entity_type"))
    return out.join(shuffled(record), "entity_id", "left")


def record(lexicon: DataFrame, entity_id: str) -> DataFrame:
    """What is declared of an id: label (the id itself where nothing is), type, aliases, anaphors, and whether it is a literal."""
    one = lexicon.sparkSession.range(1).select(F.lit(entity_id).alias("entity_id")).join(lexicon.where(F.col("entity_id") == entity_id), "entity_id", "left")
    return one.select("entity_id", F.coalesce("label", "entity_id").alias("label"), "type", "aliases", "anaphors", F.coalesce(F.col("type") == "LITERAL", F.lit(False)).alias("is_literal"))
