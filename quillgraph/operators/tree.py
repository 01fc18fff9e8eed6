"""Navigation in dependency trees, as joins over a token table.

``tokens``: document_id, sentence_index, i, text, pos, dep, head_i, lemma,
start_char, end_char; ``i`` counts in the document and a root is its own head.
``chunks``: document_id, start_i, end_i, root_index, start_char, end_char, text.
``resolutions``: document_id, start_char, end_char, mention, entity_id, label,
is_anaphoric. Everything is keyed by document, so one shuffle places a
document's rows together for all of these joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import vocab
from quillgraph.functions.text import surface_form, without_determiner
from quillgraph.operators.cut import shuffled
from quillgraph.operators.resolve import literal_index
from quillgraph.operators.spans import binned


def ancestors(tokens: DataFrame) -> DataFrame:
    """(document_id, i, ancestors): a token and everything above it, nearest first. The climb ends at a root, or where it would repeat."""
    heads = F.map_from_entries(F.collect_list(F.struct("i", "head_i")))
    sent = tokens.groupBy("document_id", "sentence_index").agg(heads.alias("h"))

    def climb(i: Column) -> Column:
        step = lambda acc, _: F.when(F.array_contains(acc, F.coalesce(F.col("h")[F.element_at(acc, -1)], F.lit(-1))), acc).otherwise(F.concat(acc, F.array(F.coalesce(F.col("h")[F.element_at(acc, -1)], F.lit(-1)))))
        return F.filter(F.aggregate(F.sequence(F.lit(1), F.size("h")), F.array(i), step), lambda x: x >= 0)

    rows = sent.select("document_id", F.explode(F.transform(F.map_keys("h"), lambda i: F.struct(i.alias("i"), climb(i).alias("ancestors")))).alias("r"))
    return rows.select("document_id", "r.i", "r.ancestors")


def reported(tokens: DataFrame, above: DataFrame) -> DataFrame:
    """(document_id, i) of tokens inside speech or belief: a reporting verb at or above them, or as a clause below."""
    says = tokens.where(F.lower("lemma").isin(*vocab.REPORTING_VERBS)).select("document_id", F.col("i").alias("up"), "dep", "head_i")
    up = above.select("document_id", "i", F.explode("ancestors").alias("up")).join(shuffled(says.select("document_id", "up")), ["document_id", "up"]).select("document_id", "i")
    down = says.where(F.col("dep").isin("ccomp", "advcl", "acl") & (F.col("head_i") != F.col("up"))).select("document_id", F.col("head_i").alias("i"))
    return up.unionByName(down).distinct()


def first_child(tokens: DataFrame, deps: tuple[str, ...], name: str) -> DataFrame:
    """(document_id, i, name): the first child of each token under one of the labels."""
    kids = tokens.where(F.col("dep").isin(*deps) & (F.col("head_i") != F.col("i")))
    return kids.groupBy("document_id", F.col("head_i").alias("i")).agg(F.min("i").alias(name)).select("document_id", "i", name)


def prepositions(tokens: DataFrame) -> DataFrame:
    """(document_id, prep_i, prep, pobj_i): prepositions and agents that have an object."""
    objects = first_child(tokens, ("pobj", "obj", "nsubj", "nsubjpass"), "pobj_i").withColumnRenamed("i", "prep_i")
    preps = tokens.where(F.col("dep").isin(*vocab.PREP_DEPS)).select("document_id", F.col("i").alias("prep_i"), "head_i", F.col("text").alias("prep_text"), F.lower("text").alias("prep"), "sentence_index")
    return preps.join(shuffled(objects), ["document_id", "prep_i"])


def subtree_preposition(verbs: DataFrame, tokens: DataFrame, above: DataFrame) -> DataFrame:
    """(verb keys, prep_text, pobj_i): the first of the verb's prepositions anywhere below it. ``verbs``: document_id, i, rule_id, preps."""
    below = prepositions(tokens).join(shuffled(above.withColumnRenamed("i", "prep_i")), ["document_id", "prep_i"]).select("document_id", "prep_i", "prep", "prep_text", "pobj_i", F.explode("ancestors").alias("i"))
    hit = verbs.select("document_id", "i", "rule_id", "preps").join(shuffled(below), ["document_id", "i"]).where(F.array_contains("preps", F.col("prep")))
    best = F.min(F.struct("prep_i", "prep_text", "pobj_i"))
    return hit.groupBy("document_id", "i", "rule_id").agg(best.alias("m")).select("document_id", "i", "rule_id", "m.prep_text", "m.pobj_i")


def subjects(tokens: DataFrame) -> DataFrame:
    """(document_id, i, subject_i): subject children of each token; where there are none and its head is an apposition, what that stands beside."""
    own = tokens.where(F.col("dep").isin(*vocab.SUBJECT_DEPS) & (F.col("head_i") != F.col("i"))).select("document_id", F.col("head_i").alias("i"), F.col("i").alias("subject_i"))
    host = tokens.where("dep = 'appos' AND head_i <> i").select("document_id", F.col("i").alias("host_i"), F.col("head_i").alias("subject_i"))
    none = tokens.select("document_id", "i", F.col("head_i").alias("host_i")).join(shuffled(own.select("document_id", "i").distinct()), ["document_id", "i"], "left_anti")
    return own.unionByName(none.join(shuffled(host), ["document_id", "host_i"]).select("document_id", "i", "subject_i"))


def _resolved(spans: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Spans with the resolution of the same span, else of the one that shares most characters; the first of several."""
    r = binned(resolutions).select(F.col("document_id").alias("__d"), F.col("bin").alias("__bin"), F.col("start_char").alias("__a"), F.col("end_char").alias("__b"), "mention", "entity_id", "label", "is_anaphoric")
    shared = F.least("end_char", "__b") - F.greatest("start_char", "__a")
    hit = binned(spans).join(shuffled(r), (F.col("document_id") == F.col("__d")) & (F.col("bin") == F.col("__bin")) & (F.col("__a") < F.col("end_char")) & (F.col("start_char") < F.col("__b")))
    rank = F.struct((~((F.col("__a") == F.col("start_char")) & (F.col("__b") == F.col("end_char")))).cast("int").alias("x"), (-shared).alias("s"), F.col("__a").alias("a"))
    keys = ["document_id", "i"]
    return hit.groupBy(*keys).agg(F.min_by(F.struct("entity_id", "label", "mention", "is_anaphoric"), rank).alias("m")).select(*keys, "m.*").where("entity_id IS NOT NULL")


def arguments(tokens: DataFrame, chunks: DataFrame, resolutions: DataFrame, lexicon: DataFrame) -> DataFrame:
    """What each token can stand for: (document_id, i, nominal, arg, own, literal).

    ``arg`` is the entity of the token's noun chunk, ``own`` of its own span
    (else of the chunk), ``literal`` the declared literal that the chunk's
    text is; each is a struct (entity_id, label, type, surface, is_anaphoric).
    """
    c = chunks.select("document_id", "start_i", "end_i", "root_index", "start_char", "end_char", F.col("text").alias("nominal"))
    covered = F.array_union(F.filter(F.sequence("start_i", "end_i"), lambda i: i < F.col("end_i")), F.array("root_index"))
    inside = tokens.select("document_id", "i").join(shuffled(c.withColumn("i", F.explode(covered))), ["document_id", "i"])
    spans = inside.groupBy("document_id", "i").agg(F.min(F.struct("start_i", "start_char", "end_char", "nominal")).alias("m")).select("document_id", "i", "m.start_char", "m.end_char", "m.nominal")
    kinds = lexicon.select("entity_id", "type", F.col("label").alias("__label"))

    def shaped(found: DataFrame, name: str) -> DataFrame:
        known = found.join(shuffled(kinds), "entity_id")
        return known.select("document_id", "i", F.struct("entity_id", F.coalesce("label", "__label").alias("label"), "type", F.col("mention").alias("surface"), "is_anaphoric").alias(name))

    by_chunk = shaped(_resolved(spans, resolutions), "arg")
    by_token = shaped(_resolved(tokens.select("document_id", "i", "start_char", "end_char"), resolutions), "own")
    index = literal_index(lexicon)
    lit = spans.select("document_id", "i", "nominal", F.explode(F.array(F.struct(F.lit(0).alias("step"), surface_form(F.col("nominal")).alias("surface")), F.struct(F.lit(1).alias("step"), surface_form(without_determiner(F.trim("nominal"))).alias("surface")))).alias("k"))
    lit = lit.select("document_id", "i", "nominal", "k.*").join(shuffled(index), "surface").groupBy("document_id", "i").agg(F.min(F.struct("step", "entity_id", "nominal")).alias("m"))
    lit = lit.select("document_id", "i", "m.entity_id", "m.nominal").join(shuffled(kinds), "entity_id")
    lit = lit.select("document_id", "i", F.struct("entity_id", F.col("__label").alias("label"), "type", F.trim("nominal").alias("surface"), F.lit(False).alias("is_anaphoric")).alias("literal"))
    out = tokens.select("document_id", "i", "text").join(shuffled(spans.select("document_id", "i", "nominal")), ["document_id", "i"], "left")
    out = out.join(shuffled(by_chunk), ["document_id", "i"], "left").join(shuffled(by_token), ["document_id", "i"], "left").join(shuffled(lit), ["document_id", "i"], "left")
    plain = lambda x: F.when(F.col(x)["type"] != "LITERAL", F.col(x))
    return out.select(
        "document_id", "i", F.coalesce("nominal", "text").alias("nominal"), plain("arg").alias("arg"), F.coalesce(plain("own"), plain("arg")).alias("own"),
        F.when(F.col("nominal").isNotNull(), F.coalesce("arg", "literal")).alias("with_literal"),
    )
