"""Relation rules over dependency trees.

Verb rules are rows of one table, so all of them are one DataFrame: predicates
meet the table by lemma, then subject, objects and prepositions are joined on,
and a CASE names the first check that fails. What fails nothing is a candidate,
the rest are skips; both carry their provenance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import vocab
from quillgraph.functions.text import confidence
from quillgraph.operators import tree
from quillgraph.operators.cut import cut, shuffled

CANDIDATE = ["rule_id", "rule_ord", "relation", "document_id", "sentence_index", "seq", "subject_arg", "object_arg", "inferred", "context_entity", "notes", "reason"]


def rule_table(spark, optional: bool = True) -> DataFrame:
    rows = [(r, n, rel, lemma, list(preps), kind) for n, (r, rel, lemmas, preps, kind) in enumerate(vocab.RULES) for lemma in lemmas if optional or r not in vocab.OPTIONAL_RULES]
    return spark.createDataFrame(rows, "rule_id string, rule_ord int, relation string, lemma string, preps array<string>, kind string")


def _verb_rules(tokens: DataFrame, above: DataFrame, args: DataFrame, rules: DataFrame) -> DataFrame:
    at = lambda col, **names: args.select("document_id", F.col("i").alias(col), *(F.col(what).alias(name) for what, name in names.items()))
    lower = F.lower("lemma")
    verbs = tokens.where(F.col("pos").isin("VERB", "AUX")).withColumn("lemma", lower).join(F.broadcast(rules), "lemma")  # a few dozen fixed rows
    verbs = verbs.select("document_id", "sentence_index", "i", "text", "dep", "head_i", "rule_id", "rule_ord", "relation", "preps", "kind")
    key = ["document_id", "i"]
    subject = tree.subjects(tokens).join(shuffled(at("subject_i", arg="a")), ["document_id", "subject_i"]).where("a IS NOT NULL").groupBy(*key).agg(F.min_by("a", "subject_i").alias("subject"))
    v = verbs.join(shuffled(subject), key, "left")
    v = v.join(shuffled(tree.reported(tokens, above).withColumn("reported", F.lit(True))), key, "left")
    v = v.join(shuffled(tree.subtree_preposition(verbs, tokens, above)), [*key, "rule_id"], "left")
    v = v.join(shuffled(tree.first_child(tokens, vocab.OBJECT_DEPS, "dobj_i")), key, "left")
    v = v.join(shuffled(tree.first_child(tokens, ("nsubjpass",), "passive_i")), key, "left").join(shuffled(tree.first_child(tokens, ("nsubj", "csubj"), "active_i")), key, "left")
    head_object = F.when((F.col("head_i") != F.col("i")) & F.col("dep").isin(*vocab.REDUCED_RELATIVE_DEPS), F.col("head_i"))
    v = v.withColumns({"object_i": F.coalesce("dobj_i", head_object), "patient_i": F.coalesce("passive_i", "active_i")})
    v = v.join(shuffled(at("pobj_i", arg="pobj", with_literal="pobj_lit", nominal="pobj_text")), ["document_id", "pobj_i"], "left")
    v = v.join(shuffled(at("object_i", arg="dobj", with_literal="dobj_lit", nominal="dobj_text")), ["document_id", "object_i"], "left")
    v = v.join(shuffled(at("patient_i", arg="patient")), ["document_id", "patient_i"], "left").join(shuffled(at("head_i", arg="head")), ["document_id", "head_i"], "left")
    lemmas = tokens.select("document_id", F.col("i").alias("dobj_i"), F.lower("lemma").alias("dobj_lemma"))
    v = v.join(shuffled(lemmas), ["document_id", "dobj_i"], "left")
    speaker = above.select("document_id", "i", F.posexplode("ancestors").alias("depth", "up")).where("depth > 0").join(shuffled(subject.select("document_id", F.col("i").alias("up"), F.col("subject.label").alias("l"))), ["document_id", "up"])
    return v.join(shuffled(speaker.groupBy(*key).agg(F.min_by("l", "depth").alias("speaker"))), key, "left")


def _quoted(before: str, what: Column, after: str) -> Column:
    return F.concat(F.lit(before + "'"), what, F.lit("'" + after))


def _judged(v: DataFrame) -> DataFrame:
    c, lit = F.col, F.lit
    text, is_focus = c("text"), c("relation") == "focuses_on"
    pobj, dobj = F.when(is_focus, c("pobj_lit")).otherwise(c("pobj")), F.when(is_focus, c("dobj_lit")).otherwise(c("dobj"))
    goal = F.coalesce(pobj, dobj)
    no_goal = F.when(c("object_i").isNotNull(), _quoted("", c("dobj_text"), " is not a canonical entity")).otherwise(_quoted("", text, " has no object"))
    inside = F.when(c("kind") == "transitive", _quoted("", text, " sits inside a reporting verb clause; the sentence reports it rather than asserting it")).otherwise(_quoted("", text, " sits inside a reporting verb clause"))
    has_prep = c("pobj_i").isNotNull()
    host = F.when(c("dep").isin("acl", "acl:relcl"), c("head")).otherwise(c("subject"))
    on = lambda kind: c("kind") == kind
    reason = (
        F.when(F.coalesce("reported", lit(False)), inside)
        .when(on("transitive") & c("subject").isNull(), _quoted("no resolved subject for ", text, ""))
        .when(on("transitive") & goal.isNull(), F.concat(_quoted("object of ", text, " is not a canonical entity ("), no_goal, lit(")")))
        .when(on("passive") & c("patient_i").isNull(), _quoted("", text, " has no patient subject"))
        .when(on("passive") & c("patient").isNull(), _quoted("patient of ", text, " is not a canonical entity"))
        .when(on("passive") & ~has_prep, _quoted("", text, " has no agent preposition; cannot invert"))
        .when(on("passive") & c("pobj").isNull(), _quoted("agent of ", text, " is not a canonical entity"))
        .when(on("partnership") & ~has_prep, _quoted("", text, " has no 'with' phrase"))
        .when(on("partnership") & host.isNull(), _quoted("host of participial ", text, " is not a canonical entity"))
        .when(on("partnership") & c("pobj").isNull(), _quoted("partner of ", text, " is not a canonical entity"))
        .when(on("integration") & (~has_prep | c("dobj_i").isNull()), _quoted("", text, " lacks a dobj + 'into' phrase"))
        .when(on("integration") & c("dobj").isNull(), _quoted("", c("dobj_text"), " is not a canonical entity"))
        .when(on("integration") & c("pobj").isNull(), _quoted("", c("pobj_text"), " is not a canonical entity"))
        .when(on("renewal") & c("subject").isNull(), _quoted("no resolved subject for ", text, ""))
        .when(on("renewal") & ~F.coalesce(c("dobj_lemma").isin(*vocab.CONTRACT_NOUNS), lit(False)), _quoted("object of ", text, " is not a contract noun; no customer relation is implied"))
        .when(on("renewal") & ~has_prep, _quoted("", text, " has no 'with' phrase"))
        .when(on("renewal") & c("pobj").isNull(), _quoted("'with' partner of ", text, " is not a canonical entity"))
    )
    subject = F.when(on("passive"), c("pobj")).when(on("partnership"), host).when(on("integration"), c("dobj")).otherwise(c("subject"))
    obj = F.when(on("transitive"), goal).when(on("passive"), c("patient")).otherwise(c("pobj"))
    notes = F.when(on("transitive"), F.when(pobj.isNotNull(), _quoted("object via ", c("prep_text"), " phrase")).otherwise("object via direct object")).otherwise(c("kind"))
    return v.select(
        "rule_id", "rule_ord", "relation", "document_id", "sentence_index", c("i").alias("seq"), subject.alias("subject_arg"), obj.alias("object_arg"), on("renewal").alias("inferred"),
        F.when(on("integration"), c("speaker")).alias("context_entity"), notes.alias("notes"), reason.alias("reason"),
    )


def _possessive(tokens: DataFrame, args: DataFrame) -> DataFrame:
    p = tokens.where("dep = 'poss'").select("document_id", "sentence_index", "i", "text", "head_i")
    heads = tokens.select("document_id", F.col("i").alias("head_i"), F.col("text").alias("head_text"))
    p = p.join(shuffled(heads), ["document_id", "head_i"]).join(shuffled(args.select("document_id", "i", F.col("own").alias("owner"))), ["document_id", "i"], "left")
    p = p.join(shuffled(args.select("document_id", F.col("i").alias("head_i"), F.col("arg").alias("thing"))), ["document_id", "head_i"], "left")
    reason = F.when(F.col("owner").isNull(), _quoted("possessor ", F.col("text"), " is not a canonical entity")).when(F.col("thing").isNull(), _quoted("possessed ", F.col("head_text"), " is not a canonical entity"))
    p = p.withColumn("reason", reason).where("reason IS NOT NULL OR owner.entity_id <> thing.entity_id")
    return _contains(p, "R_CONTAINS_POSSESSIVE", "owner", "thing", F.col("i"), F.concat(F.lit("possessive construction '"), "text", F.lit(" "), "head_text", F.lit("'")))


def _inside(tokens: DataFrame, args: DataFrame) -> DataFrame:
    p = tree.prepositions(tokens).where(F.col("prep").isin("inside", "within"))
    host = tokens.select("document_id", F.col("i").alias("head_i"), F.col("dep").alias("host_dep"), F.col("head_i").alias("host_head"))
    p = p.join(shuffled(host), ["document_id", "head_i"]).join(shuffled(tree.first_child(tokens, vocab.OBJECT_DEPS, "dobj_i").withColumnRenamed("i", "head_i")), ["document_id", "head_i"], "left")
    p = p.withColumn("inner_i", F.coalesce("dobj_i", F.when(F.col("host_dep") == "prep", F.col("host_head"))))
    p = p.join(shuffled(args.select("document_id", F.col("i").alias("pobj_i"), F.col("arg").alias("outer"))), ["document_id", "pobj_i"]).join(shuffled(args.select("document_id", F.col("i").alias("inner_i"), F.col("arg").alias("inner"))), ["document_id", "inner_i"])
    p = p.where("outer IS NOT NULL AND inner IS NOT NULL AND outer.entity_id <> inner.entity_id").withColumn("reason", F.lit(None).cast("string"))
    return _contains(p, "R_CONTAINS_INSIDE", "outer", "inner", F.col("prep_i"), _quoted("", F.col("prep_text"), " phrase reverses the direction: the preposition's object is the container"))


def _contains(rows: DataFrame, rule: str, subject: str, obj: str, seq: Column, notes: Column) -> DataFrame:
    order = next(n for n, r in enumerate(vocab.RULES) if r[0] == rule)
    return rows.select(
        F.lit(rule).alias("rule_id"), F.lit(order).alias("rule_ord"), F.lit("contains").alias("relation"), "document_id", "sentence_index", seq.alias("seq"), F.col(subject).alias("subject_arg"),
        F.col(obj).alias("object_arg"), F.lit(False).alias("inferred"), F.lit(None).cast("string").alias("context_entity"), notes.alias("notes"), "reason",
    )


def extract(tokens: DataFrame, chunks: DataFrame, resolutions: DataFrame, lexicon: DataFrame, sents: DataFrame, optional: bool = True) -> tuple[DataFrame, DataFrame]:
    """(candidates, skipped) of all documents."""
    above = cut(tree.ancestors(tokens))
    args = cut(tree.arguments(tokens, chunks, resolutions, lexicon))
    found = _judged(_verb_rules(tokens, above, args, rule_table(tokens.sparkSession, optional))).select(*CANDIDATE)
    if optional:
        found = found.unionByName(_inside(tokens, args).select(*CANDIDATE)).unionByName(_possessive(tokens, args).select(*CANDIDATE))
    found = cut(found)
    found = found.join(shuffled(sents.select("document_id", "sentence_index", F.col("text").alias("sentence"))), ["document_id", "sentence_index"], "left")
    s, o = F.col("subject_arg"), F.col("object_arg")
    good = found.where("reason IS NULL").select(
        "relation", s["entity_id"].alias("subject_id"), s["label"].alias("subject"), s["type"].alias("subject_type"), o["entity_id"].alias("object_id"), o["label"].alias("object"), o["type"].alias("object_type"),
        s["surface"].alias("original_subject"), o["surface"].alias("original_object"), "document_id", "sentence_index", "sentence", "rule_id", "rule_ord", F.col("seq").cast("int").alias("seq"),
        confidence(s["is_anaphoric"], o["is_anaphoric"], F.col("inferred")).alias("confidence"), (s["is_anaphoric"] | o["is_anaphoric"]).alias("coref_resolved"), "inferred", "context_entity", "notes",
    )
    return good, found.where("reason IS NOT NULL").select("rule_id", "relation", "reason", "document_id", "sentence_index", "sentence")
