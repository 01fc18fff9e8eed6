"""Scalar functions on columns: identifiers, normal forms, digests, display texts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.functions import vocab


def slugify(text: Column) -> Column:
    """Lower-case words joined by ``_``; a final possessive and leading honorifics go."""
    x = F.lower(F.regexp_replace(F.trim(text), r"(?i)'s$", ""))
    x = F.regexp_replace(F.regexp_replace(x, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.regexp_replace(x, "^((" + "|".join(vocab.HONORIFICS) + ")(_|$))+", "")


def entity_id(kind: Column, label: Column) -> Column:
    return F.concat(F.lower(kind), F.lit(":"), slugify(label))


def triple_id(subject: Column, relation: Column, obj: Column, document: Column) -> Column:
    return F.concat(F.lit("triple:"), subject, F.lit("--"), relation, F.lit("->"), obj, F.lit("@"), document)


def mention_id(document: Column, start: Column, end: Column, text: Column) -> Column:
    return F.concat(F.lit("mention:"), document, F.lit(":"), start.cast("string"), F.lit(":"), end.cast("string"), F.lit(":"), slugify(text))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def surface_form(text: Column) -> Column:
    """The key of a lexicon look-up. ``lower`` stands for full case folding, so a sharp s is kept."""
    return F.lower(collapse(text))


def question_form(text: Column) -> Column:
    """Lower case, punctuation to spaces (letters and digits of any script stay), one leading article dropped."""
    x = F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}_\s]", " ")
    return F.regexp_replace(collapse(x), "^the ", "")


def question_form_py(text: str) -> str:
    """``question_form`` for the driver's planner."""
    x = re.sub(r"[^\w\s]", " ", text.casefold())
    return re.sub("^the ", "", re.sub(r"\s+", " ", x).strip())


def without_possessive(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"(?i)'s$", "")


def without_determiner(text: Column) -> Column:
    return F.regexp_replace(text, "(?i)^(the|a|an) ", "")


def is_ambiguous_pronoun(text: Column) -> Column:
    return surface_form(text).isin(*vocab.PRONOUN_SURFACES)


def sentence_estimate(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("."), F.lit(""))) - 1


def confidence(subject_anaphoric: Column, object_anaphoric: Column, inferred: Column) -> Column:
    """A label of how the relation was read, never a probability."""
    return F.when(inferred, F.lit(0.80)).when(subject_anaphoric | object_anaphoric, F.lit(0.90)).otherwise(F.lit(1.00))


def confidence_text(value: Column) -> Column:
    why = F.when(value >= 0.995, "stated").when(value >= 0.895, "through a reference").otherwise("inferred")
    return F.concat(F.format_string("%.2f (", value), why, F.lit(")"))


def html_escaped(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def is_generic_nominal(text: Column) -> Column:
    return F.element_at(F.split(surface_form(text), " "), -1).isin(*vocab.GENERIC_HEADS)


def inverse_phrase(relation: Column) -> Column:
    pairs = [F.lit(x) for kv in vocab.INVERSE_PHRASES.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), relation), F.concat(F.lit("reverse of "), relation))
