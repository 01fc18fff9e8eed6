"""From plain documents to relation candidates: names, parse, mentions, resolution, rules.

The parser, a recogniser of further names and a source of coreference clusters
are a ``Backend``; the built-in one is the plain clause parser alone. Models
are loaded once per worker process by ``per_document``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import surface_form
from quillgraph.operators import coref, mentions, resolve, rules, shallow
from quillgraph.operators.cut import cut, shuffled


@dataclass(frozen=True)
class Backend:
    """``annotate``: (docs, names) -> (tokens, chunks, sentences); ``ner``: docs -> (document_id, start_char, end_char, text, label); ``clusters``: docs -> (document_id, start_char, end_char, surfaces)."""

    annotate: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame, DataFrame]] = shallow.annotate
    ner: Callable[[DataFrame], DataFrame] | None = None
    clusters: Callable[[DataFrame], DataFrame] | None = None


_loaded: dict[str, object] = {}


def per_document(docs: DataFrame, name: str, load: Callable[[], object], run: Callable[[object, str], list[dict]], fields: str, required: bool = True) -> DataFrame:
    """(document_id, fields) that a model gives for each text. ``load`` is called once per worker process; where the model is not ``required``, a failure gives no rows."""

    def made(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            try:
                if name not in _loaded:
                    _loaded[name] = load()
                out.append(run(_loaded[name], t or ""))
            except Exception:
                if required:
                    raise
                out.append([])
        return pd.Series(out, dtype=object)

    found = docs.select("document_id", F.pandas_udf(made, f"array<struct<{fields}>>")("text").alias("found"))
    return found.select("document_id", F.inline("found"))


def resolved(found: DataFrame, sents: DataFrame, lexicon: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """One row per mention: what it resolves to, by which layer, and whether a cluster contradicts a declared description.

    Names resolve by the lexicon or not at all; references by a declared
    description, a cluster, or the nearest earlier name of a fitting type.
    """
    key = ["document_id", "start_char", "end_char"]
    kinds = lexicon.select("entity_id", "label", F.col("type").alias("entity_type"))
    m = cut(mentions.located(found, sents).withColumn("is_named", F.col("source").isin("ruler", "ner")))
    named = resolve.resolve_surface(m.where("is_named").select(*key, "sentence_index", "text"), lexicon).join(shuffled(kinds), "entity_id")
    named = cut(named)
    refs = m.where("NOT is_named")
    described = refs.select(*key, surface_form(F.col("text")).alias("surface")).join(shuffled(resolve.description_index(lexicon)), "surface").select(*key, F.col("entity_id").alias("description_id"))
    if clusters is not None:
        clustered = coref.cluster_entity(coref.tightest_cluster(refs, clusters), lexicon).select(*key, F.col("entity_id").alias("cluster_id"))
    else:
        clustered = refs.select(*key, F.lit(None).cast("string").alias("cluster_id")).where("false")
    before = coref.nearest_antecedent(refs.select("document_id", "start_char", "sentence_index", "head"), named).select("document_id", "start_char", F.col("entity_id").alias("antecedent_id"))
    rows = m.join(shuffled(named.select(*key, F.col("entity_id").alias("alias_id"))), key, "left").join(shuffled(described), key, "left").join(shuffled(clustered), key, "left").join(shuffled(before), ["document_id", "start_char"], "left")
    rows = coref.resolution_chain(rows).withColumnRenamed("source", "mention_source").join(shuffled(kinds.select("entity_id", "label")), "entity_id", "left")
    return rows.select(*key, "sentence_index", F.col("text").alias("mention"), "entity_id", "label", F.col("resolution_source").alias("source"), "mention_source", "conflict", (~F.col("is_named")).alias("is_anaphoric"))


def extracted(docs: DataFrame, lexicon: DataFrame, backend: Backend = Backend()) -> tuple[DataFrame, DataFrame, DataFrame]:  # noqa: B008
    """(candidates, skipped, resolutions) of documents (document_id, text), which are dealt by their ids first: a short table may be one file, its texts much work."""
    docs = docs.repartition("document_id")
    surfaces = cut(resolve.alias_index(lexicon))
    ruler = cut(mentions.phrase_mentions(docs, surfaces))
    tokens, chunks, sents = backend.annotate(docs, ruler)
    found = mentions.detected(ruler, tokens, chunks, surfaces, backend.ner(docs) if backend.ner else None)
    resolutions = cut(resolved(found, sents, lexicon, backend.clusters(docs) if backend.clusters else None))
    candidates, skipped = rules.extract(tokens, chunks, resolutions.where("entity_id IS NOT NULL"), lexicon, sents)
    return candidates, skipped, resolutions
