"""Declared entities and literals as a DataFrame, validated on the way in."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession

from quillgraph.errors import ConfigurationError
from quillgraph.functions import vocab

SCHEMA = "entity_id string, label string, type string, aliases array<string>, anaphors array<string>, description string, decl_ord long"


def slug(text: str) -> str:
    x = re.sub(r"'s$", "", text.strip(), flags=re.IGNORECASE).lower()
    parts = [p for p in re.sub("[^a-z0-9]+", "_", x).split("_") if p]
    while parts and parts[0] in vocab.HONORIFICS:
        parts.pop(0)
    return "_".join(parts)


def from_records(spark: SparkSession, entities: list[dict], literals: list[dict] = ()) -> DataFrame:
    """A lexicon of declared records: the id must be ``<type>:<slug of the label>``, aliases and anaphors lose repeats, anaphors are lower case."""
    if not entities:
        raise ConfigurationError("the lexicon declares no entity")
    rows = []
    for n, e in enumerate([*entities, *({**x, "type": "LITERAL"} for x in literals)]):
        kind, label = str(e.get("type", "")).upper(), e.get("label")
        if kind not in vocab.ENTITY_TYPES or not label:
            raise ConfigurationError(f"record {n} needs a label and a known type")
        derived = f"{kind.lower()}:{slug(label)}"
        if e.get("id", derived) != derived:
            raise ConfigurationError(f"{e['id']} should be {derived}")
        aliases = [] if kind == "LITERAL" else list(dict.fromkeys([*e.get("aliases", []), label]))
        rows.append((derived, label, kind, aliases, list(dict.fromkeys(a.lower() for a in e.get("anaphors", []))), e.get("description", ""), n))
    return spark.createDataFrame(rows, SCHEMA)


def load(spark: SparkSession, path: str) -> DataFrame:
    """From a JSON or (where a YAML parser is installed) YAML file with ``entities`` and ``literals``, by any path that Spark reads."""
    found = spark.read.text(path, wholetext=True).first()
    if found is None:
        raise ConfigurationError(f"{path} is empty")
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise ConfigurationError("no YAML parser is installed; use JSON") from e
        data = yaml.safe_load(found[0])
    else:
        data = json.loads(found[0])
    return from_records(spark, data.get("entities", []), data.get("literals", []))
