"""The batch build: documents with parses and resolutions become triples, nodes and edges."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from quillgraph.operators import rules, triples

STAGES = ("rules", "triples", "graph")


@dataclass
class Graph:
    candidates: DataFrame
    skipped: DataFrame
    triples: DataFrame
    nodes: DataFrame
    edges: DataFrame
    report: DataFrame


def build(tokens: DataFrame, chunks: DataFrame, resolutions: DataFrame, lexicon: DataFrame, sentences: DataFrame, optional: bool = True, progress: Callable[[str], None] = lambda _: None) -> Graph:
    """Nothing runs here; sinks do. ``tokens`` come from any parser (``quillgraph.operators.shallow`` is a plain one)."""
    progress(STAGES[0])
    candidates, skipped = rules.extract(tokens, chunks, resolutions, lexicon, sentences, optional)
    progress(STAGES[1])
    found = triples.build(candidates)
    progress(STAGES[2])
    nodes = triples.nodes(found, triples.mention_stats(resolutions), lexicon)
    return Graph(candidates, skipped, found, nodes, triples.edges(found), triples.counters(found, candidates))
