"""Spans of characters that meet by position, as equi-joins.

A span is dealt to the bins of ``WIDTH`` characters that it touches, so what
overlaps shares a bin and no join compares all spans of a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 64


def binned(rows: DataFrame, start: str = "start_char", end: str = "end_char", name: str = "bin") -> DataFrame:
    """``rows`` once per bin that the span touches; an empty span has the bin of its start."""
    first = F.floor(F.col(start) / WIDTH)
    last = F.greatest(F.floor((F.col(end) - 1) / WIDTH), first)
    return rows.withColumn(name, F.explode(F.sequence(first, last)))
