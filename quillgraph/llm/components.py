"""Connected components of an edge table: local contraction, then smallest labels with pointer jumping.

Edges and labels stay distributed; every round is written to the shared folder,
so lineage does not grow and a lost executor costs a re-read. First each task
replaces its stretch of ``STRETCH`` edges at most by stars, which shortens all
paths; if there is one stretch only, its stars are the components. Else rounds
of smallest labels join the stars. Only counts reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import written

STRETCH = 200_000


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, label) of every vertex of each stretch: the smallest vertex it is connected to within."""
    parent: dict = {}

    def find(v):
        root = v
        while parent[root] != root:
            root = parent[root]
        while parent[v] != root:
            parent[v], v = root, parent[v]
        return root

    def out() -> pa.RecordBatch:
        kind = batch.column(0).type
        return pa.RecordBatch.from_arrays([pa.array(list(parent), kind), pa.array([find(v) for v in parent], kind)], ["v", "label"])

    seen = 0
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        seen += batch.num_rows
        if seen >= 2 * STRETCH:
            yield out()
            parent, seen = {}, 0
    if parent:
        yield out()


def components(edges: DataFrame) -> DataFrame:
    """(v, label) of every vertex of ``edges`` (a, b); the label is the smallest vertex of its component.

    An empty table gives no rows; loops and repeated edges change nothing.
    """
    flat = written(edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").distinct(), "edges")
    kind = flat.schema["a"].dataType.simpleString()
    n = flat.count()
    local = flat.coalesce(max(1, -(-n // STRETCH))).mapInArrow(_stars, f"v {kind}, label {kind}")
    stars = written(local, "stars")
    if n <= STRETCH:
        return stars
    spokes = stars.where("v <> label")
    both = spokes.select(F.col("v").alias("u"), F.col("label").alias("w")).unionByName(spokes.select(F.col("label").alias("u"), F.col("v").alias("w"))).distinct()
    both = written(both, "edges")
    labels = written(stars.groupBy("v").agg(F.min("label").alias("label")), "labels")
    while True:
        heard = both.join(labels, both["w"] == labels["v"]).groupBy("u").agg(F.min("label").alias("heard"))
        best = labels.join(heard, labels["v"] == heard["u"], "left").select("v", F.col("label").alias("was"), F.least("label", F.coalesce("heard", "label")).alias("label"))
        target = labels.select(F.col("v").alias("t"), F.col("label").alias("beyond"))
        jumped = best.join(target, best["label"] == target["t"], "left").select("v", "was", F.least("label", F.coalesce("beyond", "label")).alias("label"))
        jumped = written(jumped, "labels")
        changed = jumped.where("was <> label").limit(1).count()
        labels = jumped.select("v", "label")
        if not changed:
            return labels
