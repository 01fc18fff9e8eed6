"""Searches over an edge table: look-ups, pattern joins, paths.

``edges``: src, dst, relation, src_label, dst_label, src_type, dst_type,
document_id, sentence_id, triple_id and provenance. Types and labels stand on
the edges, so type tests need no join. Order is always carried in columns:
an edge's place is (src, relation, dst, document_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import vocab
from quillgraph.functions.text import inverse_phrase
from quillgraph.operators.cut import cut
from quillgraph.plans.question import Pattern, Plan

PROVENANCE = ("document_id", "sentence_id", "triple_id", "sentence", "rule_id", "confidence", "coref_resolved", "inferred", "original_subject", "original_object")


def edge_table(triples: DataFrame) -> DataFrame:
    keep = [c for c in PROVENANCE if c in triples.columns]
    return triples.select(
        F.col("subject_id").alias("src"), F.col("object_id").alias("dst"), "relation", F.col("subject").alias("src_label"), F.col("object").alias("dst_label"),
        F.col("subject_type").alias("src_type"), F.col("object_type").alias("dst_type"), F.col("sentence_index").alias("sentence_id"), *keep,
    )


def reversed_edges(edges: DataFrame) -> DataFrame:
    swap = {"src": "dst", "dst": "src", "src_label": "dst_label", "dst_label": "src_label", "src_type": "dst_type", "dst_type": "src_type"}
    return edges.select(*(F.col(swap.get(c, c)).alias(c) for c in edges.columns))


def search(edges: DataFrame, entity_id: str, relations: tuple[str, ...], direction: str) -> DataFrame:
    """Edges of these relations at the entity, turned so that the entity is ``src``; the filter reaches the scan on either side."""
    of = edges.where(F.col("relation").isin(*relations))
    out = of.where(F.col("src") == entity_id)
    back = reversed_edges(of.where(F.col("dst") == entity_id))
    return {"outgoing": out, "incoming": back, "both": out.unionByName(back)}[direction]


def best_evidence(found: DataFrame) -> DataFrame:
    """One row per answer label, by its first evidence (document, sentence, triple)."""
    order = F.struct("document_id", "sentence_id", "triple_id")
    rest = [c for c in found.columns if c not in ("dst_label", "document_id", "sentence_id", "triple_id")]
    best = found.groupBy("dst_label").agg(F.min(F.struct(order.alias("o"), *rest)).alias("m"))
    return best.select(F.col("dst_label").alias("answer"), "m.o.*", *(f"m.{c}" for c in rest if c not in ("src_type", "dst_type")))


def typed(column: str, wanted: str | None) -> Column:
    return F.lit(True) if not wanted else F.upper(column) == wanted.upper()


def _column(variable: str) -> str:
    return "v_" + variable.lstrip("?")


def pattern_edges(edges: DataFrame, pattern: Pattern, subject_known: bool, object_known: bool) -> DataFrame:
    """(s, s_label, o, o_label, place): what a pattern may bind. With both ends open it binds nothing.

    Symmetric relations also match against the stored direction; there only the
    end that the search does not start from is tested for its type.
    """
    of = edges.where(F.col("relation") == pattern.relation)
    st, ot = pattern.subject.type, pattern.object.type
    place = lambda rank: F.array(F.lit(rank), "src", "relation", "dst", "document_id").alias("place")

    def ends(rows: DataFrame, s: str, o: str, rank: str) -> DataFrame:
        return rows.select(F.col(s).alias("s"), F.col(f"{s}_label").alias("s_label"), F.col(o).alias("o"), F.col(f"{o}_label").alias("o_label"), place(rank))

    parts = []
    if subject_known or object_known:
        parts.append(ends(of.where(typed("src_type", st) & typed("dst_type", ot)), "src", "dst", "0" if subject_known else "1"))
    if pattern.relation in vocab.SYMMETRIC:
        if subject_known:
            parts.append(ends(of.where(typed("src_type", ot)), "dst", "src", "2"))
        if object_known:
            parts.append(ends(of.where(typed("dst_type", st)), "dst", "src", "3"))
    out = parts[0] if parts else ends(of.where("false"), "src", "dst", "0")
    for p in parts[1:]:
        out = out.unionByName(p)
    for term, end in ((pattern.subject, "s"), (pattern.object, "o")):
        if term.entity_id:
            out = out.where(F.col(end) == term.entity_id)
    return out


def run_patterns(edges: DataFrame, plan: Plan) -> list[DataFrame]:
    """Bindings after each pattern: a column per variable, ``label`` of the answer once it is bound, and ``place``, the edges they came by. First edge wins per binding."""
    bound: DataFrame | None = None
    steps = []
    for pattern in plan.patterns:
        names = [] if bound is None else [c for c in bound.columns if c.startswith("v_")]
        known = [bool(t.entity_id) or _column(t.variable) in names for t in (pattern.subject, pattern.object)]
        found = pattern_edges(edges, pattern, *known).withColumnRenamed("place", "here")
        ends = {_column(t.variable): e for t, e in ((pattern.subject, "s"), (pattern.object, "o")) if t.variable}
        new = [v for v in ends if v not in names]
        labelled = [F.col(f"{ends[v]}_label").alias("label") for v in new if v == _column(plan.answer)]
        if bound is None:
            joined = found.select(*(F.col(ends[v]).alias(v) for v in new), *labelled, F.col("here").alias("place"))
        else:
            on = F.lit(True)
            for v in (v for v in ends if v in names):
                on = on & (F.col(v) == F.col(ends[v]))
            before = [c for c in bound.columns if c != "place"]
            joined = bound.join(found, on).select(*before, *(F.col(ends[v]).alias(v) for v in new), *labelled, F.concat("place", "here").alias("place"))
        label = [F.first("label").alias("label")] if "label" in joined.columns else []
        variables = [c for c in joined.columns if c.startswith("v_")]
        least = [*label, F.min("place").alias("place")]
        bound = joined.groupBy(*variables).agg(*least) if variables else joined.agg(*least).where("place IS NOT NULL")
        steps.append(bound)
    return steps


def answers(bindings: DataFrame, answer: str = "?answer") -> DataFrame:
    """(entity_id, answer, place): each bound answer once, by its first binding; its label stands on the edge that bound it."""
    rows = bindings.groupBy(F.col(_column(answer)).alias("entity_id")).agg(F.first("label").alias("label"), F.min("place").alias("place"))
    return rows.select("entity_id", F.coalesce("label", "entity_id").alias("answer"), "place")


def plan_union(edges: DataFrame, plan: Plan) -> DataFrame:
    """(entity_id, answer, plan_no, place) over the plan and its alternatives; the first plan that finds an answer has it."""
    parts = [answers(run_patterns(edges, p)[-1], p.answer).withColumn("plan_no", F.lit(n)) for n, p in enumerate((plan, *plan.alternatives))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("entity_id", "answer").agg(F.min(F.struct("plan_no", "place")).alias("m")).select("entity_id", "answer", "m.plan_no", "m.place")


#: Fields of an edge in ``place``.
_PLACE = 5


def execution_steps(edges: DataFrame, found: DataFrame) -> DataFrame:
    """(answer, plan_no, step, edge columns): the edge by which each step of each answer was bound. ``found`` is (answer, plan_no, place)."""
    n = F.floor(F.size("place") / _PLACE).cast("int")
    hops = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.alias("step"), F.slice("place", (i - 1) * _PLACE + 1, _PLACE).alias("p")))
    rows = found.select("answer", "plan_no", F.inline(hops))
    key = dict(zip(("src", "relation", "dst", "document_id"), range(1, _PLACE), strict=True))
    rows = rows.select("answer", "plan_no", "step", *(F.col("p")[i].alias(f"at_{c}") for c, i in key.items()))
    on = F.lit(True)
    for c in key:
        on = on & (F.col(c) == F.col(f"at_{c}"))
    return edges.join(rows, on).select("answer", "plan_no", "step", *edges.columns)


def neighbourhood(edges: DataFrame, entity_id: str, depth: int) -> DataFrame:
    """(entity_id, distance): nodes within ``depth`` undirected hops, the start included; none for an unknown start."""
    both = cut(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    seen = both.where(F.col("src") == entity_id).select(F.col("src").alias("entity_id")).distinct().withColumn("distance", F.lit(0))
    for d in range(1, depth + 1):
        edge_of = seen.where(F.col("distance") == d - 1).select(F.col("entity_id").alias("src"))
        new = both.join(edge_of, "src", "left_semi").select(F.col("dst").alias("entity_id")).distinct().join(seen, "entity_id", "left_anti")
        seen = cut(seen.unionByName(new.withColumn("distance", F.lit(d))))
    return seen


def paths(edges: DataFrame, source: str, target: str, max_depth: int = 3) -> DataFrame:
    """(length, nodes, hops) of breadth-first paths, undirected.

    Each node keeps the path by which it was first reached (by the order of the
    frontier, out-edges before in-edges, then edge order); each edge from a
    reached node into the target is a path of its own. A hop is a struct
    (from_id, relation, to_id, document_id, direction, triple_id).
    """
    hop = F.struct(F.col("node").alias("from_id"), F.col("relation"), F.col("next").alias("to_id"), "document_id", "direction", "triple_id")
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("next"), "relation", "document_id", "triple_id", F.lit("forward").alias("direction"), F.array(F.lit("0"), "src", "relation", "dst", "document_id").alias("here"))
    back = edges.select(F.col("dst").alias("node"), F.col("src").alias("next"), "relation", "document_id", "triple_id", F.lit("reverse").alias("direction"), F.array(F.lit("1"), "src", "relation", "dst", "document_id").alias("here"))
    moves = cut(out.unionByName(back))
    spark = edges.sparkSession
    frontier = spark.range(1).select(F.lit(source).alias("node"), F.array(F.lit(source)).alias("nodes"), F.array().cast("array<struct<from_id:string,relation:string,to_id:string,document_id:string,direction:string,triple_id:string>>").alias("hops"), F.array().cast("array<string>").alias("place"))
    seen = frontier.select("node")
    found = None
    for d in range(1, max_depth + 1 if source != target else 1):
        step = frontier.join(moves, "node").where(F.col("next") != source)
        step = step.select("next", F.concat("nodes", F.array("next")).alias("nodes"), F.concat("hops", F.array(hop)).alias("hops"), F.concat("place", "here").alias("place"))
        hits = step.where(F.col("next") == target).select(F.lit(d).alias("length"), "nodes", "hops", "place")
        found = hits if found is None else found.unionByName(hits)
        if d < max_depth:
            new = step.where(F.col("next") != target).join(seen.select(F.col("node").alias("next")), "next", "left_anti")
            frontier = cut(new.groupBy("next").agg(F.min(F.struct("place", "nodes", "hops")).alias("m")).select(F.col("next").alias("node"), "m.nodes", "m.hops", "m.place"))
            seen = seen.unionByName(frontier.select("node"))
    if found is None:
        found = frontier.where("false").select(F.lit(0).alias("length"), "nodes", "hops", "place")
    return found.select("length", "nodes", "hops", "place")


def connection_steps(found: DataFrame) -> DataFrame:
    """(path ordering, step, from_id, phrase, to_id, document_id, direction): hops in words, against the stored direction by the inverse phrase."""
    rows = found.select("length", "place", F.posexplode("hops").alias("step", "h"))
    phrase = F.when(F.col("h.direction") == "forward", F.col("h.relation")).otherwise(inverse_phrase(F.col("h.relation")))
    return rows.select("length", "place", "step", "h.from_id", phrase.alias("phrase"), "h.to_id", "h.document_id", "h.direction")


def evidence(rows: DataFrame) -> DataFrame:
    """``rows`` (with provenance) and ``resolutions``: where the text used a reference instead of the name."""
    pair = lambda a, b: F.struct(F.col(a).alias("from"), F.col(b).alias("to"))
    both = F.filter(F.array(pair("original_subject", "canonical_subject"), pair("original_object", "canonical_object")), lambda x: (x["from"] != "") & (x["from"] != x["to"]))
    return rows.withColumn("resolutions", F.when(F.col("coref_resolved"), both).otherwise(F.array().cast("array<struct<from:string,to:string>>")))
