"""Questions over a graph: parse on the driver, search in Spark, answer with evidence."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators import search
from quillgraph.plans.question import Lexicon, Parse, Parser, Plan

#: Rows of an answer that are brought to the driver at most (a message says when there are more); ``answers_frame`` has no limit.
SHOWN = 1000


@dataclass
class Result:
    """``matched`` are (subject, relation, object) labels, ``bindings`` variable -> id per answer, ``steps`` the edges by which answers were bound."""

    answers: list[str] = field(default_factory=list)
    message: str = ""
    parse: Parse | None = None
    plan: Plan | None = None
    evidence: list[dict] = field(default_factory=list)
    paths: list[list[dict]] = field(default_factory=list)
    trace: list[str] = field(default_factory=list)
    matched: list[tuple[str, str, str]] = field(default_factory=list)
    bindings: list[dict[str, str]] = field(default_factory=list)
    steps: list[dict] = field(default_factory=list)

    def to_dict(self) -> dict:
        """Plain lists and dictionaries, ready for JSON."""
        x = self.parse
        read = {} if x is None else {
            "entity": x.entity.label if x.entity else None, "entity_match": x.entity.kind if x.entity else None, "relation": ", ".join(x.relations),
            "relation_phrase": x.phrase, "direction": x.direction, "intent": x.intent, "ambiguous": x.ambiguous,
        }
        patterns = self.plan.patterns if self.plan else ()
        return {
            "answers": self.answers, "matched_triples": [list(t) for t in self.matched], "evidence": self.evidence, "paths": self.paths, "interpretation": read, "message": self.message,
            "query_plan": [{"subject": p.subject.show(), "relation": p.relation, "object": p.object.show(), "subject_type": p.subject.type, "object_type": p.object.type} for p in patterns],
            "bindings": self.bindings, "execution_steps": self.steps, "trace": self.trace,
        }


class Engine:
    """``triples`` and a lexicon of (entity_id, label, aliases) records; literals are records too."""

    def __init__(self, triples: DataFrame, lexicon: Lexicon, max_depth: int = 3):
        self.edges = search.edge_table(triples)
        self.parser, self.max_depth = Parser(lexicon), max_depth
        self._names = {s.entity_id: s.label for s in lexicon.surfaces}

    def answers_frame(self, question: str) -> DataFrame | None:
        """The answers as a DataFrame (answer, ...), or None if the question is not understood."""
        parse = self.parser.parse(question)
        if not parse.understood:
            return None
        if parse.intent == "connection":
            return search.paths(self.edges, parse.entity.entity_id, parse.other.entity_id, self.max_depth)
        plan = self.parser.plan(question)
        if plan:
            return search.plan_union(self.edges, plan)
        return search.best_evidence(search.search(self.edges, parse.entity.entity_id, parse.relations, parse.direction))

    def ask(self, question: str) -> Result:
        parse = self.parser.parse(question)
        if not parse.understood:
            return Result(parse=parse, message=_not_understood(parse))
        if parse.intent == "connection":
            return self._connect(parse)
        plan = self.parser.plan(question)
        return self._run(plan, parse) if plan else self._look_up(parse)

    def _look_up(self, parse: Parse) -> Result:
        rows, n = _first(self.answers_frame(parse.raw), "document_id", "sentence_id", "triple_id")
        if not rows:
            return Result(parse=parse, message=f"No {', '.join(parse.relations)} relation found for {parse.entity.label}.")
        matched = [(parse.entity.label, r["relation"], r["answer"]) for r in rows]
        return Result([r["answer"] for r in rows], _left_out(len(rows), n, "answers"), parse, evidence=[r.asDict() for r in rows], matched=matched)

    def _run(self, plan: Plan, parse: Parse) -> Result:
        found = search.plan_union(self.edges, plan).groupBy("answer").agg(F.min(F.struct("plan_no", "place")).alias("m"))
        rows, n = _first(found.select("answer", "m.*"), "plan_no", "place")
        note = f"{plan.note}: {len(plan.alternatives)} candidate plan(s) also executed." if plan.alternatives else ""
        if rows:
            message = " ".join(x for x in (note, _left_out(len(rows), n, "answers")) if x)
            return self._explained(Result([r["answer"] for r in rows], message, parse, plan), rows)
        # only now count step by step, for the one that got furthest
        best = max((self._failure(p) for p in (plan, *plan.alternatives)), key=lambda x: x[0])
        return Result(message=" ".join(x for x in (note, best[1]) if x), parse=parse, plan=plan, trace=[best[1]])

    def _explained(self, result: Result, rows: list) -> Result:
        """With the edge of every step of the shown answers: SHOWN times the number of patterns at most."""
        shown = self.edges.sparkSession.createDataFrame([(r["answer"], r["plan_no"], r["place"]) for r in rows], "answer string, plan_no int, place array<string>")
        found: dict[tuple, list] = {}
        for r in search.execution_steps(self.edges, F.broadcast(shown)).collect():
            found.setdefault((r["plan_no"], r["answer"]), []).append(r)
        plans = (result.plan, *result.plan.alternatives)
        result.trace.append("Plan: " + " ; ".join(p.show() for p in result.plan.patterns))
        seen = set()
        for answer in rows:
            bound: dict[str, str] = {}
            patterns = plans[answer["plan_no"]].patterns
            for r in sorted(found.get((answer["plan_no"], answer["answer"]), []), key=lambda r: (r["step"], r["sentence_id"])):
                pattern, forward = patterns[r["step"] - 1], answer["place"][(r["step"] - 1) * 5] in ("0", "1")
                bound |= {t.variable: e for t, e in zip((pattern.subject, pattern.object), (r["src"], r["dst"]) if forward else (r["dst"], r["src"]), strict=True) if t.variable}
                if (key := (r["plan_no"], r["step"], r["triple_id"])) in seen:
                    continue
                seen.add(key)
                edge = r.asDict()
                step = {"step": r["step"], "subject": r["src_label"], "relation": r["relation"], "object": r["dst_label"], "status": "matched", "message": ""}
                result.steps.append(step | {c: edge.get(c) for c in ("document_id", "sentence", "rule_id", "confidence", "triple_id")})
                result.trace.append(f"Step {r['step']}: {pattern.show()} matched {r['src_label']} --{r['relation']}--> {r['dst_label']}")
                result.matched.append((r["src_label"], r["relation"], r["dst_label"]))
                result.evidence.append({"answer": answer["answer"]} | {c: v for c, v in edge.items() if c not in ("answer", "plan_no", "step")})
            result.bindings.append(bound)
        return result

    def _failure(self, plan: Plan) -> tuple[int, str]:
        for n, (pattern, bound) in enumerate(zip(plan.patterns, search.run_patterns(self.edges, plan), strict=True), 1):
            if bound.isEmpty():
                types = f"{pattern.subject.type or '*'} / {pattern.object.type or '*'}"
                return n, f"Step {n} failed: no edge matches {pattern.show()} (types: {types})."
        return len(plan.patterns) + 1, "No answer variable could be bound."

    def _connect(self, parse: Parse) -> Result:
        rows, n = _first(search.paths(self.edges, parse.entity.entity_id, parse.other.entity_id, self.max_depth), "length", "place")
        if not rows:
            return Result(parse=parse, message=f"No path of length {self.max_depth} or less connects {parse.entity.label} to {parse.other.label}.")
        from quillgraph.functions.vocab import INVERSE_PHRASES

        def shown(h) -> dict:
            forward = h["direction"] == "forward"
            phrase = h["relation"] if forward else INVERSE_PHRASES.get(h["relation"], f"reverse of {h['relation']}")
            return {"from": self._names.get(h["from_id"], h["from_id"]), "relation": phrase, "to": self._names.get(h["to_id"], h["to_id"]), "document_id": h["document_id"], "direction": h["direction"]}

        found = [[shown(h) for h in r["hops"]] for r in rows]
        said = f"Found {n} path(s) of length {self.max_depth} or less."
        return Result([parse.other.label], " ".join(x for x in (said, _left_out(len(rows), n, "paths")) if x), parse, paths=found)


def _first(rows: DataFrame, *order: str) -> tuple[list, int]:
    """The first SHOWN rows, and how many there are."""
    found = rows.orderBy(*order).limit(SHOWN + 1).collect()
    return found[:SHOWN], len(found) if len(found) <= SHOWN else rows.count()


def _left_out(shown: int, n: int, what: str) -> str:
    return f"The first {shown} of {n} {what} are shown." if n > shown else ""


#: What a question that is not understood is answered with.
NO_ENTITY = 'I could not find an entity in that question. Try a canonical name such as "Aether Analytics", "OrionEdge" or "Project Aurora".'
NO_RELATION = 'I recognised "%s" but not the relation. Try phrasing like "Who founded Aether Analytics?" or "What does Aether Analytics develop?".'
NO_READING = "I could not interpret that question."


def _not_understood(parse: Parse) -> str:
    if parse.entity is None:
        return NO_ENTITY
    return NO_READING if parse.relations else NO_RELATION % parse.entity.label
