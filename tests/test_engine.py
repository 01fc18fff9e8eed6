"""Questions, plans and paths over a small graph."""

import pytest
from pyspark.sql import functions as F

from quillgraph.functions.text import triple_id
from quillgraph.plans.engine import Engine
from quillgraph.plans.question import Lexicon, Parser, relation_at
from quillgraph.sources.lexicon import ConfigurationError, from_records, slug

PEOPLE = ["Dr. Mira Sen", "Arun Mehta", "Nila Rao", "Elon Musk"]
COMPANIES = ["Aether Analytics", "Quantum Forge", "LedgerLine", "Helios Bank", "SpaceX", "NASA", "DeNA"]
PRODUCTS = ["OrionEdge", "Starship"]
FACTS = [
    ("Dr. Mira Sen", "founded", "Aether Analytics", "doc_01", 0), ("Aether Analytics", "develops", "OrionEdge", "doc_01", 1), ("Dr. Mira Sen", "leads", "Project Aurora", "doc_01", 2),
    ("Arun Mehta", "works_at", "Aether Analytics", "doc_02", 0), ("Arun Mehta", "works_on", "OrionEdge", "doc_02", 1), ("Nila Rao", "leads", "Project Aurora", "doc_02", 2),
    ("Arun Mehta", "collaborates_with", "Nila Rao", "doc_02", 2), ("Aether Analytics", "partners_with", "Quantum Forge", "doc_03", 0), ("LedgerLine", "partners_with", "Aether Analytics", "doc_04", 0),
    ("OrionEdge", "deployed_at", "Helios Bank", "doc_04", 1), ("Helios Bank", "uses", "OrionEdge", "doc_04", 2), ("Nila Rao", "improves", "Entity Resolution Engine", "doc_05", 0),
    ("Project Aurora", "integrated_into", "OrionEdge", "doc_05", 1), ("LedgerLine", "integrated_into", "OrionEdge", "doc_06", 0), ("Helios Bank", "customer_of", "Aether Analytics", "doc_06", 1),
    ("Elon Musk", "founded", "SpaceX", "doc_07", 0), ("SpaceX", "develops", "Starship", "doc_07", 1), ("NASA", "uses", "Starship", "doc_07", 2), ("NASA", "partners_with", "SpaceX", "doc_07", 3),
]


def kind(label):
    return "PERSON" if label in PEOPLE else "ORGANIZATION" if label in COMPANIES else "PRODUCT" if label in PRODUCTS else "PROJECT" if label.startswith("Project") else "COMPONENT"


def ident(label):
    return f"{kind(label).lower()}:{slug(label)}"


@pytest.fixture(scope="module")
def engine(spark):
    rows = [(ident(s), s, kind(s), r, ident(o), o, kind(o), d, n, f"{s} {r} {o}.") for s, r, o, d, n in FACTS]
    t = spark.createDataFrame(rows, "subject_id string, subject string, subject_type string, relation string, object_id string, object string, object_type string, document_id string, sentence_index int, sentence string")
    t = t.withColumn("triple_id", triple_id(F.col("subject_id"), F.col("relation"), F.col("object_id"), F.col("document_id"))).cache()
    names = list(dict.fromkeys(x for s, _, o, _, _ in FACTS for x in (s, o))) + ["DeNA"]
    aliases = {"Project Aurora": ["Aurora"], "Dr. Mira Sen": ["Mira Sen"]}
    return Engine(t, Lexicon.of((ident(n), n, aliases.get(n, [])) for n in names))


GOLDEN = [
    ("Who founded Aether Analytics?", ["Dr. Mira Sen"]), ("What does Aether Analytics develop?", ["OrionEdge"]), ("Who works at Aether Analytics?", ["Arun Mehta"]),
    ("Who works on OrionEdge?", ["Arun Mehta"]), ("Who leads Project Aurora?", ["Dr. Mira Sen", "Nila Rao"]), ("Who collaborates with Arun Mehta?", ["Nila Rao"]),
    ("Who partnered with Aether Analytics?", ["Quantum Forge", "LedgerLine"]), ("Where is OrionEdge deployed?", ["Helios Bank"]), ("Who uses OrionEdge?", ["Helios Bank"]),
    ("Who improved the Entity Resolution Engine?", ["Nila Rao"]), ("What is integrated into OrionEdge?", ["Project Aurora", "LedgerLine"]), ("Who is the customer of Aether Analytics?", ["Helios Bank"]),
    ("Who founded the company that developed Starship?", ["Elon Musk"]), ("What does the organization that NASA partners with develop?", ["Starship"]),
    ("What does the organization that works with NASA develop?", ["Starship"]), ("Who founded the company that developed the product that NASA uses?", ["Elon Musk"]),
]


@pytest.mark.parametrize(("question", "expected"), GOLDEN)
def test_golden_questions(engine, question, expected):
    assert engine.ask(question).answers == expected


def test_failures_say_why(engine):
    assert "No uses relation" in engine.ask("Who uses Nila Rao?").message
    assert engine.ask("What does the company that NASA uses focus on?").message.startswith("Step 1 failed")
    assert engine.ask("Who leads the organization that partnered with Quantum Forge?").message.startswith("Step 2 failed")
    assert "Ambiguous" in engine.ask("What does the organization that works with NASA develop?").message
    assert not engine.ask("Who is there?").parse.understood


def test_plans_put_the_constant_first(engine):
    plan = engine.parser.plan("Who founded the company that developed the product that NASA uses?")
    assert [p.relation for p in plan.patterns] == ["uses", "develops", "founded"]
    assert plan.patterns[0].subject.entity_id == ident("NASA") and plan.patterns[0].object.type == "PRODUCT"
    assert engine.parser.plan("Who founded SpaceX?") is None


def test_answers_are_explained(engine):
    import json

    found = engine.ask("Who founded the company that developed the product that NASA uses?").to_dict()
    assert found["matched_triples"] == [["NASA", "uses", "Starship"], ["SpaceX", "develops", "Starship"], ["Elon Musk", "founded", "SpaceX"]]
    assert [s["step"] for s in found["execution_steps"]] == [1, 2, 3] and found["execution_steps"][0]["document_id"] == "doc_07" and found["execution_steps"][2]["sentence"] == "Elon Musk founded SpaceX."
    assert found["bindings"] == [{"?product_1": ident("Starship"), "?company_2": ident("SpaceX"), "?answer": ident("Elon Musk")}]
    assert found["query_plan"][0] == {"subject": ident("NASA"), "relation": "uses", "object": "?product_1", "subject_type": None, "object_type": "PRODUCT"}
    assert len(found["trace"]) == 4 and found["interpretation"]["intent"] == "relation_lookup" and json.dumps(found)
    backwards = engine.ask("What does the organization that works with NASA develop?")
    assert backwards.bindings == [{"?organization_1": ident("SpaceX"), "?answer": ident("Starship")}] and backwards.matched[0] == ("NASA", "partners_with", "SpaceX")
    single = engine.ask("Who founded SpaceX?").to_dict()
    assert single["matched_triples"] == [["SpaceX", "founded", "Elon Musk"]] and single["interpretation"]["direction"] == "incoming"


def test_example_questions_are_read(engine):
    from quillgraph.plans import examples

    read = [engine.parser.parse(q) for q in examples.QUESTIONS]
    assert all(p.intent == "relation_lookup" for p in read) and len(examples.EXAMPLES) == 15
    assert [len(engine.parser.plan(q).patterns) for q in examples.MULTI_HOP[:2]] == [2, 2]
    nested = engine.parser.plan("Who works on the product developed by the company founded by Elon Musk?")
    assert [p.show() for p in nested.patterns] == [f"{ident('Elon Musk')} --founded--> ?company_1", "?company_1 --develops--> ?product_2", "?answer --works_on--> ?product_2"]


def test_questions_that_are_not_understood_say_what_to_try(engine):
    assert engine.ask("Who is there?").message.endswith('"Aether Analytics", "OrionEdge" or "Project Aurora".')
    assert engine.ask("NASA?").message.startswith('I recognised "NASA" but not the relation. Try phrasing like')


def test_paths_go_both_ways(engine):
    found = engine.ask("How is Quantum Forge connected to Project Aurora?")
    assert found.paths and all(p[0]["direction"] == "reverse" and p[0]["from"] == "Quantum Forge" for p in found.paths)
    assert {len(p) for p in found.paths} == {3}
    assert engine.ask("How is Elon Musk connected to Arun Mehta?").message.startswith("No path")


def test_repeated_answers_go_before_the_limit(spark, engine, monkeypatch):
    facts = [("o:nasa", "NASA", "uses", "p:x", "Starship", "d0"), ("o:s", "SpaceX", "develops", "p:x", "Starship", "d1")]
    facts += [(f"n:{i}", "Zoe" if i == 3 else "Sam", "founded", "o:s", "SpaceX", f"d{i + 2}") for i in range(4)]
    types = {"o": "ORGANIZATION", "p": "PRODUCT", "n": "PERSON"}
    rows = [(a, s, types[a[0]], r, b, o, types[b[0]], d, 0, f"{s} {r} {o}.") for a, s, r, b, o, d in facts]
    t = spark.createDataFrame(rows, "subject_id string, subject string, subject_type string, relation string, object_id string, object string, object_type string, document_id string, sentence_index int, sentence string")
    t = t.withColumn("triple_id", triple_id(F.col("subject_id"), F.col("relation"), F.col("object_id"), F.col("document_id")))
    names = [("o:nasa", "NASA", []), ("o:s", "SpaceX", []), ("p:x", "Starship", [])]
    monkeypatch.setattr("quillgraph.plans.engine.SHOWN", 2)
    asked = Engine(t, Lexicon.of(names)).ask("Who founded the company that developed the product that NASA uses?")
    assert asked.answers == ["Sam", "Zoe"] and "shown" not in asked.message
    monkeypatch.setattr("quillgraph.plans.engine.SHOWN", 1)
    asked = engine.ask("Who partnered with Aether Analytics?")
    assert asked.answers == ["Quantum Forge"] and asked.message == "The first 1 of 2 answers are shown."
    found = engine.ask("How is Aether Analytics connected to OrionEdge?")
    assert len(found.paths) == 1 and not found.message.startswith("Found 1 ") and "The first 1 of" in found.message


def test_phrases_match_inside_words_and_the_earliest_wins():
    assert relation_at("because nasa leads")[2] == ("uses",)
    assert relation_at("who works with x")[2] == ("collaborates_with", "partners_with")
    assert relation_at("nothing here") is None
    assert Parser(Lexicon.of([("a:b", "B", [])])).parse("Which are used by B?").direction == "outgoing"


def test_lexicon_is_validated(spark):
    assert slug("Dr. Mira Sen") == "mira_sen" and slug("Aurora's") == "aurora"
    with pytest.raises(ConfigurationError):
        from_records(spark, [])
    with pytest.raises(ConfigurationError):
        from_records(spark, [{"label": "X", "type": "PLANET"}])
    with pytest.raises(ConfigurationError):
        from_records(spark, [{"id": "person:y", "label": "X", "type": "PERSON"}])
