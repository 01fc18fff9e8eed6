"""Relation rules over annotated sentences."""

import pytest

from quillgraph.plans.pipeline import build
from quillgraph.sources.lexicon import from_records

LEXICON = [
    {"label": "Aether Analytics", "type": "ORGANIZATION", "anaphors": ["the company"]}, {"label": "Dr. Mira Sen", "type": "PERSON"}, {"label": "OrionEdge", "type": "PRODUCT"},
    {"label": "Helios Bank", "type": "ORGANIZATION"}, {"label": "Project Aurora", "type": "PROJECT"}, {"label": "Nila Rao", "type": "PERSON"}, {"label": "Arun Mehta", "type": "PERSON"},
    {"label": "Matching Module", "type": "COMPONENT"},
]
ID = {"Aether": "organization:aether_analytics", "Sen": "person:mira_sen", "OrionEdge": "product:orionedge", "Helios": "organization:helios_bank", "Aurora": "project:project_aurora", "Nila": "person:nila_rao", "Arun": "person:arun_mehta", "Module": "component:matching_module", "company": "organization:aether_analytics"}
LABEL = {"organization:aether_analytics": "Aether Analytics", "person:mira_sen": "Dr. Mira Sen", "product:orionedge": "OrionEdge", "organization:helios_bank": "Helios Bank", "project:project_aurora": "Project Aurora", "person:nila_rao": "Nila Rao", "person:arun_mehta": "Arun Mehta", "component:matching_module": "Matching Module"}

# word/POS/dep/head/lemma
SENTENCES = {
    "passive": "Aether/PROPN/nsubjpass/2/aether was/AUX/auxpass/2/be founded/VERB/ROOT/2/found by/ADP/agent/2/by Sen/PROPN/pobj/3/sen",
    "active": "The/DET/det/1/the company/NOUN/nsubj/2/company develops/VERB/ROOT/2/develop OrionEdge/PROPN/dobj/2/orionedge",
    "no_agent": "Sen/PROPN/nsubj/1/sen founded/VERB/ROOT/1/found Aether/PROPN/dobj/1/aether",
    "renewal": "Helios/PROPN/nsubj/1/helios renewed/VERB/ROOT/1/renew contract/NOUN/dobj/1/contract with/ADP/prep/2/with Aether/PROPN/pobj/3/aether",
    "reported": "Arun/PROPN/nsubj/1/arun said/VERB/ROOT/1/say Sen/PROPN/nsubj/3/sen leads/VERB/ccomp/1/lead Aurora/PROPN/poss/5/aurora Module/PROPN/dobj/3/module",
    "inside": "Nila/PROPN/nsubj/1/nila improved/VERB/ROOT/1/improve Module/PROPN/dobj/1/module inside/ADP/prep/1/inside Aurora/PROPN/pobj/3/aurora",
    "integration": "Aether/PROPN/nsubj/1/aether plans/VERB/ROOT/1/plan to/PART/aux/3/to integrate/VERB/xcomp/1/integrate Aurora/PROPN/dobj/3/aurora into/ADP/prep/3/into OrionEdge/PROPN/pobj/5/orionedge",
    "participial": "Aether/PROPN/ROOT/0/aether partnered/VERB/acl/0/partner with/ADP/prep/1/with Helios/PROPN/pobj/2/helios",
    "appositive": "Nila/PROPN/ROOT/0/nila leading/VERB/amod/2/lead Aurora/PROPN/appos/0/aurora",
    "unknown": "Sen/PROPN/nsubj/1/sen leads/VERB/ROOT/1/lead work/NOUN/dobj/1/work",
}


@pytest.fixture(scope="module")
def graph(spark):
    tokens, chunks, found, sents = [], [], [], []
    for doc, line in SENTENCES.items():
        at = 0
        for i, word in enumerate(line.split()):
            text, pos, dep, head, lemma = word.split("/")
            tokens.append((doc, 0, i, text, pos, dep, int(head), lemma, at, at + len(text)))
            if pos in ("PROPN", "NOUN"):
                chunks.append((doc, i, i + 1, i, at, at + len(text), text))
            if text in ID:
                found.append((doc, at, at + len(text), text, ID[text], LABEL[ID[text]], text == "company"))
            at += len(text) + 1
        sents.append((doc, 0, " ".join(w.split("/")[0] for w in line.split())))
    return build(
        spark.createDataFrame(tokens, "document_id string, sentence_index int, i int, text string, pos string, dep string, head_i int, lemma string, start_char int, end_char int"),
        spark.createDataFrame(chunks, "document_id string, start_i int, end_i int, root_index int, start_char int, end_char int, text string"),
        spark.createDataFrame(found, "document_id string, start_char int, end_char int, mention string, entity_id string, label string, is_anaphoric boolean"),
        from_records(spark, LEXICON),
        spark.createDataFrame(sents, "document_id string, sentence_index int, text string"),
    )


def test_candidates(graph):
    got = {(r["document_id"], r["subject"], r["relation"], r["object"], r["confidence"]) for r in graph.candidates.collect()}
    assert got == {
        ("passive", "Dr. Mira Sen", "founded", "Aether Analytics", 1.0),
        ("active", "Aether Analytics", "develops", "OrionEdge", 0.9),
        ("renewal", "Helios Bank", "customer_of", "Aether Analytics", 0.8),
        ("reported", "Project Aurora", "contains", "Matching Module", 1.0),
        ("inside", "Nila Rao", "improves", "Matching Module", 1.0),
        ("inside", "Project Aurora", "contains", "Matching Module", 1.0),
        ("integration", "Project Aurora", "integrated_into", "OrionEdge", 1.0),
        ("participial", "Aether Analytics", "partners_with", "Helios Bank", 1.0),
        ("appositive", "Nila Rao", "leads", "Project Aurora", 1.0),
    }
    context = {r["document_id"]: r["context_entity"] for r in graph.candidates.collect() if r["context_entity"]}
    assert context == {"integration": "Aether Analytics"}


def test_skips_name_the_first_failed_check(graph):
    got = {(r["document_id"], r["rule_id"], r["reason"]) for r in graph.skipped.collect()}
    assert ("no_agent", "R_FOUNDED_PASSIVE", "'founded' has no agent preposition; cannot invert") in got
    assert ("reported", "R_LEADS", "'leads' sits inside a reporting verb clause; the sentence reports it rather than asserting it") in got
    assert ("unknown", "R_LEADS", "object of 'leads' is not a canonical entity ('work' is not a canonical entity)") in got


def test_graph_is_consistent(graph):
    n = {r["entity_id"]: r for r in graph.nodes.collect()}
    assert sum(r["degree"] for r in n.values()) == 2 * graph.triples.count()
    assert n["organization:helios_bank"]["aliases"] == ["Helios Bank"]
    assert graph.report.first()["triples"] == 9
