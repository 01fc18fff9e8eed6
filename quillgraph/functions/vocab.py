"""Closed vocabularies of the graph and of its question language.

Fixed values: results depend on exactly these words, in this order.
"""

from __future__ import annotations

ENTITY_TYPES = ("PERSON", "ORGANIZATION", "PRODUCT", "PROJECT", "COMPONENT", "LITERAL")

RELATIONS = (
    "founded", "develops", "leads", "focuses_on", "works_at", "works_on", "collaborates_with", "partners_with",
    "deployed_at", "uses", "improves", "integrated_into", "customer_of", "contains", "reuses",
)

SYMMETRIC = ("collaborates_with", "partners_with")

#: Relation -> phrases that name it in a question.
SYNONYMS = {
    "founded": ("founded", "founder of", "started", "co-founded", "founded by"),
    "develops": ("develops", "developed", "develop", "builds", "built", "makes", "made", "creates", "created", "developed by", "made by", "created by"),
    "works_on": ("works on", "working on", "contributes to", "worked on", "worked on by"),
    "works_at": ("works at", "works for", "working at", "joined", "employee of"),
    "leads": ("leads", "leading", "leader of", "headed by", "heads", "lead of"),
    "collaborates_with": ("collaborates with", "collaborate with", "collaborated with", "collaborates", "works with"),
    "partners_with": ("partnered with", "partners with", "partner with", "partnered", "partners", "works with"),
    "deployed_at": ("deployed at", "deployed in", "runs at", "is deployed", "was deployed", "deployed", "runs in", "deployed at by"),
    "uses": ("uses", "using", "use of", "utilizes", "utilises", "use", "used by"),
    "improves": ("improves", "improved", "improving", "enhanced", "improves on", "improved by"),
    "integrated_into": ("integrated into", "integrated in", "integrates into", "integrated with", "integrated"),
    "customer_of": ("customer of", "client of", "customers of"),
    "focuses_on": ("focuses on", "focus on", "focused on", "focuses"),
    "contains": ("contains", "contain", "includes", "comprises", "consists of"),
}

#: Phrases reported as ambiguous whatever they map to.
AMBIGUOUS_PHRASES = ("works with", "works on", "develops", "developed")

NOUN_TYPES = {
    "company": "ORGANIZATION", "organization": "ORGANIZATION", "organisation": "ORGANIZATION", "studio": "ORGANIZATION",
    "foundation": "ORGANIZATION", "bank": "ORGANIZATION", "person": "PERSON", "product": "PRODUCT", "project": "PROJECT",
    "team": "PROJECT", "group": "PROJECT", "working group": "PROJECT", "anime": "PRODUCT", "film": "PRODUCT", "movie": "PRODUCT",
}

#: A hop against the stored direction, in words.
INVERSE_PHRASES = {
    "leads": "led by", "founded": "founded by", "develops": "developed by", "works_at": "employs", "works_on": "worked on by",
    "contains": "contained in", "focuses_on": "focus of", "improves": "improved by", "integrated_into": "integrates",
    "deployed_at": "deployed", "uses": "used by", "customer_of": "has customer", "collaborates_with": "collaborates with",
    "partners_with": "partners with",
}

CONNECTION_WORDS = ("how", "connected", "connection", "connect", "linked", "path")

COMMON_NOUN_HEADS = ("company", "bank", "platform", "project", "engineer", "extension", "engine", "team", "group")
PRONOUN_LEMMAS = ("he", "she", "it", "they", "his", "her", "its", "their", "them", "him")
PRONOUN_SURFACES = ("he", "she", "it", "they", "him", "her", "his", "hers", "its", "their", "them", "himself", "herself")
PLURAL_PRONOUNS = ("they", "them", "their")
SKIPPED_NER = ("CARDINAL", "DATE", "MONEY", "ORDINAL", "PERCENT", "QUANTITY", "TIME")

#: Head word of a reference -> the types it can stand for; a word that is absent stands for any.
EXPECTED_TYPES = {
    "company": ("ORGANIZATION",), "bank": ("ORGANIZATION",), "partner": ("ORGANIZATION",), "platform": ("PRODUCT",),
    "extension": ("PRODUCT",), "project": ("PROJECT",), "engine": ("COMPONENT",), "module": ("COMPONENT",),
    "engineer": ("PERSON",), "scientist": ("PERSON",), "he": ("PERSON",), "she": ("PERSON",), "him": ("PERSON",),
    "they": ("PERSON", "ORGANIZATION"), "it": ("PRODUCT", "ORGANIZATION", "PROJECT"), "its": ("ORGANIZATION", "PRODUCT"),
    "their": ("ORGANIZATION", "PRODUCT"),
}

REPORTING_VERBS = (
    "say", "report", "state", "claim", "note", "mention", "announce", "argue", "believe", "think", "assert", "explain",
    "write", "tell", "suggest", "declare",
)
SUBJECT_DEPS = ("nsubj", "nsubjpass", "csubj", "expl")
PREP_DEPS = ("prep", "agent")
OBJECT_DEPS = ("dobj", "attr", "oprd")
REDUCED_RELATIVE_DEPS = ("amod", "acl", "acl:relcl", "nmod")
GENERIC_HEADS = (
    "work", "alert", "transaction", "branch", "pilot", "contract", "infrastructure", "analysis", "resolution", "detection",
    "time", "fraud", "study", "research", "year", "team", "engine",
)
HONORIFICS = ("dr", "mr", "mrs", "ms", "prof", "sir", "madam")

#: Rules in order: id, relation, verb lemmas, prepositions, kind. A literal may be the object of focuses_on alone.
RULES = (
    ("R_FOUNDED_PASSIVE", "founded", ("found", "establish"), ("by",), "passive"),
    ("R_DEVELOPS", "develops", ("develop", "build", "create"), (), "transitive"),
    ("R_LEADS", "leads", ("lead", "head"), (), "transitive"),
    ("R_FOCUSES_ON", "focuses_on", ("focus", "concentrate"), ("on", "upon"), "transitive"),
    ("R_JOINED_EMPLOYMENT", "works_at", ("join",), (), "transitive"),
    ("R_WORKS_ON", "works_on", ("work",), ("on", "at"), "transitive"),
    ("R_COLLABORATES_WITH", "collaborates_with", ("collaborate",), ("with",), "transitive"),
    ("R_PARTNERS_WITH", "partners_with", ("partner",), ("with",), "partnership"),
    ("R_DEPLOYED_AT", "deployed_at", ("deploy", "install"), ("at", "in"), "transitive"),
    ("R_USES", "uses", ("use", "utilise", "leverage"), (), "transitive"),
    ("R_IMPROVES", "improves", ("improve", "enhance"), (), "transitive"),
    ("R_INTEGRATED_INTO", "integrated_into", ("integrate",), ("into",), "integration"),
    ("R_CUSTOMER_OF", "customer_of", ("renew",), ("with",), "renewal"),
    ("R_CONTAINS_INSIDE", "contains", (), ("inside", "within"), "inside"),
    ("R_CONTAINS_POSSESSIVE", "contains", (), (), "possessive"),
)
OPTIONAL_RULES = ("R_CONTAINS_INSIDE", "R_CONTAINS_POSSESSIVE")
CONTRACT_NOUNS = ("contract", "agreement", "subscription")

TRIPLE_COLUMNS = (
    "triple_id", "subject_id", "subject", "relation", "object_id", "object", "document_id", "sentence_index", "sentence",
    "original_subject", "original_object", "confidence", "coref_resolved", "inferred", "rule_id", "context_entity", "duplicate_count",
)
