"""A plain parser for simple clauses, so that extraction runs where no language model is installed.

It gives what the rules read: tokens with a part of speech and a dependency,
noun chunks, sentences. A clause has one predicate, a verb of the rule table;
what stands before it is its subject, what follows its object, prepositions
attach to it. A better parser can take its place: any function from documents
to the same three tables.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import vocab
from quillgraph.operators.cut import cut, shuffled

_LEMMAS = {lemma for _, _, lemmas, _, _ in vocab.RULES for lemma in lemmas} | set(vocab.REPORTING_VERBS)
_BE = {"is", "are", "was", "were", "be", "been"}
_DETERMINERS = {"the", "a", "an", "its", "their", "his", "her", "this", "that"}
_POSSESSIVES = {"its", "their", "his", "her"}
_PREPOSITIONS = {p for _, _, _, preps, _ in vocab.RULES for p in preps} | {"of", "for", "from", "to"}
_IRREGULAR = {"built": "build", "led": "lead", "said": "say", "told": "tell", "wrote": "write", "thought": "think"}
_TOKEN = re.compile(r"'s\b|[^\W_]+(?:[#_-][^\W_]+)*|[^\w\s]")
TOKENS = "array<struct<sentence_index:int,i:int,text:string,pos:string,dep:string,head_i:int,lemma:string,start_char:int,end_char:int>>"
CHUNKS = "array<struct<start_i:int,end_i:int,root_index:int,start_char:int,end_char:int,text:string>>"
SENTENCES = "array<struct<sentence_index:int,text:string,start_char:int,end_char:int>>"


def lemma(word: str) -> str:
    """Of a verb of the rules; any other word is its own lemma."""
    w = word.lower()
    stems = [_IRREGULAR.get(w, w)]
    for end in ("s", "es", "d", "ed", "ing"):
        if w.endswith(end):
            stems += [w[: -len(end)], w[: -len(end)] + "e"]
            if len(w) > len(end) + 2 and w[-len(end) - 1] == w[-len(end) - 2]:
                stems.append(w[: -len(end) - 1])
    return next((s for s in stems if s in _LEMMAS), w)


def _modifier(word: str) -> tuple[str, str]:
    """Part of speech and dependency of a word before the head of a nominal."""
    if word in _POSSESSIVES:
        return "PRON", "poss"
    return ("DET", "det") if word in _DETERMINERS else ("NOUN", "compound")


def parse(text: str, spans: list[tuple[int, int]]) -> tuple[list, list, list]:
    """(tokens, chunks, sentences). ``spans`` are known names; each is one nominal."""
    tokens, chunks, sentences, n = [], [], [], 0
    names = sorted(spans)
    for number, m in enumerate(x for x in re.finditer(r"[^.!?]+[.!?]*", text) if x[0].strip()):
        words = []  # text, start, end, is a name
        at = m.start()
        for a, b in [(a, b) for a, b in names if m.start() <= a < m.end()] + [(m.end(), m.end())]:
            words += [(t[0], at + t.start(), at + t.end(), False) for t in _TOKEN.finditer(text[at:a])]
            if a < b:
                words.append((text[a:b], a, b, True))
            at = max(at, b)
        lemmas = [w.lower() if name else lemma(w) for w, _, _, name in words]
        verb = next((k for k, w in enumerate(words) if not w[3] and lemmas[k] in _LEMMAS and w[0].lower() not in _DETERMINERS), None)
        passive = verb is not None and any(words[k][0].lower() in _BE for k in range(verb))
        rows, nominal, k, prep = [], [], 0, None
        while k < len(words):
            w, a, b, name = words[k]
            low = w.lower()
            if k == verb:
                rows.append(("VERB", "ROOT", k))
                prep = None
            elif not name and low in _BE:
                rows.append(("AUX", "auxpass", k if verb is None else verb))
            elif not name and low in _PREPOSITIONS:
                rows.append(("ADP", "agent" if passive and low == "by" else "prep", k if verb is None else verb))
                prep = k
            elif not name and (low == "'s" or not w[0].isalnum()):
                rows.append(("PART" if low == "'s" else "PUNCT", "case" if low == "'s" else "punct", k if verb is None else verb))
            else:  # a nominal: from here over determiners and plain words to its head
                end = k + 1
                while not name and end < len(words) and end != verb and not words[end][3] and words[end][0][0].isalnum() and words[end][0].lower() not in _PREPOSITIONS | _BE:
                    end += 1
                root = end - 1
                possessor = end < len(words) and words[end][0] == "'s" and end + 1 < len(words)
                if possessor:
                    dep, head = "poss", end + 1
                elif prep is not None:
                    dep, head, prep = "pobj", prep, None
                elif verb is not None and root < verb:
                    dep, head = ("nsubjpass" if passive else "nsubj"), verb
                else:
                    dep, head = "dobj", root if verb is None else verb
                rows += [(*_modifier(words[x][0].lower()), root) for x in range(k, root)]
                rows.append(("PROPN" if name else "PRON" if words[root][0].lower() in vocab.PRONOUN_LEMMAS else "NOUN", dep, head))
                nominal.append((k, end, root))
                k = end
                continue
            k += 1
        for k, (pos, dep, head) in enumerate(rows):
            tokens.append({"sentence_index": number, "i": n + k, "text": words[k][0], "pos": pos, "dep": dep, "head_i": n + head, "lemma": lemmas[k], "start_char": words[k][1], "end_char": words[k][2]})
        for a, b, r in nominal:
            chunks.append({"start_i": n + a, "end_i": n + b, "root_index": n + r, "start_char": words[a][1], "end_char": words[b - 1][2], "text": text[words[a][1] : words[b - 1][2]]})
        lead = len(m[0]) - len(m[0].lstrip())
        sentences.append({"sentence_index": number, "text": m[0].strip(), "start_char": m.start() + lead, "end_char": m.start() + lead + len(m[0].strip())})
        n += len(words)
    return tokens, chunks, sentences


def _parsed(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
    rows = [parse(t or "", [(s["a"], s["b"]) for s in (x if x is not None else [])]) for t, x in zip(texts, spans, strict=True)]
    return pd.DataFrame(rows, columns=["tokens", "chunks", "sentences"])


def annotate(docs: DataFrame, named: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tokens, chunks, sentences) of documents, given the spans of names in them."""
    spans = named.groupBy("document_id").agg(F.collect_list(F.struct(F.col("start_char").alias("a"), F.col("end_char").alias("b"))).alias("spans"))
    run = F.pandas_udf(_parsed, f"tokens {TOKENS}, chunks {CHUNKS}, sentences {SENTENCES}")
    whole = docs.join(shuffled(spans), "document_id", "left").select("document_id", run("text", "spans").alias("p"))
    whole = cut(whole)
    return tuple(whole.select("document_id", F.inline(f"p.{part}")) for part in ("tokens", "chunks", "sentences"))
