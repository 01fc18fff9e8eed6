"""Sentences, tokens and mentions of documents (document_id, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import vocab
from quillgraph.functions.text import surface_form
from quillgraph.operators.cut import cut, marked, shuffled

#: Strongest first, for spans that overlap.
SOURCES = ("ruler", "ner", "common_noun_noun_chunk", "pronoun", "coreference")


def sentences(docs: DataFrame) -> DataFrame:
    """(document_id, sentence_index, text, start_char, end_char): runs up to and with their end marks, trimmed; blank ones are left out."""
    parts = F.regexp_extract_all(F.col("text"), F.lit(r"[^.!?]+[.!?]*"), F.lit(0))
    # running offsets: what stands before the first run is end marks only
    lead = F.length(F.regexp_extract("text", r"^[.!?]*", 0))
    with_start = F.aggregate(
        parts,
        F.struct(lead.cast("int").alias("at"), F.array().cast("array<struct<s:int,t:string>>").alias("out")),
        lambda acc, p: F.struct((acc["at"] + F.length(p)).cast("int").alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("s"), p.alias("t")))).alias("out")),
    )["out"]
    rows = docs.select("document_id", F.filter(with_start, lambda x: F.trim(F.regexp_replace(x["t"], r"\s+", " ")) != "").alias("p")).select("document_id", F.posexplode("p").alias("sentence_index", "x"))
    left = F.length("x.t") - F.length(F.regexp_replace("x.t", r"^\s+", ""))
    own = F.regexp_replace(F.regexp_replace("x.t", r"^\s+", ""), r"\s+$", "")
    start = F.col("x.s") + left
    return rows.select("document_id", "sentence_index", own.alias("text"), start.cast("int").alias("start_char"), (start + F.length(own)).cast("int").alias("end_char"))


def words(docs: DataFrame) -> DataFrame:
    """(document_id, i, text): words and single marks in order."""
    return docs.select("document_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"), F.lit(0))).alias("i", "text"))


def word_counts(surfaces: DataFrame, pattern: str) -> list[int]:
    """How many words surfaces have: the distinct counts, which a lexicon has few of."""
    n = F.size(F.regexp_extract_all("surface", F.lit(pattern), F.lit(0)))
    return sorted(r["n"] for r in surfaces.select(n.alias("n")).where("n > 0").distinct().collect())


def phrase_mentions(docs: DataFrame, surfaces: DataFrame) -> DataFrame:
    """(document_id, start_char, end_char, text, surface, source) of declared surfaces, longest at each place.

    Surfaces that begin with an article are left out. Documents become word
    runs with offsets, of the word counts that surfaces have, so the match is
    one equi-join on the lower-cased run. Runs whose hash no surface has are
    sifted out before they are dealt for it. The result stands by document.
    """
    known = cut(surfaces.select("surface").where("NOT surface LIKE 'the %'").distinct())
    sizes = word_counts(known, r"[\p{L}\p{N}#]+")
    whole, word = r"[\p{L}\p{N}#]+[^\p{L}\p{N}#]*", r"([\p{L}\p{N}#]+)[^\p{L}\p{N}#]*"
    lead = F.length(F.regexp_extract("text", r"^[^\p{L}\p{N}#]*", 0))
    rows = docs.select("document_id", lead.alias("lead"), F.regexp_extract_all("text", F.lit(whole), F.lit(0)).alias("p"), F.regexp_extract_all("text", F.lit(word), F.lit(1)).alias("w"), F.col("text").rlike(r"\s\s|[^\S ]").alias("odd"))
    rows = rows.withColumn("s", F.aggregate("p", F.array("lead"), lambda a, p: F.concat(a, F.array(F.element_at(a, -1) + F.length(p)))))

    def runs(n: int) -> Column:
        """Each run of n words: its place, text and hash."""

        def run(k: Column) -> Column:
            last = k + (n - 1)
            before = [F.get("p", k + i) for i in range(n - 1)] if n <= 8 else [F.array_join(F.slice("p", k + 1, n - 1), "")]
            text = F.concat(*before, F.get("w", last))
            surface = F.when(F.col("odd"), surface_form(text)).otherwise(F.lower(text))
            return F.struct(F.get("s", k).alias("start_char"), (F.get("s", last) + F.length(F.get("w", last))).alias("end_char"), text.alias("text"), F.xxhash64(surface).alias("hash"))

        at = F.when(F.size("w") >= n, F.sequence(F.lit(0), F.size("w") - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, run)

    none = F.array().cast("array<struct<start_char:int,end_char:int,text:string,hash:bigint>>")
    rows = rows.select("document_id", F.explode(F.concat(none, *map(runs, sizes))).alias("x")).select("document_id", "x.*").where(_marked(known, F.col("hash"))).drop("hash")
    hit = rows.withColumn("surface", surface_form(F.col("text"))).join(shuffled(known), "surface")
    top = hit.repartition("document_id").groupBy("document_id", "start_char").agg(F.max(F.struct("end_char", "text", "surface")).alias("m"))
    return top.select("document_id", "start_char", "m.end_char", "m.text", "m.surface", F.lit("ruler").alias("source"))


def _marked(known: DataFrame, code: Column) -> Column:
    """May ``code`` be the hash of a surface in ``known``?"""
    return marked(known.select(F.xxhash64("surface").alias("hash")), code)


def detected(ruler: DataFrame, tokens: DataFrame, chunks: DataFrame, surfaces: DataFrame, ner: DataFrame | None = None) -> DataFrame:
    """(document_id, start_char, end_char, text, source, head) of all mentions: declared names, other named entities, definite common nouns and pronouns.

    Spans that a recogniser gives (document_id, start_char, end_char, text,
    label) count as declared where their text is; numbers and dates are none.
    ``head`` is the word by which a reference is understood.
    """
    spans = ruler.select("document_id", "start_char", "end_char", "text", "source")
    if ner is not None:
        declared = surfaces.select(F.col("surface").alias("__s"), F.lit(True).alias("__known")).distinct()
        seen = ner.where(is_entity_label(F.col("label"))).join(shuffled(declared), surface_form(F.col("text")) == F.col("__s"), "left")
        spans = spans.unionByName(seen.select("document_id", "start_char", "end_char", "text", F.when(F.col("__known"), "ruler").otherwise("ner").alias("source")))
    word = lambda i: tokens.select("document_id", F.col("i").alias(i), F.col("pos").alias(f"{i}_pos"), F.col("dep").alias(f"{i}_dep"), F.lower("lemma").alias(f"{i}_lemma"))
    nouns = chunks.join(shuffled(word("root_index")), ["document_id", "root_index"]).join(shuffled(word("start_i")), ["document_id", "start_i"])
    nouns = nouns.where(definite_reference(F.col("start_i_pos"), F.col("start_i_lemma") == "the", F.col("root_index_dep"), F.col("root_index_lemma")))
    nouns = nouns.select("document_id", "start_char", "end_char", "text", F.lit("common_noun_noun_chunk").alias("source"), F.col("root_index_lemma").alias("head"))
    pronouns = tokens.where((F.col("pos") == "PRON") & F.lower("lemma").isin(*vocab.PRONOUN_LEMMAS))
    pronouns = pronouns.select("document_id", "start_char", "end_char", "text", F.lit("pronoun").alias("source"), F.lower("lemma").alias("head"))
    spans = spans.withColumn("head", F.lit(None).cast("string")).unionByName(nouns).unionByName(pronouns)
    return without_overlaps(spans)


def pronoun_mentions(docs: DataFrame) -> DataFrame:
    """(document_id, start_char, end_char, text, source) of pronouns."""
    pieces = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"), F.lit(0))
    rows = docs.select("document_id", pieces.alias("__p"))
    starts = F.aggregate("__p", F.array(F.lit(0)), lambda a, p: F.concat(a, F.array(F.element_at(a, -1) + F.length(p))))
    rows = rows.withColumn("__s", starts).select("document_id", "__s", F.posexplode("__p").alias("k", "text")).where(F.lower("text").isin(*vocab.PRONOUN_LEMMAS))
    start = F.get("__s", F.col("k"))
    return rows.select("document_id", start.alias("start_char"), (start + F.length("text")).alias("end_char"), "text", F.lit("pronoun").alias("source"))


def definite_reference(first_pos: Column, first_definite: Column, root_dep: Column, head_lemma: Column) -> Column:
    """Does a noun chunk refer back ("the company")?"""
    return F.lower(head_lemma).isin(*vocab.COMMON_NOUN_HEADS) & (root_dep != "appos") & ((first_pos == "PRON") | ((first_pos == "DET") & first_definite))


def is_entity_label(ner_label: Column) -> Column:
    return ~ner_label.isin(*vocab.SKIPPED_NER)


def without_overlaps(spans: DataFrame) -> DataFrame:
    """Greedy choice per document: by source, then longest, then first; a span stays if no chosen one overlaps it.

    A window in the order of the text cuts a document into clumps of spans that
    touch, so the choice is a fold over one clump, in the JVM. ``spans`` has
    document_id, start_char, end_char, text, source, and head where it is known.
    """
    head = [F.col("head")] if "head" in spans.columns else [F.lit(None).cast("string").alias("head")]
    rank = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source")).cast("int")
    in_order = Window.partitionBy("document_id").orderBy("start_char", "end_char")
    reached = F.max("end_char").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.select("document_id", F.col("start_char").cast("int").alias("start_char"), F.col("end_char").cast("int").alias("end_char"), "text", "source", *head)
    rows = rows.withColumn("new", F.coalesce(F.col("start_char") >= reached, F.lit(True)).cast("int"))
    rows = rows.withColumn("clump", F.sum("new").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    item = F.struct(rank.alias("rank"), (F.col("start_char") - F.col("end_char")).alias("neg"), "start_char", "end_char", "text", "source", "head")
    listed = rows.groupBy("document_id", "clump").agg(F.sort_array(F.collect_list(item)).alias("all"))
    kind = "array<struct<rank:int,neg:int,start_char:int,end_char:int,text:string,source:string,head:string>>"
    kept = F.aggregate(
        F.col("all").cast(kind),
        F.array().cast(kind),
        lambda acc, x: F.when(F.exists(acc, lambda k: (k["start_char"] < x["end_char"]) & (x["start_char"] < k["end_char"])), acc).otherwise(F.concat(acc, F.array(x))),
    )
    found = listed.select("document_id", F.explode(kept).alias("k"))
    return found.select("document_id", "k.start_char", "k.end_char", "k.text", "k.source", *(["k.head"] if "head" in spans.columns else []))


def located(spans: DataFrame, sents: DataFrame) -> DataFrame:
    """Spans with the sentence they begin in (0 where none does): the last one that began before, by a window in the order of the text."""
    s = sents.select("document_id", F.col("start_char").alias("__at"), F.struct(F.col("sentence_index").alias("n"), F.col("end_char").alias("end")).alias("__s"))
    rows = spans.withColumn("__at", F.col("start_char")).unionByName(s, allowMissingColumns=True)
    order = Window.partitionBy("document_id").orderBy("__at", F.col("__s").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__last", F.last("__s", ignorenulls=True).over(order)).where("__s IS NULL")
    return rows.withColumn("sentence_index", F.coalesce(F.when(F.col("start_char") < F.col("__last.end"), F.col("__last.n")), F.lit(0))).drop("__at", "__s", "__last")


def sentence_text(sents: DataFrame, document_id: str, sentence_index: int) -> DataFrame:
    return sents.where((F.col("document_id") == document_id) & (F.col("sentence_index") == sentence_index)).select("text")


def mentions_at(found: DataFrame, document_id: str, position: int) -> DataFrame:
    """The mentions that cover a place of a document."""
    return found.where((F.col("document_id") == document_id) & (F.col("start_char") <= position) & (F.col("end_char") > position))


def mentions_in_sentence(found: DataFrame, document_id: str, sentence_index: int) -> DataFrame:
    return found.where((F.col("document_id") == document_id) & (F.col("sentence_index") == sentence_index)).orderBy("start_char")
