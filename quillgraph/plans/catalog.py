"""Every registered query of the engine with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.functions import vocab
from quillgraph.operators import coref, explore, extraction, mentions, resolve, search, triples
from quillgraph.plans.question import Lexicon, Parser, Pattern, Plan, Term
from quillgraph.sources import store
from quillgraph.sources.relational import CANDIDATES_SQL, table

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def _triples(spark, d: str) -> DataFrame:
    return store.graph(spark, d)


def _edges(spark, d: str) -> DataFrame:
    return search.edge_table(_triples(spark, d))


def _docs(spark, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.coalesce("text", F.lit("")).alias("text"))


def _lexicon(spark, d: str) -> DataFrame:
    """Parts as products with their (shared) names as aliases and types as descriptions, customers and segments."""
    p = table(spark, d, "part").select(
        F.concat(F.lit("product:part_"), "p_partkey").alias("entity_id"), F.concat(F.lit("Part "), "p_partkey").alias("label"), F.lit("PRODUCT").alias("type"), F.array("p_name").alias("aliases"),
        F.array(F.concat(F.lit("the "), F.lower("p_type")), F.lit("it")).alias("anaphors"), F.col("p_partkey").alias("decl_ord"),
    )
    c = table(spark, d, "customer").select(
        T.entity_id(F.lit("ORGANIZATION"), F.col("c_name")).alias("entity_id"), F.col("c_name").alias("label"), F.lit("ORGANIZATION").alias("type"), F.array(F.concat(F.lit("c_"), "c_custkey")).alias("aliases"),
        F.array(F.concat(F.lit("the customer "), "c_custkey")).alias("anaphors"), (F.col("c_custkey") + 10_000_000_000).alias("decl_ord"),
    )
    s = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.min("c_custkey").alias("k"))
    s = s.select(T.entity_id(F.lit("LITERAL"), F.col("c_mktsegment")).alias("entity_id"), F.col("c_mktsegment").alias("label"), F.lit("LITERAL").alias("type"), F.array().cast("array<string>").alias("aliases"), F.array().cast("array<string>").alias("anaphors"), (F.col("k") + 20_000_000_000).alias("decl_ord"))
    return p.unionByName(c).unionByName(s)


G = CANDIDATES_SQL
LEX_SQL = """
lex AS (SELECT 'product:part_' || p_partkey AS entity_id, 'Part ' || p_partkey AS label, 'PRODUCT' AS type, [p_name] AS aliases, ['the ' || lower(p_type), 'it'] AS anaphors, p_partkey::BIGINT AS decl_ord FROM part
UNION ALL SELECT 'organization:' || regexp_replace(lower(c_name), '[^a-z0-9]+', '_', 'g'), c_name, 'ORGANIZATION', ['c_' || c_custkey], ['the customer ' || c_custkey], c_custkey + 10000000000 FROM customer
UNION ALL SELECT 'literal:' || regexp_replace(lower(c_mktsegment), '[^a-z0-9]+', '_', 'g'), c_mktsegment, 'LITERAL', [], [], min(c_custkey) + 20000000000 FROM customer GROUP BY c_mktsegment),
spellings AS (SELECT entity_id, decl_ord, x AS spelling, trim(regexp_replace(lower(x), '\\s+', ' ', 'g')) AS surface FROM (SELECT entity_id, decl_ord, unnest(list_distinct(list_concat(aliases, [label]))) AS x FROM lex WHERE type <> 'LITERAL')),
alias_index AS (SELECT surface, arg_min(entity_id, row(-length(spelling), decl_ord, entity_id)) AS entity_id FROM spellings WHERE surface <> '' GROUP BY surface),
des AS (SELECT entity_id, lower(unnest(anaphors)) AS surface FROM lex WHERE type <> 'LITERAL'),
desc_index AS (SELECT surface, min(entity_id) AS entity_id FROM des WHERE surface NOT IN ('he', 'she', 'it', 'they', 'him', 'her', 'his', 'hers', 'its', 'their', 'them', 'himself', 'herself') GROUP BY surface HAVING count(DISTINCT entity_id) = 1)
""".replace("\\\\", "\\")

# -- sources and scalar functions ------------------------------------------


@query("doc_scan_hash", "SELECT doc_id::VARCHAR AS document_id, sha256(text) AS sha256, length(text)::BIGINT AS character_count, (length(text) - length(replace(text, '.', '')) - 1)::BIGINT AS sentences_estimate FROM documents WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''")
def doc_scan_hash(spark, d):
    docs = _docs(spark, d).where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "")
    return docs.select("document_id", F.sha2("text", 256).alias("sha256"), F.char_length("text").cast("long").alias("character_count"), T.sentence_estimate(F.col("text")).cast("long").alias("sentences_estimate"))


@query(
    "slugify_labels",
    """WITH x AS (SELECT c_custkey, 'Dr. ' || c_name || ' of ' || c_mktsegment || '''s' AS label FROM customer),
    y AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_replace(trim(label), '''s$', '')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM x)
    SELECT c_custkey, label, regexp_replace(s, '^((dr|mr|mrs|ms|prof|sir|madam)(_|$))+', '') AS slug FROM y""",
)
def slugify_labels(spark, d):
    x = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("Dr. "), "c_name", F.lit(" of "), "c_mktsegment", F.lit("'s")).alias("label"))
    return x.withColumn("slug", T.slugify(F.col("label")))


@query("entity_ids", "SELECT s_suppkey, 'organization:' || regexp_replace(lower(s_name), '[^a-z0-9]+', '_', 'g') AS entity_id FROM supplier")
def entity_ids(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", T.entity_id(F.lit("ORGANIZATION"), F.col("s_name")).alias("entity_id"))


@query("mention_ids", r"SELECT doc_id, 'mention:' || doc_id || ':0:' || length(text) || ':' || regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(trim(text, ' '), chr(39) || 's$', '', 'i')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), '^((dr|mr|mrs|ms|prof|sir|madam)(_|$))+', '') AS mention_id FROM documents")
def mention_ids(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", T.mention_id(F.col("doc_id").cast("string"), F.lit(0), F.char_length("text"), F.col("text")).alias("mention_id"))


@query("normalise_text", r"SELECT doc_id, regexp_replace(trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')), '^the ', '') AS normal FROM documents")
def normalise_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.question_form(F.col("text")).alias("normal"))


@query("confidence_bands", G + "SELECT rule_id, confidence, count(*)::BIGINT AS n FROM triples GROUP BY ALL")
def confidence_bands(spark, d):
    c = store.candidates(spark, d).withColumn("confidence", T.confidence(F.col("coref_resolved"), F.lit(False), F.col("inferred")))
    return store.grouped(c).groupBy("rule_id", "confidence").agg(F.count("*").alias("n"))


# -- text -------------------------------------------------------------------


@query(
    "sentence_split",
    r"""WITH s AS (SELECT doc_id, regexp_extract_all(text, '[^.!?]+[.!?]*') AS p FROM documents),
    t AS (SELECT doc_id, list_filter(p, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g')) <> '') AS p FROM s),
    u AS (SELECT doc_id, unnest(p) AS x, unnest(range(len(p))) AS i FROM t)
    SELECT doc_id::VARCHAR AS document_id, i::INTEGER AS sentence_index, regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '') AS text FROM u""",
)
def sentence_split(spark, d):
    return mentions.sentences(_docs(spark, d)).select("document_id", "sentence_index", "text")


@query(
    "sentence_counts",
    r"SELECT doc_id::VARCHAR AS document_id, len(list_filter(regexp_extract_all(text, '[^.!?]+[.!?]*'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g')) <> ''))::BIGINT AS n FROM documents WHERE n > 0",
)
def sentence_counts(spark, d):
    return mentions.sentences(_docs(spark, d)).groupBy("document_id").agg(F.count("*").alias("n"))


@query("token_counts", r"SELECT t AS token, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}\s]')) AS t FROM documents) GROUP BY t")
def token_counts(spark, d):
    return mentions.words(_docs(spark, d)).groupBy(F.col("text").alias("token")).agg(F.count("*").alias("n"))


@query(
    "pronoun_mentions",
    r"SELECT doc_id::VARCHAR AS document_id, lower(t) AS pronoun, count(*)::BIGINT AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}]+')) AS t FROM documents) WHERE lower(t) IN ('he', 'she', 'it', 'they', 'his', 'her', 'its', 'their', 'them', 'him') GROUP BY ALL",
)
def pronoun_mentions(spark, d):
    return mentions.pronoun_mentions(_docs(spark, d)).groupBy("document_id", F.lower("text").alias("pronoun")).agg(F.count("*").alias("n"))


def _rendered(spark, d: str) -> DataFrame:
    """A sentence pair per order line."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    o = li.join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    text = F.concat("c_name", F.lit(" uses Part "), F.col("l_partkey").cast("string"), F.lit(". The company focuses on "), F.lower("c_mktsegment"), F.lit("."))
    return o.select(F.concat(F.lit("order_"), "l_orderkey", F.lit("_"), "l_partkey").alias("document_id"), text.alias("text"), "c_name", "l_partkey")


R_SQL = """WITH li AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
rendered AS (SELECT 'order_' || l_orderkey || '_' || l_partkey AS document_id, c_name || ' uses Part ' || l_partkey || '. The company focuses on ' || lower(c_mktsegment) || '.' AS text, c_name, l_partkey FROM li JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)
"""


@query("phrase_match_mentions", R_SQL + "SELECT document_id, 0 AS start_char, length(c_name)::INTEGER AS end_char, lower(c_name) AS surface FROM rendered UNION ALL SELECT document_id, (length(c_name) + 6)::INTEGER, (length(c_name) + 11 + length(l_partkey::VARCHAR))::INTEGER, 'part ' || l_partkey FROM rendered")
def phrase_match_mentions(spark, d):
    surfaces = resolve.alias_index(_lexicon(spark, d))
    return mentions.phrase_mentions(_rendered(spark, d).select("document_id", "text"), surfaces).select("document_id", "start_char", "end_char", "surface")


@query("mention_overlap_resolution", R_SQL + "SELECT document_id, 0 AS start_char, length(c_name)::INTEGER AS end_char, 'ruler' AS source FROM rendered UNION ALL SELECT document_id, (length(c_name) + 6)::INTEGER, (length(c_name) + 11 + length(l_partkey::VARCHAR))::INTEGER, 'ruler' FROM rendered")
def mention_overlap_resolution(spark, d):
    surfaces = resolve.alias_index(_lexicon(spark, d))
    found = mentions.phrase_mentions(_rendered(spark, d).select("document_id", "text"), surfaces).select("document_id", "start_char", "end_char", "text", "source")
    # a weaker reading of the number alone, which the declared surface beats; both from one pass
    own = F.struct("start_char", "end_char", "text", "source")
    weak = F.struct((F.col("start_char") + 2).alias("start_char"), "end_char", F.lit("x").alias("text"), F.lit("ner").alias("source"))
    both = found.select("document_id", F.inline(F.when(F.col("start_char") > 0, F.array(own, weak)).otherwise(F.array(own))))
    return mentions.without_overlaps(both).select("document_id", "start_char", "end_char", "source")


# -- lexicon ------------------------------------------------------------------


@query("alias_index", "WITH " + LEX_SQL + "SELECT surface, entity_id FROM alias_index")
def alias_index(spark, d):
    return resolve.alias_index(_lexicon(spark, d))


@query("unambiguous_descriptions", "WITH " + LEX_SQL + "SELECT surface, entity_id FROM desc_index")
def unambiguous_descriptions(spark, d):
    return resolve.description_index(_lexicon(spark, d))


@query("pronoun_index", "WITH " + LEX_SQL + "SELECT surface, count(DISTINCT entity_id)::BIGINT AS n, min(entity_id) AS first_id FROM des WHERE surface IN ('he', 'she', 'it', 'they', 'him', 'her', 'his', 'hers', 'its', 'their', 'them', 'himself', 'herself') GROUP BY surface")
def pronoun_index(spark, d):
    return resolve.pronoun_index(_lexicon(spark, d)).select("surface", F.size("entity_ids").cast("long").alias("n"), F.col("entity_ids")[0].alias("first_id"))


def _questions(spark, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    k = F.col("o_custkey").cast("string")
    text = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit(" C_"), k, F.lit("'s"))).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("The  customer "), k)).when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("part "), k)).otherwise(F.concat(F.lit("unknown "), k))
    return o.select("o_orderkey", text.alias("text"))


Q_SQL = "q AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN ' C_' || o_custkey || '''s' WHEN 1 THEN 'The  customer ' || o_custkey WHEN 2 THEN 'part ' || o_custkey ELSE 'unknown ' || o_custkey END AS text FROM orders), qf AS (SELECT *, trim(regexp_replace(lower(text), ' +', ' ', 'g')) AS f FROM q)"


@query("surface_resolution", "WITH " + LEX_SQL + ", " + Q_SQL + " SELECT o_orderkey, coalesce(a.entity_id, b.entity_id, c.entity_id) AS entity_id FROM qf LEFT JOIN alias_index a ON a.surface = f LEFT JOIN alias_index b ON b.surface = regexp_replace(f, '''s$', '') LEFT JOIN desc_index c ON c.surface = f")
def surface_resolution(spark, d):
    return resolve.resolve_surface(_questions(spark, d), _lexicon(spark, d)).select("o_orderkey", "entity_id")


@query("entity_annotate", "WITH " + LEX_SQL + ", " + Q_SQL + " SELECT o_orderkey, e.entity_id, label AS canonical_label, type AS entity_type FROM (SELECT o_orderkey, coalesce(a.entity_id, b.entity_id, c.entity_id) AS entity_id FROM qf LEFT JOIN alias_index a ON a.surface = f LEFT JOIN alias_index b ON b.surface = regexp_replace(f, '''s$', '') LEFT JOIN desc_index c ON c.surface = f) e LEFT JOIN lex USING (entity_id)")
def entity_annotate(spark, d):
    return resolve.annotate(_questions(spark, d), _lexicon(spark, d)).select("o_orderkey", "entity_id", "canonical_label", "entity_type")


@query("literal_resolution", "WITH " + LEX_SQL + "SELECT c_custkey, l.entity_id AS literal_id FROM customer JOIN lex l ON l.type = 'LITERAL' AND lower(l.label) = lower(c_mktsegment)")
def literal_resolution(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("The "), F.lower("c_mktsegment")).alias("text"))
    return resolve.resolve_literal(c, _lexicon(spark, d)).select("c_custkey", "literal_id")


@query("longest_entity_in_text", "WITH " + LEX_SQL + ", t AS (SELECT o_orderkey, 'order of part ' || o_custkey || ' by c_' || o_custkey || ' and others' AS text, 'part ' || o_custkey AS a, 'c_' || o_custkey AS b FROM orders) SELECT o_orderkey::VARCHAR AS document_id, coalesce(x.surface, y.surface) AS surface, coalesce(x.entity_id, y.entity_id) AS entity_id FROM t LEFT JOIN alias_index x ON x.surface = a LEFT JOIN alias_index y ON y.surface = b WHERE coalesce(x.surface, y.surface) IS NOT NULL")
def longest_entity_in_text(spark, d):
    k = F.col("o_custkey").cast("string")
    docs = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("document_id"), F.concat(F.lit("order of part "), k, F.lit(" by c_"), k, F.lit(" and others")).alias("text"))
    return resolve.longest_in_text(docs, _lexicon(spark, d))


# -- coreference ---------------------------------------------------------------


def _ev(spark, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id") % 50).alias("document_id"), F.col("event_id").alias("start_char"), (F.col("event_id") % 7).cast("int").alias("sentence_index"), "event_type", "user_id", "event_id")
    named = e.where("event_id % 5 = 0").select("document_id", "start_char", "sentence_index", F.concat(F.lit("person:"), "user_id").alias("entity_id"), F.when(F.col("event_id") % 2 == 0, "PERSON").otherwise("ORGANIZATION").alias("entity_type"), F.col("event_type").alias("text"))
    refs = e.where("event_id % 5 = 3").select("document_id", "start_char", "sentence_index", F.when(F.col("event_id") % 3 == 0, "he").when(F.col("event_id") % 3 == 1, "company").otherwise("they").alias("head"))
    return refs, named


@query(
    "nearest_antecedent",
    """WITH e AS (SELECT 'u' || (user_id % 50) AS document_id, event_id AS start_char, event_id % 7 AS s, event_type, user_id, event_id FROM events),
    n AS (SELECT document_id, start_char, s, 'person:' || user_id AS entity_id, CASE WHEN event_id % 2 = 0 THEN 'PERSON' ELSE 'ORGANIZATION' END AS t, event_type AS x FROM e WHERE event_id % 5 = 0),
    r AS (SELECT document_id, start_char, s, CASE WHEN event_id % 3 = 0 THEN 'PERSON' ELSE 'ORGANIZATION' END AS t FROM e WHERE event_id % 5 = 3)
    SELECT r.document_id, r.start_char, arg_min(n.entity_id, row(CASE WHEN r.s = n.s THEN 0 ELSE 1000 END, r.start_char - n.start_char, n.entity_id, n.x)) AS entity_id FROM r JOIN n ON r.document_id = n.document_id AND n.start_char < r.start_char AND n.t = r.t GROUP BY ALL""",
)
def nearest_antecedent(spark, d):
    return coref.nearest_antecedent(*_ev(spark, d))


@query(
    "tightest_cluster",
    """WITH m AS (SELECT o_custkey::VARCHAR AS document_id, o_orderkey AS a, o_orderkey + 5 AS b FROM orders),
    c AS (SELECT o_custkey::VARCHAR AS document_id, o_orderkey - o_orderkey % 100 AS x, o_orderkey - o_orderkey % 100 + 50 + o_orderkey % 60 AS y, o_orderkey AS k FROM orders)
    SELECT m.document_id, a::BIGINT AS start_char, b::BIGINT AS end_char, min(row(y - x, x))[1]::BIGINT AS width FROM m JOIN c ON m.document_id = c.document_id AND x <= a AND b <= y GROUP BY ALL""",
)
def tightest_cluster(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("document_id"), F.col("o_orderkey").alias("k"))
    m = o.select("document_id", F.col("k").alias("start_char"), (F.col("k") + 5).alias("end_char"))
    low = F.col("k") - F.col("k") % 100
    c = o.select("document_id", low.alias("start_char"), (low + 50 + F.col("k") % 60).alias("end_char"), F.array((F.lit(50) + F.col("k") % 60).cast("string")).alias("surfaces"))
    return coref.tightest_cluster(m, c).select("document_id", "start_char", "end_char", F.col("surfaces")[0].cast("long").alias("width"))


@query(
    "resolution_chain",
    """WITH x AS (SELECT o_orderkey, o_orderkey % 2 = 0 AS named, CASE WHEN o_orderkey % 3 = 0 THEN 'a' END AS al, CASE WHEN o_orderkey % 5 = 0 THEN 'd' END AS de, CASE WHEN o_orderkey % 7 < 3 THEN 'c' END AS cl, CASE WHEN o_orderkey % 11 < 6 THEN 'n' END AS an FROM orders)
    SELECT o_orderkey, CASE WHEN named THEN al ELSE coalesce(de, cl, an) END AS entity_id, CASE WHEN named AND al IS NOT NULL THEN 'ALIAS' WHEN named THEN 'NONE' WHEN de IS NOT NULL THEN 'ALIAS' WHEN cl IS NOT NULL THEN 'FASTCOREF' WHEN an IS NOT NULL THEN 'ANTECEDENT' ELSE 'NONE' END AS resolution_source, NOT named AND de IS NOT NULL AND cl IS NOT NULL AS conflict FROM x""",
)
def resolution_chain(spark, d):
    k = F.col("o_orderkey")
    m = table(spark, d, "orders").select(k, (k % 2 == 0).alias("is_named"), F.when(k % 3 == 0, "a").alias("alias_id"), F.when(k % 5 == 0, "d").alias("description_id"), F.when(k % 7 < 3, "c").alias("cluster_id"), F.when(k % 11 < 6, "n").alias("antecedent_id"))
    return coref.resolution_chain(m).select("o_orderkey", "entity_id", "resolution_source", "conflict")


# -- triples and graph -----------------------------------------------------------

T_COLS = "triple_id, subject_id, relation, object_id, document_id, sentence_index, confidence, coref_resolved, inferred, duplicate_count"


@query("triple_dedup_support", G + f"SELECT {T_COLS} FROM triples")
def triple_dedup_support(spark, d):
    return _triples(spark, d).select(*T_COLS.split(", "))


def _spoiled(spark, d: str) -> DataFrame:
    c = store.candidates(spark, d)
    o = F.when(F.col("sentence_index") == 3, F.lit(None)).when(F.col("sentence_index") == 5, F.col("subject_id")).otherwise(F.col("object_id"))
    return c.withColumn("object_id", o).withColumn("object_type", F.when(F.col("sentence_index") == 6, "LITERAL").otherwise(F.col("object_type")))


@query("reject_reasons", G + "SELECT CASE sentence_index WHEN 3 THEN 'unresolved_endpoint' WHEN 5 THEN 'self_loop' ELSE 'literal_endpoint' END AS reason, count(*)::BIGINT AS n FROM cand WHERE sentence_index IN (3, 5, 6) GROUP BY ALL")
def reject_reasons(spark, d):
    return triples.rejected_counts(_spoiled(spark, d))


@query("edges", G + "SELECT subject_id AS src, object_id AS dst, relation, document_id, sentence_index AS sentence_id, sentence, triple_id, duplicate_count FROM triples")
def edges(spark, d):
    return triples.edges(_triples(spark, d)).select("src", "dst", "relation", "document_id", "sentence_id", "sentence", "triple_id", "duplicate_count")


def _mentions(spark, d: str) -> DataFrame:
    return store.candidates(spark, d).select(F.inline(F.array(F.struct(F.col("subject_id").alias("entity_id"), "document_id"), F.struct(F.col("object_id").alias("entity_id"), "document_id"))))


M_SQL = ", m AS (SELECT subject_id AS entity_id, document_id FROM cand UNION ALL SELECT object_id, document_id FROM cand), st AS (SELECT entity_id, count(*)::BIGINT AS mention_count, count(DISTINCT document_id)::BIGINT AS n_documents FROM m GROUP BY entity_id) "


@query("mention_stats", G + M_SQL + "SELECT * FROM st")
def mention_stats(spark, d):
    return triples.mention_stats(_mentions(spark, d))


@query("degrees", G + "SELECT entity_id, in_degree, out_degree, degree FROM nodes")
def degrees(spark, d):
    return triples.degrees(_triples(spark, d)).select("entity_id", "in_degree", "out_degree", "degree")


@query("nodes", G + M_SQL + "SELECT entity_id, label, type, degree, mention_count, n_documents FROM nodes JOIN st USING (entity_id)")
def nodes(spark, d):
    return triples.nodes(_triples(spark, d), triples.mention_stats(_mentions(spark, d))).select("entity_id", "label", "type", "degree", "mention_count", "n_documents")


@query("relation_histogram", G + "SELECT relation, count(*)::BIGINT AS n FROM triples GROUP BY relation")
def relation_histogram(spark, d):
    return triples.relation_histogram(_triples(spark, d))


@query("run_counters", G + "SELECT (SELECT count(*) FROM cand)::BIGINT AS relation_candidates, (SELECT count(*) FROM triples)::BIGINT AS triples, (SELECT count(*) FROM nodes)::BIGINT AS nodes, (SELECT count(*) FROM nodes WHERE type <> 'LITERAL')::BIGINT AS entities, (SELECT max(degree) FROM nodes)::BIGINT AS largest_degree, (SELECT sum(duplicate_count) FROM triples)::BIGINT AS support")
def run_counters(spark, d):
    return triples.counters(_triples(spark, d), store.candidates(spark, d)).select("relation_candidates", "triples", "nodes", "entities", "largest_degree", "support")


@query("triples_for_entity", G + f"SELECT {T_COLS} FROM triples WHERE subject_id = 'organization:supplier_000000001' OR object_id = 'organization:supplier_000000001'")
def triples_for_entity(spark, d):
    return explore.triples_for(_triples(spark, d), "organization:supplier_000000001").select(*T_COLS.split(", "))


@query("has_edges_inventory", G + ", " + LEX_SQL + "SELECT lex.entity_id, n.entity_id IS NOT NULL AS has_edges FROM lex LEFT JOIN nodes n USING (entity_id)")
def has_edges_inventory(spark, d):
    return explore.inventory(_lexicon(spark, d), _triples(spark, d)).select("entity_id", "has_edges")


@query("integrity_diff", "WITH a AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 0), b AS (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN text || 'x' ELSE text END) AS h FROM documents WHERE doc_id % 11 <> 0) SELECT doc_id, CASE WHEN b.h IS NULL THEN 'MISSING' WHEN a.h IS NULL THEN 'EXTRA' ELSE 'DRIFTED' END AS problem FROM a FULL JOIN b USING (doc_id) WHERE a.h IS DISTINCT FROM b.h")
def integrity_diff(spark, d):
    from quillgraph.sources.corpus import integrity_diff as diff

    docs = table(spark, d, "documents").select("doc_id", "text")
    manifest = docs.where("doc_id % 10 <> 0").select("doc_id", F.sha2("text", 256).alias("sha256"))
    actual = docs.where("doc_id % 11 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("sha256"))
    return diff(manifest, actual, "doc_id")


# -- questions --------------------------------------------------------------------

SUPPLIER, CUSTOMER = "Supplier#000000001", "Customer#000000001"


def _records(spark, d: str):
    """The lexicon entries that the registered questions name; a look-up by name, not a scan into the driver."""
    s = table(spark, d, "supplier").where(F.col("s_name") == SUPPLIER).select(T.entity_id(F.lit("ORGANIZATION"), F.col("s_name")).alias("i"), F.col("s_name").alias("l"))
    c = table(spark, d, "customer").where(F.col("c_name") == CUSTOMER).select(T.entity_id(F.lit("ORGANIZATION"), F.col("c_name")).alias("i"), F.col("c_name").alias("l"))
    return [(r["i"], r["l"], []) for r in s.unionByName(c).collect()]


def _parser(spark, d: str) -> Parser:
    return Parser(Lexicon.of(_records(spark, d)))


def _asked(spark, d: str, question: str) -> DataFrame:
    p = _parser(spark, d)
    parse, plan = p.parse(question), p.plan(question)
    e = _edges(spark, d)
    if plan:
        return search.plan_union(e, plan).select("entity_id", "answer", "plan_no")
    return search.best_evidence(search.search(e, parse.entity.entity_id, parse.relations, parse.direction)).select("answer", "document_id", "sentence_id", "triple_id")


def _look_up_sql(where: str, other: str) -> str:
    return G + f"SELECT {other} AS answer, min(row(document_id, sentence_index, triple_id))[1] AS document_id, min(row(document_id, sentence_index, triple_id))[2] AS sentence_id, min(row(document_id, sentence_index, triple_id))[3] AS triple_id FROM triples WHERE {where} GROUP BY ALL"


S_ID, C_ID = "'organization:supplier_000000001'", "'organization:customer_000000001'"


@query("flagship_question", _look_up_sql(f"relation = 'develops' AND subject_id = {S_ID}", "object"))
def flagship_question(spark, d):
    return _asked(spark, d, f"What does {SUPPLIER} develop?")


@query("lookup_incoming", _look_up_sql(f"relation = 'customer_of' AND object_id = {S_ID}", "subject"))
def lookup_incoming(spark, d):
    return _asked(spark, d, f"Who is the customer of {SUPPLIER}?")


@query("lookup_outgoing", _look_up_sql(f"relation = 'uses' AND subject_id = {C_ID}", "object"))
def lookup_outgoing(spark, d):
    return _asked(spark, d, f"What does {CUSTOMER} use?")


@query("lookup_symmetric", G + f", b AS (SELECT object AS answer, document_id, sentence_index, triple_id FROM triples WHERE relation = 'partners_with' AND subject_id = {S_ID} UNION ALL SELECT subject, document_id, sentence_index, triple_id FROM triples WHERE relation = 'partners_with' AND object_id = {S_ID}) SELECT answer, min(row(document_id, sentence_index, triple_id))[1] AS document_id, min(row(document_id, sentence_index, triple_id))[2] AS sentence_id, min(row(document_id, sentence_index, triple_id))[3] AS triple_id FROM b GROUP BY ALL")
def lookup_symmetric(spark, d):
    return _asked(spark, d, f"Who partnered with {SUPPLIER}?")


_PARSED = [
    (f"Who founded {SUPPLIER}?", "relation_lookup", S_ID, "founded", "founded", "incoming", "false"),
    (f"What does {SUPPLIER} develop?", "relation_lookup", S_ID, "develops", "develop", "outgoing", "false"),
    (f"Who works with {SUPPLIER}?", "relation_lookup", S_ID, "collaborates_with,partners_with", "works with", "both", "true"),
    (f"Which parts are used by {CUSTOMER}?", "relation_lookup", C_ID, "uses", "used by", "outgoing", "false"),
    (f"How is {SUPPLIER} connected to {CUSTOMER}?", "connection", S_ID, "", "", "outgoing", "false"),
    ("Who leads nothing?", "unknown", "NULL", "leads", "leads", "outgoing", "false"),
]


@query("parse_questions", " UNION ALL ".join(f"SELECT '{q}' AS question, '{i}' AS intent, {e} AS entity_id, '{r}' AS relations, '{p}' AS phrase, '{w}' AS direction, {a} AS ambiguous" for q, i, e, r, p, w, a in _PARSED))
def parse_questions(spark, d):
    p = _parser(spark, d)
    rows = [(q, x.intent, x.entity.entity_id if x.entity else None, ",".join(x.relations), x.phrase, x.direction, x.ambiguous) for q, *_ in _PARSED for x in [p.parse(q)]]
    return spark.createDataFrame(rows, "question string, intent string, entity_id string, relations string, phrase string, direction string, ambiguous boolean")


HOP2 = G + "SELECT DISTINCT d.subject_id AS entity_id, d.subject AS answer, 0 AS plan_no FROM triples d JOIN triples u ON u.relation = 'uses' AND u.object_id = d.object_id AND u.subject_id = " + C_ID + " WHERE d.relation = 'develops'"


@query("conjunctive_2hop", HOP2)
def conjunctive_2hop(spark, d):
    return _asked(spark, d, f"Who developed the product that {CUSTOMER} uses?")


@query("conjunctive_3hop", G + "SELECT DISTINCT c.subject_id AS entity_id, c.subject AS answer, 0 AS plan_no FROM triples c JOIN triples d ON d.relation = 'develops' AND d.subject_id = c.object_id JOIN triples u ON u.relation = 'uses' AND u.object_id = d.object_id AND u.subject_id = " + C_ID + " WHERE c.relation = 'contains'")
def conjunctive_3hop(spark, d):
    return _asked(spark, d, f"What contains the company that developed the product that {CUSTOMER} uses?")


@query("type_constraint_empty", G + "SELECT entity_id, label AS answer, 0 AS plan_no FROM nodes WHERE false")
def type_constraint_empty(spark, d):
    return _asked(spark, d, f"Who founded the person that {CUSTOMER} uses?")


@query("ambiguous_plan_union", G + f", p AS (SELECT object_id AS x FROM triples WHERE relation = 'partners_with' AND subject_id = {S_ID} UNION SELECT subject_id FROM triples WHERE relation = 'partners_with' AND object_id = {S_ID}) SELECT DISTINCT object_id AS entity_id, object AS answer, 1 AS plan_no FROM triples JOIN p ON subject_id = x WHERE relation = 'develops'")
def ambiguous_plan_union(spark, d):
    return _asked(spark, d, f"What does the company that works with {SUPPLIER} develop?")


@query("pattern_join_1", G + f"SELECT DISTINCT object_id AS o FROM triples WHERE relation = 'uses' AND subject_id = {C_ID} AND object_type = 'PRODUCT'")
def pattern_join_1(spark, d):
    p = Pattern(Term(entity_id=C_ID.strip("'")), "uses", Term(variable="?answer", type="PRODUCT"))
    return search.run_patterns(_edges(spark, d), Plan((p,)))[0].select(F.col("v_answer").alias("o"))


@query("symmetric_pattern", G + f"SELECT object_id AS o FROM triples WHERE relation = 'partners_with' AND subject_id = {S_ID} UNION SELECT subject_id FROM triples WHERE relation = 'partners_with' AND object_id = {S_ID}")
def symmetric_pattern(spark, d):
    p = Pattern(Term(entity_id=S_ID.strip("'")), "partners_with", Term(variable="?answer", type="ORGANIZATION"))
    return search.run_patterns(_edges(spark, d), Plan((p,)))[0].select(F.col("v_answer").alias("o"))


# -- paths and exploration ----------------------------------------------------------


BI = ", bi AS (SELECT subject_id AS src, object_id AS dst FROM triples UNION SELECT object_id, subject_id FROM triples) "
BFS = BI + f", d0 AS (SELECT DISTINCT src AS n, 0 AS distance FROM bi WHERE src = {S_ID}), d1 AS (SELECT DISTINCT dst AS n, 1 AS distance FROM bi JOIN d0 ON src = n WHERE dst NOT IN (SELECT n FROM d0)), d2 AS (SELECT DISTINCT dst AS n, 2 AS distance FROM bi JOIN d1 ON src = n WHERE dst NOT IN (SELECT n FROM d0 UNION SELECT n FROM d1)) "


@query("neighbourhood_k", G + BFS + "SELECT n AS entity_id, distance FROM d0 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2")
def neighbourhood_k(spark, d):
    return search.neighbourhood(_edges(spark, d), S_ID.strip("'"), 2)


@query("bfs_distance", G + BFS + "SELECT distance, count(*)::BIGINT AS n FROM (SELECT * FROM d0 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2) GROUP BY distance")
def bfs_distance(spark, d):
    return search.neighbourhood(_edges(spark, d), S_ID.strip("'"), 2).groupBy("distance").agg(F.count("*").alias("n"))


def _paths_sql(source: str, target: str, depth: int) -> str:
    """Breadth-first paths, a level a step: ``f`` are the nodes reached first at a level, ``h`` the paths that end there."""
    moves = """, moves AS (SELECT subject_id AS node, object_id AS next, relation, document_id, 'forward' AS direction, ['0', subject_id, relation, object_id, document_id] AS here FROM triples
    UNION ALL SELECT object_id, subject_id, relation, document_id, 'reverse', ['1', subject_id, relation, object_id, document_id] FROM triples)"""
    empty = "[]::STRUCT(f VARCHAR, r VARCHAR, t VARCHAR, d VARCHAR, w VARCHAR)[]"
    sql = moves + f", f0 AS (SELECT {source} AS node, [{source}] AS nodes, {empty} AS hops, []::VARCHAR[] AS place)"
    for n in range(1, depth + 1):
        sql += f", s{n} AS (SELECT next, list_append(nodes, next) AS nodes, list_append(hops, {{'f': node, 'r': relation, 't': next, 'd': document_id, 'w': direction}}) AS hops, list_concat(place, here) AS place FROM f{n - 1} JOIN moves USING (node) WHERE next <> {source})"
        sql += f", h{n} AS (SELECT {n} AS length, nodes, hops, place FROM s{n} WHERE next = {target})"
        before = " UNION ALL ".join(f"SELECT node FROM f{i}" for i in range(n))
        sql += f", f{n} AS (SELECT next AS node, arg_min(nodes, place) AS nodes, arg_min(hops, place) AS hops, min(place) AS place FROM s{n} WHERE next <> {target} AND next NOT IN ({before}) GROUP BY next)"
    return sql + ", hits AS (" + " UNION ALL ".join(f"SELECT * FROM h{n}" for n in range(1, depth + 1)) + ") "


@query("bfs_paths", G + _paths_sql(S_ID, "'organization:supplier_000000002'", 3) + "SELECT length, array_to_string(nodes, ' > ') AS nodes FROM hits")
def bfs_paths(spark, d):
    return search.paths(_edges(spark, d), S_ID.strip("'"), "organization:supplier_000000002", 3).select("length", F.array_join("nodes", " > ").alias("nodes"))


_INVERSE_SQL = "CASE r " + " ".join(f"WHEN '{r}' THEN '{p}'" for r, p in vocab.INVERSE_PHRASES.items()) + " ELSE 'reverse of ' || r END"


@query("connection_steps", G + _paths_sql(S_ID, C_ID, 3) + f"SELECT length, i::INTEGER AS step, f AS from_id, CASE w WHEN 'forward' THEN r ELSE {_INVERSE_SQL} END AS phrase, t AS to_id, d AS document_id, w AS direction FROM (SELECT length, unnest(hops, recursive := true), unnest(range(len(hops))) AS i FROM hits)")
def connection_steps(spark, d):
    return search.connection_steps(search.paths(_edges(spark, d), S_ID.strip("'"), C_ID.strip("'"), 3)).select("length", "step", "from_id", "phrase", "to_id", "document_id", "direction")


@query("path_steps_of_answers", HOP2.replace("SELECT DISTINCT d.subject_id AS entity_id, d.subject AS answer, 0 AS plan_no", "SELECT answer, step, triple_id FROM (SELECT d.subject AS answer, arg_min([u.triple_id, d.triple_id], ['0', u.subject_id, 'uses', u.object_id, u.document_id, '1', d.subject_id, 'develops', d.object_id, d.document_id]) AS t").replace("WHERE d.relation = 'develops'", "WHERE d.relation = 'develops' GROUP BY d.subject_id, d.subject), LATERAL (SELECT unnest(t) AS triple_id, unnest([1, 2]) AS step)"))
def path_steps_of_answers(spark, d):
    e = _edges(spark, d)
    plan = _parser(spark, d).plan(f"Who developed the product that {CUSTOMER} uses?")
    return search.execution_steps(e, search.plan_union(e, plan)).select("answer", "step", "triple_id")


@query("filter_graph_types", G + "SELECT triple_id FROM triples WHERE subject_type IN ('ORGANIZATION', 'PRODUCT') AND object_type IN ('ORGANIZATION', 'PRODUCT')")
def filter_graph_types(spark, d):
    _, e = explore.filter_graph(_triples(spark, d), types=("ORGANIZATION", "PRODUCT"))
    return e.select("triple_id")


@query("filter_graph_relations", G + "SELECT entity_id FROM nodes WHERE type = 'ORGANIZATION'")
def filter_graph_relations(spark, d):
    n, _ = explore.filter_graph(_triples(spark, d), types=("ORGANIZATION",), relations=("partners_with",))
    return n.select("entity_id")


@query("connections_of", G + f"SELECT DISTINCT '→' AS arrow, relation, object AS other FROM triples WHERE subject_id = {S_ID} UNION ALL SELECT DISTINCT '←', relation, subject FROM triples WHERE object_id = {S_ID}")
def connections_of(spark, d):
    return explore.connections_of(_edges(spark, d), S_ID.strip("'")).select("arrow", "relation", "other")


@query("entity_search", "WITH " + LEX_SQL + "SELECT entity_id FROM lex WHERE lower(label) = 'red widget' OR lower(entity_id) = 'red widget' OR len(list_filter(aliases, lambda a: contains(lower(a), 'red widget'))) > 0 ORDER BY decl_ord LIMIT 1")
def entity_search(spark, d):
    return explore.entity_search(_lexicon(spark, d), "red widget").select("entity_id")


@query("node_size", G + M_SQL + "SELECT entity_id, round(18 + 34 * (0.72 * degree / (SELECT max(degree) FROM nodes) + 0.28 * least(1.0, mention_count / 12)), 6) AS size FROM nodes JOIN st USING (entity_id)")
def node_size(spark, d):
    n = triples.nodes(_triples(spark, d), triples.mention_stats(_mentions(spark, d)))
    return explore.node_sizes(n).select("entity_id", F.round("size", 6).alias("size"))


@query("edge_distinct", G + "SELECT DISTINCT subject_id AS src, relation, object_id AS dst FROM triples")
def edge_distinct(spark, d):
    return _edges(spark, d).select("src", "relation", "dst").distinct()


@query("doc_drilldown", G + "SELECT document_id, count(*)::BIGINT AS triples, count(DISTINCT sentence_index)::BIGINT AS sentences, count(DISTINCT relation)::BIGINT AS relations FROM triples GROUP BY document_id")
def doc_drilldown(spark, d):
    return explore.document_summary(_triples(spark, d))


@query("evidence_resolutions", G + "SELECT triple_id, CASE WHEN coref_resolved THEN subject END AS resolved_to FROM triples")
def evidence_resolutions(spark, d):
    t = _triples(spark, d).withColumn("original_subject", F.when(F.col("coref_resolved"), "it").otherwise(F.col("subject")))
    return search.evidence(triples.edges(t)).select("triple_id", F.get("resolutions", F.lit(0))["to"].alias("resolved_to"))


@query("kpis", G + "SELECT (SELECT count(*) FROM nodes)::BIGINT AS nodes, (SELECT count(*) FROM triples)::BIGINT AS edges, (SELECT count(DISTINCT document_id) FROM triples)::BIGINT AS documents, (SELECT count(DISTINCT relation) FROM triples)::BIGINT AS relations, (SELECT count(DISTINCT type) FROM nodes)::BIGINT AS types")
def kpis(spark, d):
    return explore.kpis(_triples(spark, d))


# -- extraction from rendered sentences ------------------------------------------------

RENDERED = {
    "transitive": ("{c} uses {p}. The company focuses on {s}.", [("c", "uses", "p", 1.0), ("c", "focuses_on", "s", 0.9)]),
    "passive": ("{p} was established by {c}.", [("c", "founded", "p", 1.0)]),
    "renewal": ("{c} renewed its contract with {c2}.", [("c", "customer_of", "c2", 0.8)]),
    "works_on": ("{c} works on {p}.", [("c", "works_on", "p", 1.0)]),
    "partnered": ("{c} partnered with {c2}.", [("c", "partners_with", "c2", 1.0)]),
    "collaborated": ("{c} collaborates with {c2}.", [("c", "collaborates_with", "c2", 1.0)]),
    "develops": ("{c} built {p}.", [("c", "develops", "p", 1.0)]),
    "leads": ("{c} leads {p}.", [("c", "leads", "p", 1.0)]),
    "joined": ("{c} joined {c2}.", [("c", "works_at", "c2", 1.0)]),
    "deployed": ("{c} deployed {p} at {c2}.", [("c", "deployed_at", "c2", 1.0)]),
    "integrated": ("{c} integrated {p} into {c2}.", [("p", "integrated_into", "c2", 1.0)]),
    "plural_pronoun": ("{c} uses {p}. They focus on {s}.", [("c", "uses", "p", 1.0), ("c", "focuses_on", "s", 0.9)]),
    "pronoun": ("{c} uses {p}. It improves {c2}.", [("c", "uses", "p", 1.0), ("p", "improves", "c2", 0.9)]),
    "inside": ("{c} improved {p} inside {c2}.", [("c", "improves", "p", 1.0), ("c2", "contains", "p", 1.0)]),
    "possessive": ("{c}'s {p}.", [("c", "contains", "p", 1.0)]),
}


def _customer_sentences(spark, d: str, template: str) -> DataFrame:
    """A text per customer, about a part and another customer."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    values = {"c": F.col("c_name"), "c2": F.when(F.col("c_custkey") == 1, "Customer#000000002").otherwise("Customer#000000001"), "p": F.concat(F.lit("Part "), F.col("c_custkey").cast("string")), "s": F.lower("c_mktsegment")}
    import re

    parts = [values[x[1:-1]] if x.startswith("{") else F.lit(x) for x in re.split(r"(\{\w+\})", template) if x]
    return c.select(F.concat(F.lit("c"), F.col("c_custkey")).alias("document_id"), F.concat(*parts).alias("text"))


_SQL_ID = {
    "c": "'organization:' || regexp_replace(lower(c_name), '[^a-z0-9]+', '_', 'g')", "c2": "CASE c_custkey WHEN 1 THEN 'organization:customer_000000002' ELSE 'organization:customer_000000001' END", "p": "'product:part_' || c_custkey",
    "s": "'literal:' || regexp_replace(lower(c_mktsegment), '[^a-z0-9]+', '_', 'g')",
}


def _register_rendered() -> None:
    for name, (template, facts) in RENDERED.items():
        sql = " UNION ALL ".join(
            f"SELECT 'c' || c_custkey AS document_id, {_SQL_ID[s]} AS subject_id, '{r}' AS relation, {_SQL_ID[o]} AS object_id, {conf}::DOUBLE AS confidence FROM customer WHERE ({'c_custkey <= (SELECT max(p_partkey) FROM part)' if 'p' in (s, o) else 'true'})"
            for s, r, o, conf in facts
        )

        def run(spark, d, template=template):
            found, *_ = extraction.extracted(_customer_sentences(spark, d, template), _lexicon(spark, d))
            return found.select("document_id", "subject_id", "relation", "object_id", "confidence")

        query(f"rendered_extract_{name}", sql)(run)


_register_rendered()


@query("report_skips", "SELECT 'c' || c_custkey AS document_id, 'R_LEADS' AS rule_id, 'object of ''leads'' is not a canonical entity (''work'' is not a canonical entity)' AS reason FROM customer")
def report_skips(spark, d):
    _, skipped, _ = extraction.extracted(_customer_sentences(spark, d, "{c} leads work."), _lexicon(spark, d))
    return skipped.select("document_id", "rule_id", "reason")


@query(
    "mention_resolutions",
    f"""SELECT 'c' || c_custkey AS document_id, 0 AS start_char, length(c_name)::INTEGER AS end_char, c_name AS mention, {_SQL_ID['c']} AS entity_id, 'ALIAS' AS source, 'ruler' AS mention_source, false AS is_anaphoric FROM customer
    UNION ALL SELECT 'c' || c_custkey, (length(c_name) + 6)::INTEGER, (length(c_name) + 11 + length(c_custkey::VARCHAR))::INTEGER, 'Part ' || c_custkey, {_SQL_ID['p']}, 'ALIAS', 'ruler', false FROM customer WHERE c_custkey IN (SELECT p_partkey FROM part)
    UNION ALL SELECT 'c' || c_custkey, (length(c_name) + 13 + length(c_custkey::VARCHAR))::INTEGER, (length(c_name) + 24 + length(c_custkey::VARCHAR))::INTEGER, 'The company', {_SQL_ID['c']}, 'ANTECEDENT', 'common_noun_noun_chunk', true FROM customer""",
)
def mention_resolutions(spark, d):
    *_, found = extraction.extracted(_customer_sentences(spark, d, RENDERED["transitive"][0]), _lexicon(spark, d))
    return found.select("document_id", "start_char", "end_char", "mention", "entity_id", "source", "mention_source", "is_anaphoric")


@query("confidence_texts", G + "SELECT triple_id, printf('%.2f', confidence) || ' (' || CASE WHEN confidence >= 0.995 THEN 'stated' WHEN confidence >= 0.895 THEN 'through a reference' ELSE 'inferred' END || ')' AS said FROM triples")
def confidence_texts(spark, d):
    return _triples(spark, d).select("triple_id", T.confidence_text(F.col("confidence")).alias("said"))


@query("declared_record", "WITH " + LEX_SQL + f"SELECT entity_id, label, type, type = 'LITERAL' AS is_literal FROM lex WHERE entity_id = {C_ID}")
def declared_record(spark, d):
    return resolve.record(_lexicon(spark, d), C_ID.strip("'")).select("entity_id", "label", "type", "is_literal")
