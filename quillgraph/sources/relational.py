"""An entity-relation graph over the star-schema tables.

Each foreign key or event pair is read as a relation candidate with full
provenance. ``quillgraph.sources.store`` keeps what is built from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import entity_id
from quillgraph.operators.cut import shuffled

#: Orders that two suppliers must share to count as partners.
PARTNER_ORDERS = 30
#: Of a candidate.
COLUMNS = ("relation", "subject_id", "subject", "subject_type", "object_id", "object", "object_type", "document_id", "sentence_index", "sentence", "confidence", "coref_resolved", "inferred", "rule_id", "seq")
#: Relations whose candidates come dealt by document.
BY_DOCUMENT = ("uses", "customer_of")
#: What the graph is read from.
TABLES = ("region", "nation", "customer", "supplier", "orders", "lineitem", "events")


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _org(name: Column) -> Column:
    return entity_id(F.lit("ORGANIZATION"), name)


def _part(key: Column) -> tuple[Column, Column]:
    label = F.concat(F.lit("Part "), key.cast("string"))
    plain = F.concat(F.lit("product:part_"), key.cast("string"))  # what the words come to, unless there is a sign
    return F.when(key >= 0, plain).otherwise(entity_id(F.lit("PRODUCT"), label)), label


def sentence(subject: Column, relation: Column, obj: Column) -> Column:
    return F.concat(subject, F.lit(" "), F.replace(relation, F.lit("_"), F.lit(" ")), F.lit(" "), obj)


def _user(key: Column) -> tuple[Column, Column]:
    label = F.concat(F.lit("User "), key.cast("string"))
    return entity_id(F.lit("PERSON"), label), label


def _columns(relation: str, rule: str, subject, obj, document: Column, sentence_index: Column, seq: Column, confidence: float = 1.0) -> list[Column]:
    (sid, slabel, stype), (oid, olabel, otype) = subject, obj
    return [
        F.lit(relation).alias("relation"),
        sid.alias("subject_id"),
        slabel.alias("subject"),
        F.lit(stype).alias("subject_type"),
        oid.alias("object_id"),
        olabel.alias("object"),
        F.lit(otype).alias("object_type"),
        document.alias("document_id"),
        sentence_index.cast("int").alias("sentence_index"),
        F.concat(slabel, F.lit(" "), F.lit(relation.replace("_", " ")), F.lit(" "), olabel).alias("sentence"),
        F.lit(confidence).alias("confidence"),
        F.lit(confidence == 0.9).alias("coref_resolved"),
        F.lit(confidence == 0.8).alias("inferred"),
        F.lit(rule).alias("rule_id"),
        seq.alias("seq"),
    ]


def _candidates(rows: DataFrame, *of) -> DataFrame:
    return rows.select(*_columns(*of))


def _both_of_a_line(sold: DataFrame, customer, part, supplier, document: Column, line: Column) -> DataFrame:
    """``uses`` and ``customer_of`` of every order line, from one pass over the joined lines; a line without a known supplier has the first alone. The document stays outside, so that rows still stand by it."""
    uses = _columns("uses", "ORDER_LINE", customer, part, document, F.col("l_linenumber"), line, 0.9)
    buys = _columns("customer_of", "ORDER_LINE", customer, supplier, document, F.col("l_linenumber"), line, 0.8)
    at = next(i for i, x in enumerate(COLUMNS) if x == "document_id")
    own = lambda columns: F.struct(*columns[:at], *columns[at + 1 :])
    return sold.select(document.alias("document_id"), F.inline(F.array(own(uses), own(buys)))).where("relation = 'uses' OR object_id IS NOT NULL").select(*COLUMNS)


def candidates(spark, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    region, nation, customer, supplier = t("region"), t("nation"), t("customer"), t("supplier")
    c = F.col
    none = F.lit("0")
    reg = (entity_id(F.lit("PROJECT"), c("r_name")), c("r_name"), "PROJECT")
    nat = (entity_id(F.lit("COMPONENT"), c("n_name")), c("n_name"), "COMPONENT")
    cus = (_org(c("c_name")), c("c_name"), "ORGANIZATION")
    sup = (_org(c("s_name")), c("s_name"), "ORGANIZATION")
    seg = (entity_id(F.lit("LITERAL"), c("c_mktsegment")), c("c_mktsegment"), "LITERAL")
    part = (*_part(c("l_partkey")), "PRODUCT")
    number = lambda key: F.concat(F.lit("order_"), c(key).cast("string"))
    order = number("l_orderkey")
    line = F.format_string("%012d%012d", c("l_partkey"), c("l_suppkey"))
    items = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    # lines meet their orders by document, slim; ids are made once per customer and supplier, and all rows of a document stay together
    buyers = customer.select("c_custkey", "c_name", cus[0].alias("c_id"))
    who = t("orders").select("o_orderkey", "o_custkey").join(shuffled(buyers), c("o_custkey") == c("c_custkey")).select(number("o_orderkey").alias("document_id"), "c_name", "c_id")
    named = items.select(order.alias("document_id"), "l_linenumber", "l_partkey", "l_suppkey").join(shuffled(who), "document_id")
    sold = named.join(supplier.select("s_suppkey", "s_name", sup[0].alias("s_id")), c("l_suppkey") == c("s_suppkey"), "left")
    buyer, seller = (c("c_id"), *cus[1:]), (c("s_id"), *sup[1:])
    first = items.groupBy("l_partkey").agg(F.min(F.struct("l_orderkey", "l_linenumber", "l_suppkey")).alias("f"))
    made = first.select("l_partkey", "f.*").join(supplier.select("s_suppkey", "s_name"), c("l_suppkey") == c("s_suppkey"))
    together = items.where("l_orderkey IS NOT NULL").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_suppkey")).alias("all"))
    each = together.select("l_orderkey", "all", F.posexplode("all").alias("at", "x")).select("l_orderkey", "x", F.explode(F.slice("all", F.col("at") + 2, F.size("all"))).alias("y"))
    pairs = each.groupBy("x", "y").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("l_orderkey")).where(c("n") >= PARTNER_ORDERS)
    sx = supplier.select(c("s_suppkey").alias("x"), c("s_name").alias("x_name"))
    sy = supplier.select(c("s_suppkey").alias("y"), c("s_name").alias("y_name"))
    pairs = pairs.join(sx, "x").join(sy, "y")
    e = t("events").select("event_id", "user_id", "event_type")
    nxt = e.select((c("event_id") - 1).alias("event_id"), c("user_id").alias("other"), c("event_type").alias("next_type"))
    both = e.join(nxt, "event_id").where((c("event_type") == c("next_type")) & (c("user_id") != c("other")))
    doc = lambda name: F.lit(name)
    parts = [
        _candidates(region.join(nation, c("r_regionkey") == c("n_regionkey")), "contains", "FK_NATION", reg, nat, doc("nation"), F.lit(0), none),
        _candidates(nation.join(customer, c("n_nationkey") == c("c_nationkey")), "contains", "FK_CUSTOMER", nat, cus, doc("customer"), F.lit(0), none),
        _candidates(nation.join(supplier, c("n_nationkey") == c("s_nationkey")), "contains", "FK_SUPPLIER", nat, sup, doc("supplier"), F.lit(0), none),
        _candidates(made, "develops", "PRIMARY_SUPPLIER", sup, part, order, c("l_linenumber"), none),
        _both_of_a_line(sold, buyer, part, seller, c("document_id"), line),
        _candidates(customer, "focuses_on", "SEGMENT", cus, seg, doc("customer"), F.lit(0), none),
        _candidates(pairs, "partners_with", "SHARED_ORDERS", (_org(c("x_name")), c("x_name"), "ORGANIZATION"), (_org(c("y_name")), c("y_name"), "ORGANIZATION"), order, F.lit(0), none),
        _candidates(both, "collaborates_with", "SAME_EVENT", (*_user(c("user_id")), "PERSON"), (*_user(c("other")), "PERSON"), F.concat(F.lit("event_"), c("event_id").cast("string")), F.lit(0), none),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: The same candidates, and the triples that follow, for DuckDB.
CANDIDATES_SQL = f"""
WITH org AS (SELECT 1 AS x),
lines AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, c_name, s_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey),
made AS (SELECT l_partkey, (min(row(l_orderkey, l_linenumber, l_suppkey))) AS f FROM lineitem GROUP BY l_partkey),
sp AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem),
pairs AS (SELECT a.l_suppkey AS x, b.l_suppkey AS y, min(a.l_orderkey) AS l_orderkey FROM sp a JOIN sp b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY ALL HAVING count(*) >= {PARTNER_ORDERS}),
raw AS (
SELECT 'contains' AS relation, r_name AS subject, 'PROJECT' AS subject_type, n_name AS object, 'COMPONENT' AS object_type, 'nation' AS document_id, 0 AS sentence_index, 1.0 AS confidence, 'FK_NATION' AS rule_id, '0' AS seq FROM region JOIN nation ON r_regionkey = n_regionkey
UNION ALL SELECT 'contains', n_name, 'COMPONENT', c_name, 'ORGANIZATION', 'customer', 0, 1.0, 'FK_CUSTOMER', '0' FROM nation JOIN customer ON n_nationkey = c_nationkey
UNION ALL SELECT 'contains', n_name, 'COMPONENT', s_name, 'ORGANIZATION', 'supplier', 0, 1.0, 'FK_SUPPLIER', '0' FROM nation JOIN supplier ON n_nationkey = s_nationkey
UNION ALL SELECT 'develops', s_name, 'ORGANIZATION', 'Part ' || l_partkey, 'PRODUCT', 'order_' || f[1], f[2], 1.0, 'PRIMARY_SUPPLIER', '0' FROM made JOIN supplier ON f[3] = s_suppkey
UNION ALL SELECT 'uses', c_name, 'ORGANIZATION', 'Part ' || l_partkey, 'PRODUCT', 'order_' || l_orderkey, l_linenumber, 0.9, 'ORDER_LINE', printf('%012d%012d', l_partkey, l_suppkey) FROM lines
UNION ALL SELECT 'customer_of', c_name, 'ORGANIZATION', s_name, 'ORGANIZATION', 'order_' || l_orderkey, l_linenumber, 0.8, 'ORDER_LINE', printf('%012d%012d', l_partkey, l_suppkey) FROM lines
UNION ALL SELECT 'focuses_on', c_name, 'ORGANIZATION', c_mktsegment, 'LITERAL', 'customer', 0, 1.0, 'SEGMENT', '0' FROM customer
UNION ALL SELECT 'partners_with', a.s_name, 'ORGANIZATION', b.s_name, 'ORGANIZATION', 'order_' || l_orderkey, 0, 1.0, 'SHARED_ORDERS', '0' FROM pairs JOIN supplier a ON a.s_suppkey = x JOIN supplier b ON b.s_suppkey = y
UNION ALL SELECT 'collaborates_with', 'User ' || a.user_id, 'PERSON', 'User ' || b.user_id, 'PERSON', 'event_' || a.event_id, 0, 1.0, 'SAME_EVENT', '0' FROM events a JOIN events b ON b.event_id = a.event_id + 1 AND a.event_type = b.event_type AND a.user_id <> b.user_id),
cand AS (SELECT *, lower(subject_type) || ':' || regexp_replace(lower(subject), '[^a-z0-9]+', '_', 'g') AS subject_id, lower(object_type) || ':' || regexp_replace(lower(object), '[^a-z0-9]+', '_', 'g') AS object_id,
  subject || ' ' || replace(relation, '_', ' ') || ' ' || object AS sentence FROM raw),
triples AS (SELECT 'triple:' || subject_id || '--' || relation || '->' || object_id || '@' || document_id AS triple_id, subject_id, any_value(subject) AS subject, any_value(subject_type) AS subject_type, relation, object_id, any_value(object) AS object, any_value(object_type) AS object_type,
  document_id, min(sentence_index)::INTEGER AS sentence_index, any_value(sentence) AS sentence, any_value(confidence)::DOUBLE AS confidence, any_value(confidence) = 0.9 AS coref_resolved, any_value(confidence) = 0.8 AS inferred, any_value(rule_id) AS rule_id, count(*)::BIGINT AS duplicate_count
  FROM cand GROUP BY subject_id, relation, object_id, document_id),
nodes AS (SELECT id AS entity_id, any_value(label) AS label, any_value(type) AS type, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree, sum(i + o)::BIGINT AS degree
  FROM (SELECT subject_id AS id, subject AS label, subject_type AS type, 0 AS i, 1 AS o FROM triples UNION ALL SELECT object_id, object, object_type, 1, 0 FROM triples) GROUP BY id)
""".replace("WITH org AS (SELECT 1 AS x),\n", "WITH RECURSIVE ")
