"""Plans that must not change as tables grow."""

from pyspark.sql import functions as F

from quillgraph.operators import mentions, resolve, tree


def _plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("extended"))


def _lexicon(spark):
    rows = [("product:part_1", "Part 1", "PRODUCT", ["Red  Ring"], ["the ring"], 1), ("organization:a", "A-B Works", "ORGANIZATION", [], ["the works"], 2), ("literal:metal", "METAL", "LITERAL", [], [], 3)]
    return spark.createDataFrame(rows, "entity_id string, label string, type string, aliases array<string>, anaphors array<string>, decl_ord long")


def test_word_runs_are_sifted_before_they_are_dealt(spark):
    texts = [("x", "So the A-B  Works sold red ring, RED\tRing and Part 1."), ("y", None), ("z", "..."), ("w", "nothing of it")]
    docs = spark.createDataFrame(texts, "document_id string, text string")
    found = mentions.phrase_mentions(docs, resolve.alias_index(_lexicon(spark)))
    got = sorted(tuple(r) for r in found.select("document_id", "start_char", "end_char", "text", "surface").collect())
    text = texts[0][1]
    at = lambda t: (text.index(t), text.index(t) + len(t), t)
    assert got == [("x", *at("A-B  Works"), "a-b works"), ("x", *at("red ring"), "red ring"), ("x", *at("RED\tRing"), "red ring"), ("x", *at("Part 1"), "part 1")]
    plan = _plan(found)
    assert "getbit" in plan.lower() and "scalar-subquery" in plan.lower()


def test_marks_lose_no_surface(spark):
    known = spark.range(5000).select(F.concat(F.lit("name "), "id").alias("surface")).cache()
    other = spark.range(5000).select(F.concat(F.lit("other "), "id").alias("surface"))
    marked = lambda rows: rows.where(mentions._marked(known, F.xxhash64("surface"))).count()
    assert marked(known) == 5000 and marked(other) < 1000


def test_joins_of_extraction_are_never_broadcast(spark):
    lexicon = _lexicon(spark)
    rows = spark.createDataFrame([(1, "part 1"), (2, "The works")], "k int, text string")
    tokens = spark.createDataFrame([("d", 0, 0, "Part 1", "PROPN", "nsubj", 1, "part 1", 0, 6), ("d", 0, 1, "runs", "VERB", "ROOT", 1, "run", 7, 11)], "document_id string, sentence_index int, i int, text string, pos string, dep string, head_i int, lemma string, start_char int, end_char int")
    chunks = spark.createDataFrame([("d", 0, 1, 0, 0, 6, "Part 1")], "document_id string, start_i int, end_i int, root_index int, start_char int, end_char int, text string")
    named = spark.createDataFrame([("d", 0, 6, "Part 1", "product:part_1", "Part 1", False)], "document_id string, start_char int, end_char int, mention string, entity_id string, label string, is_anaphoric boolean")
    above = tree.ancestors(tokens)
    for df in (resolve.annotate(rows, lexicon), tree.arguments(tokens, chunks, named, lexicon), tree.reported(tokens, above), tree.subjects(tokens)):
        df.collect()
        assert "BroadcastHashJoin" not in _plan(df)
    assert [(r["i"], r["arg"]["entity_id"]) for r in tree.arguments(tokens, chunks, named, lexicon).where("arg IS NOT NULL").collect()] == [(0, "product:part_1")]


def _tables(spark, folder):
    made = {
        "region": ([(0, "ASIA")], "r_regionkey int, r_name string"),
        "nation": ([(0, "N_0", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(1, "Customer#1", 0, "METAL"), (2, "Customer#2", 0, "METAL"), (3, "customer 1", 0, "WOOD")], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string"),
        "supplier": ([(k, f"Supplier#{k}", 0) for k in (1, 2, 3)], "s_suppkey long, s_name string, s_nationkey int"),
        "orders": ([(k, k % 3 + 1) for k in range(40)], "o_orderkey long, o_custkey long"),
        "lineitem": ([(k, p, s, n) for k in range(40) for n, (p, s) in enumerate([(k % 5, 1), (k % 5, 2), (7, 9), (-7, 1)], 1)] + [(None, 1, 1, 1), (None, 1, 2, 2), (99, 1, 1, 1)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int"),
        "events": ([(1, 5, "view"), (2, 6, "view"), (3, 6, "view")], "event_id long, user_id long, event_type string"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_triples_of_lines_are_grouped_where_their_document_is(spark, tmp_path):
    from quillgraph.operators import triples
    from quillgraph.sources import relational, store

    found = relational.candidates(spark, _tables(spark, tmp_path))
    lines = store.grouped(found.where(F.col("relation").isin(*relational.BY_DOCUMENT)))
    dealt = [x for x in lines._jdf.queryExecution().sparkPlan().toString().splitlines() if "Exchange" in x] + [x for x in lines._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]
    assert dealt and not any("subject_id" in x for x in dealt)
    whole = triples.build(found)
    got = store.graph(spark, str(tmp_path)).select(*whole.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, whole.collect()))
    by = {(r["relation"], r["subject_id"], r["object_id"], r["document_id"]): r for r in got.collect()}
    assert by["uses", "organization:customer_1", "product:part_0", "order_0"]["duplicate_count"] == 2
    assert by["uses", "organization:customer_1", "product:part_7", "order_0"]["duplicate_count"] == 2  # 7 and -7 have one id
    assert ("partners_with", "organization:supplier_1", "organization:supplier_2", "order_0") in by and sum(k[0] == "partners_with" for k in by) == 1
    assert sum(k[0] == "collaborates_with" for k in by) == 1


def test_what_a_row_says_is_not_stored(spark, tmp_path):
    from quillgraph.sources import store

    rows = [("a", "X", "P", "leads_to", "b", "Y", "P", "d", 0, "0", s, 1.0, False, False, "R") for s in ("X leads to Y",)] + [("a", "X", "P", "uses", "b", "Y", "P", "d", 0, "0", s, 1.0, False, False, "R") for s in ("it does",)] + [("a", "X", "P", "has", "b", "Y", "P", "d", 0, "0", None, 1.0, False, False, "R")]
    cols = "subject_id string, subject string, subject_type string, relation string, object_id string, object string, object_type string, document_id string, sentence_index int, seq string, sentence string, confidence double, coref_resolved boolean, inferred boolean, rule_id string"
    slim = store._slim(store.grouped(spark.createDataFrame(rows, cols)))
    assert not {"sentence", "triple_id", "original_subject"} & set(slim.columns)
    assert {r["relation"]: r["sentence"] for r in store._whole(slim).collect()} == {"leads_to": "X leads to Y", "uses": "it does", "has": None}


def test_texts_that_stay_are_not_dealt(spark):
    from quillgraph.llm import jaccard

    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, words), (2, words), (3, words + " more"), (4, "quite another text that stands alone here"), (4, "quite another text that stands alone here"), (4, "and a different one under the same id"), (None, "one without any id at all there"), (5, None), (6, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = jaccard.one_of_each(docs, n=5, percent=80)
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in kept.collect()) == sorted((str(a), str(b)) for a, b in [rows[0], rows[3], *rows[5:]])
    assert "getbit" in _plan(kept).lower()
