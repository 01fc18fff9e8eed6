"""Corpora, artifacts, mentions and streams."""

import os

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import coref, mentions, resolve, triples
from quillgraph.sources import artifacts, corpus
from quillgraph.sources.lexicon import from_records
from quillgraph.streaming import ingest


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def test_scan_salvages_bad_bytes_and_drops_blank_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"Good text.")
    (tmp_path / "b.txt").write_bytes(b"Bad \xff byte.")
    (tmp_path / "c.txt").write_bytes(b" \n ")
    got = {r["document_id"]: r for r in corpus.scan(spark, str(tmp_path)).collect()}
    assert set(got) == {"a", "b"} and got["a"]["read_warnings"] == [] and len(got["b"]["read_warnings"]) == 2
    with pytest.raises(corpus.CorpusError):
        corpus.checked(corpus.scan(spark, str(tmp_path), "*.none"))


def test_scalar_functions(spark):
    for raw, want in {"Dr. Mira Sen": "mira_sen", "Aurora's": "aurora", "  The Élan ": "the_lan", "Mr. Dr. X": "x", "dr": ""}.items():
        assert one(spark, T.slugify(F.col("x")), x=raw) == want
    assert one(spark, T.question_form(F.col("x")), x="The co-founded, Élan!  ") == "co founded élan"
    assert one(spark, T.html_escaped(F.col("x")), x="<a & 'b'>") == "&lt;a &amp; &#x27;b&#x27;&gt;"
    assert one(spark, T.is_generic_nominal(F.col("x")), x="the entity resolution  Work") is True


def test_triples_survive_csv(spark, tmp_path):
    rows = [("person:a", "A", "PERSON", "leads", "project:b", "B", "PROJECT", "d", 0, 1, 'says "x",\nand more', 0.9, True, False, "R"), ("person:a", "A", "PERSON", "leads", "project:b", "B", "PROJECT", "d", 2, 1, "later", 1.0, False, False, "R")]
    cols = "subject_id string, subject string, subject_type string, relation string, object_id string, object string, object_type string, document_id string, sentence_index int, seq int, sentence string, confidence double, coref_resolved boolean, inferred boolean, rule_id string"
    t = triples.build(spark.createDataFrame(rows, cols))
    path = str(tmp_path / "t")
    artifacts.write_triples_csv(t, path)
    back = artifacts.read_triples_csv(spark, path).collect()
    assert len(back) == 1 and back[0]["duplicate_count"] == 2 and back[0]["coref_resolved"] is True and back[0]["sentence"] == 'says "x",\nand more'
    artifacts.write_graph_json(triples.degrees(t), triples.edges(t), str(tmp_path / "g"))
    n, e = artifacts.read_graph_json(spark, str(tmp_path / "g"))
    assert n.count() == 2 and e.count() == 1


def test_overlaps_are_chosen_greedily(spark):
    rows = [("d", 0, 5, "a", "ner"), ("d", 3, 9, "b", "ner"), ("d", 8, 12, "c", "pronoun"), ("d", 20, 22, "e", "ruler"), ("d", 19, 30, "f", "ner")]
    spans = spark.createDataFrame(rows, "document_id string, start_char int, end_char int, text string, source string")
    assert sorted(r["text"] for r in mentions.without_overlaps(spans).collect()) == ["b", "e"]


def test_sentences_have_offsets(spark):
    docs = spark.createDataFrame([("d", "One.  Two here! \n"), ("e", ""), ("f", "...Three")], "document_id string, text string")
    got = {(r["document_id"], r["text"], r["start_char"], r["end_char"]) for r in mentions.sentences(docs).collect()}
    assert got == {("d", "One.", 0, 4), ("d", "Two here!", 6, 15), ("f", "Three", 3, 8)}
    spans = spark.createDataFrame([("d", 7, 8)], "document_id string, start_char int, end_char int")
    assert mentions.located(spans, mentions.sentences(docs)).first()["sentence_index"] == 1


def test_resolution_order(spark):
    lex = from_records(spark, [{"label": "Helios Bank", "type": "ORGANIZATION", "aliases": ["Helios"], "anaphors": ["the bank"]}, {"label": "Ada", "type": "PERSON", "anaphors": ["she", "the engineer"]}, {"label": "Bob", "type": "PERSON", "anaphors": ["he", "the engineer"]}], [{"label": "fraud detection"}])
    rows = spark.createDataFrame([("helios's",), ("The  Bank",), ("the engineer",), ("she",), (None,)], "text string")
    got = {r["text"]: r["entity_id"] for r in resolve.resolve_surface(rows, lex).collect()}
    assert got == {"helios's": "organization:helios_bank", "The  Bank": "organization:helios_bank", "the engineer": None, "she": None, None: None}
    lit = spark.createDataFrame([("The Fraud  detection",)], "text string")
    assert resolve.resolve_literal(lit, lex).first()["literal_id"] == "literal:fraud_detection"
    docs = spark.createDataFrame([("d", "At Helios, Ada met Helios Bank."), ("e", "Heliostat")], "document_id string, text string")
    assert [r["surface"] for r in resolve.longest_in_text(docs, lex).collect()] == ["helios bank"]
    clusters = spark.createDataFrame([("d", ["she", "Ada", "Helios"])], "document_id string, surfaces array<string>")
    assert coref.cluster_entity(clusters, lex).first()["entity_id"] == "organization:helios_bank"


def test_stream_gives_each_triple_once(spark, tmp_path):
    src = str(tmp_path / "in")
    cols = "subject_id string, relation string, object_id string, object_type string, document_id string, ts timestamp"
    rows = [("a", "uses", "b", "PRODUCT", "d", None), ("a", "uses", "b", "PRODUCT", "d", None), ("a", "uses", "a", "PRODUCT", "d", None)]
    spark.createDataFrame(rows, cols).withColumn("ts", F.lit("2024-01-01").cast("timestamp")).write.parquet(src)
    stream = ingest.triple_stream(spark.readStream.schema(cols).parquet(src), "ts")
    q = stream.writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("once").count() == 1


def test_texts_and_counts_stream(spark, tmp_path):
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts" / "a.txt").write_text("One.\nTwo.")
    q = ingest.text_stream(spark, str(tmp_path / "texts")).writeStream.format("memory").queryName("texts").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["document_id"], r["text"]) for r in spark.table("texts").collect()] == [("a", "One.\nTwo.")]
    cols = "subject_id string, relation string, object_id string, object_type string, document_id string, minute int"
    rows = [("a", "uses", "b", "PRODUCT", "d", 1), ("a", "uses", "c", "PRODUCT", "d", 2), ("a", "uses", "a", "PRODUCT", "d", 2), ("a", "leads", "b", "PROJECT", "d", 9)]
    made = spark.createDataFrame(rows, cols).withColumn("ts", F.make_timestamp(F.lit(2024), F.lit(1), F.lit(1), F.lit(0), "minute", F.lit(0)))
    made.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(made.schema).parquet(str(tmp_path / "in"))
    q = ingest.relation_counts(stream, "ts").writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["relation"], r["n"]) for r in spark.table("counts").collect()) == [("leads", 1), ("uses", 2)]


def test_nothing_imports_the_training_data_package():
    root = os.path.join(os.path.dirname(os.path.dirname(__file__)), "quillgraph")
    for folder, _, files in os.walk(root):
        for f in files:
            if f.endswith(".py") and os.path.basename(folder) != "llm":
                assert "quillgraph.llm" not in open(os.path.join(folder, f)).read()


def test_manifest_problems(spark):
    want = spark.createDataFrame([("a.txt", "1"), ("b.txt", "2"), ("c.txt", "3")], "filename string, sha256 string")
    have = spark.createDataFrame([("a.txt", "1", "One."), ("b.txt", "9", "x\ny"), ("d.txt", "4", " \n")], "filename string, sha256 string, text string")
    got = {(r["filename"], r["problem"]) for r in corpus.verify(want, have).collect()}
    assert got == {("b.txt", "DRIFTED"), ("c.txt", "MISSING"), ("d.txt", "EXTRA"), ("b.txt", "MULTILINE"), ("d.txt", "EMPTY")}


def test_command_line_builds_a_graph(spark, tmp_path, capsys):
    import json

    from quillgraph.__main__ import main

    (tmp_path / "texts").mkdir()
    (tmp_path / "texts" / "d1.txt").write_text("Helios Bank uses OrionEdge. The company leads Project Aurora.")
    records = [{"label": "Helios Bank", "type": "ORGANIZATION"}, {"label": "OrionEdge", "type": "PRODUCT"}, {"label": "Project Aurora", "type": "PROJECT"}]
    (tmp_path / "lexicon.json").write_text(json.dumps({"entities": records}))
    main([str(tmp_path / "texts"), str(tmp_path / "lexicon.json"), str(tmp_path / "out")])
    assert "triples 2" in capsys.readouterr().out
    got = {(r["subject"], r["relation"], r["object"], r["confidence"]) for r in artifacts.read_triples_csv(spark, str(tmp_path / "out" / "triples_csv")).collect()}
    assert got == {("Helios Bank", "uses", "OrionEdge", 1.0), ("Helios Bank", "leads", "Project Aurora", 0.9)}
    entities = json.loads((tmp_path / "out" / "entities.json").read_text())
    assert [e["id"] for e in entities["entities"]] == ["organization:helios_bank", "product:orionedge", "project:project_aurora"]
    assert entities["alias_index"]["orionedge"] == ["product:orionedge"] and {m["text"] for m in entities["mention_inventory"]["organization:helios_bank"]} == {"Helios Bank", "The company"}
    report = json.loads((tmp_path / "out" / "pipeline_report.json").read_text())
    assert report["counts"]["triples"] == 2 and report["relation_histogram"] == {"leads": 1, "uses": 1} and report["unresolved_mentions"] == [] and report["stages"]
    graph = json.loads((tmp_path / "out" / "graph.json").read_text())
    assert graph["graph"] == {"node_count": 3, "edge_count": 2} and len(graph["links"]) == 2
    main(["ask", str(tmp_path / "out"), "What does Helios Bank use?"])
    assert "- OrionEdge" in capsys.readouterr().out
    main(["doctor"])
    assert "pyspark: found" in capsys.readouterr().out


def test_settings_are_checked():
    from quillgraph.config import Config
    from quillgraph.errors import ConfigurationError

    assert Config.from_env({}) == Config() and Config.from_env({"QUILL_MAX_PATH_LENGTH": "5", "QUILL_OPTIONAL_RULES": "off"}).max_path_length == 5
    for bad in ({"QUILL_MAX_PATH_LENGTH": "0"}, {"QUILL_MAX_PATH_LENGTH": "x"}, {"QUILL_OPTIONAL_RULES": "maybe"}):
        with pytest.raises(ConfigurationError):
            Config.from_env(bad)


def test_page_needs_no_network(spark):
    from quillgraph.plans import page

    nodes = spark.createDataFrame([("a:x", "X <b>", "PERSON", 20.0, 2), ("a:y", "Y </script>", "GHOST", 20.0, 1)], "entity_id string, label string, type string, size double, degree int")
    edges = spark.createDataFrame([("a:x", "a:y", "leads", "d1", "see http://x.y"), ("a:x", "a:y", "leads", "d2", "again")], "src string, dst string, relation string, document_id string, sentence string")
    got = page.build_html(nodes, edges)
    assert got.count('"relation": "leads"') == 1 and "X &lt;b&gt;" in got and got.count("</script>") == 1 and page.colour("ghost") == page.OTHER
    assert page.external('<script src="https://a.b/c.js">') and not page.external("<p>http://a.b</p>")


def test_mentions_and_resolutions_of_a_document(spark):
    from quillgraph.operators.extraction import Backend, extracted, per_document

    lex = from_records(spark, [{"label": "Helios Bank", "type": "ORGANIZATION", "anaphors": ["the bank"]}, {"label": "Orion Edge Data Mining And Fraud Detection Platform", "type": "PRODUCT"}, {"label": "Quantum Forge", "type": "ORGANIZATION"}])
    text = "Quantum Forge uses Orion Edge Data Mining And Fraud Detection Platform. The bank leads Quantum Forge. They develop GPU. It improves the platform."
    docs = spark.createDataFrame([("d", text), ("e", None), ("f", "")], "document_id string, text string")

    def ner(rows):
        return rows.where("document_id = 'd'").selectExpr("document_id", "cast(instr(text, 'GPU') - 1 as int) start_char", "cast(instr(text, 'GPU') + 2 as int) end_char", "'GPU' text", "'ORG' label")

    def broken():
        raise RuntimeError("no model")

    def clusters(rows):
        return per_document(rows, "broken", broken, lambda m, t: [], "start_char int, end_char int, surfaces array<string>", required=False)

    candidates, _, resolutions = extracted(docs, lex, Backend(ner=ner, clusters=clusters))
    got = {r["mention"]: (r["entity_id"], r["source"]) for r in resolutions.collect()}
    product = "product:orion_edge_data_mining_and_fraud_detection_platform"
    assert got["The bank"] == ("organization:helios_bank", "ALIAS") and got["They"][1] == "ANTECEDENT" and got["GPU"] == (None, "NONE")
    assert got["Orion Edge Data Mining And Fraud Detection Platform"] == (product, "ALIAS") and got["the platform"] == (product, "ANTECEDENT")
    assert ("organization:helios_bank", "leads", "organization:quantum_forge", 0.9) in {(r["subject_id"], r["relation"], r["object_id"], r["confidence"]) for r in candidates.collect()}


def test_a_graph_is_built_once_for_the_same_files(spark, tmp_path, monkeypatch):
    from quillgraph.sources import store

    (tmp_path / "t.parquet").mkdir()
    (tmp_path / "t.parquet" / "part").write_text("a")
    seen = [store.fingerprint(spark, [str(tmp_path / "t.parquet")]) for _ in range(2)]
    (tmp_path / "t.parquet" / "part").write_text("ab")
    assert seen[0] == seen[1] != store.fingerprint(spark, [str(tmp_path / "t.parquet")]) != store.fingerprint(spark, [str(tmp_path / "none")])
    made = []
    rows = [("a:x", "X", "PERSON", "leads", "b:y", "Y", "PROJECT", "d", 0, "0", "s", 1.0, False, False, "R"), ("a:x", "X", "PERSON", "uses", "b:z", "Z", "PROJECT", "d", 0, "0", "s", 1.0, False, False, "R")]
    cols = "subject_id string, subject string, subject_type string, relation string, object_id string, object string, object_type string, document_id string, sentence_index int, seq string, sentence string, confidence double, coref_resolved boolean, inferred boolean, rule_id string"
    monkeypatch.setattr(store.relational, "candidates", lambda s, d: made.append(d) or spark.createDataFrame(rows, cols))
    for _ in range(2):
        got = store.graph(spark, str(tmp_path))
        assert sorted((r["subject_id"], r["relation"], r["object_id"]) for r in got.collect()) == [("a:x", "leads", "b:y"), ("a:x", "uses", "b:z")]
        assert got.where("relation = 'uses'").count() == 1
    assert len(made) == 1


def test_point_look_ups(spark):
    found = spark.createDataFrame([("d", 0, 5, 0), ("d", 3, 9, 0), ("d", 12, 14, 1)], "document_id string, start_char int, end_char int, sentence_index int")
    assert [r["start_char"] for r in mentions.mentions_at(found, "d", 4).orderBy("start_char").collect()] == [0, 3] and mentions.mentions_at(found, "d", 10).isEmpty()
    assert [r["start_char"] for r in mentions.mentions_in_sentence(found, "d", 1).collect()] == [12]
    sents = mentions.sentences(spark.createDataFrame([("d", "One. Two.")], "document_id string, text string"))
    assert mentions.sentence_text(sents, "d", 1).first()[0] == "Two."
    lex = from_records(spark, [{"label": "Ada", "type": "PERSON"}], [{"label": "ethics"}])
    assert resolve.record(lex, "literal:ethics").first()["is_literal"] and resolve.record(lex, "x:y").first()["label"] == "x:y"


def test_nearest_antecedent_matches_brute_force(spark):
    import random

    from quillgraph.functions import vocab

    rng = random.Random(3)
    heads = ["he", "company", "they", "it", "gadget", "their"]
    named = [(f"d{rng.randrange(4)}", rng.randrange(60), rng.randrange(4), f"e{i}", rng.choice(vocab.ENTITY_TYPES), "t") for i in range(120)]
    refs = list({(f"d{rng.randrange(4)}", s): (s, rng.randrange(4), rng.choice(heads)) for s in rng.choices(range(70), k=90)}.items())
    refs = [(d, s, n, h) for (d, _), (s, n, h) in refs]

    def best(d, s, n, h):
        types = vocab.EXPECTED_TYPES.get(h, vocab.ENTITY_TYPES)
        fits = [(0 if n == m else 1, s - a, e) for x, a, m, e, t, _ in named if x == d and a < s and t in types and not (h in vocab.PLURAL_PRONOUNS and t == "PERSON")]
        return min(fits)[2] if fits else None

    got = coref.nearest_antecedent(spark.createDataFrame(refs, "document_id string, start_char int, sentence_index int, head string"), spark.createDataFrame(named, "document_id string, start_char int, sentence_index int, entity_id string, entity_type string, text string"))
    want = {(d, s): e for d, s, n, h in refs if (e := best(d, s, n, h))}
    assert {(r["document_id"], r["start_char"]): r["entity_id"] for r in got.collect()} == want
