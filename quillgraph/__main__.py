"""``python -m quillgraph build [TEXTS LEXICON OUT]``, ``ask OUT QUESTION`` or ``doctor``.

Folders that are not given come from the environment (``quillgraph.config``).
"""

from __future__ import annotations

import argparse
import importlib.util
import shutil
import sys
import time

from pyspark.sql import SparkSession

from quillgraph.config import Config
from quillgraph.errors import QuillError
from quillgraph.operators import triples
from quillgraph.operators.cut import cut
from quillgraph.operators.extraction import extracted
from quillgraph.plans.engine import Engine
from quillgraph.plans.question import Lexicon
from quillgraph.plans.show import shown
from quillgraph.sources import artifacts, corpus, lexicon


def build(spark: SparkSession, config: Config, texts: str, names: str, out: str, progress=lambda _: None) -> dict:
    """Builds a graph from a folder of texts and a lexicon file, writes all artifacts, returns the report's counts."""
    stages = []

    def stage(name: str, make):
        progress(name)
        began = time.time()
        made = make()
        stages.append({"stage": name, "seconds": round(time.time() - began, 3)})
        return made

    docs = stage("reading texts", lambda: corpus.checked(cut(corpus.scan(spark, texts, config.pattern))))
    lex = stage("reading the lexicon", lambda: lexicon.load(spark, names))
    candidates, skipped, resolutions = stage("extracting", lambda: extracted(docs.select("document_id", "text"), lex))
    candidates, skipped = stage("applying rules", lambda: (cut(candidates), cut(skipped)))
    found = stage("building triples", lambda: cut(triples.build(candidates)))
    stage("writing tables", lambda: artifacts.write_bundle(found, triples.nodes(found, triples.mention_stats(resolutions), lex), lex, out))
    progress("writing exports")
    return {**artifacts.write_all(out, lex, candidates, skipped, found, resolutions, stages), "documents": docs.count()}


def ask(spark: SparkSession, config: Config, folder: str, question: str) -> str:
    """Answers from the tables of a build; nothing is extracted anew."""
    bundle = artifacts.read_bundle(spark, folder)
    kinds = bundle["lexicon"].select("entity_id", "type")
    t = bundle["triples"]
    for side in ("subject", "object"):
        if f"{side}_type" not in t.columns:
            t = t.join(kinds.withColumnsRenamed({"entity_id": f"{side}_id", "type": f"{side}_type"}), f"{side}_id", "left")
    records = ((r["entity_id"], r["label"], r["aliases"]) for r in bundle["lexicon"].orderBy("decl_ord").toLocalIterator())
    return shown(Engine(t, Lexicon.of(records), config.max_path_length).ask(question))


def doctor() -> list[str]:
    """What is there and what is missing."""
    lines = [f"python {sys.version.split()[0]}", f"java: {shutil.which('java') or 'missing'}"]
    for name, needed in (("pyspark", True), ("pandas", True), ("pyarrow", True), ("yaml", False), ("spacy", False), ("fastcoref", False)):
        lines.append(f"{name}: " + ("found" if importlib.util.find_spec(name) else "MISSING" if needed else "not installed (optional)"))
    return lines


def main(argv: list[str] | None = None) -> None:
    argv = list(sys.argv[1:] if argv is None else argv)
    if argv[:1] not in (["build"], ["ask"], ["doctor"], ["-h"], ["--help"]):
        argv.insert(0, "build")
    config = Config.from_env()
    p = argparse.ArgumentParser(prog="quillgraph", description=__doc__)
    sub = p.add_subparsers(dest="what", required=True)
    b = sub.add_parser("build")
    for name, default in (("texts", config.texts), ("lexicon", config.lexicon), ("out", config.artifacts)):
        b.add_argument(name, nargs="?", default=default)
    a = sub.add_parser("ask")
    a.add_argument("folder")
    a.add_argument("question")
    sub.add_parser("doctor")
    args = p.parse_args(argv)
    if args.what == "doctor":
        print("\n".join(doctor()))
        return
    spark = SparkSession.builder.getOrCreate()
    spark.sparkContext.setLogLevel(config.log_level)
    try:
        if args.what == "ask":
            print(ask(spark, config, args.folder, args.question))
            return
        began = time.time()
        counts = build(spark, config, args.texts, args.lexicon, args.out)
        print(f"documents {counts['documents']}, triples {counts['triples']}, skipped {counts['skipped']}, {time.time() - began:.1f} s, written to {args.out}")
    except QuillError as e:
        sys.exit(f"{type(e).__name__}: {e}")


if __name__ == "__main__":
    main()
