"""python -m shelfspark.cli --store PATH COMMAND ...: a passage store from the command line."""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import Settings
from .functions import text as tx
from .operators import ask, catalog, citations, maintenance, models, prompt
from .sources import sinks
from .sources.manifest import Manifest
from .sources.readers import discover
from .sources.store import Store
from .streaming import ingest


def search(store: Store, question: str, settings: Settings = Settings(), prior: str | None = None):
    """Vector, full-text and fuzzy search, fused, with the question repaired and the hits reranked; prior is the question before it."""
    asked = store.spark.createDataFrame([(0, question)], "qid long, q string")
    before = store.spark.createDataFrame([(0, prior)], "qid long, prior string") if prior else None
    best = ask.retrieve(asked, store.read(), settings, models.hashed_words, before, index=store.index)
    return best.join(store.view().drop("vector"), "id").orderBy("rank")


def answer(store: Store, question: str, settings: Settings = Settings(), generator=ask.extractive, provider: str = "ollama", notes: str = "", history=None):
    """(prompt row, answer row) for a question; history (turn, role, text) are the turns of its conversation before it."""
    turns = [] if history is None else history.orderBy("turn").collect()  # one conversation
    prior = next((t["text"] for t in reversed(turns) if t["role"] == "user"), None)
    hits = search(store, question, settings, prior)
    cited = tx.citation(F.col("title"), F.col("author"), F.col("chapter"), F.col("page"), F.col("format"), F.col("loc_start"))
    sources = hits.select(F.lit(0).cast("long").alias("qid"), "rank", cited.alias("citation"), "text")
    asks = store.spark.createDataFrame([(0, question)], "qid long, question string")
    noted = store.spark.createDataFrame([(0, notes)], "qid long, note string") if notes else None
    said = None if history is None else history.select(F.lit(0).cast("long").alias("qid"), F.col("turn").cast("long").alias("turn"), "role", "text")
    prompts = prompt.prompts(asks, sources, said, noted, settings).persist()
    try:
        return prompts.first(), ask.answers(ask.answer_lines(prompts, generator), provider).first()
    finally:
        prompts.unpersist()


def _named(spec: str):
    """The object that module:name means."""
    module, _, name = spec.partition(":")
    return getattr(importlib.import_module(module), name)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="shelfspark")
    parser.add_argument("--store", required=True)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("ingest", "audit", "apply", "plan", "plan-soak", "backfill-state", "cite-metric"):
        commands.add_parser(name).add_argument("root")
    commands.choices["cite-metric"].add_argument("--books", type=int, default=8)
    commands.choices["cite-metric"].add_argument("--per-book", type=int, default=4)
    for name in ("audit", "apply"):
        commands.choices[name].add_argument("--unreachable", nargs="*", default=[])
    commands.add_parser("search").add_argument("question")
    commands.add_parser("ask").add_argument("question")
    commands.choices["ask"].add_argument("--generator", type=_named, default=ask.extractive, help="module:name of a function that makes a generator")
    commands.choices["ask"].add_argument("--provider", default="ollama")
    commands.choices["ask"].add_argument("--conversation", help="id of a conversation that the question goes on; question and answer become its next turns")
    commands.add_parser("import").add_argument("parquet")
    for name in ("titles", "stop", "events", "reindex"):
        commands.add_parser(name)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    work = f"{args.store.rstrip('/')}-work"
    store, manifest = Store(spark, args.store, indexed=True), Manifest(spark, f"{work}/manifest")
    settings = sinks.read_settings(spark, work)
    engine = ingest.Engine(store, manifest, settings=settings)

    def findings():
        rows = store.read().select("book_id", "source_path", "format")
        return maintenance.scan(rows, manifest.read("book_state"), discover(spark, args.root).select(F.col("path").alias("source_path")), args.unreachable)

    if args.command == "ingest":
        ingest.run(spark, args.root, store, work, settings=settings)
        print(store.count(), "passages")
    elif args.command == "stop":
        manifest.ask_to_stop()
    elif args.command == "events":
        ingest.progress(manifest.read("events")).show(truncate=80)
    elif args.command == "import":
        print(store.import_parquet(args.parquet), "rows")
    elif args.command == "search":
        search(store, args.question, settings).select("rank", "score", "title", "chapter", "text").show(truncate=80)
    elif args.command == "ask":
        turns = manifest.turns(args.conversation) if args.conversation else None
        asked, said = answer(store, args.question, settings, args.generator, args.provider, sinks.read_notebook(spark, work), turns)
        if args.conversation and said.error is None:
            manifest.say(args.conversation, [("user", args.question), ("assistant", said.said or "")])
        print(said.said if said.error is None else f"no answer: {said.error}")
        print(f"({asked.prompt_tokens} tokens asked, {said.out_tokens or 0} answered)")
    elif args.command == "reindex":
        store.reindex()
        store.tidy()
        print(store.index.passages.count(), "passages indexed")
    elif args.command == "titles":
        catalog.titles(store.read()).orderBy(F.desc("n"), "title").show(50, truncate=80)
    elif args.command == "audit":
        findings().orderBy("kind", "source_path", "book_id").show(1000, truncate=80)
    elif args.command == "apply":
        found = findings().persist()
        print(found.where("kind IN ('orphan', 'stamp', 'ids')").count(), "findings put right")
        store.change(found, ["source_path"], lambda t: maintenance.mended(t, found))
        manifest.delete("book_state", found.where("kind IN ('orphan', 'state')").select("book_id"))
        found.unpersist()
    elif args.command in ("plan", "plan-soak"):
        steps = ingest.planned(engine, discover(spark, args.root))
        if args.command == "plan-soak":  # the plan twice, as a check that it does not depend on the order of its input
            again = ingest.planned(engine, discover(spark, args.root).orderBy(F.desc("path")))
            print("stable" if steps.select("path", "action").exceptAll(again.select("path", "action")).isEmpty() else "plans differ")
        steps.groupBy("action").agg(F.count("*").alias("n")).orderBy("action").show()
    elif args.command == "backfill-state":
        rows = maintenance.seed(store.read(), discover(spark, args.root), engine.collection).join(manifest.read("book_state").select("book_id"), "book_id", "left_anti").persist()
        print(rows.count(), "books")
        manifest.upsert("book_state", rows)
        rows.unpersist()
    else:
        view = store.view().select("id", "book_id", "title", "source_path", "chapter", "page", "text")
        citations.metric(view, discover(spark, args.root), args.books, args.per_book).show(100, truncate=80)


if __name__ == "__main__":
    main()
