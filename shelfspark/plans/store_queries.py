"""Queries over a kept store made of the documents: its index, its filters, and its compaction."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import planner
from ..operators import retrieval as r
from ..session import shared_dir
from ..sources.manifest import FILTERS, TABLES
from ..sources.store import Store, Table
from . import retrieval_queries as rq
from .ingest_queries import plan_sql
from .registry import Library, query

#: Buckets of tables that a query makes.
BUCKETS = 8


def _folder(t: Library) -> str:
    return f"{shared_dir(t.spark)}/store-{uuid.uuid4().hex}"


def _passages(docs: DataFrame) -> DataFrame:
    """Documents as passages of a book for each hundred ids."""
    path = F.concat(F.lit("/lib/"), F.floor(F.col("doc_id") / 100).cast("string"), F.lit(".txt"))
    blank = [F.lit("").alias(c) for c in ("author", "chapter")]
    numbers = [F.lit(x).cast("long").alias(c) for c, x in (("page", -1), ("loc_start", 0), ("loc_end", 0))]
    return docs.select(F.col("doc_id").cast("string").alias("id"), F.sha1(path.cast("binary")).alias("book_id"), F.lit("t").alias("title"), path.alias("source_path"), F.lit("txt").alias("format"), *blank, *numbers, "text", F.lit(None).cast("array<float>").alias("vector"))


def _store(t: Library) -> Store:
    store = Store(t.spark, _folder(t), buckets=BUCKETS, indexed=True)
    store.append(_passages(t.documents))
    return store


WORDS = rq.TOK.format("text")
POSTINGS = "SELECT term, doc_id::VARCHAR AS id, count(*) AS tf, any_value(n)::BIGINT AS n FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM (SELECT doc_id, {words} AS t FROM {docs})) GROUP BY ALL"


@query(POSTINGS.format(words=WORDS, docs="documents"))
def postings_build(t):
    """The index of all documents."""
    return _store(t).index.live()


CHANGED = "(SELECT doc_id, CASE WHEN doc_id % 300 // 100 = 1 THEN 'anew ' || text ELSE text END AS text FROM documents WHERE doc_id % 300 // 100 <> 2)"


def _changed(t: Library) -> Store:
    """Of three books one stays, one is written anew, one goes, and all that are left move."""
    store = _store(t)
    third = F.floor(F.col("doc_id") / 100) % 3
    store.replace(_passages(t.documents.where(third == 1).withColumn("text", F.concat(F.lit("anew "), F.col("text")))))
    gone = _passages(t.documents.where(third == 2)).select("source_path").distinct()
    store.change(gone, ["source_path"], lambda rows: rows.join(gone, "source_path", "left_anti"))
    every = store.read().select("source_path").distinct()
    store.change(every, ["source_path"], lambda rows: rows.withColumn("source_path", F.concat(F.lit("/new"), "source_path")))
    return store


@query(POSTINGS.format(words=WORDS, docs=CHANGED))
def postings_update(t):
    """The index after books were replaced, deleted and moved, which it followed bucket by bucket."""
    return _changed(t).index.live()


@query(f"WITH {rq.Q_SQL}, {rq.TERMS_SQL}, {rq.bm25_sql('terms', 'b')} SELECT qid, id, score, rank FROM b")
def bm25_indexed(t):
    """Full-text search by the kept index; the ids are numbers again for ties."""
    index = _store(t).index
    terms = r.terms_of(rq._queries(t))
    stats = index.passages.read().agg(F.count("*").alias("_docs"), F.avg("n").alias("_avg"))
    found = lambda wanted: index.live(wanted).select(F.col("id").cast("long").alias("id"), F.col("n").alias("_n"), "term", F.col("tf").alias("_tf"))
    return r.ranked(terms, found, stats, 10)


@query("SELECT doc_id, text, source FROM documents WHERE doc_id % 10 <> 3 UNION ALL SELECT doc_id, 'anew ' || text, source FROM documents WHERE doc_id % 10 = 3")
def store_compacted(t):
    """Documents that came in ten batches, one of which came again with other texts, after the folders were merged."""
    table = Table(t.spark, _folder(t), "doc_id long, text string, source string", "doc_id", BUCKETS, ("source",))
    for i in range(10):
        table.append(t.documents.where(F.col("doc_id") % 10 == i).select("doc_id", "text", "source"))
    table.replace(t.documents.where("doc_id % 10 = 3").select("doc_id", F.concat(F.lit("anew "), F.col("text")).alias("text"), "source"), ["doc_id"])
    table.tidy()
    return table.read()


@query(plan_sql(False))
def index_plan_pruned(t):
    """The ingest plan against tables in buckets, of which only those are read whose filters may match."""
    folder = _folder(t)

    def table(name: str, rows: DataFrame) -> Table:
        schema, _, by = TABLES[name]
        out = Table(t.spark, f"{folder}/{name}", schema, by, BUCKETS, FILTERS.get(name, ()))
        out.write(rows)
        return out

    store = Table(t.spark, f"{folder}/store", "book_id string, source_path string", "source_path", BUCKETS, ("book_id",))
    store.write(t.fx_store)
    found = t.fx_candidates
    held = planner.lookups(found, table("book_state", t.fx_book_state), table("skip_state", t.fx_skip_state), store, "c1")
    return planner.plan(found, *held, "cpu", "caps-v1")
