"""Incremental ingest and live progress with Structured Streaming."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import formats as fm
from ..operators import models
from ..operators import state as st
from ..operators.planner import CURRENT_VERSION, lookups, plan
from ..operators.sections import chunk_books
from ..sources.manifest import TABLES, Manifest
from ..sources.readers import read_blocks
from ..sources.store import Store

#: Files in a batch; passages that are embedded at once, and where that fails.
BATCH_FILES, EMBED_BATCH, MICRO_BATCH = 40, 64, 8


def files(spark: SparkSession, root: str) -> DataFrame:
    """New files below root as a stream, so many at a time."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", BATCH_FILES).load(root)


class Fatal(RuntimeError):
    """Raised by an embedder that would fail for every book: nothing is quarantined for it."""


@dataclass(frozen=True)
class Engine:
    """Where books go, and how they are cut and embedded."""

    store: Store
    manifest: Manifest
    collection: str = "main"
    pipeline: str = "cpu"
    caps: str = "v1"
    embedder: Callable[[], models.Embedder] | None = models.hashed_words
    settings: Settings = Settings()
    rechunk: bool = False

    @property
    def spark(self) -> SparkSession:
        return self.store.spark


def candidates(files: DataFrame) -> DataFrame:
    """(pos, path, book_id, fp, csig) of files, in order of their paths; sorted by ranges, so that no task numbers all of them."""
    seconds = F.floor(F.unix_micros("modificationTime") / 1_000_000)
    rows = files.select("path", fm.book_id(F.col("path")).alias("book_id"), fm.fingerprint(F.col("length"), seconds).alias("fp"), fm.content_signature(F.col("content"), F.col("length")).alias("csig"))
    return rows.orderBy("path").select(F.monotonically_increasing_id().alias("pos"), "path", "book_id", "fp", "csig")


def planned(engine: Engine, files: DataFrame) -> DataFrame:
    """The plan of a batch, with fp and csig."""
    found = candidates(files).persist()
    tables = engine.manifest.tables
    held = lookups(found, tables["book_state"], tables["skip_state"], engine.store, engine.collection)
    steps = plan(found, *held, engine.pipeline, engine.caps, engine.rechunk)
    return steps.join(found.select("pos", "fp", "csig"), "pos")


def _state_rows(engine: Engine, rows: list, version: int | None = CURRENT_VERSION) -> DataFrame:
    data = [(engine.collection, r["book_id"], r["fp"], None if r["csig"] == "missing" else r["csig"], version, r["path"]) for r in rows]
    return engine.spark.createDataFrame(data, TABLES["book_state"][0])


def embed_books(engine: Engine, files: DataFrame, steps: list, batch: int) -> dict[str, tuple[str, str | None]]:
    """Read, cut, embed and store the books of some steps at once; (outcome, reason) by path. Nothing is stored if it fails."""
    paths = [r["path"] for r in steps]
    s = engine.settings
    blocks = read_blocks(files.where(F.col("path").isin(paths)).select("path", "content")).persist()
    try:
        good = blocks.where("reason IS NULL")
        chunks = chunk_books(good.select("book_id", "pos", "chapter", "page", "text"), s.target_tokens, s.overlap_tokens, s.min_tokens)
        books = good.groupBy("book_id").agg(F.first("title").alias("title"), F.first("author").alias("author"), F.first("path").alias("source_path"), F.first("format").alias("format"))
        rows = chunks.join(books, "book_id")
        rows = models.embed(rows, engine.embedder, batch=batch) if engine.embedder else rows.withColumn("vector", F.array().cast("array<float>"))
        engine.store.replace(rows)
        reasons = {r["path"]: r["reason"] for r in blocks.groupBy("path").agg(F.max("reason").alias("reason")).collect()}  # a row for each file of the batch
    finally:
        blocks.unpersist()
    done = [r for r in steps if reasons.get(r["path"], "no text") is None]
    if done:
        engine.manifest.upsert("book_state", _state_rows(engine, done))
    return {p: ("indexed", None) if p in {r["path"] for r in done} else ("skipped", reasons.get(p, "unknown format")) for p in paths}


def bisect(steps: list, work: Callable[[list, int], dict], stopping: Callable[[], bool] = lambda: False) -> dict[str, tuple[str, str | None]]:
    """work on all steps at once; where it fails on each half, and on a single one once more with small batches, before that is quarantined.

    Steps that a stop leaves undone get no outcome, so they are planned again.
    """
    out: dict[str, tuple[str, str | None]] = {}
    queue = [(steps, EMBED_BATCH)] if steps else []
    while queue and not stopping():
        some, batch = queue.pop(0)
        try:
            out |= work(some, batch)
        except Exception as e:
            said = next((x for x in reversed(str(e).strip().splitlines()) if x.strip()), type(e).__name__).strip()
            if isinstance(e, Fatal) or re.search(r"^\s*(?:\w+\.)*Fatal\b", str(e), re.M):
                raise
            if len(some) > 1:
                half = len(some) // 2
                queue[:0] = [(some[:half], batch), (some[half:], batch)]
            elif batch > MICRO_BATCH:
                queue.insert(0, (some, MICRO_BATCH))
            else:
                out[some[0]["path"]] = ("quarantined", f"fails even alone and in small batches: {said[:300]}")
    return out


def ingest_batch(engine: Engine, outcomes: str, batch: DataFrame, batch_id: int) -> None:
    """Plan one batch of files and do what the plan says. A batch that is run again finds its books unchanged."""
    files = batch.select("path", "modificationTime", "length", "content").persist()
    m = engine.manifest
    try:
        steps = [r.asDict() for r in planned(engine, files).orderBy("pos").collect()]  # BATCH_FILES rows at most
        by = lambda action: [r for r in steps if r["action"] == action]
        result = {r["path"]: (r["action"], None) for r in steps if r["action"] not in ("embed", "remap", "refresh")}
        for r in by("refresh"):
            result[r["path"]] = ("refreshed", None)
        for r in by("remap"):
            result[r["path"]] = ("remapped", None)
        fresh = by("refresh")
        if fresh:
            ids = engine.spark.createDataFrame([(r["book_id"],) for r in fresh], "book_id string")
            old = m.read("book_state").where(F.col("collection_id") == engine.collection).join(ids, "book_id", "left_semi")
            m.upsert("book_state", st.refresh(old, _state_rows(engine, fresh, None).drop("chunker_ver")))
        moves = by("remap")
        if moves:  # all in one change
            moved = engine.spark.createDataFrame([(r["other_id"], r["book_id"], r["path"]) for r in moves], "old_id string, new_id string, path string")
            old_ids = moved.select(F.col("old_id").alias("book_id"))
            engine.store.change(old_ids, ["book_id"], lambda t: st.remap(t, moved))
            states = m.tables["book_state"]
            known = states.read(states.buckets_of(old_ids)).where(F.col("collection_id") == engine.collection).join(old_ids, "book_id", "left_semi")
            versions = {r["book_id"]: r["chunker_ver"] for r in known.select("book_id", "chunker_ver").collect()}  # a row for each file of the batch
            m.delete("book_state", old_ids.select(F.lit(engine.collection).alias("collection_id"), "book_id"))
            for version in {versions.get(r["other_id"], 0) for r in moves}:
                m.upsert("book_state", _state_rows(engine, [r for r in moves if versions.get(r["other_id"], 0) == version], version))
        result |= bisect(by("embed"), lambda some, size: embed_books(engine, files, some, size), m.stopping)
        over = [r for r in steps if result.get(r["path"], ("",))[0] in ("skipped", "quarantined")]
        if over:
            rows = [(engine.collection, r["path"], engine.pipeline, r["fp"], result[r["path"]][1], engine.caps) for r in over]
            m.upsert("skip_state", engine.spark.createDataFrame(rows, TABLES["skip_state"][0]))
        rows = [(r["path"], *result.get(r["path"], ("stopped", None))) for r in steps]
        engine.spark.createDataFrame(rows, "path string, outcome string, reason string").write.mode("overwrite").parquet(f"{outcomes}/batch={batch_id}")
        now = dt.datetime.now()
        told = [(outcomes, batch_id * 1000 + i, now, outcome, path, reason, i + 1, len(rows)) for i, (path, outcome, reason) in enumerate(rows)]
        if told:
            m.upsert("events", engine.spark.createDataFrame(told, TABLES["events"][0]))
        engine.store.tidy()
        m.tidy()
    finally:
        files.unpersist()


def progress(events: DataFrame) -> DataFrame:
    """(run, kind, n, last): events of a run by kind, from the manifest's table."""
    return events.groupBy("run", "kind").agg(F.count("*").alias("n"), F.max("at").alias("last"))


def ingest(spark: SparkSession, root: str, store: Store, work: str, **options):
    """Start the ingest of all that is new below root; ends when there is no more, or when the manifest's stop flag stands.

    Options are Engine's. The manifest is at work/manifest; its lock is held while the query runs, see run().
    """
    engine = Engine(store, Manifest(spark, f"{work}/manifest"), **options)
    one = lambda batch, n: ingest_batch(engine, f"{work}/outcomes", batch, n)
    return files(spark, root).where(fm.ext_of(F.col("path")).isNotNull()).writeStream.foreachBatch(one).option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start()


def run(spark: SparkSession, root: str, store: Store, work: str, poll: float = 0.5, **options) -> None:
    """Ingest as the manifest's only writer, until there is no more or the stop flag is set; what is committed stays."""
    manifest = Manifest(spark, f"{work}/manifest")
    manifest.acquire()
    try:
        manifest.go_on()
        query = ingest(spark, root, store, work, **options)
        while not query.awaitTermination(poll):
            if manifest.stopping():
                query.stop()
                break
    finally:
        manifest.release()


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of (ts, event_type) in windows, rows later than the watermark left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
