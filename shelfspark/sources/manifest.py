"""The tables beside the passages: what was ingested, what is passed over, and conversations."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import state as st
from .store import Files, Table

#: Table: columns, keys, the column of the buckets.
TABLES = {
    "collections": ("collection_id string, name string, db_path string, created_at long", ["collection_id"], "collection_id"),
    "conversations": ("conv_id string, title string, collection_ids array<string>, created_at long", ["conv_id"], "conv_id"),
    "messages": ("conv_id string, turn long, role string, text string, created_at long", ["conv_id", "turn"], "conv_id"),
    "notebook": ("collection_id string, text string, updated_at long", ["collection_id"], "collection_id"),
    "book_state": ("collection_id string, book_id string, fingerprint string, content_sig string, chunker_ver long, source_path string", ["collection_id", "book_id"], "book_id"),
    "skip_state": ("collection_id string, source_path string, pipeline string, fingerprint string, reason string, caps_ver string", ["collection_id", "source_path", "pipeline"], "source_path"),
    "events": ("run string, seq long, at timestamp, kind string, path string, detail string, done long, total long", ["run", "seq"], "run"),
}
BUCKETS = 64
#: Columns by which rows are looked up besides that of the buckets.
FILTERS = {"book_state": ("fingerprint", "content_sig")}


class Busy(RuntimeError):
    """Another writer holds the manifest."""


class Manifest:
    """A folder with one bucketed table for each of TABLES, a lock for a single writer, and a flag that asks it to stop."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.files = Files(spark, path)
        self.tables = {name: Table(spark, f"{self.path}/{name}", schema, by, BUCKETS, FILTERS.get(name, ())) for name, (schema, _, by) in TABLES.items()}

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        return self.tables[name].read(buckets)

    def tidy(self) -> None:
        for table in self.tables.values():
            table.tidy()

    def upsert(self, name: str, rows: DataFrame) -> None:
        """rows in place of those with the same keys; of rows with one key the last by all columns."""
        schema, keys, _ = TABLES[name]
        columns = [x.split()[0] for x in schema.split(", ")]
        self.tables[name].replace(st.upsert(rows.select(*columns).limit(0), rows.select(*columns), keys), keys)

    def delete(self, name: str, keys: DataFrame) -> None:
        self.tables[name].change(keys, keys.columns, lambda t: st.delete(t, keys))

    def delete_collection(self, collection_id: str) -> None:
        """A collection, with its manifest rows and notes, and conversations that belong to no other; those of several lose the name."""
        one = self.spark.createDataFrame([(collection_id,)], "collection_id string")
        for name in ("collections", "notebook", "book_state", "skip_state"):
            self.delete(name, one)
        held = self.read("conversations").where(F.array_contains("collection_ids", collection_id))
        gone = held.where(F.size("collection_ids") == 1).select("conv_id")
        alone = [r[0] for r in gone.collect()]  # one reader's conversations
        if alone:
            ids = self.spark.createDataFrame([(x,) for x in alone], "conv_id string")
            self.delete("messages", ids)
            self.delete("conversations", ids)
        rest = self.read("conversations").where(F.array_contains("collection_ids", collection_id))
        if not rest.isEmpty():
            self.upsert("conversations", rest.withColumn("collection_ids", F.array_remove("collection_ids", collection_id)))

    def turns(self, conv_id: str) -> DataFrame:
        """(turn, role, text) of a conversation; only its bucket is read."""
        table = self.tables["messages"]
        one = self.spark.createDataFrame([(conv_id,)], "conv_id string")
        return table.read(table.buckets_of(one)).where(F.col("conv_id") == conv_id).select("turn", "role", "text")

    def say(self, conv_id: str, said: list[tuple[str, str]]) -> None:
        """Add turns (role, text) to the end of a conversation."""
        last = self.turns(conv_id).agg(F.max("turn")).first()[0]
        first = 0 if last is None else last + 1
        now = int(time.time())
        rows = [(conv_id, first + i, role, text, now) for i, (role, text) in enumerate(said)]
        self.upsert("messages", self.spark.createDataFrame(rows, TABLES["messages"][0]))

    def acquire(self) -> None:
        if not self.files.lock("lock"):
            raise Busy(f"{self.path} is being written to; delete {self.path}/lock if that writer is gone")

    def release(self) -> None:
        self.files.delete("lock")

    def ask_to_stop(self) -> None:
        self.files.lock("stop")

    def stopping(self) -> bool:
        return "stop" in self.files.names()

    def go_on(self) -> None:
        self.files.delete("stop")
