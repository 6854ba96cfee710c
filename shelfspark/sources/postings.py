"""A full-text index that is kept: postings in buckets by term, beside the passages that they follow."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieval as r
from ..session import bound_batches
from .store import BUCKETS, KEEP, Files, Table

#: Share of dead passages (tombstones to passages) from which postings are written anew without them.
DEAD = 0.5
#: Tombstones that are broadcast at most, a few dozen bytes each.
FEW_DEAD = 1 << 19
#: Words that are counted at once.
WORDS = 1 << 20


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n, gen, term, tf) of rows (id, n, gen, _t): the words of each row, with their occurrences."""
    for batch in batches:
        at = np.concatenate([[0], np.cumsum(batch.column("n").fill_null(0).to_numpy())])
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + WORDS, "right")) - 1)
            part = batch.slice(lo, hi - lo)
            lo = hi
            words = part.column("_t").flatten().dictionary_encode()
            names, code = words.dictionary, words.indices.to_numpy().astype(np.int64)
            row = np.repeat(np.arange(part.num_rows), pc.list_value_length(part.column("_t")).fill_null(0).to_numpy())
            key, tf = np.unique(row * max(len(names), 1) + code, return_counts=True)
            row, code = pa.array(key // max(len(names), 1)), pa.array(key % max(len(names), 1))
            yield pa.RecordBatch.from_arrays([*[part.column(c).take(row) for c in ("id", "n", "gen")], names.take(code), pa.array(tf)], ["id", "n", "gen", "term", "tf"])


class Postings:
    """Three tables: postings by term, passages with their lengths by path, and tombstones by passage.

    Every change has a generation. A posting tells the generation in which its passage was indexed, a tombstone the
    last generation of its passage that is dead, so nothing is rewritten where a passage goes or changes: its
    tombstone is added, and a passage that stays as it was keeps its postings, also under another path. The passages
    lie in the same buckets as the store's, so a change of some buckets is followed by reading those alone.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark = spark
        self.postings = Table(spark, f"{path}/terms", "term string, id string, tf long, n long, gen long", "term", buckets)
        self.passages = Table(spark, f"{path}/passages", "id string, source_path string, sig long, n long, gen long", "source_path", buckets, ("id",))
        self.dead = Table(spark, f"{path}/dead", "id string, gen long", "id", buckets)
        self.files = Files(spark, path)

    def _numbers(self) -> str:
        return f"{self.postings.snapshot()[0]} {self.dead.snapshot()[0]}"

    def _done(self) -> str:
        return self.files.read_text("done") if "done" in self.files.names() else "-1 -1"

    def recover(self) -> None:
        """Put right what a run that failed half way has left: its postings die, and passages whose postings are dead are unknown, so they are indexed anew."""
        done = self._done()
        if self._numbers() == done:
            return
        known = self.passages.read().select("id", "gen")
        made = self.postings.read().where(F.col("gen") > int(done.split()[0])).select("id", "gen").distinct()
        self.dead.append(made.join(known, ["id", "gen"], "left_anti"))
        lost = known.join(self._last(), "id").where("gen <= dead").select("id", "gen")
        self.passages.change(lost, ["id"], lambda t: t.join(lost, ["id", "gen"], "left_anti"))
        self.files.create(self._numbers(), "done", overwrite=True)

    def _last(self) -> DataFrame:
        return self.dead.read().groupBy("id").agg(F.max("gen").alias("dead"))

    def follow(self, store, buckets: list[int]) -> None:
        """Index what the store has in these buckets in place of what is known of them.

        Tombstones come first and passages last; a run that fails half way is put right by the next one.
        """
        self.recover()
        bound_batches(self.spark)  # a row has all words of a passage
        gen = self.postings.snapshot()[0] + 1
        known = self.passages.read(buckets)
        here = store.read(buckets).select("id", "source_path", "text").withColumn("sig", F.xxhash64("text"))
        keep = known.select("id", "sig", "n", "gen").join(here.select("id", "sig", "source_path"), ["id", "sig"]).select(*self.passages.columns)
        keep = keep.persist()
        try:
            gone = known.join(keep.select("id", "gen"), ["id", "gen"], "left_anti").select("id", "gen")
            self.dead.append(gone)
            fresh = here.join(keep.select("id"), "id", "left_anti").withColumn("_t", r.tokens(F.col("text"))).withColumn("n", F.size("_t").cast("long")).withColumn("gen", F.lit(gen).cast("long"))
            self.postings.append(self._counted(fresh))
            self.passages.put_buckets(buckets, keep.unionByName(fresh.select(*self.passages.columns)))
            self.files.create(self._numbers(), "done", overwrite=True)
        finally:
            keep.unpersist()

    def _counted(self, fresh: DataFrame) -> DataFrame:
        """The postings of rows (id, n, gen, _t). Words are counted within a row, so postings are shuffled only as they are written; those of ids that come twice are added up before."""
        words = fresh.select("id", "n", "gen", "_t").mapInArrow(counted, "id string, n long, gen long, term string, tf long")
        twice = fresh.groupBy("id").agg(F.count("*").alias("many")).where("many > 1").select("id")
        if twice.isEmpty():
            return words
        some = words.join(twice, "id", "left_semi").groupBy("term", "id", "n", "gen").agg(F.sum("tf").alias("tf"))
        return words.join(twice, "id", "left_anti").unionByName(some)

    def live(self, terms: DataFrame | None = None) -> DataFrame:
        """The postings (term, id, tf, n) of passages that are there, of all terms or of a few (term); only the buckets of these are read."""
        if terms is None:
            rows = self.postings.read()
        else:
            wanted = terms.select("term").distinct()
            rows = self.postings.read(self.postings.buckets_of(wanted)).join(wanted, "term", "left_semi")
        return self._alive(rows).select("term", "id", "tf", "n")

    def _alive(self, rows: DataFrame) -> DataFrame:
        """rows (id, gen, ...) without dead ones. Where nothing is dead, or little, they are not shuffled."""
        if not any(self.dead.snapshot()[1].values()):
            return rows
        dead = self._last()
        return rows.join(F.broadcast(dead) if self.dead.count() <= FEW_DEAD else dead, "id", "left").where("dead IS NULL OR gen > dead")

    def search(self, terms: DataFrame, k: int) -> DataFrame:
        """(qid, id, score, rank) for terms (qid, term), as retrieval.bm25 gives them; no text is read."""
        stats = self.passages.read().agg(F.count("*").alias("_docs"), F.avg("n").alias("_avg"))
        found = lambda wanted: self.live(wanted).select("id", F.col("n").alias("_n"), "term", F.col("tf").alias("_tf"))
        return r.ranked(terms, found, stats, k)

    def vocabulary(self) -> DataFrame:
        """(word, n) of words of letters of three bytes or more, with their occurrences."""
        words = self.live().where(F.col("term").rlike(r"^\p{L}+$") & (F.octet_length("term") >= 3))
        return words.groupBy(F.col("term").alias("word")).agg(F.sum("tf").alias("n"))

    def fuzzy_terms(self, queries: DataFrame) -> DataFrame:
        """(qid, term) of the words known that are near those of queries (qid, q)."""
        return r.near_terms(queries, self.live().select("term").distinct())

    def tidy(self, keep: int = KEEP) -> None:
        """Compact the tables, and write the postings anew without the dead ones where those are many."""
        self.recover()
        dead, here = self.dead.count(), self.passages.count()
        if dead > DEAD * max(here, 1):
            self.postings.write(self._alive(self.postings.read()).select(*self.postings.columns))
            self.dead.write(self.dead.read().limit(0))
        for table in (self.postings, self.passages, self.dead):
            table.tidy(keep)
        self.files.create(self._numbers(), "done", overwrite=True)
