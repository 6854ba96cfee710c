"""A passage store held against its manifest and the disk: what is wrong, and putting it right."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import formats as fm
from . import state as st

#: (kind, book_id, source_path, detail) of a finding.
FINDING = ("kind", "book_id", "source_path", "detail")


def scan(rows: DataFrame, manifest: DataFrame, disk: DataFrame, unreachable: list[str]) -> DataFrame:
    """FINDINGs of five kinds in rows (book_id, source_path, format), manifest (book_state) and disk (source_path).

    orphan: a stored book whose file is gone; state: a manifest row without passages whose file is gone; stamp: a stored
    format that is not the path's; variant: a path beside a better one of the same work; ids: other ids of a path.
    Files under roots that cannot be reached are never gone.
    """
    finding = lambda kind, df, detail: df.select(F.lit(kind).alias("kind"), "book_id", "source_path", detail.cast("string").alias("detail"))
    books = rows.select("book_id", "source_path").distinct()
    none = F.lit(None)
    gone = finding("orphan", st.orphans(books, disk, unreachable), none)
    lone = manifest.join(books.select("book_id").distinct(), "book_id", "left_anti").select("book_id", "source_path")
    lost = lone.where("source_path = ''").unionByName(st.orphans(lone.where("source_path <> ''"), disk, unreachable))
    stamps = st.bad_stamps(rows).select("book_id", "source_path", F.col("to"))
    extra = books.join(st.variants(books.select(F.col("source_path").alias("path"))).where("place > 1"), F.col("source_path") == F.col("path"), "left_semi")
    ids = st.multi_id(books, manifest).select("source_path", "keep_id", F.explode(F.split("remove_ids", ",")).alias("book_id"))
    return gone.unionByName(finding("state", lost, none)).unionByName(finding("stamp", stamps, F.col("to"))).unionByName(finding("variant", extra, none)).unionByName(finding("ids", ids, F.col("keep_id")))


def affected(rows: DataFrame, roots: list[str]) -> DataFrame:
    """(root, affected): books under each root."""
    r = rows.sparkSession.createDataFrame([(x,) for x in roots], "root string")
    return r.join(rows.select("book_id", "source_path").distinct(), fm.under_root(F.col("source_path"), F.col("root")), "left").groupBy("root").agg(F.count("book_id").alias("affected"))


def mended(rows: DataFrame, findings: DataFrame, kinds: tuple[str, ...] = ("orphan", "stamp", "ids")) -> DataFrame:
    """rows with the findings of some kinds put right: books deleted, formats set."""
    f = findings.where(F.col("kind").isin(*kinds))
    gone = f.where("kind IN ('orphan', 'variant', 'ids')").select("book_id", "source_path").distinct()
    kept = rows.join(gone, ["book_id", "source_path"], "left_anti")
    to = f.where("kind = 'stamp'").groupBy("book_id").agg(F.max("detail").alias("_to"))
    return kept.join(to, "book_id", "left").withColumn("format", F.coalesce("_to", "format")).select(*rows.columns)


def seed(rows: DataFrame, files: DataFrame, collection: str) -> DataFrame:
    """Manifest rows of version 0 for stored books whose file is there: (collection_id, book_id, fingerprint, content_sig, chunker_ver, source_path).

    files (path, length, modificationTime, content).
    """
    seconds = F.floor(F.unix_micros("modificationTime") / 1_000_000)
    known = files.select(F.col("path").alias("source_path"), fm.fingerprint(F.col("length"), seconds).alias("fingerprint"), fm.content_signature(F.col("content"), F.col("length")).alias("content_sig"))
    known = known.where(~fm.is_sentinel(F.col("fingerprint"))).withColumn("content_sig", F.nullif("content_sig", F.lit("missing")))
    books = rows.select("book_id", "source_path").distinct().join(known, "source_path")
    return books.select(F.lit(collection).alias("collection_id"), "book_id", "fingerprint", "content_sig", F.lit(0).cast("long").alias("chunker_ver"), "source_path")
