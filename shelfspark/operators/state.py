"""Upserts, deletes and audits of manifest tables as snapshot to snapshot plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import formats as fm
from ..session import stored


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows in place of the table's rows of the same keys; of rows with one key, the last by all columns."""
    every = table.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    rest = [F.col(c).desc_nulls_last() for c in table.columns if c not in keys]
    last = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("_new"), *rest))
    return every.withColumn("_n", last).where("_n = 1").drop("_n", "_new")


def refresh(state: DataFrame, rows: DataFrame) -> DataFrame:
    """Take fingerprint and path of rows; keep the version, and the content signature where rows have none. New books get version 0."""
    r = rows.select("collection_id", "book_id", F.col("fingerprint").alias("_f"), F.col("content_sig").alias("_c"), F.col("source_path").alias("_p"))
    j = state.join(r, ["collection_id", "book_id"], "full")
    return j.select("collection_id", "book_id", F.coalesce("_f", "fingerprint").alias("fingerprint"), F.coalesce("_c", "content_sig").alias("content_sig"), F.coalesce("chunker_ver", F.lit(0)).cast("long").alias("chunker_ver"), F.coalesce("_p", "source_path").alias("source_path"))


def delete(table: DataFrame, keys: DataFrame) -> DataFrame:
    """Without the rows that share all columns of keys."""
    return table.join(keys.distinct(), keys.columns, "left_anti")


def delete_paths(table: DataFrame, paths: DataFrame) -> DataFrame:
    """Without rows at the paths, or under the ids that the paths derive."""
    p = paths.select(F.col("path").alias("source_path")).distinct()
    ids = p.select(fm.book_id(F.col("source_path")).alias("book_id"))
    return table.join(p, "source_path", "left_anti").join(ids, "book_id", "left_anti")


def remap(chunks: DataFrame, moves: DataFrame) -> DataFrame:
    """Give chunks of old_id the new id and path; chunk ids stay as they were."""
    m = moves.select(F.col("old_id").alias("book_id"), F.col("new_id").alias("_id"), F.col("path").alias("_path"))
    j = chunks.join(m, "book_id", "left")
    return j.withColumn("book_id", F.coalesce("_id", "book_id")).withColumn("source_path", F.coalesce("_path", "source_path")).drop("_id", "_path")


def replace_books(chunks: DataFrame, fresh: DataFrame) -> DataFrame:
    """fresh in place of all chunks at the paths that it brings, whatever their ids."""
    return chunks.join(fresh.select("source_path").distinct(), "source_path", "left_anti").select(*chunks.columns).unionByName(fresh.select(*chunks.columns))


def orphans(rows: DataFrame, disk: DataFrame, unreachable: list[str]) -> DataFrame:
    """Rows whose path is neither on disk nor under a root that cannot be reached."""
    roots = F.array(*map(F.lit, unreachable)) if unreachable else F.array().cast("array<string>")
    return rows.join(disk.select("source_path").distinct(), "source_path", "left_anti").where(~F.exists(roots, lambda r: fm.under_root(F.col("source_path"), r)))


def bad_stamps(chunks: DataFrame) -> DataFrame:
    """(book_id, source_path, from, to): books whose stored format is not their path's."""
    b = chunks.groupBy("book_id").agg(F.min(F.struct("source_path", "format")).alias("x")).select("book_id", "x.*")
    want = fm.family(fm.ext_of(F.col("source_path")))
    return b.where(want.isNotNull() & ~want.eqNullSafe(fm.family(F.col("format")))).select("book_id", "source_path", F.col("format").alias("from"), want.alias("to"))


def variants(paths: DataFrame) -> DataFrame:
    """(path, place): paths of one work in one folder, best first; works with one path are left out."""
    e = paths.select("path").distinct().withColumn("_r", fm.variant_rank(fm.ext_of(F.col("path")))).where("_r IS NOT NULL")
    by = W.partitionBy(fm.parent(F.col("path")), fm.stem(F.col("path")))
    ranked = e.withColumn("place", F.row_number().over(by.orderBy("_r", "path"))).withColumn("_n", F.count("*").over(by))
    return ranked.where("_n > 1").select("path", "place")


def multi_id(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """(source_path, keep_id, remove_ids) of paths stored under several ids: the manifest's id stays, else the derived one, else the smallest."""
    known = manifest.where("source_path <> ''").groupBy("source_path").agg(F.min("book_id").alias("_m"))
    g = rows.groupBy("source_path").agg(F.array_sort(F.collect_set("book_id")).alias("_ids")).where(F.size("_ids") > 1).join(known, "source_path", "left")
    has = lambda c: F.array_contains("_ids", c)
    derived = fm.book_id(F.col("source_path"))
    keep = F.when(F.coalesce(has(F.col("_m")), F.lit(False)), F.col("_m")).when(has(derived), derived).otherwise(F.element_at("_ids", 1))
    return g.withColumn("keep_id", keep).select("source_path", "keep_id", F.array_join(F.filter("_ids", lambda i: i != F.col("keep_id")), ",").alias("remove_ids"))


#: Bins that a range of values is cut into by one pass.
BINS = 1_024


def nearest_ranks(rows: DataFrame, by: list[str], value: str, shares: list[int]) -> DataFrame:
    """(by..., p<share>...): of each group the value at index n * share / 100 of all in order, without interpolation; nulls don't count.

    Selection by counting: each pass counts the values of a group's range by bin and goes on with the bin that
    holds the index, from its smallest to its largest value, until these are one. No group is sorted or gathered;
    what is shuffled is a row for each task, group and bin.
    """
    rows = rows.select(*by, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    none = F.array().cast("array<int>")
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    at = F.least(F.floor(F.col("_n") * F.col("_share") / 100), F.col("_n") - 1)
    wanted = stored(sizes.withColumn("_share", F.explode(F.array(*map(F.lit, shares)) if shares else none)).select(*by, "_share", at.alias("_at"), "_lo", "_hi"))
    keys = [*by, "_share"]
    while not (still := wanted.where("_lo < _hi")).isEmpty():
        asked = still.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], "_share", "_lo", "_hi")
        same = F.col("_v").between(F.col("_lo"), F.col("_hi"))
        for i, c in enumerate(by):
            same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
        # halves, as the difference of two large numbers may be no number; that of two tiny ones may be 0
        wide = F.col("_hi") / 2 - F.col("_lo") / 2
        place = F.try_divide(F.col("_v") / 2 - F.col("_lo") / 2, wide)
        bin_ = F.when(wide > 0, F.least(F.floor(place * BINS), F.lit(BINS - 1))).otherwise((F.col("_v") > F.col("_lo")).cast("long"))
        counted = rows.join(asked, same).groupBy(*keys, bin_.alias("_bin")).agg(F.count("*").alias("_c"), F.min("_v").alias("_a"), F.max("_v").alias("_z"))
        upto = F.sum("_c").over(W.partitionBy(*keys).orderBy("_bin"))  # of BINS rows at most
        counted = counted.withColumn("_upto", upto).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], "_c", "_a", "_z", "_upto")
        held = (F.col("_upto") > F.col("_at")) & (F.col("_upto") - F.col("_c") <= F.col("_at"))
        for i, c in enumerate(keys):
            held = held & F.col(c).eqNullSafe(F.col(f"_k{i}"))
        narrowed = still.join(counted, held).select(*keys, (F.col("_at") - F.col("_upto") + F.col("_c")).alias("_at"), F.col("_a").alias("_lo"), F.col("_z").alias("_hi"))
        wanted = stored(wanted.where("NOT (_lo < _hi)").unionByName(narrowed))
    return wanted.groupBy(*by).agg(*[F.max(F.when(F.col("_share") == s, F.col("_lo"))).alias(f"p{s}") for s in shares])
