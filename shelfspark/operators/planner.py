"""The ingest planner: what to do with each candidate file, by a ladder of checks.

All lookups are joins on keys that Spark may broadcast or shuffle as their sizes
ask for; the ladder is one CASE. Only "the same content is queued already"
depends on other candidates: it compares a row's position with the first
queued one of its content, found by a partial aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formats import is_sentinel

CURRENT_VERSION = 1


def _first_by(state: DataFrame, key: str, prefix: str, paths: DataFrame) -> DataFrame:
    """For each value of key, the state row of the smallest book id, with its path, or else the store's."""
    s = state.where(~is_sentinel(F.col(key))).groupBy(key).agg(F.min(F.struct("book_id", "source_path", "content_sig", "chunker_ver")).alias("x")).select(F.col(key).alias(f"{prefix}_key"), "x.*")
    s = s.join(paths, s.book_id == paths.pid, "left")
    path = F.coalesce(F.nullif("source_path", F.lit("")), "ppath", F.lit(""))
    return s.select(f"{prefix}_key", F.col("book_id").alias(f"{prefix}_id"), path.alias(f"{prefix}_path"), (F.col("source_path") == "").alias(f"{prefix}_empty"), F.col("content_sig").alias(f"{prefix}_csig"), F.col("chunker_ver").alias(f"{prefix}_ver"))


def lookups(found: DataFrame, states, skips, store, collection: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the planner asks of bucketed tables for candidates: (state, skips, store), read from the buckets that may hold it.

    Skips go by path. A state row goes by its id, its fingerprint or its signature, and a stored book by its path, its id, or
    the id of such a state row; by all but the bucket's own column through the filters of the snapshot (sources.store.Table).
    """
    ids, paths, mine = found.select("book_id"), found.select("path"), F.col("collection_id") == collection
    some = {*states.buckets_of(ids), *states.may_hold("fingerprint", found.select("fp")), *states.may_hold("content_sig", found.select("csig"))}
    state = states.read(sorted(some)).where(mine)
    same = [found.select(F.col(c).alias(key)).distinct() for c, key in (("fp", "fingerprint"), ("csig", "content_sig"))]
    hits = state.join(same[0], "fingerprint", "left_semi").select("book_id").unionByName(state.join(same[1], "content_sig", "left_semi").select("book_id"))
    held = {*store.buckets_of(paths), *store.may_hold("book_id", ids.unionByName(hits))}
    stored = store.read(sorted(held)).select("book_id", "source_path").distinct()
    return state, skips.read(skips.buckets_of(paths)).where(mine), stored


def plan(candidates: DataFrame, state: DataFrame, skips: DataFrame, store: DataFrame, pipeline: str, caps: str, rechunk: bool = False) -> DataFrame:
    """(pos, path, book_id, action, other_id, forced) for candidates (pos, path, book_id, fp, csig).

    Actions: unreadable, silenced, unchanged, refresh, remap (from other_id), duplicate, embed.
    """
    paths = store.groupBy(F.col("book_id").alias("pid")).agg(F.min("source_path").alias("ppath"))
    own = state.select(F.col("book_id").alias("own_id"), F.col("fingerprint").alias("own_fp"), F.col("chunker_ver").alias("own_ver"))
    silenced = skips.where((F.col("pipeline") == pipeline) & (F.col("caps_ver") == caps)).select(F.col("source_path").alias("k_path"), F.col("fingerprint").alias("k_fp")).distinct()
    ids, places = paths.select(F.col("pid").alias("in_id")), store.select(F.col("source_path").alias("in_path")).distinct()
    c = (
        candidates.join(own, candidates.book_id == own.own_id, "left")
        .join(silenced, (F.col("path") == F.col("k_path")) & (F.col("fp") == F.col("k_fp")), "left")
        .join(_first_by(state, "fingerprint", "f", paths), F.col("fp") == F.col("f_key"), "left")
        .join(_first_by(state, "content_sig", "s", paths), F.col("csig") == F.col("s_key"), "left")
        .join(ids, F.col("book_id") == F.col("in_id"), "left")
        .join(places, F.col("path") == F.col("in_path"), "left")
    )
    in_id, in_path = F.col("in_id").isNotNull(), F.col("in_path").isNotNull()
    bad = is_sentinel(F.col("csig"))
    legacy = F.lit(rechunk) & F.when(F.col("own_id").isNotNull(), F.col("own_ver") < CURRENT_VERSION).otherwise(in_id | in_path)
    moved = F.col("f_id").isNotNull() & (F.col("f_id") != F.col("book_id"))
    same_fp_file = (F.col("f_path") != "") & (F.col("f_path") == F.col("path"))
    known = F.coalesce(~is_sentinel(F.col("f_csig")) & (F.col("f_csig") == F.col("csig")), F.lit(False))
    same_content_file = (F.col("s_path") != "") & (F.col("s_path") == F.col("path"))
    late = F.when(in_path, "refresh").when(F.col("s_id").isNull(), "embed").when(same_content_file, "late refresh").when(F.col("s_id") != F.col("book_id"), "late remap").otherwise("late refresh")
    step = (
        F.when(is_sentinel(F.col("fp")), "unreadable")
        .when(F.col("k_path").isNotNull(), "silenced")
        .when(legacy & bad, "unreadable")
        .when(legacy, "forced")
        .when(F.coalesce(F.col("own_fp") == F.col("fp"), F.lit(False)), "unchanged")
        .when(moved & same_fp_file, F.when(F.col("f_empty"), "refresh").otherwise("unchanged"))
        .when(moved & bad, "unreadable")
        .when(moved & known, "remap")
        .when(moved, late)
        .when(in_id, "refresh")
        .when(bad, "unreadable")
        .otherwise(late)
    )
    c = c.withColumn("step", step)
    queued = c.where(F.col("step").isin("forced", "embed")).groupBy(F.col("csig").alias("q_csig")).agg(F.min("pos").alias("q_pos"))
    c = c.join(queued, F.col("csig") == F.col("q_csig"), "left")
    behind: Column = F.col("step").isin("forced", "embed", "late refresh", "late remap") & (F.coalesce("q_pos", "pos") < F.col("pos"))
    action = F.when(behind, "duplicate").when(F.col("step") == "forced", "embed").otherwise(F.regexp_replace("step", "^late ", ""))
    old = F.when(F.col("step") == "remap", F.col("f_id")).when((F.col("step") == "late remap") & ~behind, F.col("s_id"))
    version = F.when(F.col("step") == "remap", F.col("f_ver")).otherwise(F.col("s_ver"))
    forced = (F.col("step") == "forced") | F.lit(rechunk) & (action == "remap") & (version < CURRENT_VERSION)
    return c.select("pos", "path", "book_id", action.alias("action"), old.alias("other_id"), forced.alias("forced"))
