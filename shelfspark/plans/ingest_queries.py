"""The planner, manifest upserts and maintenance over the derived library."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import formats as fm
from ..functions import text as tx
from ..operators import planner, state
from .registry import Library, query

BAD = "({0} IS NULL OR {0} IN ('', 'missing'))"


def plan_sql(rechunk: bool) -> str:
    hit = "SELECT {key}, arg_min(book_id, book_id) AS id, arg_min(source_path, book_id) AS sp, arg_min(content_sig, book_id) AS cs, arg_min(chunker_ver, book_id) AS ver FROM fx_book_state WHERE NOT " + BAD.format("{key}") + " GROUP BY {key}"
    late = "CASE WHEN in_path THEN 'refresh' WHEN s_id IS NULL THEN 'embed' WHEN s_path <> '' AND s_path = path THEN 'late refresh' WHEN s_id <> book_id THEN 'late remap' ELSE 'late refresh' END"
    legacy = "coalesce(own_ver < 1, in_id OR in_path)" if rechunk else "false"
    return f"""WITH p AS (SELECT book_id, min(source_path) AS path FROM fx_store GROUP BY 1), f AS ({hit.format(key='fingerprint')}), s AS ({hit.format(key='content_sig')}),
  k AS (SELECT DISTINCT source_path, fingerprint FROM fx_skip_state WHERE pipeline = 'cpu' AND caps_ver = 'caps-v1'), places AS (SELECT DISTINCT source_path FROM fx_store),
  j AS (SELECT c.*, o.fingerprint AS own_fp, o.chunker_ver AS own_ver, k.source_path IS NOT NULL AS silent, f.id AS f_id, coalesce(nullif(f.sp, ''), pf.path, '') AS f_path, f.sp = '' AS f_empty, f.cs AS f_cs, f.ver AS f_ver,
      s.id AS s_id, coalesce(nullif(s.sp, ''), ps.path, '') AS s_path, s.ver AS s_ver, pi.book_id IS NOT NULL AS in_id, pl.source_path IS NOT NULL AS in_path
    FROM fx_candidates c LEFT JOIN fx_book_state o ON c.book_id = o.book_id LEFT JOIN k ON c.path = k.source_path AND c.fp = k.fingerprint LEFT JOIN f ON c.fp = f.fingerprint LEFT JOIN p pf ON f.id = pf.book_id
    LEFT JOIN s ON c.csig = s.content_sig LEFT JOIN p ps ON s.id = ps.book_id LEFT JOIN p pi ON c.book_id = pi.book_id LEFT JOIN places pl ON c.path = pl.source_path),
  l AS (SELECT *, CASE WHEN {BAD.format('fp')} THEN 'unreadable' WHEN silent THEN 'silenced' WHEN {legacy} THEN 'forced' WHEN own_fp = fp THEN 'unchanged'
      WHEN f_id <> book_id AND f_path <> '' AND f_path = path THEN CASE WHEN f_empty THEN 'refresh' ELSE 'unchanged' END WHEN f_id <> book_id AND NOT {BAD.format('f_cs')} AND f_cs = csig THEN 'remap'
      WHEN f_id <> book_id THEN {late} WHEN in_id THEN 'refresh' ELSE {late} END AS step FROM j),
  q AS (SELECT csig, min(pos) AS q FROM l WHERE step IN ('forced', 'embed') GROUP BY csig),
  d AS (SELECT l.*, step IN ('forced', 'embed', 'late refresh', 'late remap') AND coalesce(q.q, pos) < pos AS dup FROM l LEFT JOIN q ON l.csig = q.csig)
  SELECT pos, path, book_id, CASE WHEN dup THEN 'duplicate' WHEN step = 'forced' THEN 'embed' ELSE replace(step, 'late ', '') END AS action, CASE WHEN step = 'remap' THEN f_id WHEN step = 'late remap' AND NOT dup THEN s_id END AS other_id,
    {"step = 'forced' OR (step = 'remap' AND f_ver < 1) OR (step = 'late remap' AND NOT dup AND s_ver < 1)" if rechunk else "false"} AS forced FROM d"""


def _plan(t: Library, rechunk: bool):
    return planner.plan(t.fx_candidates, t.fx_book_state, t.fx_skip_state, t.fx_store, "cpu", "caps-v1", rechunk)


@query(plan_sql(False))
def index_plan(t):
    return _plan(t, False)


@query(plan_sql(True))
def index_plan_rechunk(t):
    return _plan(t, True)


@query("SELECT c.path FROM fx_candidates c JOIN fx_skip_state k ON c.path = k.source_path AND k.pipeline = 'cpu' AND k.fingerprint = c.fp AND k.caps_ver = 'caps-v1'")
def plan_silenced(t):
    k = t.fx_skip_state.where("pipeline = 'cpu' AND caps_ver = 'caps-v1'").select(F.col("source_path").alias("path"), F.col("fingerprint").alias("fp"))
    return t.fx_candidates.join(k, ["path", "fp"]).select("path")


@query("SELECT c.pos, min(s.book_id) AS hit FROM fx_candidates c JOIN fx_book_state s ON c.fp = s.fingerprint WHERE c.fp NOT IN ('', 'missing') GROUP BY c.pos")
def plan_stage2(t):
    s = t.fx_book_state.select(F.col("fingerprint").alias("fp"), F.col("book_id").alias("b"))
    return t.fx_candidates.where(~fm.is_sentinel(F.col("fp"))).join(s, "fp").groupBy("pos").agg(F.min("b").alias("hit"))


@query("SELECT pos FROM fx_candidates c WHERE EXISTS (SELECT 1 FROM fx_store s WHERE s.book_id = c.book_id) OR EXISTS (SELECT 1 FROM fx_store s WHERE s.source_path = c.path)")
def plan_stage3(t):
    c = t.fx_candidates
    a = c.join(t.fx_store.select("book_id"), "book_id", "left_semi").select("pos")
    return a.union(c.join(t.fx_store.select(F.col("source_path").alias("path")), "path", "left_semi").select("pos")).distinct()


@query("SELECT c.pos, min(s.book_id) AS hit FROM fx_candidates c JOIN fx_book_state s ON c.csig = s.content_sig GROUP BY c.pos")
def plan_stage4(t):
    s = t.fx_book_state.where(~fm.is_sentinel(F.col("content_sig"))).select(F.col("content_sig").alias("csig"), F.col("book_id").alias("b"))
    return t.fx_candidates.join(s, "csig").groupBy("pos").agg(F.min("b").alias("hit"))


@query("SELECT pos FROM fx_candidates QUALIFY row_number() OVER (PARTITION BY csig ORDER BY pos) > 1")
def inrun_dup(t):
    c = t.fx_candidates
    first = c.groupBy("csig").agg(F.min("pos").alias("_p"))
    return c.join(first, "csig").where("pos > _p").select("pos")


LEGACY = "b.chunker_ver < 1 OR b.source_path = ''"


@query(f"SELECT count(*) AS n FROM fx_book_state b WHERE ({LEGACY}) AND NOT EXISTS (SELECT 1 FROM fx_skip_state k WHERE k.source_path = b.source_path)")
def legacy_count(t):
    b = t.fx_book_state.where("chunker_ver < 1 OR source_path = ''")
    return b.join(t.fx_skip_state, "source_path", "left_anti").agg(F.count("*").alias("n"))


@query(f"SELECT count(*) AS n FROM fx_book_state b WHERE ({LEGACY}) AND EXISTS (SELECT 1 FROM fx_skip_state k WHERE k.source_path = b.source_path)")
def legacy_skipped(t):
    b = t.fx_book_state.where("chunker_ver < 1 OR source_path = ''")
    return b.join(t.fx_skip_state, "source_path", "left_semi").agg(F.count("*").alias("n"))


def _fresh(t: Library):
    c = t.fx_candidates.where("pos % 3 = 0")
    return c.select(F.lit("c1").alias("collection_id"), "book_id", F.col("fp").alias("fingerprint"), F.when(F.col("pos") % 2 == 0, F.col("csig")).alias("content_sig"), F.lit(1).cast("long").alias("chunker_ver"), F.col("path").alias("source_path"))


FRESH = "fresh AS (SELECT 'c1' AS collection_id, book_id, fp AS fingerprint, CASE WHEN pos % 2 = 0 THEN csig END AS content_sig, 1::BIGINT AS chunker_ver, path AS source_path FROM fx_candidates WHERE pos % 3 = 0)"


@query(f"WITH {FRESH} SELECT * FROM fresh UNION ALL SELECT collection_id, book_id, fingerprint, content_sig, chunker_ver, source_path FROM fx_book_state s WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.book_id = s.book_id)")
def upsert_state(t):
    return state.upsert(t.fx_book_state, _fresh(t), ["collection_id", "book_id"])


@query(f"WITH {FRESH} SELECT coalesce(s.collection_id, f.collection_id) AS collection_id, coalesce(s.book_id, f.book_id) AS book_id, coalesce(f.fingerprint, s.fingerprint) AS fingerprint, coalesce(f.content_sig, s.content_sig) AS content_sig, coalesce(s.chunker_ver, 0)::BIGINT AS chunker_ver, coalesce(f.source_path, s.source_path) AS source_path FROM fx_book_state s FULL JOIN fresh f ON s.book_id = f.book_id")
def refresh_state(t):
    return state.refresh(t.fx_book_state, _fresh(t))


@query("WITH p AS (SELECT path FROM fx_books WHERE doc_id % 5 = 0) SELECT book_id, source_path FROM fx_store WHERE source_path NOT IN (SELECT path FROM p) AND book_id NOT IN (SELECT substr(sha1(path), 1, 16) FROM p)")
def delete_by_path(t):
    return state.delete_paths(t.fx_store, t.fx_books.where("doc_id % 5 = 0").select("path")).select("book_id", "source_path")


@query("WITH p AS (SELECT path FROM fx_books WHERE doc_id % 100 = 7) SELECT book_id, source_path, fingerprint FROM fx_book_state WHERE source_path NOT IN (SELECT path FROM p) AND book_id NOT IN (SELECT substr(sha1(path), 1, 16) FROM p)")
def reindex_book(t):
    return state.delete_paths(t.fx_book_state, t.fx_books.where("doc_id % 100 = 7").select("path")).select("book_id", "source_path", "fingerprint")


@query("SELECT id, CASE WHEN doc_id % 6 = 0 THEN 'new-' || doc_id ELSE book_id END AS book_id, CASE WHEN doc_id % 6 = 0 THEN '/new' || source_path ELSE source_path END AS source_path FROM fx_chunks")
def remap_book(t):
    c = t.fx_chunks
    moves = c.where("doc_id % 6 = 0").select(F.col("book_id").alias("old_id"), F.concat(F.lit("new-"), F.col("doc_id").cast("string")).alias("new_id"), F.concat(F.lit("/new"), "source_path").alias("path")).distinct()
    return state.remap(c, moves).select("id", "book_id", "source_path")


STAMPS = "st AS (SELECT book_id, source_path, CASE WHEN doc_id % 8 = 0 THEN 'txt' ELSE format END AS format FROM fx_chunks)"
FAM = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fm.FAMILY.items()) + " END"
BADST = f"bs AS (SELECT book_id, source_path, format AS \"from\", {FAM.format('x')} AS \"to\" FROM (SELECT *, regexp_extract(source_path, '\\.({fm.EXT_PATTERN})$', 1) AS x FROM st) WHERE {FAM.format('x')} <> {FAM.format('format')})"


def _stamped(t: Library):
    return t.fx_chunks.withColumn("format", F.when(F.col("doc_id") % 8 == 0, "txt").otherwise(F.col("format")))


@query(f"WITH {STAMPS}, {BADST} SELECT * FROM bs")
def maint_stamps(t):
    return state.bad_stamps(_stamped(t))


@query(f"WITH {STAMPS}, {BADST} SELECT \"from\", \"to\", count(*) AS n FROM bs GROUP BY ALL")
def stamp_pairs(t):
    return state.bad_stamps(_stamped(t)).groupBy("from", "to").agg(F.count("*").alias("n"))


@query(f"WITH {STAMPS}, {BADST} SELECT st.book_id, coalesce(bs.\"to\", st.format) AS format FROM st LEFT JOIN bs ON st.book_id = bs.book_id")
def restamp(t):
    s = _stamped(t).select("book_id", "source_path", "format")
    return s.join(state.bad_stamps(s).select("book_id", "to"), "book_id", "left").select("book_id", F.coalesce("to", "format").alias("format"))


DISK = "disk AS (SELECT path FROM fx_books WHERE doc_id % 13 <> 6)"
GONE = "NOT EXISTS (SELECT 1 FROM disk WHERE disk.path = s.source_path) AND NOT (s.source_path = '/lib/src19' OR starts_with(s.source_path, '/lib/src19/'))"


def _disk(t: Library):
    return t.fx_books.where("doc_id % 13 <> 6").select(F.col("path").alias("source_path"))


@query(f"WITH {DISK} SELECT DISTINCT book_id, source_path FROM fx_store s WHERE {GONE}")
def orphans_store(t):
    return state.orphans(t.fx_store.distinct(), _disk(t), ["/lib/src19"]).select("book_id", "source_path")


@query(f"WITH {DISK} SELECT book_id, source_path FROM fx_book_state s WHERE NOT EXISTS (SELECT 1 FROM fx_store x WHERE x.book_id = s.book_id) AND (source_path = '' OR ({GONE}))")
def orphans_manifest(t):
    lone = t.fx_book_state.join(t.fx_store.select("book_id"), "book_id", "left_anti")
    empty = lone.where("source_path = ''").select("book_id", "source_path")
    return empty.union(state.orphans(lone.where("source_path <> ''"), _disk(t), ["/lib/src19"]).select("book_id", "source_path"))


@query(f"WITH {DISK} SELECT 'store' AS kind, count(*) AS n FROM (SELECT DISTINCT book_id, source_path FROM fx_store s WHERE {GONE}) UNION ALL SELECT 'manifest', count(*) FROM fx_book_state s WHERE NOT EXISTS (SELECT 1 FROM fx_store x WHERE x.book_id = s.book_id) AND (source_path = '' OR ({GONE}))")
def maint_orphans(t):
    count = lambda kind, d: d.agg(F.lit(kind).alias("kind"), F.count("*").alias("n")).select("kind", "n")
    return count("store", orphans_store(t)).union(count("manifest", orphans_manifest(t)))


@query("SELECT r.root, count(s.book_id) AS affected FROM (VALUES ('/lib/src19'), ('/lib/src3'), ('/nowhere')) r(root) LEFT JOIN fx_store s ON starts_with(s.source_path, r.root || '/') GROUP BY r.root")
def root_affected(t):
    names = ("/lib/src19", "/lib/src3", "/nowhere")
    roots = t.spark.createDataFrame([(x,) for x in names], "root string")
    # a path is tried against the few roots where it is read, and no more than counts are joined
    above = F.filter(F.array(*map(F.lit, names)), lambda r: fm.under_root(F.col("source_path"), r))
    n = t.fx_store.select("book_id", F.explode(above).alias("root")).groupBy("root").agg(F.count("book_id").alias("n"))
    return roots.join(n, "root", "left").select("root", F.coalesce("n", F.lit(0).cast("long")).alias("affected"))


VARS = """vp AS (SELECT doc_id, '/v/w/work' || (doc_id // 4) || '.' || ['pdf', 'epub', 'docx', 'md'][(doc_id % 4 + 1)::INT] AS path, [1, 0, 5, NULL][(doc_id % 4 + 1)::INT] AS r, (doc_id // 4) AS g FROM documents)"""


def _variant_paths(t: Library):
    ext = F.element_at(F.array(*map(F.lit, ("pdf", "epub", "docx", "md"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return t.documents.select("doc_id", F.concat(F.lit("/v/w/work"), F.floor(F.col("doc_id") / 4).cast("string"), F.lit("."), ext).alias("path"))


@query(f"WITH {VARS} SELECT path, place FROM (SELECT path, row_number() OVER (PARTITION BY g ORDER BY r, path) AS place, count(*) OVER (PARTITION BY g) AS n FROM vp WHERE r IS NOT NULL) WHERE n > 1")
def maint_dups(t):
    return state.variants(_variant_paths(t))


@query(f"WITH {VARS} SELECT path FROM vp WHERE r IS NULL UNION ALL SELECT arg_min(path, (r, path)) FROM vp WHERE r IS NOT NULL GROUP BY g")
def variant_dedup(t):
    p = _variant_paths(t).select("path")
    return p.join(state.variants(p).where("place > 1").select("path"), "path", "left_anti")


@query(f"WITH {VARS} SELECT path FROM (SELECT DISTINCT path FROM vp UNION SELECT path FROM fx_books) WHERE regexp_matches(lower(path), '\\.({fm.EXT_PATTERN})$') AND NOT ends_with(path, '.xps')")
def discover(t):
    paths = _variant_paths(t).select("path").union(t.fx_books.select("path")).distinct()
    return paths.where(fm.ext_of(F.col("path")).isNotNull() & (fm.ext_of(F.col("path")) != "xps"))


IDS = "(SELECT book_id, source_path FROM fx_store UNION ALL SELECT 'alt-' || source_path, source_path FROM fx_store WHERE length(source_path) % 3 = 0)"


@query(f"WITH i AS (SELECT source_path, list_sort(list(DISTINCT book_id)) AS ids FROM {IDS} GROUP BY source_path), m AS (SELECT source_path, min(book_id) AS b FROM fx_book_state WHERE source_path <> '' GROUP BY 1), k AS (SELECT i.*, CASE WHEN list_contains(ids, m.b) THEN m.b WHEN list_contains(ids, substr(sha1(i.source_path), 1, 16)) THEN substr(sha1(i.source_path), 1, 16) ELSE ids[1] END AS keep_id FROM i LEFT JOIN m USING (source_path) WHERE len(ids) > 1) SELECT source_path, keep_id, array_to_string(list_filter(ids, lambda x: x <> keep_id), ',') AS remove_ids FROM k")
def maint_multi_id(t):
    s = t.fx_store
    alt = s.where(F.length("source_path") % 3 == 0).select(F.concat(F.lit("alt-"), "source_path").alias("book_id"), "source_path")
    return state.multi_id(s.union(alt), t.fx_book_state)


@query("SELECT source_path, array_to_string(list_sort(list(DISTINCT book_id)), ',') AS ids FROM fx_store GROUP BY source_path")
def ids_by_path(t):
    return t.fx_store.groupBy("source_path").agg(F.array_join(F.array_sort(F.collect_set("book_id")), ",").alias("ids"))


@query(f"WITH {DISK}, {STAMPS}, {BADST}, s AS (SELECT book_id, source_path, format FROM st) SELECT s.book_id, s.source_path, coalesce(bs.\"to\", s.format) AS format FROM s LEFT JOIN bs ON s.book_id = bs.book_id WHERE NOT ({GONE})")
def maint_apply(t):
    """The chunk table after maintenance: rows of files that are gone deleted, wrong formats put right."""
    s = _stamped(t).select("book_id", "source_path", "format")
    kept = s.join(state.orphans(s, _disk(t), ["/lib/src19"]).select("book_id").distinct(), "book_id", "left_anti")
    return kept.join(state.bad_stamps(kept).select("book_id", "to"), "book_id", "left").select("book_id", "source_path", F.coalesce("to", "format").alias("format"))


@query("SELECT id, text FROM fx_chunks WHERE doc_id % 4 <> 1 UNION ALL SELECT 'new:' || id, 'again: ' || text FROM fx_chunks WHERE doc_id % 4 = 1")
def reindex_replace(t):
    c = t.fx_chunks.select("id", "source_path", "text", "doc_id")
    fresh = c.where("doc_id % 4 = 1").withColumn("id", F.concat(F.lit("new:"), "id")).withColumn("text", F.concat(F.lit("again: "), "text"))
    return state.replace_books(c, fresh).select("id", "text")


@query("SELECT conv_id, turn FROM conversations WHERE conv_id % 3 <> 0")
def cascade_delete(t):
    gone = t.conversations.where("conv_id % 3 = 0").select("conv_id").distinct()
    return state.delete(t.conversations, gone).select("conv_id", "turn")


@query("SELECT b.book_id, coalesce(nullif(b.source_path, ''), p.path, '') AS source_path, b.source_path = '' AND p.path IS NOT NULL AS filled FROM fx_book_state b LEFT JOIN (SELECT book_id, min(source_path) AS path FROM fx_store GROUP BY 1) p ON b.book_id = p.book_id")
def backfill_paths(t):
    p = t.fx_store.groupBy("book_id").agg(F.min("source_path").alias("path"))
    j = t.fx_book_state.join(p, "book_id", "left")
    return j.select("book_id", F.coalesce(F.nullif("source_path", F.lit("")), "path", F.lit("")).alias("source_path"), ((F.col("source_path") == "") & F.col("path").isNotNull()).alias("filled"))


@query("SELECT source_path, pipeline FROM fx_skip_state WHERE starts_with(source_path, '/lib/src1/') OR starts_with(source_path, '/lib/src2/')")
def gc_skips(t):
    roots = F.array(F.lit("/lib/src1"), F.lit("/lib/src2/"))
    return t.fx_skip_state.where(F.exists(roots, lambda r: fm.under_root(F.col("source_path"), r))).select("source_path", "pipeline")


@query("SELECT s.book_id, s.source_path, c.fp AS fingerprint, 0::BIGINT AS chunker_ver FROM fx_store s JOIN fx_candidates c ON s.source_path = c.path WHERE c.fp <> 'missing'")
def backfill_state(t):
    c = t.fx_candidates.where(~fm.is_sentinel(F.col("fp"))).select(F.col("path").alias("source_path"), F.col("fp").alias("fingerprint"))
    return t.fx_store.join(c, "source_path").select("book_id", "source_path", "fingerprint", F.lit(0).cast("long").alias("chunker_ver"))


@query("SELECT pos, fp FROM fx_candidates WHERE fp NOT IN ('', 'missing')")
def purge_sentinels(t):
    return t.fx_candidates.where(~fm.is_sentinel(F.col("fp"))).select("pos", "fp")


@query("SELECT source, count(*) AS n, count(DISTINCT doc_id) AS kinds, min(doc_id) AS lo, max(doc_id) AS hi, count(*) = count(DISTINCT doc_id) AS whole FROM documents GROUP BY source")
def sidecar_validate(t):
    """Whether the lines of a helper's outcomes, read from JSON, name each input of a source once."""
    line = t.documents.select("source", F.to_json(F.struct(F.col("doc_id").alias("index"), F.lit("ok").alias("outcome"))).alias("j"))
    i = line.select("source", F.from_json("j", "index long, outcome string")["index"].alias("i"))
    seen = i.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("i").alias("kinds"), F.min("i").alias("lo"), F.max("i").alias("hi"))
    return seen.withColumn("whole", F.col("n") == F.col("kinds"))


@query(f"SELECT doc_id, {FAM.format('format')} AS format, text FROM fx_chunks")
def import_strict(t):
    """Import of rows with an unknown format fails and names the row; known ones pass with their family."""
    c = t.fx_chunks
    f = fm.family(F.col("format"))
    checked = F.when(f.isNull(), F.raise_error(F.concat(F.lit("unknown format "), "format", F.lit(" of book "), "book_id")).cast("string")).otherwise(f)
    return c.select("doc_id", checked.alias("format"), "text")


@query("SELECT doc_id, CASE WHEN ext IN ('pages') THEN 'converter' ELSE 'direct' END AS part FROM fx_books")
def format_partition(t):
    conv = F.col("ext").isin("doc", "pages", "webarchive", "djvu")
    b = t.fx_books
    return b.where(conv).select("doc_id", F.lit("converter").alias("part")).union(b.where(~conv).select("doc_id", F.lit("direct").alias("part")))
