"""Catalog roll-ups, conversations, citations, plain relational checks and windows of time."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import catalog, citations, conversations, scans, state, themes
from .registry import Library, query
from .text_queries import CHAPTERS_SQL, PROBE_SQL, _labels, chapter_sql



def micros(ts) -> F.Column:
    """Microseconds since 1970 of a time without a zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts)


def seconds(ts) -> F.Column:
    return F.floor(micros(ts) / 1000000).cast("long")


THEME_SQL = "array_to_string(list_filter(regexp_split_to_array(translate(lower(title), '_-.():,/', '        '), '\\s+'), lambda w: w NOT IN ('meap', 'edition', 'final', '') AND NOT regexp_matches(w, '^[0-9]+$') AND NOT regexp_matches(w, '^[vb][0-9]+$')), ' ')"
BOOKS_SQL = "bk AS (SELECT book_id, arg_min(title, id) AS title, arg_min(author, id) AS author, arg_min(source_path, id) AS source_path, arg_min(format, id) AS format, count(*) AS n FROM fx_chunks GROUP BY book_id)"


@query("SELECT title, count(*) AS n FROM fx_chunks GROUP BY title")
def book_titles(t):
    return catalog.titles(t.fx_chunks)


@query(f"WITH {BOOKS_SQL} SELECT book_id, title, author, source_path, format, n FROM bk")
def book_catalog(t):
    return catalog.books(t.fx_chunks)


CHAP_SQL = "ch AS (SELECT title, trim(chapter) AS chapter, min(CASE WHEN page >= 0 THEN page END) AS page, arg_min(source_path, id) AS source_path FROM fx_chunks WHERE trim(chapter) <> '' GROUP BY 1, 2)"


@query(f"WITH {CHAP_SQL} SELECT * FROM ch")
def chapter_index(t):
    return catalog.chapters(t.fx_chunks)


@query(f"WITH {BOOKS_SQL} SELECT title, arg_min(author, book_id) AS author, arg_min(format, book_id) AS format, arg_min(source_path, (-n, book_id)) AS source_path, max(n) AS n FROM bk GROUP BY title")
def library_catalog(t):
    return catalog.library(catalog.books(t.fx_chunks))


@query(f"SELECT theme, arg_min(title, (-n, title)) AS title, sum(n)::BIGINT AS n FROM (SELECT title, count(*) AS n, {THEME_SQL} AS theme FROM fx_chunks GROUP BY title) WHERE theme <> '' GROUP BY theme")
def theme_titles(t):
    return catalog.themes(catalog.titles(t.fx_chunks))


@query(f"SELECT 'Name themes for: ' || string_agg(title || ' (' || n || ')', '; ' ORDER BY title) AS prompt FROM (SELECT title, count(*) AS n FROM fx_chunks GROUP BY title)")
def theme_prompt(t):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("title", "n"))), lambda x: F.concat(x["title"], F.lit(" ("), x["n"].cast("string"), F.lit(")")))
    return catalog.titles(t.fx_chunks).agg(F.concat(F.lit("Name themes for: "), F.array_join(ordered, "; ")).alias("prompt"))


@query("SELECT DISTINCT book_id FROM fx_chunks")
def distinct_books(t):
    return t.fx_chunks.select("book_id").distinct()


@query("SELECT DISTINCT book_id, source_path FROM fx_chunks")
def path_pairs(t):
    return t.fx_chunks.select("book_id", "source_path").distinct()


@query("SELECT book_id, min(source_path) AS source_path, min(format) AS format FROM fx_chunks GROUP BY book_id")
def book_formats(t):
    return t.fx_chunks.groupBy("book_id").agg(F.min(F.struct("source_path", "format")).alias("x")).select("book_id", "x.*")


@query("SELECT id, book_id, title, author, source_path, format, chapter FROM fx_chunks")
def scan_meta(t):
    return t.fx_chunks.select("id", "book_id", "title", "author", "source_path", "format", "chapter")


@query("SELECT id, text FROM fx_chunks WHERE doc_id % 20 = 0")
def fetch_texts(t):
    ids = t.fx_chunks.where("doc_id % 20 = 0").select("id")
    return t.fx_chunks.join(ids, "id", "left_semi").select("id", "text")


@query("SELECT count(*) AS n FROM fx_chunks")
def count_rows(t):
    return t.fx_chunks.agg(F.count("*").alias("n"))


@query(f"WITH {CHAP_SQL}, h AS (SELECT chapter, title FROM ch WHERE contains(lower(concat_ws(chr(0), chapter, title)), 'ch 3')) SELECT chapter, title, (SELECT count(*) FROM h) AS total FROM h ORDER BY chapter, title LIMIT 800")
def catalog_search(t):
    return catalog.search(catalog.chapters(t.fx_chunks).select("chapter", "title"), "CH 3", ["chapter", "title"], 800)


@query("WITH o AS (SELECT p_name, p_partkey, row_number() OVER (ORDER BY key) - 1 AS i FROM (SELECT p_name, p_partkey, p_name || lpad(p_partkey::VARCHAR, 8, '0') AS key FROM part)), n AS (SELECT count(*) AS n FROM o), w AS (SELECT floor(i * n / 100)::BIGINT AS i FROM range(0, 100) r(i), n) SELECT p_partkey FROM o SEMI JOIN w USING (i)")
def even_sample(t):
    p = t.part.select("p_partkey", F.concat("p_name", F.lpad(F.col("p_partkey").cast("string"), 8, "0")).alias("key"))
    return catalog.even_sample(p, "key", 100).select("p_partkey")


@query("SELECT title, CASE WHEN lag(l) OVER (ORDER BY title) IS DISTINCT FROM l THEN l END AS header FROM (SELECT title, CASE WHEN regexp_matches(upper(trim(title)[1:1]), '^[A-Z]$') THEN upper(trim(title)[1:1]) ELSE '#' END AS l FROM (SELECT DISTINCT title FROM fx_chunks))")
def letter_headers(t):
    l = t.fx_chunks.select("title").distinct().withColumn("l", tx.group_letter(F.col("title")))
    first = l.groupBy("l").agg(F.min("title").alias("f"))
    return l.join(first, "l").select("title", F.when(F.col("title") == F.col("f"), F.col("l")).alias("header"))


@query("SELECT source, format, count(*) AS indexed, count(*) FILTER (page < 0) AS skipped FROM fx_chunks GROUP BY ALL")
def stats_merge(t):
    """Counters of two runs, kept as maps and added key by key."""
    part = lambda d: d.groupBy("source", "format").agg(F.struct(F.count("*").alias("i"), F.count_if(F.col("page") < 0).alias("s")).alias("v")).groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("format", "v"))).alias("m"))
    c = t.fx_chunks
    a, b = part(c.where("doc_id % 2 = 0")).withColumnRenamed("m", "a"), part(c.where("doc_id % 2 = 1")).withColumnRenamed("m", "b")
    zero = F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("s"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<struct<i:bigint,s:bigint>>"))
    m = F.map_zip_with(F.coalesce("a", none), F.coalesce("b", none), lambda _, x, y: F.struct((F.coalesce(x, zero)["i"] + F.coalesce(y, zero)["i"]).alias("i"), (F.coalesce(x, zero)["s"] + F.coalesce(y, zero)["s"]).alias("s")))
    return a.join(b, "source", "full").select("source", F.explode(m).alias("format", "v")).select("source", "format", F.col("v.i").alias("indexed"), F.col("v.s").alias("skipped"))


@query("SELECT source, CASE WHEN source = 'src3' THEN 0 ELSE max(doc_id) + 1 END::BIGINT AS next FROM documents GROUP BY source")
def next_ord(t):
    ords = t.documents.where("source <> 'src3'")
    return t.documents.select("source").distinct().join(ords, "source", "left").groupBy("source").agg(F.coalesce(F.max("doc_id") + 1, F.lit(0)).cast("long").alias("next"))


@query("SELECT conv_id, sum(CASE WHEN role = 'user' THEN ceil(length(text) / 4.0)::BIGINT ELSE 0 END)::BIGINT AS in_tokens, sum(CASE WHEN role = 'assistant' THEN ceil(length(text) / 4.0)::BIGINT ELSE 0 END)::BIGINT AS out_tokens FROM conversations GROUP BY conv_id")
def token_usage(t):
    n = tx.estimate_tokens(F.col("text"))
    of = lambda role: F.sum(F.when(F.col("role") == role, n).otherwise(0))
    return t.conversations.groupBy("conv_id").agg(of("user").alias("in_tokens"), of("assistant").alias("out_tokens"))


@query("SELECT event_type, v[(len(v) // 2 + 1)::INT] AS p50, v[(least(len(v) * 95 // 100, len(v) - 1) + 1)::INT] AS p95, v[len(v)] AS most FROM (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY event_type)")
def nearest_rank_pct(t):
    return state.nearest_ranks(t.events, ["event_type"], "value", [50, 95, 100]).withColumnRenamed("p100", "most")


PAGES_SQL = "pg AS (SELECT doc_id, unnest(range(1, greatest(n, 1) + 1)) AS page, text, n FROM (SELECT doc_id, text, (length(text) + 399) // 400 AS n FROM documents)), pl AS (SELECT doc_id, page, 'Part ' || (doc_id % 3) || ' page ' || page || chr(10) || text[(page - 1) * 400 + 1:page * 400] AS text FROM pg)"


def _pages(t: Library):
    """Documents as files of pages of 400 characters, under a head that counts them; (doc_id, page, text)."""
    d = t.documents.select("doc_id", "text", F.ceil(F.length("text") / 400).cast("int").alias("n"))
    d = d.withColumn("page", F.explode(F.sequence(F.lit(1), F.greatest("n", F.lit(1)))))
    part = F.col("text").substr((F.col("page") - 1) * 400 + 1, F.lit(400))
    head = F.concat(F.lit("Part "), (F.col("doc_id") % 3).cast("string"), F.lit(" page "), F.col("page").cast("string"), F.lit("\n"))
    return d.select("doc_id", F.col("page").cast("long").alias("page"), F.concat(head, part).alias("text"))


@query(f"""WITH {PAGES_SQL}, l AS (SELECT DISTINCT doc_id, page, regexp_replace(lower(trim(regexp_replace(line, '\\s+', ' ', 'g'))), '[0-9]+', '#', 'g') AS line FROM (SELECT doc_id, page, unnest(string_split(text, chr(10))) AS line FROM pl)),
  n AS (SELECT doc_id, count(*) AS n FROM pg GROUP BY doc_id)
  SELECT doc_id, line, count(*) AS pages FROM l JOIN n USING (doc_id) WHERE line <> '' AND n >= 5 GROUP BY doc_id, line, n HAVING count(*) >= greatest(5, floor(n * 0.3))""")
def repeated_lines(t):
    """Running heads: lines on at least 5 pages and three tenths of the pages of a file of at least 5 pages."""
    return scans.running_heads(_pages(t), "doc_id").select("doc_id", "line", "pages")


@query("SELECT r_name AS node, count(*) AS weight FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY 1 UNION ALL SELECT n_name, 1 FROM nation")
def node_weight(t):
    """Leaves under each node of a tree of two levels."""
    tree = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    return tree.select("n_name", F.explode(F.array("r_name", "n_name")).alias("node")).groupBy("node").agg(F.count("*").alias("weight"))


@query("SELECT event_type, count(*) AS n, round(count(*) / greatest(epoch(max(ts)) - epoch(min(ts)), 1), 6) AS rate FROM events GROUP BY event_type")
def throughput(t):
    took = F.greatest((micros(F.max("ts")) - micros(F.min("ts"))) / 1e6, F.lit(1.0))
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.count("*") / took, 6).alias("rate"))


SAMPLE = "(SELECT doc_id, source, ext, md5('7' || doc_id) AS h FROM fx_books)"


@query(f"WITH b AS (SELECT source, ext, doc_id, h, row_number() OVER (PARTITION BY ext ORDER BY h, doc_id) AS r FROM {SAMPLE}) SELECT ext, doc_id FROM b WHERE r <= 6")
def strat_sample(t):
    """The first six books of each stratum in the order of a hash."""
    b = t.fx_books.withColumn("h", F.md5(F.concat(F.lit("7"), F.col("doc_id").cast("string")).cast("binary")))
    return b.withColumn("r", F.row_number().over(W.partitionBy("ext").orderBy("h", "doc_id"))).where("r <= 6").select("ext", "doc_id")


# ----------------------------------------------------------- conversations


@query("SELECT conv_id, string_agg(role || ': ' || CASE WHEN length(l) > 1500 THEN l[1:1500] || '…' ELSE l END, chr(10) ORDER BY turn) AS turns FROM (SELECT conv_id, turn, role, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS l, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE role IN ('user', 'assistant')) WHERE back <= 6 GROUP BY conv_id")
def history_window(t):
    c = t.conversations.where(F.col("role").isin("user", "assistant"))
    c = c.withColumn("back", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))).where("back <= 6")
    line = F.concat("role", F.lit(": "), tx.truncated(tx.one_line(F.col("text")), 1500))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("turns"))


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(ceil(length(text) / 4.0)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS s FROM conversations) WHERE s <= 100")
def digest_cap(t):
    """The latest turns that fit a budget of tokens: older ones are shed first."""
    s = F.sum(tx.estimate_tokens(F.col("text"))).over(W.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(W.unboundedPreceding, 0))
    return t.conversations.withColumn("s", s).where("s <= 100").select("conv_id", "turn")


@query("SELECT conv_id, turn, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM conversations")
def prior_user(t):
    before = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    return t.conversations.select("conv_id", "turn", F.max(F.when(F.col("role") == "user", F.col("turn"))).over(before).alias("prior"))


@query("SELECT c.conv_id, turn FROM conversations c JOIN (SELECT conv_id, max(turn) AS last FROM conversations WHERE role = 'user' GROUP BY 1) u ON c.conv_id = u.conv_id WHERE turn < last")
def retry_truncate(t):
    last = t.conversations.where("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("last"))
    return t.conversations.join(last, "conv_id").where("turn < last").select("conv_id", "turn")


@query("SELECT conv_id, max(turn) AS last, count(*) AS n FROM conversations GROUP BY conv_id")
def conversation_list(t):
    return t.conversations.groupBy("conv_id").agg(F.max("turn").alias("last"), F.count("*").alias("n")).orderBy(F.desc("conv_id"))


@query("SELECT conv_id, conv_id % 4 = 0 OR conv_id % 3 IN (0, 2) AS visible FROM (SELECT DISTINCT conv_id FROM conversations)")
def visible_convs(t):
    """Shown with a selection of collections: those of no collection, or of one that is selected."""
    k = F.col("conv_id")
    mine = F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("c"), (k % 3).cast("string"))))
    return t.conversations.select("conv_id").distinct().select("conv_id", conversations.visible(mine, F.array(F.lit("c0"), F.lit("c2"))).alias("visible"))


@query("""WITH a AS (SELECT conv_id, turn, unnest(range(0, 4)) AS n FROM conversations WHERE role = 'assistant'),
  s AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank, length(text)::BIGINT AS size FROM conversations WHERE role = 'user')
SELECT a.conv_id, a.turn, a.n::BIGINT AS n, s.size FROM a LEFT JOIN s ON a.conv_id = s.conv_id AND a.n = s.rank""")
def citation_sources(t):
    """[0] to [3] in each answer; its sources are the user's turns of the conversation, by rank."""
    c = t.conversations
    answers = c.where("role = 'assistant'").select("conv_id", "turn", F.concat(F.lit("[0] "), F.lit("[[1]] and [2], [3]")).alias("text"))
    rank = F.row_number().over(W.partitionBy("conv_id").orderBy("turn")).cast("long")
    asked = c.where("role = 'user'").select("conv_id", rank.alias("rank"), F.length("text").cast("long").alias("size"))
    sources = answers.select("conv_id", "turn").join(asked, "conv_id")
    return conversations.citation_links(answers, sources, ["conv_id", "turn"]).select("conv_id", "turn", "n", "size")


@query("""WITH p AS (SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN [] WHEN 1 THEN [r_name] WHEN 2 THEN [r_name, n_name] ELSE [r_name, n_name, 'coast'] END AS p FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT n_nationkey, CASE WHEN len(p) <= 1 THEN 'Sum up ' || coalesce(nullif(array_to_string(p, ' › '), ''), 'the library') || ' as the library has it.'
  WHEN len(p) = 2 THEN 'Explain "' || p[2] || '" as a part of ' || p[1] || ': its ideas, and what ties them together.'
  ELSE 'Go into "' || p[len(p)] || '" under ' || array_to_string(p[1:len(p) - 1], ' › ') || ': how it works, what it costs, and the details.' END AS question,
  CASE WHEN len(p) > 0 THEN 'In a library, take this path of topics: ' || array_to_string(p, ' › ') || '. Split "' || p[len(p)] || '" into four to six narrower topics, none of them named like it, each with one sentence.' || chr(10) || 'Answer with JSON alone: [{"name": "...", "blurb": "..."}]' END AS deepen
FROM p""")
def theme_questions(t):
    k = F.col("n_nationkey") % 4
    path = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array("r_name")).when(k == 2, F.array("r_name", "n_name")).otherwise(F.array("r_name", "n_name", F.lit("coast")))
    p = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", path.alias("path"))
    return p.select("n_nationkey", themes.level_question(F.col("path")).alias("question"), themes.deepen_prompt(F.col("path")).alias("deepen"))


@query("SELECT p_name AS topic, a.angle, replace(a.q, '{}', p_name) AS question FROM (SELECT DISTINCT p_name FROM part), (VALUES " + ", ".join(f"('{k}', '{q}')" for k, q in themes.ANGLES.items()) + ") a(angle, q)")
def theme_angles(t):
    return themes.angles(t.part.select(F.col("p_name").alias("topic")).distinct())


@query("SELECT conv_id, turn, n::BIGINT AS n, n BETWEEN 1 AND 5 AS known FROM (SELECT conv_id, turn, unnest(range(0, turn + 1)) AS n FROM conversations WHERE role = 'assistant')")
def citation_links(t):
    """[n] in an answer, and whether the answer has a source of that rank."""
    a = t.conversations.where("role = 'assistant'")
    marked = F.concat("text", F.array_join(F.transform(F.sequence(F.lit(0), F.col("turn").cast("int")), lambda i: F.concat(F.lit(" [["), i.cast("string"), F.lit("]]"))), ""))
    n = a.select("conv_id", "turn", F.explode(F.regexp_extract_all(marked, F.lit(r"\[\[(\d+)\]\]"), F.lit(1)).cast("array<bigint>")).alias("n"))
    sources = t.spark.range(1, 6).withColumnRenamed("id", "rank")
    return n.join(F.broadcast(sources), F.col("n") == F.col("rank"), "left").select("conv_id", "turn", "n", F.col("rank").isNotNull().alias("known"))


@query("SELECT item_id, '[' || (item_id + 1) || '] ' || text AS block, sum(length(text)) OVER (PARTITION BY item_id // 8 ORDER BY item_id)::BIGINT AS upto FROM benchmark")
def prompt_blocks(t):
    """Numbered sources, and how long a question's sources are up to each; eight items are those of one question."""
    b = t.benchmark
    upto = F.sum(F.length("text")).over(W.partitionBy(F.floor(F.col("item_id") / 8)).orderBy("item_id"))
    return b.select("item_id", F.concat(F.lit("["), (F.col("item_id") + 1).cast("string"), F.lit("] "), "text").alias("block"), upto.cast("long").alias("upto"))


@query("SELECT conv_id, sum(ceil(length(text) / 4.0))::BIGINT AS tokens, count(*) FILTER (role = 'user') AS asked, sum(ceil(length(text) / 4.0)) > 12902 AS shed FROM conversations GROUP BY conv_id")
def prompt_meta(t):
    n = F.sum(tx.estimate_tokens(F.col("text")))
    return t.conversations.groupBy("conv_id").agg(n.alias("tokens"), F.count_if(F.col("role") == "user").alias("asked"), (n > int((16384 - 2048) * 0.9)).alias("shed"))


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 300")
def log_tail(t):
    return t.events.select("event_id", "event_type").orderBy(F.desc("event_id")).limit(300)


# -------------------------------------------------------------- citations

FIND_SQL = f"""st AS (SELECT doc_id, {chapter_sql('label')} AS s FROM {CHAPTERS_SQL}), lb AS (SELECT doc_id AS pos, (doc_id + 7) // 20 AS src, {chapter_sql('label')} AS l FROM {CHAPTERS_SQL}),
  c AS (SELECT st.doc_id, lb.pos, s, l, list_distinct(list_filter(string_split(s, ' '), lambda w: length(w) >= 3)) AS a, list_distinct(list_filter(string_split(l, ' '), lambda w: length(w) >= 3)) AS b FROM st JOIN lb ON st.doc_id // 20 = lb.src),
  d AS (SELECT *, len(list_intersect(a, b)) AS k FROM c), e AS (SELECT *, k / greatest(len(a) + len(b) - k, 1) AS sc FROM d),
  f AS (SELECT doc_id, pos, CASE WHEN s = '' THEN NULL WHEN s = l THEN 1 WHEN length(s) >= 6 AND length(l) >= 6 AND (contains(l, s) OR contains(s, l)) THEN 2 WHEN len(a) >= 2 AND k >= 2 AND sc >= 0.6 THEN 3 END AS tier, sc FROM e)"""


@query(f"WITH {FIND_SQL} SELECT doc_id, arg_min(pos, (tier, -round(CASE WHEN tier = 3 THEN sc ELSE 0 END, 9), pos)) AS pos, min(tier) AS tier FROM f WHERE tier IS NOT NULL GROUP BY doc_id")
def find_label(t):
    """The label of a table of contents that a stored chapter means; here tables of contents have 20 labels each."""
    labels = _labels(t).select("doc_id", tx.norm_chapter(F.col("label")).alias("l"))
    stored = labels.select("doc_id", F.col("l").alias("s"), F.floor(F.col("doc_id") / 20).alias("src"))
    toc = labels.select(F.col("doc_id").alias("pos"), "l", F.floor((F.col("doc_id") + 7) / 20).alias("src"))
    tier, score = citations.label_tier(F.col("s"), F.col("l"))
    pairs = stored.join(toc, "src").select("doc_id", "pos", tier.alias("tier"), score.alias("score")).where("tier IS NOT NULL")
    return pairs.groupBy("doc_id").agg(F.min(F.struct("tier", -F.col("score"), "pos")).alias("m")).select("doc_id", "m.pos", "m.tier")


CITE_SQL = f"""pr AS (SELECT doc_id, lower(probe) AS probe FROM {PROBE_SQL}), bk AS (SELECT doc_id, lower(trim(regexp_replace(regexp_replace(text, '([0-9A-Za-z_])-\\s+([0-9A-Za-z_])', '\\1\\2', 'g'), '\\s+', ' ', 'g'))) AS a FROM documents),
  x AS (SELECT bk.doc_id, probe, a, CASE doc_id % 4 WHEN 0 THEN NULL ELSE 'ch' END AS chapter, CASE doc_id % 4 WHEN 1 THEN a WHEN 2 THEN 'elsewhere' END AS run, CASE WHEN doc_id % 5 = 0 THEN 'cut ' || a[1:10] ELSE a END AS whole FROM bk JOIN pr USING (doc_id)),
  kb AS (SELECT doc_id, CASE WHEN probe = '' THEN 'cold miss' WHEN chapter IS NULL THEN CASE WHEN contains(whole, probe) THEN 'chapterless located' ELSE 'chapterless miss' END WHEN run IS NULL THEN CASE WHEN contains(whole, probe) THEN 'located' ELSE 'cold miss' END
    WHEN contains(run, probe) THEN 'direct' WHEN contains(whole, probe) THEN 'located' ELSE 'miss in chapter' END AS outcome FROM x),
  kp AS (SELECT doc_id, CASE WHEN probe = '' THEN 'cold miss' WHEN doc_id % 4 = 0 THEN CASE WHEN contains(whole, probe) THEN 'chapterless located' ELSE 'chapterless miss' END WHEN doc_id % 4 = 1 AND contains(a, probe) THEN 'direct' WHEN doc_id % 4 = 2 AND contains(a, probe) THEN 'near' WHEN contains(whole, probe) THEN 'located' ELSE 'miss in chapter' END AS outcome FROM x)"""


def _cited(t: Library):
    """Documents as books of one chapter; stored labels and pages that fit, are off by one, or lead nowhere, in turn."""
    whole = F.lower(tx.norm_text(F.col("text")))
    d = t.documents.select("doc_id", F.lower(tx.probe_of(F.col("text"))).alias("probe"), whole.alias("a"))
    k = F.col("doc_id") % 4
    d = d.withColumn("chapter", F.when(k != 0, "ch")).withColumn("run", F.when(k == 1, F.col("a")).when(k == 2, "elsewhere"))
    return d.withColumn("whole", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("cut "), F.substring("a", 1, 10))).otherwise(F.col("a")))


def _book_outcomes(t: Library):
    return _cited(t).select("doc_id", citations.classify_book(F.col("chapter"), F.col("probe"), F.col("run"), F.col("whole")).alias("outcome"))


def _pdf_outcomes(t: Library):
    k = F.col("doc_id") % 4
    on, near = F.when(k == 1, F.col("a")), F.when(k == 2, F.col("a"))
    return _cited(t).select("doc_id", citations.classify_pdf(F.when(k != 0, F.lit(3)), F.col("probe"), on, near, F.col("whole")).alias("outcome"))


@query(f"WITH {CITE_SQL} SELECT * FROM kb")
def classify_book(t):
    return _book_outcomes(t)


@query(f"WITH {CITE_SQL} SELECT * FROM kp")
def classify_pdf(t):
    return _pdf_outcomes(t)


TALLY_SQL = "SELECT family, lang, outcome, n, round(100.0 * n / sum(n) OVER (PARTITION BY family, lang), 6)::DOUBLE AS percent FROM (SELECT family, lang, outcome, count(*) AS n FROM o JOIN documents USING (doc_id) GROUP BY ALL)"


@query(f"WITH {CITE_SQL}, o AS (SELECT 'book' AS family, * FROM kb UNION ALL SELECT 'pdf', * FROM kp) {TALLY_SQL}")
def cite_tally(t):
    o = _book_outcomes(t).withColumn("family", F.lit("book")).unionByName(_pdf_outcomes(t).withColumn("family", F.lit("pdf")))
    n = o.join(t.documents.select("doc_id", "lang"), "doc_id").groupBy("family", "lang", "outcome").agg(F.count("*").alias("n"))
    return n.withColumn("percent", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(W.partitionBy("family", "lang")), 6))


LADDER_SQL = f"""{PAGES_SQL}, c0 AS (SELECT doc_id, min(page) AS p FROM pl WHERE page >= 2 OR doc_id % 2 = 0 GROUP BY doc_id), pr AS (SELECT c0.doc_id, p, string_split(trim(regexp_replace(pl.text, '\\s+', ' ', 'g')), ' ')[6:13] AS w FROM c0 JOIN pl ON c0.doc_id = pl.doc_id AND c0.p = pl.page),
  ct AS (SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN p + 1 WHEN 2 THEN p - 1 WHEN 3 THEN p + 7 ELSE p END AS page, CASE WHEN doc_id % 5 = 4 THEN list_concat(w[1:4], ['nowhere']) ELSE w END AS w FROM pr),
  rx AS (SELECT doc_id, page, array_to_string(list_transform(w, lambda x: regexp_escape(x)), '\\s*') AS whole, CASE WHEN len(w) > 4 THEN array_to_string(list_transform(w[1:4], lambda x: regexp_escape(x)), '\\s*') END AS short FROM ct WHERE len(w) > 0),
  hit AS (SELECT rx.doc_id, CASE WHEN pl.page = rx.page AND regexp_matches(pl.text, whole, 'i') THEN 1 WHEN pl.page = rx.page - 1 AND regexp_matches(pl.text, whole, 'i') THEN 2 WHEN pl.page = rx.page + 1 AND regexp_matches(pl.text, whole, 'i') THEN 3 WHEN pl.page = rx.page AND short IS NOT NULL AND regexp_matches(pl.text, short, 'i') THEN 4 END AS rung, pl.page FROM rx JOIN pl ON rx.doc_id = pl.doc_id AND abs(pl.page - rx.page) <= 1)"""


@query(f"WITH {LADDER_SQL} SELECT ct.doc_id, coalesce(['page', 'page before', 'page behind', 'prefix'][m.rung], 'none') AS rung, m.page FROM ct LEFT JOIN (SELECT doc_id, min(rung) AS rung, arg_min(page, rung) AS page FROM hit WHERE rung IS NOT NULL GROUP BY doc_id) m USING (doc_id)")
def pdf_ladder(t):
    """The reader's ladder over files of pages: the cited page, the one before, the one behind, then the first words on the cited one.

    Citations are right, one page off either way, far off, or right with other words at their end.
    """
    pages = _pages(t)
    first = pages.where((F.col("page") >= 2) | (F.col("doc_id") % 2 == 0)).groupBy("doc_id").agg(F.min("page").alias("page"))
    words = F.slice(F.split(tx.one_line(F.col("text")), " "), 6, 8)
    k = F.col("doc_id") % 5
    off = F.when(k == 1, F.col("page") + 1).when(k == 2, F.col("page") - 1).when(k == 3, F.col("page") + 7).otherwise(F.col("page"))
    said = F.when(k == 4, F.concat(F.slice("w", 1, 4), F.array(F.lit("nowhere")))).otherwise(F.col("w"))
    cites = pages.join(first, ["doc_id", "page"]).withColumn("w", words).select(F.col("doc_id").alias("id"), F.col("doc_id").alias("path"), off.alias("page"), said.alias("words"))
    return citations.ladder(cites, pages.withColumnRenamed("doc_id", "path")).select(F.col("id").alias("doc_id"), "rung", F.col("found").alias("page"))


# ------------------------------------------------------ relational checks


def _join(kind: str, sql: str) -> None:
    @query(f"SELECT c_custkey, o_orderkey FROM customer {sql} JOIN orders ON c_custkey = o_custkey", f"join_{kind}")
    def joined(t):
        c, o = t.customer, t.orders
        return c.join(o, c.c_custkey == o.o_custkey, kind).select("c_custkey", "o_orderkey")


for _kind in ("inner", "left", "full"):
    _join(_kind, _kind)


@query("SELECT c_custkey FROM customer SEMI JOIN (SELECT o_custkey AS c_custkey FROM orders WHERE o_totalprice > 200000) USING (c_custkey)")
def join_semi(t):
    return t.customer.join(t.orders.where("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer ANTI JOIN (SELECT o_custkey AS c_custkey FROM orders WHERE o_totalprice > 200000) USING (c_custkey)")
def join_anti(t):
    return t.customer.join(t.orders.where("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT n_name, r_name FROM nation, region")
def join_cross(t):
    return t.nation.select("n_name").crossJoin(F.broadcast(t.region.select("r_name")))


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
def intersect_ids(t):
    return t.customer.select(F.col("c_custkey").alias("k")).intersect(t.orders.select("o_custkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def except_ids(t):
    return t.customer.select(F.col("c_custkey").alias("k")).subtract(t.orders.select("o_custkey"))


# ----------------------------------------------------------- time windows


@query("SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) // 1000000 AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_counts(t):
    return t.events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(seconds(F.col("w.start")).alias("start"), "event_type", "n")


@query("SELECT s AS start, count(*) AS n FROM (SELECT unnest([epoch_us(ts) // 1000000 // 1800 * 1800, epoch_us(ts) // 1000000 // 1800 * 1800 - 1800]) AS s FROM events) GROUP BY s")
def sliding_counts(t):
    return t.events.groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select(seconds(F.col("w.start")).alias("start"), "n")


@query("WITH o AS (SELECT user_id, epoch_us(ts) AS u, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), s AS (SELECT *, sum((p IS NULL OR u - p >= 1800000000)::INT) OVER (PARTITION BY user_id ORDER BY u) AS k FROM o) SELECT user_id, min(u) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def session_windows(t):
    s = t.events.groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", micros(F.col("w.start")).alias("start"), "n")


@query("WITH o AS (SELECT event_id, epoch_us(ts) AS u, user_id, max(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM events) SELECT user_id, count(*) AS n, count(*) FILTER (u < seen - 600000000) AS late FROM o GROUP BY user_id")
def late_drop(t):
    """Each user's events behind a watermark of ten minutes, as they arrive in order of id."""
    seen = F.max(micros(F.col("ts"))).over(W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, -1))
    e = t.events.withColumn("seen", seen)
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(micros(F.col("ts")) < F.col("seen") - 600000000).alias("late"))
