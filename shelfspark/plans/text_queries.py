"""Scalar functions and row generators over documents, paths and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import formats as fm
from ..functions import text as tx
from ..operators import scans
from .registry import Library, query

EXT_SQL = f"nullif(regexp_extract(lower(regexp_extract(path, '([^/\\\\]*)$', 1)), '^.+?\\.({fm.EXT_PATTERN})$', 1, 's'), '')"
FAMILY_SQL = "CASE " + EXT_SQL + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fm.FAMILY.items()) + " END"
MIXED_SQL = "(SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN path WHEN 1 THEN upper(path) WHEN 2 THEN replace(path, '/', '\\') || '.pdf.txt' ELSE path || '.gz' END AS path FROM fx_books)"


def _mixed(t: Library) -> DataFrame:
    b = t.fx_books
    k = F.col("doc_id") % 4
    path = F.when(k == 0, F.col("path")).when(k == 1, F.upper("path")).when(k == 2, F.concat(F.translate("path", "/", "\\"), F.lit(".pdf.txt"))).otherwise(F.concat("path", F.lit(".gz")))
    return b.select("doc_id", path.alias("path"))


@query(f"SELECT doc_id, {EXT_SQL} AS ext FROM {MIXED_SQL}")
def ext_of(t):
    return _mixed(t).select("doc_id", fm.ext_of(F.col("path")).alias("ext"))


@query(f"SELECT doc_id, {FAMILY_SQL} AS family FROM {MIXED_SQL}")
def format_family(t):
    return _mixed(t).select("doc_id", fm.family(fm.ext_of(F.col("path"))).alias("family"))


@query("SELECT path, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '') AS title, substr(sha1(path), 1, 16) AS book_id FROM fx_books")
def title_of(t):
    return t.fx_books.select("path", fm.title_of(F.col("path")).alias("title"), fm.book_id(F.col("path")).alias("book_id"))


@query("SELECT doc_id, path, substr(sha1(path), 1, 16) AS book_id FROM fx_books")
def book_id(t):
    return t.fx_books.select("doc_id", "path", fm.book_id(F.col("path")).alias("book_id"))


@query("SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'missing' ELSE n_chars || ':' || (1700000000 + doc_id) END AS fp FROM documents")
def fingerprint(t):
    d = t.documents
    return d.select("doc_id", fm.fingerprint(F.when(F.col("doc_id") % 50 != 0, F.col("n_chars")), F.when(F.col("doc_id") % 50 != 0, F.col("doc_id") + 1700000000)).alias("fp"))


@query("""SELECT doc_id, printf('%x', length(text)) || ':' || sha256(length(text) || '|' || text[1:1024] || CASE WHEN length(text) > 2048 THEN text[-1024:] ELSE '' END) AS csig FROM documents""")
def content_sig(t):
    """Length, first part, and last part if the text is longer than both."""
    n = F.length("text")
    tail = F.when(n > 2048, F.substring(F.col("text"), n - 1023, F.lit(1024))).otherwise(F.lit(""))
    body = F.concat(n.cast("string"), F.lit("|"), F.substring("text", 1, 1024), tail)
    return t.documents.select("doc_id", F.concat(F.lower(F.hex(n)), F.lit(":"), F.sha2(body.cast("binary"), 256)).alias("csig"))


@query("SELECT source, substr(sha256(string_agg(lang || chr(0), '' ORDER BY lang)), 1, 16) AS caps FROM (SELECT DISTINCT source, lang FROM documents) GROUP BY source")
def caps_hash(t):
    """The version of what a source can do, its languages standing for the capabilities."""
    return t.documents.groupBy("source").agg(fm.caps_version(F.collect_set("lang")).alias("caps"))


SPACED_SQL = "(SELECT doc_id, ' ' || replace(replace(text, 'th ', 'th-' || chr(10)), '. ', '.  ' || chr(9) || chr(10) || chr(10) || chr(10) || chr(10)) AS text FROM documents)"


def _spaced(t: Library) -> DataFrame:
    return t.documents.select("doc_id", F.concat(F.lit(" "), F.replace(F.replace("text", F.lit("th "), F.lit("th-\n")), F.lit(". "), F.lit(".  \t\n\n\n\n"))).alias("text"))


@query(f"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '([\\pL\\pN_])-\\n([\\pL\\pN_])', '\\1\\2', 'g'), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM {SPACED_SQL}")
def clean_text(t):
    return _spaced(t).select("doc_id", tx.clean_text(F.col("text")).alias("text"))


NORM_SQL = "trim(regexp_replace(regexp_replace(text, '([0-9A-Za-z_])-\\s+([0-9A-Za-z_])', '\\1\\2', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT doc_id, {NORM_SQL} AS text FROM {SPACED_SQL}")
def norm_text(t):
    return _spaced(t).select("doc_id", tx.norm_text(F.col("text")).alias("text"))


CHAPTERS_SQL = "(SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Chapter ' || doc_id || ': ' WHEN 1 THEN 'Part IV. ' WHEN 2 THEN doc_id || '.2 — ' WHEN 3 THEN 'xii. ' WHEN 4 THEN 'Глава 3 ' ELSE '' END || string_split(text, chr(10))[1] AS label FROM documents)"


def _labels(t: Library) -> DataFrame:
    k, d = F.col("doc_id") % 6, F.col("doc_id").cast("string")
    head = F.when(k == 0, F.concat(F.lit("Chapter "), d, F.lit(": "))).when(k == 1, "Part IV. ").when(k == 2, F.concat(d, F.lit(".2 — "))).when(k == 3, "xii. ").when(k == 4, "Глава 3 ").otherwise("")
    return t.documents.select("doc_id", F.concat(head, F.split("text", "\n")[0]).alias("label"))


def chapter_sql(c: str) -> str:
    n = NORM_SQL.replace("text", c)
    return f"lower(regexp_replace(regexp_replace(regexp_replace({n}, '^(?:chapter|глава|часть|part)\\s+(?:\\d+|[ivxlcdm]+)\\.?:?\\s+', '', 'i'), '^[\\d.]+\\s*[.:—-]?\\s*', ''), '^[ivxlcdm]+\\.\\s+', '', 'i'))"


@query(f"SELECT doc_id, {chapter_sql('label')} AS label FROM {CHAPTERS_SQL}")
def norm_chapter(t):
    return _labels(t).select("doc_id", tx.norm_chapter(F.col("label")).alias("label"))


PROBE_SQL = f"""(SELECT doc_id, array_to_string(w[coalesce(list_min(list_filter(range(1, greatest(len(w) - 6, 1)), lambda i: len(list_filter(w[i:i + 7], lambda x: length(regexp_replace(x, '\\PL', '', 'g')) < 2)) = 0)), 1):][1:8], ' ') AS probe
  FROM (SELECT doc_id, string_split({NORM_SQL}, ' ') AS w FROM documents))"""


@query(f"SELECT doc_id, probe FROM {PROBE_SQL}")
def probe_of(t):
    return t.documents.select("doc_id", tx.probe_of(F.col("text")).alias("probe"))


@query("SELECT doc_id, regexp_replace('a [1] b [2, 3] [x] [ ] ' || text || '[' || doc_id || ']', '\\[[0-9, ]*[0-9][0-9, ]*\\]', '', 'g') AS text FROM documents")
def strip_markers(t):
    s = F.concat(F.lit("a [1] b [2, 3] [x] [ ] "), "text", F.lit("["), F.col("doc_id").cast("string"), F.lit("]"))
    return t.documents.select("doc_id", tx.strip_markers(s).alias("text"))


@query("SELECT doc_id, CASE WHEN length(l) > 80 THEN l[1:80] || '…' ELSE l END AS line FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS l FROM documents)")
def one_line(t):
    return t.documents.select("doc_id", tx.truncated(tx.one_line(F.col("text")), 80).alias("line"))


@query("SELECT conv_id, turn, ceil(length(text) / 4.0)::BIGINT AS tokens FROM conversations")
def estimate_tokens(t):
    return t.conversations.select("conv_id", "turn", tx.estimate_tokens(F.col("text")).alias("tokens"))


QUESTION_SQL = "(SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'Why, ' || text WHEN 1 THEN text ELSE role END AS q, (conv_id % 100) / 100.0::DOUBLE AS cosine FROM conversations)"
PRONOUN_SQL = "lower(regexp_replace(coalesce(w[1], ''), '^[^\\pL\\pN]+|[^\\pL\\pN]+$', '', 'g')) IN ('" + "', '".join(tx.PRONOUNS) + "')"


def _questions(t: Library) -> DataFrame:
    k = F.col("turn") % 3
    q = F.when(k == 0, F.concat(F.lit("Why, "), "text")).when(k == 1, F.col("text")).otherwise(F.col("role"))
    return t.conversations.select("conv_id", "turn", q.alias("q"), ((F.col("conv_id") % 100) / 100.0).alias("cosine"))


@query(f"SELECT conv_id, turn, {PRONOUN_SQL} AS led FROM (SELECT *, list_filter(regexp_split_to_array(q, '\\s+'), lambda x: x <> '') AS w FROM {QUESTION_SQL})")
def pronoun_led(t):
    return _questions(t).select("conv_id", "turn", tx.pronoun_led(F.col("q")).alias("led"))


@query(f"SELECT conv_id, turn, CASE WHEN len(w) = 0 THEN false WHEN len(w) <= 3 THEN true WHEN len(w) <= 12 AND {PRONOUN_SQL} THEN true ELSE cosine >= 0.33 END AS fuse FROM (SELECT *, list_filter(regexp_split_to_array(q, '\\s+'), lambda x: x <> '') AS w FROM {QUESTION_SQL})")
def fuse_gate(t):
    return _questions(t).select("conv_id", "turn", tx.fuse_followup(F.col("q"), F.col("cosine")).alias("fuse"))


ASK_SQL = "(SELECT conv_id, turn, CASE conv_id % 5 WHEN 0 THEN 'Give an overview of ' WHEN 1 THEN 'Summarize CHAPTER 3 of ' WHEN 2 THEN 'The gist of ' WHEN 3 THEN 'Key takeaways? ' ELSE '' END || text AS q FROM conversations)"
_any = lambda c, ws: "(" + " OR ".join(f"contains({c}, '{w.replace(chr(39), chr(39) * 2)}')" for w in ws) + ")"


@query(f"SELECT conv_id, turn, NOT {_any('lower(q)', tx.LOCAL_ASKS)} AND {_any('lower(q)', tx.WHOLE_ASKS)} AS whole FROM {ASK_SQL}")
def aggregative(t):
    k = F.col("conv_id") % 5
    head = F.when(k == 0, "Give an overview of ").when(k == 1, "Summarize CHAPTER 3 of ").when(k == 2, "The gist of ").when(k == 3, "Key takeaways? ").otherwise("")
    return t.conversations.select("conv_id", "turn", tx.is_aggregative(F.concat(head, "text")).alias("whole"))


@query("SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(translate(lower(title || '_MEAP (' || doc_id || ') v7 b2b'), '_-.():,/', '        '), '\\s+'), lambda w: w NOT IN ('meap', 'edition', 'final', '') AND NOT regexp_matches(w, '^[0-9]+$') AND NOT regexp_matches(w, '^[vb][0-9]+$')), ' ') AS title FROM fx_chunks")
def normalize_title(t):
    raw = F.concat("title", F.lit("_MEAP ("), F.col("doc_id").cast("string"), F.lit(") v7 b2b"))
    return t.fx_chunks.select("doc_id", tx.normalize_title(raw).alias("title"))


SLUG_SQL = "CASE WHEN s = '' THEN 'artifact' ELSE s END"
SLUGS_SQL = "(SELECT *, trim(lower(trim(regexp_replace(q, '[^0-9A-Za-z]+', '-', 'g'), '-'))[1:60], '-') AS s FROM (SELECT item_id, '«' || text AS q FROM benchmark))"


@query(f"SELECT item_id, {SLUG_SQL} AS slug FROM {SLUGS_SQL}")
def slugify(t):
    return t.benchmark.select("item_id", tx.slugify(F.concat(F.lit("«"), "text")).alias("slug"))


@query("""SELECT slug || CASE WHEN n > 1 THEN '-' || n ELSE '' END || '.md' AS file, doc_id FROM (
  SELECT doc_id, slug, row_number() OVER (PARTITION BY slug ORDER BY doc_id) AS n FROM (
    SELECT doc_id, trim(lower(trim(regexp_replace(title, '[^0-9A-Za-z]+', '-', 'g'), '-'))[1:60], '-') AS slug FROM fx_chunks))""")
def artifact_slug(t):
    s = t.fx_chunks.select("doc_id", tx.slugify(F.col("title")).alias("slug"))
    n = F.row_number().over(W.partitionBy("slug").orderBy("doc_id"))
    return s.select(F.concat("slug", F.when(n > 1, F.concat(F.lit("-"), n.cast("string"))).otherwise(F.lit("")), F.lit(".md")).alias("file"), "doc_id")


@query("""SELECT conv_id, '---' || chr(10) || 'title: "' || replace(replace(trim(max(CASE WHEN turn = 0 THEN text END)), '\\', '\\\\'), '"', '\\"') || '"' || chr(10) || 'sources: []' || chr(10) || '---' || chr(10) || chr(10)
  || '# ' || trim(max(CASE WHEN turn = 0 THEN text END)) || chr(10) || chr(10) || coalesce(string_agg(CASE WHEN role = 'assistant' THEN trim(text) END, chr(10) ORDER BY turn), '') || chr(10) || chr(10) || '## Sources' || chr(10) || chr(10) || '_No sources retrieved._' || chr(10) AS body
  FROM conversations GROUP BY conv_id""")
def artifact_md(t):
    c = t.conversations
    first = F.trim(F.max(F.when(F.col("turn") == 0, F.col("text"))))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", F.trim("text").alias("text"))))), lambda x: x["text"]), "\n")
    g = c.groupBy("conv_id").agg(first.alias("q"), said.alias("a"))
    body = F.concat(F.lit("---\ntitle: "), tx.yaml_quote(F.col("q")), F.lit("\nsources: []\n---\n\n# "), "q", F.lit("\n\n"), "a", F.lit("\n\n## Sources\n\n_No sources retrieved._\n"))
    return g.select("conv_id", body.alias("body"))


@query(f"SELECT model, NOT {_any('lower(model)', tx.NO_CHAT)} AS chat FROM (SELECT p_partkey, p_name || CASE p_partkey % 4 WHEN 0 THEN '-Embed' WHEN 1 THEN ' whisper' ELSE '' END AS model FROM part)")
def chat_model(t):
    k = F.col("p_partkey") % 4
    m = t.part.select(F.concat("p_name", F.when(k == 0, "-Embed").when(k == 1, " whisper").otherwise("")).alias("model"))
    return m.select("model", tx.is_chat_model(F.col("model")).alias("chat"))


@query("""SELECT doc_id, title || CASE WHEN author <> '' THEN ' — ' || author ELSE '' END || CASE WHEN w = '' THEN '' ELSE ' · ' || w END AS citation FROM (
  SELECT *, concat_ws(', ', CASE WHEN chapter <> '' THEN 'Ch. ' || chapter END, CASE WHEN format = 'pdf' AND page >= 0 THEN 'p.' || page WHEN chapter = '' THEN '~loc ' || loc_start END) AS w FROM fx_chunks)""")
def citation(t):
    c = t.fx_chunks
    none = lambda n: F.nullif(F.col(n), F.lit(""))
    page = F.when(F.col("page") >= 0, F.col("page"))
    return c.select("doc_id", tx.citation(F.col("title"), none("author"), none("chapter"), page, fm.family(F.col("format")), F.col("loc_start")).alias("citation"))


@query("SELECT a.item_id AS a, b.item_id AS b, levenshtein(regexp_replace(a.text, '[^ -~]', '?', 'g'), regexp_replace(b.text, '[^ -~]', '?', 'g'))::BIGINT AS d FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1")
def edit_distance(t):
    a, b = t.benchmark.alias("a"), t.benchmark.alias("b")
    plain = lambda c: F.regexp_replace(c, "[^ -~]", "?")  # noqa: E731  SQL counts bytes
    d = F.levenshtein(plain("a.text"), plain("b.text")).cast("long")
    return a.join(b, F.col("b.item_id") == F.col("a.item_id") + 1).select(F.col("a.item_id").alias("a"), F.col("b.item_id").alias("b"), d.alias("d"))


@query("""SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)), 6) AS cosine
  FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) a JOIN (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) b ON b.vec_id = a.vec_id + 1""")
def cosine_pairs(t):
    a, b = t.embeddings.alias("a"), t.embeddings.alias("b")
    return a.join(b, F.col("b.vec_id") == F.col("a.vec_id") + 1).select(F.col("a.vec_id").alias("a"), F.col("b.vec_id").alias("b"), F.round(tx.cosine(F.col("a.embedding"), F.col("b.embedding")), 6).alias("cosine"))


@query("SELECT vec_id, i - 1 AS pos, round(v[i] / n, 6) AS value FROM (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n, unnest(range(1, len(v) + 1)) AS i FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * 3) AS v FROM embeddings))")
def l2_normalize(t):
    v = t.embeddings.withColumn("v", tx.l2_normalize(F.transform("embedding", lambda x: x.cast("double") * 3)))
    return v.select("vec_id", F.posexplode("v").alias("pos", "value")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"))


@query("SELECT event_id, round(1.0 / (1.0 + exp(-value / 10)), 9) AS p FROM events")
def sigmoid(t):
    return t.events.select("event_id", F.round(tx.sigmoid(F.col("value") / 10), 9).alias("p"))


@query("""SELECT doc_id, CASE WHEN ext = 'pdf' THEN 'pdf' WHEN ext IN ('md', 'markdown', 'txt') THEN 'text' WHEN ext IN ('html', 'docx', 'pages') THEN 'unverified' WHEN ext = 'mobi' THEN 'book-unverifiable' ELSE 'book' END AS family,
  CASE WHEN doc_id % 9 = 0 THEN 'ru' ELSE 'en' END AS script FROM fx_books""")
def strata(t):
    title = F.when(F.col("doc_id") % 9 == 0, "Чистый Python").otherwise(F.concat(F.lit("Effective "), "source"))
    return t.fx_books.select("doc_id", fm.render_family(F.col("ext")).alias("family"), tx.script_of(title).alias("script"))


LINES_SQL = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)"


def _lines(t: Library) -> DataFrame:
    return t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))


@query(f"SELECT line, count(*) AS n FROM (SELECT regexp_replace(lower(trim(regexp_replace(line, '\\s+', ' ', 'g'))), '[0-9]+', '#', 'g') AS line FROM {LINES_SQL}) GROUP BY line")
def line_norm(t):
    return _lines(t).groupBy(tx.line_norm(F.col("line")).alias("line")).agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, count(*) FILTER (regexp_matches(trim(regexp_replace(line, '\\s+', ' ', 'g')), '^[0-9\\s.·—–|-]*$')) AS noise FROM {LINES_SQL} GROUP BY doc_id")
def noise_line(t):
    return _lines(t).groupBy("doc_id").agg(F.count_if(tx.is_noise_line(F.col("line"))).alias("noise"))


@query("""SELECT doc_id, CASE WHEN len(w) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(w, lambda x: regexp_matches(x, '[Ѐ-ӿ]') AND regexp_matches(x, '[A-Za-z]'))) / len(w) END AS mix
  FROM (SELECT doc_id, list_filter(regexp_split_to_array(CASE WHEN doc_id % 3 = 0 THEN replace(text, 'a', 'а') ELSE text END, '\\s+'), lambda x: length(x) >= 3) AS w FROM documents)""")
def script_mix(t):
    """In every third text a Cyrillic letter stands for the Latin one that looks like it."""
    text = F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit("a"), F.lit("а"))).otherwise(F.col("text"))
    return t.documents.select("doc_id", tx.script_mix(text).alias("mix"))


@query("SELECT item_id, round(levenshtein(lower(a), lower(b)) / greatest(length(a), 1), 9) AS cer FROM (SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS a, trim(regexp_replace(replace(text, 'th', 'tb'), '\\s+', ' ', 'g')) AS b FROM benchmark)")
def cer(t):
    return t.benchmark.select("item_id", F.round(tx.cer(F.col("text"), F.replace("text", F.lit("th"), F.lit("tb"))), 9).alias("cer"))


@query("""SELECT item_id, round(CASE WHEN len(a) = 0 THEN 1.0 ELSE len(list_filter(a, lambda x: list_contains(b, x))) / len(a) END, 9) AS recall FROM (
  SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\pL\\pN_]+'), lambda x: length(x) >= 4) AS a, list_filter(regexp_split_to_array(lower(replace(text, 'on', 'om')), '[^\\pL\\pN_]+'), lambda x: length(x) >= 4) AS b FROM benchmark)""")
def word_recall(t):
    return t.benchmark.select("item_id", F.round(tx.word_recall(F.col("text"), F.replace("text", F.lit("on"), F.lit("om"))), 9).alias("recall"))


@query("SELECT letter, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(upper(trim(text)[1:1]), '^[A-Z]$') THEN upper(trim(text)[1:1]) ELSE '#' END AS letter FROM documents) GROUP BY letter")
def group_letter(t):
    return t.documents.groupBy(tx.group_letter(F.col("text")).alias("letter")).agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad((s // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') ELSE (s // 60) || ':' || lpad((s % 60)::VARCHAR, 2, '0') END AS text FROM (SELECT event_id, event_id * 37 % 9000 AS s FROM events)")
def format_duration(t):
    return t.events.select("event_id", tx.duration(F.col("event_id") * 37 % 9000).alias("text"))


@query("SELECT event_id, regexp_replace(regexp_extract('so: ' || chr(9) || '[{\"a\": ' || event_id || chr(10) || '}, 2] done', '(\\[.*\\])', 1, 's'), '[\\x00-\\x1f]', ' ', 'g') AS json FROM events")
def json_salvage(t):
    raw = F.concat(F.lit('so: \t[{"a": '), F.col("event_id").cast("string"), F.lit("\n}, 2] done"))
    return t.events.select("event_id", tx.json_array(raw).alias("json"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'skip' WHEN 1 THEN 'book' ELSE 'other' END AS kind, CASE WHEN event_id % 3 = 1 THEN 'T: ' || event_type END AS title, CASE WHEN event_id % 3 = 1 THEN event_id % 7 END AS chunks, CASE WHEN event_id % 3 = 0 THEN '/lib/' || event_id || '.pdf' END AS path FROM events")
def parse_progress(t):
    s = F.col("event_id")
    line = F.when(s % 3 == 0, F.format_string("[%d/40] skip (no extractable text) /lib/%d.pdf", s % 40, s)).when(s % 3 == 1, F.format_string("[%d/40] T: %s: %d chunks ", s % 40, F.col("event_type"), s % 7)).otherwise("loading the model")
    return t.events.select("event_id", tx.progress_line(line).alias("x")).select("event_id", "x.*")


@query("""SELECT event_id, CASE WHEN k < 3 THEN event_type END AS content, CASE WHEN k < 3 AND event_id % 5 = 0 THEN 'so' END AS reasoning, CASE WHEN k IN (0, 3) THEN event_id END AS in_tokens, CASE WHEN k IN (0, 4) THEN 7::BIGINT END AS out_tokens, k IN (0, 5) AS done FROM (SELECT *, event_id % 6 AS k FROM events)""")
def parse_llm_lines(t):
    """Lines of three providers' streams: text and thought, tokens, and whether they end it."""
    k, n = F.col("event_id") % 6, F.col("event_id")
    thought = F.when(n % 5 == 0, "so")
    js = lambda *c: F.to_json(F.struct(*c))
    sse = lambda c: F.concat(F.lit("data: "), c)
    line = (
        F.when(k == 0, js(F.col("event_type").alias("response"), thought.alias("thinking"), n.alias("prompt_eval_count"), F.lit(7).alias("eval_count"), F.lit(True).alias("done")))
        .when(k == 1, sse(js(F.lit("content_block_delta").alias("type"), F.struct(F.col("event_type").alias("text"), thought.alias("thinking")).alias("delta"))))
        .when(k == 2, sse(js(F.array(F.struct(F.struct(F.col("event_type").alias("content"), thought.alias("reasoning")).alias("delta"))).alias("choices"))))
        .when(k == 3, sse(js(F.lit("message_start").alias("type"), F.struct(F.struct(n.alias("input_tokens")).alias("usage")).alias("message"))))
        .when(k == 4, sse(js(F.lit("message_delta").alias("type"), F.struct(F.lit(7).alias("output_tokens")).alias("usage"))))
        .otherwise("data: [DONE]")
    )
    provider = F.when(k == 0, "ollama").when(k.isin(1, 3, 4), "anthropic").otherwise("openai")
    return t.events.select("event_id", tx.stream_line(line, provider).alias("x")).select("event_id", "x.*")


@query("""SELECT event_id, CASE WHEN s IN (401, 403) THEN 'The key was refused, or this model cannot chat' WHEN s = 404 THEN 'The provider has no model of that name' WHEN s = 400 THEN 'The request was not accepted'
  WHEN s = 429 THEN 'Too many requests, wait a little' ELSE 'The provider failed' END || ' (' || s || ')' || CASE WHEN s = 429 THEN '' ELSE ': ' || event_type END AS error
  FROM (SELECT *, [400, 401, 403, 404, 429, 500, 503][(event_id % 7 + 1)::INT] AS s FROM events)""")
def chat_error(t):
    s = F.element_at(F.array(*map(F.lit, (400, 401, 403, 404, 429, 500, 503))), (F.col("event_id") % 7 + 1).cast("int"))
    return t.events.select("event_id", tx.chat_error(s, F.concat(F.lit(" "), "event_type")).alias("error"))


@query(f"SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN 'I couldn''t find any matching passages in the selected collection(s).' WHEN NOT {_any('lower(q)', tx.LOCAL_ASKS)} AND {_any('lower(q)', tx.WHOLE_ASKS)} THEN '{tx.WHOLE_CAVEAT.strip()}' || chr(10) || chr(10) ELSE '' END AS opening FROM {ASK_SQL}")
def answer_envelope(t):
    """What an answer opens with: the message for no hits, a caveat on whole books, or nothing."""
    k = F.col("conv_id") % 5
    head = F.when(k == 0, "Give an overview of ").when(k == 1, "Summarize CHAPTER 3 of ").when(k == 2, "The gist of ").when(k == 3, "Key takeaways? ").otherwise("")
    opening = F.when(F.col("turn") % 4 == 3, tx.NO_HITS).when(tx.is_aggregative(F.concat(head, "text")), tx.WHOLE_CAVEAT).otherwise("")
    return t.conversations.select("conv_id", "turn", opening.alias("opening"))


@query("SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'iCloud Drive' WHEN 1 THEN 'a cloud drive (File Provider)' WHEN 2 THEN 'Dropbox' WHEN 3 THEN 'pCloud' END AS provider FROM documents")
def cloud_marker(t):
    k = F.col("doc_id") % 8
    root = F.when(k == 0, "/u/Library/Mobile Documents").when(k == 1, "/u/Library/CloudStorage/x").when(k == 2, "/u/.dropbox").when(k == 3, "/pCloud").otherwise("/home")
    return t.fx_books.select("doc_id", fm.cloud_marker(F.concat(root, "path")).alias("provider"))


@query("SELECT doc_id, CASE WHEN ext = 'pages' THEN '.pages: handled by standard indexing — needs an embedded PDF preview' END AS gpu, CAST(NULL AS VARCHAR) AS cpu FROM fx_books")
def directed_skip(t):
    return t.fx_books.select("doc_id", fm.directed_skip(F.col("ext"), F.lit("gpu")).alias("gpu"), fm.directed_skip(F.col("ext"), F.lit("cpu")).alias("cpu"))


@query("SELECT doc_id, source = 'src1' OR source = 'src19' AS under FROM fx_books")
def under_roots(t):
    roots = F.array(F.lit("/lib/src1/"), F.lit("/lib/src19"), F.lit("/lib/sr"))
    return t.fx_books.select("doc_id", F.exists(roots, lambda r: fm.under_root(F.col("path"), r)).alias("under"))


@query("SELECT doc_id, text[1:500] AS head, length(text) > 500 AS truncated, length(text)::BIGINT AS total FROM documents")
def read_capped(t):
    return t.documents.select("doc_id", F.substring("text", 1, 500).alias("head"), (F.length("text") > 500).alias("truncated"), F.length("text").cast("long").alias("total"))


@query("SELECT doc_id, CASE WHEN ext = 'pages' THEN path || '.pdf' WHEN ext = 'docx' THEN path || '.html' WHEN ext = 'pdf' AND doc_id % 3 = 0 THEN path || '.ocr.pdf' ELSE path END AS shown FROM fx_books")
def display_path(t):
    """What the reader opens: a searchable copy, a converted copy, or the file itself."""
    b = t.fx_books
    ocr = b.where("ext = 'pdf' AND doc_id % 3 = 0").select(F.col("path").alias("p"), F.concat("path", F.lit(".ocr.pdf")).alias("ocr"))
    j = b.join(ocr, b.path == ocr.p, "left")
    shown = F.when(F.col("ext") == "pages", F.concat("path", F.lit(".pdf"))).when(F.col("ext").isin("docx", "rtf", "odt", "doc", "webarchive"), F.concat("path", F.lit(".html"))).otherwise(F.coalesce("ocr", "path"))
    return j.select("doc_id", shown.alias("shown"))


@query("SELECT doc_id, coalesce(CASE WHEN ext = 'pdf' AND doc_id % 3 = 0 THEN path || '.ocr.pdf' END, path) AS path FROM fx_books")
def ocr_prefer(t):
    b = t.fx_books
    cache = b.where("ext = 'pdf' AND doc_id % 3 = 0").select(F.col("doc_id").alias("d"), F.concat("path", F.lit(".ocr.pdf")).alias("copy"))
    return b.join(cache, b.doc_id == cache.d, "left").select("doc_id", F.coalesce("copy", "path").alias("path"))


@query("""WITH b AS (SELECT doc_id // 10 AS file, doc_id % 10 + 1 AS page, CASE WHEN doc_id // 10 % 2 = 0 THEN text[1:80] ELSE text[1:doc_id * 7 % 90] END AS text FROM documents WHERE doc_id % 10 < 7), n AS (SELECT DISTINCT doc_id // 10 AS file, CASE WHEN doc_id // 10 % 7 = 5 THEN 0 ELSE 9 END AS pages FROM documents),
  f AS (SELECT file, count(*) AS full_pages FROM (SELECT file, page FROM b GROUP BY file, page HAVING sum(length(text)) >= 50) JOIN n USING (file) WHERE page <= pages GROUP BY file), h AS (SELECT file, count(*) AS blocks FROM b GROUP BY file)
  SELECT file, (pages - coalesce(full_pages, 0))::BIGINT AS thin, pages::BIGINT AS pages, CASE WHEN pages = 0 THEN coalesce(blocks, 0) = 0 ELSE (pages - coalesce(full_pages, 0)) / pages >= 0.6 END AS scanned FROM n LEFT JOIN f USING (file) LEFT JOIN h USING (file)""")
def looks_scanned(t):
    """Ten documents as the pages of a file, of which some have little text and two none; the files count nine pages, or do not say."""
    file = F.floor(F.col("doc_id") / 10)
    part = F.when(file % 2 == 0, F.substring("text", 1, 80)).otherwise(F.col("text").substr(F.lit(1), (F.col("doc_id") * 7 % 90).cast("int")))
    blocks = t.documents.where("doc_id % 10 < 7").select(file.alias("file"), (F.col("doc_id") % 10 + 1).alias("page"), part.alias("text"))
    totals = t.documents.select(file.alias("file")).distinct().withColumn("pages", F.when(F.col("file") % 7 == 5, 0).otherwise(9).cast("long"))
    return scans.looks_scanned(blocks, totals, "file")


DASHED = "(SELECT doc_id, i, line FROM (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM (SELECT doc_id, string_split(replace(replace(text, 'th ', 'th-' || chr(10)), '. ', '.' || chr(10)), chr(10)) AS ls FROM documents)))"


@query(f"""WITH l AS (SELECT *, coalesce(regexp_matches(lag(line) OVER w, '\\pL-$') AND regexp_matches(line, '^\\pL'), false) AS joins FROM {DASHED} WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
  g AS (SELECT *, sum((NOT joins)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM l), e AS (SELECT *, i = max(i) OVER (PARTITION BY doc_id, g) AS final FROM g)
  SELECT doc_id, min(i) AS i, string_agg(CASE WHEN final THEN line ELSE regexp_replace(line, '-$', '') END, '' ORDER BY i) AS line FROM e GROUP BY doc_id, g""")
def dehyphenated(t):
    """Texts whose lines end in hyphens here and there, put together again."""
    text = F.replace(F.replace("text", F.lit("th "), F.lit("th-\n")), F.lit(". "), F.lit(".\n"))
    lines = t.documents.select("doc_id", F.posexplode(F.split(text, "\n")).alias("i", "line"))
    return scans.dehyphenated(lines.withColumn("i", F.col("i").cast("long")), "doc_id", "i", "line")


@query("""SELECT doc_id, h::UBIGINT::VARCHAR AS hash FROM (SELECT doc_id, list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(string_split('b' || doc_id, ''), lambda c: ascii(c)::HUGEINT)), lambda a, c: (xor(a, c) * 1099511628211) % 18446744073709551616) AS h FROM documents)""")
def fnv1a(t):
    """64-bit FNV-1a of a key. The 128-bit product is made of decimals; the exclusive or of the low byte is in plain longs."""
    prime, modulus = F.lit("1099511628211").cast("decimal(20,0)"), F.lit("18446744073709551616").cast("decimal(20,0)")
    low = lambda a: (a % F.lit(256).cast("decimal(20,0)")).cast("int")
    step = lambda a, c: (((a - low(a).cast("decimal(20,0)") + low(a).bitwiseXOR(F.ascii(c)).cast("decimal(20,0)")).cast("decimal(20,0)") * prime.cast("decimal(14,0)")).cast("decimal(38,0)") % modulus).cast("decimal(20,0)")
    key = F.concat(F.lit("b"), F.col("doc_id").cast("string"))
    h = F.aggregate(F.split(key, ""), F.lit("14695981039346656037").cast("decimal(20,0)"), step)
    return t.documents.select("doc_id", h.cast("string").alias("hash"))


# ------------------------------------------------------------- generators


@query("""WITH l AS (SELECT doc_id, i, CASE WHEN i % 5 = 3 THEN '## ' || lines[i] ELSE lines[i] END AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))),
  s AS (SELECT *, regexp_matches(line, '^#{1,2} +\\S') AS head FROM l), g AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM s)
  SELECT doc_id, sec::BIGINT AS sec, max(CASE WHEN head THEN trim(regexp_replace(line, '^#+ +', '')) END) AS heading, coalesce(string_agg(CASE WHEN NOT head THEN line END, chr(10) ORDER BY i), '') AS body FROM g GROUP BY doc_id, sec""")
def md_sections(t):
    from ..operators.sections import by_heading

    i = F.col("i")
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("i", i + 1)
    lines = lines.withColumn("line", F.when(i % 5 == 3, F.concat(F.lit("## "), "line")).otherwise(F.col("line")))
    return by_heading(lines, r"^#{1,2} +\S", r"^#+ +")


def _heading_query(name: str, mark: str, is_head: str, strip: str):
    sql = f"""WITH l AS (SELECT doc_id, i, CASE WHEN i % 4 = 2 THEN '{mark}' || lines[i] ELSE lines[i] END AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))),
      s AS (SELECT *, regexp_matches(line, '{is_head}') AS head FROM l), g AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM s)
      SELECT doc_id, sec::BIGINT AS sec, max(CASE WHEN head THEN trim(regexp_replace(line, '{strip}', '')) END) AS heading, coalesce(string_agg(CASE WHEN NOT head THEN line END, chr(10) ORDER BY i), '') AS body FROM g GROUP BY doc_id, sec"""

    @query(sql, name)
    def sections(t):
        from ..operators.sections import by_heading

        lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("i", F.col("i") + 1)
        lines = lines.withColumn("line", F.when(F.col("i") % 4 == 2, F.concat(F.lit(mark), "line")).otherwise(F.col("line")))
        return by_heading(lines, is_head, strip)


_heading_query("adoc_sections", "=== ", r"^={2,3} +\S", r"^=+ +")
_heading_query("org_sections", "** ", r"^\*{1,2} +\S", r"^\*+ +")
_heading_query("tex_sections", r"\section{", r"^\\(chapter|section)\{", r"^\\(chapter|section)\{")


@query("""SELECT doc_id, string_agg(CASE WHEN i % 2 = 0 THEN src ELSE '```' || chr(10) || src || chr(10) || '```' END, chr(10) || chr(10) ORDER BY i) AS body FROM (SELECT doc_id, i - 1 AS i, lines[i] AS src FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))) GROUP BY doc_id""")
def ipynb_sections(t):
    """Notebooks made of the lines of a text, markdown and code in turn, then flattened again."""
    cells = F.transform(F.split("text", "\n"), lambda s, i: F.struct(F.when(i % 2 == 0, "markdown").otherwise("code").alias("cell_type"), s.alias("source")))
    book = t.documents.select("doc_id", F.to_json(F.struct(cells.alias("cells"))).alias("json"))
    read = F.from_json("json", "cells array<struct<cell_type:string,source:string>>")["cells"]
    body = F.transform(read, lambda c: F.when(c["cell_type"] == "markdown", c["source"]).otherwise(F.concat(F.lit("```\n"), c["source"], F.lit("\n```"))))
    return book.select("doc_id", F.array_join(body, "\n\n").alias("body"))


@query("""WITH l AS (SELECT doc_id, i, lines[i] AS line, i = 1 OR length(trim(lines[i])) >= 120 AS big FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))),
  g AS (SELECT *, sum(big::INT) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM l) SELECT doc_id, sec::BIGINT AS sec, string_agg(line, chr(10) ORDER BY i) AS body FROM g GROUP BY doc_id, sec""")
def section_floor(t):
    """Sections below a floor of characters join the one before; the first always stays."""
    from ..operators.sections import joined

    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    big = (F.col("i") == 0) | (F.length(F.trim("line")) >= 120)
    return joined(lines, big).select("doc_id", "sec", "body")


@query("""SELECT doc_id, i - 1 AS pos, trim(p[i]) AS text, coalesce(list_sum(list_transform(p[1:i - 1], lambda x: length(x) + 2)), 0)::BIGINT + (length(p[i]) - length(ltrim(p[i]))) AS start FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)) AS p FROM documents)) WHERE trim(p[i]) <> ''""")
def paragraphs(t):
    from ..operators.sections import split_paragraphs

    return split_paragraphs(t.documents.select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text")))


@query("""SELECT doc_id, i AS part, array_to_string(w[i * wpp + 1:(i + 1) * wpp], ' ') AS text FROM (SELECT doc_id, w, wpp, unnest(range(0, ((len(w) + wpp - 1) // wpp)::BIGINT)) AS i FROM (SELECT doc_id, w, greatest(1, 100)::BIGINT AS wpp FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents) WHERE len(w) > 100))""")
def oversize_split(t):
    from ..operators.sections import split_oversize

    return split_oversize(t.documents.select("doc_id", "text"), 100)


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))::BIGINT AS tokens FROM documents")
def token_count(t):
    return t.documents.select("doc_id", F.size(tx.words_of(F.col("text"))).cast("long").alias("tokens"))


@query("""WITH c AS (SELECT source, doc_id, 'Ch ' || (doc_id // 60 % 5) AS chapter FROM documents), l AS (SELECT *, coalesce(chapter <> lag(chapter) OVER (PARTITION BY source ORDER BY doc_id), true) AS new FROM c),
  g AS (SELECT *, sum(new::INT) OVER (PARTITION BY source ORDER BY doc_id) AS island FROM l) SELECT source, island::BIGINT AS island, any_value(chapter) AS chapter, min(doc_id) AS first, count(*) AS n FROM g GROUP BY source, island""")
def chapter_islands(t):
    from ..operators.sections import islands

    c = t.documents.select("source", "doc_id", F.concat(F.lit("Ch "), F.floor(F.col("doc_id") / 60).cast("long").cast("string")).alias("x")).withColumn("chapter", F.concat(F.lit("Ch "), (F.floor(F.col("doc_id") / 60) % 5).cast("string")))
    return islands(c, ["source"], "doc_id", "chapter").groupBy("source", "island").agg(F.first("chapter").alias("chapter"), F.min("doc_id").alias("first"), F.count("*").alias("n"))


@query("""SELECT doc_id, i AS win, array_to_string(w[i * 320 + 1:i * 320 + 400], ' ') AS text FROM (SELECT doc_id, w, unnest(range(0, greatest(1, ((len(w) - 80 + 319) // 320))::BIGINT)) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents)) WHERE len(w) > 0""")
def token_windows(t):
    from ..operators.sections import sliding_windows

    return sliding_windows(t.documents.select("doc_id", "text"), 400, 80)


@query("""WITH p AS (SELECT source, doc_id AS page, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS start FROM documents), q AS (SELECT DISTINCT source, i * 997 AS at FROM documents, range(0, 40) r(i))
  SELECT q.source, q.at, max(p.page) AS page FROM q JOIN p ON q.source = p.source AND coalesce(p.start, 0) <= q.at GROUP BY 1, 2""")
def page_at(t):
    from ..operators.joins import as_of

    start = F.coalesce(F.sum("n_chars").over(W.partitionBy("source").orderBy("doc_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    pages = t.documents.select("source", F.col("doc_id").alias("page"), start.alias("start"))
    at = t.documents.select("source").distinct().withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(39 * 997).cast("long"), F.lit(997).cast("long"))))
    return as_of(at, pages, ["source"], "at", "start", "page")


@query("""WITH toc AS (SELECT source, doc_id AS page, 'Ch ' || doc_id AS chapter FROM documents WHERE doc_id % 100 >= 60) SELECT d.source, d.doc_id AS page, coalesce(arg_max(toc.chapter, toc.page), '') AS chapter FROM documents d LEFT JOIN toc ON d.source = toc.source AND toc.page <= d.doc_id GROUP BY 1, 2""")
def chapter_at(t):
    from ..operators.joins import as_of

    toc = t.documents.where("doc_id % 100 >= 60").select("source", F.col("doc_id").alias("p"), F.concat(F.lit("Ch "), F.col("doc_id").cast("string")).alias("chapter"))
    pages = t.documents.select("source", F.col("doc_id").alias("page"))
    return as_of(pages, toc, ["source"], "page", "p", "chapter").withColumn("chapter", F.coalesce("chapter", F.lit("")))


@query("""WITH c AS (SELECT source, doc_id, lower(text) AS text, 'Ch ' || (doc_id // 60 % 3) AS chapter FROM documents), l AS (SELECT *, coalesce(chapter <> lag(chapter) OVER (PARTITION BY source ORDER BY doc_id), true) AS new FROM c), g AS (SELECT *, sum(new::INT) OVER (PARTITION BY source ORDER BY doc_id) AS island FROM l),
  f AS (SELECT *, min(island) OVER (PARTITION BY source, chapter) AS first FROM g) SELECT source, chapter, string_agg(text, '' ORDER BY doc_id) AS text FROM f WHERE island = first GROUP BY source, chapter""")
def first_runs(t):
    from ..operators.sections import first_run_texts

    c = t.documents.select("source", "doc_id", F.lower("text").alias("text"), F.concat(F.lit("Ch "), (F.floor(F.col("doc_id") / 60) % 3).cast("string")).alias("chapter"))
    return first_run_texts(c, ["source"], "doc_id", "chapter", "text")


@query("SELECT doc_id, ((length(text) - length(replace(lower(text), 'the ', ''))) / 4)::BIGINT AS n FROM documents WHERE contains(lower(text), 'the ')")
def find_in_doc(t):
    return t.documents.select("doc_id", F.regexp_count(F.lower("text"), F.lit("the ")).cast("long").alias("n")).where("n > 0")


@query("""SELECT source, string_agg(CASE WHEN prev IS DISTINCT FROM chapter THEN '## ' || chapter || chr(10) || chr(10) ELSE '' END || text, chr(10) || chr(10) ORDER BY doc_id) AS preview FROM (SELECT source, doc_id, text, 'Ch ' || (doc_id // 60 % 3) AS chapter, lag('Ch ' || (doc_id // 60 % 3)) OVER (PARTITION BY source ORDER BY doc_id) AS prev FROM documents) GROUP BY source""")
def preview_text(t):
    from ..operators.sections import preview

    c = t.documents.select("source", "doc_id", "text", F.concat(F.lit("Ch "), (F.floor(F.col("doc_id") / 60) % 3).cast("string")).alias("chapter"))
    return preview(c, "source", "doc_id", "chapter", "text")
