"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embed_dedup, html_extract, importance, langid, lexical, mixing, ngram_join, nn_descent, quality_rules, secret_scan, substring_dedup, warc
from .shared import durable

RANKS = "byte_bpe_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(RANKS)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path)
    digest = F.sha2(bpe.ids_text(F.col("ids")).cast("binary"), 256)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    placed, taken = mixing.mix(docs)
    return mixing.taken_words(placed, taken).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "n_runs")


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op4_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.link(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = secret_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [secret_scan.count_kind(k).alias(f"n_{k}") for k in secret_scan.BASE]
    digest = F.sha2(secret_scan.spans_text(F.col("base_spans")).cast("binary"), 256)
    return scanned.select("doc_id", *counts, digest.alias("base_sha256"), secret_scan.spans_text(F.col("spans")).alias("spans"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    counted = durable(quality_rules.counts(docs).drop("text"))
    judged = quality_rules.judge(counted, durable(quality_rules.thresholds(counted)))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = html_extract.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return read.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.nearest(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0, 20)


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark").select("text"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {"op1_bpe": op1_bpe, "op2_mixing": op2_mixing, "op3_langid": op3_langid, "op4_embed_dedup": op4_embed_dedup, "op5_ngram_join": op5_ngram_join, "op6_secrets": op6_secrets, "op7_quality": op7_quality, "op8_substring_dedup": op8_substring_dedup, "op9_html": op9_html, "op10_warc": op10_warc, "op11_ann": op11_ann, "op12_lexical": op12_lexical, "op13_importance": op13_importance}

SQL = {
    "op2_mixing": """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM s),
v AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][((place - 1) % 3 + 1)::INT] AS wt, source_size * 2.0::DOUBLE AS cap FROM w),
l AS (SELECT *, cap / wt AS ratio,
        (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / wt, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / (sum(wt) OVER () - coalesce(sum(wt) OVER (ORDER BY cap / wt, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM v),
m AS (SELECT arg_min(level, (ratio, place)) AS level FROM l WHERE level <= ratio),
t AS (SELECT l.source, l.source_size, least(l.cap, coalesce(m.level, 0) * l.wt)::DOUBLE AS target FROM l, m),
p AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, round(t.target)::BIGINT AS goal,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
n AS (SELECT *, sum(blocks) OVER (ORDER BY place) AS hi, length(bin((sum(blocks) OVER ())::BIGINT)) AS bits
      FROM (SELECT t.source, place, ceil(round(target)::BIGINT / 2048)::BIGINT AS blocks FROM t JOIN w ON t.source IS NOT DISTINCT FROM w.source)),
o AS (SELECT source, bits, unnest(range((hi - blocks)::BIGINT, hi::BIGINT)) AS point FROM n WHERE blocks > 0),
k AS (SELECT source, list_sum(list_transform(range(bits), lambda i: ((point >> i) & 1) << (bits - 1 - i)))::BIGINT AS slot FROM o),
r AS (SELECT source, slot, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank FROM k)
SELECT doc_id, size, source_size, target,
       (least(greatest(goal - a, 0), size) + least(greatest(goal - a - source_size, 0), size))::BIGINT AS taken, r.slot AS first_slot,
       (CASE WHEN size > 0 AND a < goal THEN (least(a + size, goal) - 1) // 2048 - a // 2048 + 1 ELSE 0 END
        + CASE WHEN size > 0 AND a + source_size < goal THEN (least(a + source_size + size, goal) - 1) // 2048 - (a + source_size) // 2048 + 1 ELSE 0 END)::BIGINT AS n_runs
FROM p LEFT JOIN r ON p.size > 0 AND p.a < p.goal AND p.source IS NOT DISTINCT FROM r.source AND p.a // 2048 = r.rank""",
    "op5_ngram_join": """
WITH RECURSIVE t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT r, array_to_string(w[i:i + 4], chr(10)) AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
c AS (SELECT x.r AS a, y.r AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.r < y.r GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n p ON c.a = p.r JOIN n q ON c.b = q.r WHERE 100 * c >= 75 * (p.n + q.n - c)),
s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(a, b) AS (SELECT a, b FROM s UNION SELECT reach.a, s.b FROM reach JOIN s ON reach.b = s.a),
m AS (SELECT reach.a AS r, min(t.doc_id) AS least FROM reach JOIN t ON reach.b = t.r GROUP BY 1)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(doc_id, m.least)::BIGINT AS component_id FROM t LEFT JOIN n ON t.r = n.r LEFT JOIN m ON t.r = m.r""",
    "op6_secrets": """
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
p(kind, place, pat, grp, least) AS (VALUES
  ('assign', 1, '(?i)(password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 6),
  ('access', 2, 'AKIA[A-Z0-9]+', 0, 20), ('hex', 3, '[0-9a-f]{24,}', 0, 24), ('entropy', 4, '[A-Za-z0-9+/_=-]{20,}', 0, 20)),
f AS (
  SELECT r, kind, place, least, m, v, b FROM (
    SELECT r, 'assign' AS kind, regexp_extract_all(text, '(?i)(password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS m,
           regexp_extract_all(text, '(?i)(password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS v,
           string_split_regex(text, '(?i)(password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS b FROM t
    UNION ALL SELECT r, 'access', regexp_extract_all(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+'), string_split_regex(text, 'AKIA[A-Z0-9]+') FROM t
    UNION ALL SELECT r, 'hex', regexp_extract_all(text, '[0-9a-f]{24,}'), regexp_extract_all(text, '[0-9a-f]{24,}'), string_split_regex(text, '[0-9a-f]{24,}') FROM t
    UNION ALL SELECT r, 'entropy', regexp_extract_all(text, '[A-Za-z0-9+/_=-]{20,}'), regexp_extract_all(text, '[A-Za-z0-9+/_=-]{20,}'), string_split_regex(text, '[A-Za-z0-9+/_=-]{20,}') FROM t) x
  JOIN p USING (kind)),
i AS (SELECT r, kind, place, least, m, v, b, unnest(range(1, len(m) + 1)) AS i FROM f WHERE len(m) > 0),
s AS (SELECT r, kind, place, m[i] AS m,
        (list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS a
      FROM i WHERE length(v[i]) >= least),
w AS (SELECT r, a, m, unnest(range(0, length(m) - 19)) AS j FROM s WHERE kind = 'entropy'
        AND regexp_matches(m, '[A-Za-z0-9][A-Z]|[0-9][a-z]') AND NOT regexp_matches(m, '^[A-Z_/=+-]*$')
        AND NOT regexp_matches(m, '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$') AND NOT regexp_matches(m, '^[0-9=_+/-]*$')),
h AS (SELECT r, a, min(j) AS lo, max(j) AS hi FROM w
      WHERE list_aggregate(string_split(m[j + 1:j + 20], ''), 'entropy')
            >= CASE WHEN regexp_matches(m, '^[0-9a-fA-F]*$') THEN 3.0 WHEN regexp_matches(m, '^[a-z0-9+/_=-]*$') OR regexp_matches(m, '^[A-Z0-9+/_=-]*$') THEN 3.5 ELSE 3.8 END GROUP BY ALL),
z AS (SELECT r, kind, place, a, a + length(m) AS e FROM s WHERE kind <> 'entropy' UNION ALL SELECT r, 'entropy', 4, a + lo, a + hi + 20 FROM h),
g AS (SELECT r, string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, place, e) AS spans, string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, place, e) FILTER (place < 4) AS base,
        count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex FROM z GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN g ON t.r = g.r""",
    "op7_quality": """
WITH t AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text,
             regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT r, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS g
      FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
h AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
c AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM h) GROUP BY r),
l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM t)
      WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY r),
f AS (SELECT t.r, doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(l.n_lines, 0)::BIGINT AS n_lines,
        coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
      FROM t LEFT JOIN l ON t.r = l.r LEFT JOIN c ON t.r = c.r),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        1000 * n_symbols // greatest(n_words, 1) AS x1, 1000 * n_dup_lines // greatest(n_lines, 1) AS x2,
        1000 * n_repeat_words // greatest(n_words, 1) AS x3, 100 * word_chars // greatest(n_words, 1) AS x4 FROM f),
u AS (SELECT lang, source, k, (x >> greatest(length(bin(x)) - 6, 0)::BIGINT) << greatest(length(bin(x)) - 6, 0)::BIGINT AS x
      FROM (SELECT lang, source, unnest([1, 2, 3, 4]) AS k, unnest([x1, x2, x3, x4]) AS x FROM b WHERE NOT base_failed)),
f1 AS (SELECT lang, source, k, x, count(*)::HUGEINT AS n FROM u GROUP BY ALL),
f2 AS (SELECT lang, k, x, count(*)::HUGEINT AS n FROM u GROUP BY ALL),
f3 AS (SELECT *, (sum(n) OVER (PARTITION BY k))::HUGEINT AS t FROM (SELECT k, x, count(*)::HUGEINT AS n FROM u GROUP BY ALL)),
g2 AS (SELECT lang, k, x, sum(n)::HUGEINT AS n FROM (
         SELECT lang, k, x, n * t AS n FROM f2 JOIN (SELECT DISTINCT k, t FROM f3) USING (k)
         UNION ALL SELECT lang, k, x, n * 50 FROM (SELECT DISTINCT lang, k FROM f2) JOIN f3 USING (k)) GROUP BY ALL),
h2 AS (SELECT *, (sum(n) OVER (PARTITION BY lang, k))::HUGEINT AS t FROM g2),
g1 AS (SELECT lang, source, k, x, sum(n)::HUGEINT AS n FROM (
         SELECT f1.lang, source, f1.k, x, n * t AS n FROM f1 JOIN (SELECT DISTINCT lang, k, t FROM h2) h ON f1.lang IS NOT DISTINCT FROM h.lang AND f1.k = h.k
         UNION ALL SELECT h2.lang, source, h2.k, x, n * 50 FROM (SELECT DISTINCT lang, source, k FROM f1) h JOIN h2 ON h2.lang IS NOT DISTINCT FROM h.lang AND h2.k = h.k) GROUP BY ALL),
h1 AS (SELECT *, (sum(n) OVER (PARTITION BY lang, source, k ORDER BY x))::HUGEINT AS s, (sum(n) OVER (PARTITION BY lang, source, k))::HUGEINT AS t FROM g1),
r(k, lo, hi, spread, least) AS (VALUES (1, 25, 75, 8, 60), (2, 50, 90, 1, 400), (3, 50, 90, 3, 300), (4, 25, 75, 6, 40)),
z AS (SELECT lang, source, k, min(x) FILTER (s * 100 >= t * lo) AS a, min(x) FILTER (s * 100 >= t * hi) AS m, any_value(spread) AS spread, any_value(least) AS least FROM h1 JOIN r USING (k) GROUP BY ALL),
y AS (SELECT lang, source, max(CASE WHEN k = 1 THEN m + (m - a) * spread + least END) AS t1, max(CASE WHEN k = 2 THEN m + (m - a) * spread + least END) AS t2,
        max(CASE WHEN k = 3 THEN m + (m - a) * spread + least END) AS t3, max(CASE WHEN k = 4 THEN m + (m - a) * spread + least END) AS t4 FROM z GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(x1 > t1, false) AND NOT coalesce(x2 > t2, false) AND NOT coalesce(x3 > t3, false) AND NOT coalesce(x4 > t4, false) AS kept
FROM b LEFT JOIN y ON b.lang IS NOT DISTINCT FROM y.lang AND b.source IS NOT DISTINCT FROM y.source""",
    "op10_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, '')))::BIGINT AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT d, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY d)
SELECT p.page_id, p.n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN m.last IS NULL OR m.last = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN m.last <> p.page_id THEN m.last END AS refers_to
FROM p LEFT JOIN m ON p.d = m.d""",
    "op12_lexical": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents),
p AS (SELECT r, any_value(doc_id) AS doc_id, term, count(*)::BIGINT AS tf FROM d GROUP BY r, term),
n AS (SELECT r, sum(tf)::BIGINT AS n FROM p GROUP BY r),
g AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS length FROM n),
f AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, g GROUP BY term, docs),
i AS (SELECT DISTINCT k, item_id, term FROM (SELECT row_number() OVER () AS k, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark)),
s AS (SELECT k, item_id, p.r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // length)))))::BIGINT AS score
      FROM i JOIN f USING (term) JOIN p USING (term) JOIN n ON p.r = n.r, g GROUP BY k, item_id, p.r, doc_id),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id ASC NULLS LAST, r)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10""",
}
