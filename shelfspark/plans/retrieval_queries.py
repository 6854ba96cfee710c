"""Searches over documents and embeddings. Queries are the rows whose id is divisible by 20; all rows are searched."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import retrieval as r
from .registry import Library, query

TOK = "list_filter(regexp_split_to_array(lower({}), '[^\\pL\\pN]+'), lambda w: w <> '')"
Q_SQL = "q AS (SELECT item_id AS qid, text AS q FROM benchmark WHERE item_id % 20 = 0)"
VEC_SQL = """v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
  vr AS (SELECT * FROM (SELECT a.id AS qid, b.id, list_dot_product(a.v, b.v) AS score, row_number() OVER (PARTITION BY a.id ORDER BY list_dot_product(a.v, b.v) DESC, b.id) AS rank FROM v a JOIN v b ON a.id % 20 = 0 AND a.id <> b.id) WHERE rank <= 10)"""


def bm25_sql(terms: str, out: str, k: int = 10, docs: str = "(SELECT doc_id AS id, text FROM documents)") -> str:
    return f"""{out}_d AS (SELECT id, {TOK.format('text')} AS t FROM {docs}), {out}_n AS (SELECT count(*) AS n, avg(len(t)) AS avg FROM {out}_d),
  {out}_f AS (SELECT id, len AS len, term, count(*) AS tf FROM (SELECT id, len(t) AS len, unnest(t) AS term FROM {out}_d) WHERE term IN (SELECT term FROM {terms}) GROUP BY ALL),
  {out}_df AS (SELECT term, count(*) AS df FROM {out}_f GROUP BY term),
  {out}_s AS (SELECT qid, id, round(sum(ln(1.0::DOUBLE + (n - df + 0.5) / (df + 0.5)) * tf * (1.2::DOUBLE + 1) / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * len / avg))), 6) AS score FROM {out}_f JOIN {out}_df USING (term) JOIN {terms} USING (term), {out}_n GROUP BY qid, id),
  {out} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM {out}_s) WHERE rank <= {k})"""


TERMS_SQL = f"terms AS (SELECT DISTINCT qid, unnest({TOK.format('q')}) AS term FROM q)"
FUZZY_SQL = f"""fq AS (SELECT DISTINCT qid, w, CASE WHEN length(w) <= 2 THEN 0 WHEN length(w) <= 5 THEN 1 ELSE 2 END AS d FROM (SELECT qid, unnest(regexp_split_to_array(lower(q), '[^0-9a-z]+')) AS w FROM q) WHERE w <> ''),
  known AS (SELECT DISTINCT term FROM (SELECT unnest({TOK.format('text')}) AS term FROM documents) WHERE regexp_matches(term, '^[0-9a-z]+$')),
  fterms AS (SELECT DISTINCT qid, term FROM fq JOIN known ON w[1] = term[1] AND abs(length(w) - length(term)) <= d AND levenshtein(w, term) <= d)"""


def _queries(t: Library):
    return t.benchmark.where("item_id % 20 = 0").select(F.col("item_id").alias("qid"), F.col("text").alias("q"))


def _docs(t: Library):
    return t.documents.select(F.col("doc_id").alias("id"), "text")


def _vectors(t: Library, asked=None):
    """Of the vectors that ask, all, or those of some queries (qid)."""
    v = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    q = v.where("id % 20 = 0").withColumnRenamed("id", "qid")
    return r.vector_search(q if asked is None else q.join(asked.select("qid"), "qid", "left_semi"), v, 10)


def _bm25(t: Library):
    return r.bm25(r.terms_of(_queries(t)), _docs(t), 10)


def _fuzzy(t: Library):
    return r.bm25(r.fuzzy_terms(_queries(t), _docs(t)), _docs(t), 10)


@query(f"WITH {VEC_SQL} SELECT qid, id, round(score, 6) AS score, rank FROM vr")
def vector_topk(t):
    return _vectors(t).select("qid", "id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {Q_SQL}, {TERMS_SQL}, {bm25_sql('terms', 'b')} SELECT qid, id, score, rank FROM b")
def bm25_topk(t):
    return _bm25(t)


@query(f"WITH {Q_SQL}, {FUZZY_SQL}, {bm25_sql('fterms', 'z')} SELECT qid, id, score, rank FROM z")
def fuzzy_topk(t):
    return _fuzzy(t)


@query(f"WITH {Q_SQL}, {FUZZY_SQL} SELECT qid, count(*) AS n, min(term) AS first FROM fterms GROUP BY qid")
def fuzzy_expansion(t):
    return r.fuzzy_terms(_queries(t), _docs(t)).groupBy("qid").agg(F.count("*").alias("n"), F.min("term").alias("first"))


RRF_SQL = f"WITH {Q_SQL}, {TERMS_SQL}, {FUZZY_SQL}, {VEC_SQL}, {bm25_sql('terms', 'b')}, {bm25_sql('fterms', 'z')}, u AS (SELECT qid, id, rank FROM vr UNION ALL SELECT qid, id, rank FROM b UNION ALL SELECT qid, id, rank FROM z), s AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM u GROUP BY qid, id), h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 24)"


def _hybrid(t: Library, asked=None):
    """The texts are read once to learn their words and once to rank them for both lists."""
    lists = r.bm25_lists([r.terms_of(_queries(t)), r.fuzzy_terms(_queries(t), _docs(t))], _docs(t), 10)
    return r.fuse([_vectors(t, asked), *lists], r.HYBRID_K)


@query(f"{RRF_SQL} SELECT qid, id, score, rank FROM h")
def hybrid_topk(t):
    return _hybrid(t)


@query(f"WITH {Q_SQL}, {TERMS_SQL}, {VEC_SQL}, {bm25_sql('terms', 'b')}, u AS (SELECT qid, id, rank FROM vr UNION ALL SELECT qid, id, rank FROM b), s AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM u GROUP BY qid, id) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10")
def rrf_fuse(t):
    return r.fuse([_vectors(t), _bm25(t)], 10)


RERANK_SQL = f"{RRF_SQL}, k AS (SELECT h.qid, h.id, round(len(list_filter(x, lambda w: list_contains(y, w))) / greatest(len(x), 1), 6) AS score FROM h JOIN (SELECT qid, list_distinct({TOK.format('q')}) AS x FROM q) USING (qid) JOIN (SELECT doc_id AS id, {TOK.format('text')} AS y FROM documents) USING (id)), rr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM k) WHERE rank <= 12)"


def _reranked(t: Library):
    """Only what has a query's text is ranked anew, so vectors ask only for these."""
    return r.rerank(_hybrid(t, _queries(t)), _queries(t), _docs(t), 12)


@query(f"{RERANK_SQL} SELECT qid, id, score, rank FROM rr")
def rerank_topk(t):
    return _reranked(t)


@query(f"{RERANK_SQL}, l AS (SELECT *, max(score) OVER (PARTITION BY qid) < 0.5 AS loose FROM rr) SELECT qid, id, score, loose, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM l WHERE score >= CASE WHEN loose THEN 0.06 ELSE 0.5 END QUALIFY rank <= 8")
def relevance_tiers(t):
    return r.tiers(_reranked(t), 0.5)


@query("WITH a AS (SELECT event_id % 50 AS qid, event_id AS id, round(value, 3) AS score FROM events) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM a) WHERE rank <= 5")
def rank_results(t):
    e = t.events.select((F.col("event_id") % 50).alias("qid"), F.col("event_id").alias("id"), F.round("value", 3).alias("score"))
    return r.top(e, ["qid"], [F.desc("score"), "id"], 5)


@query("WITH e AS (SELECT event_id % 20 AS qid, event_type AS collection, user_id AS id, max(round(value, 3)) AS score FROM events GROUP BY ALL), n AS (SELECT greatest(24 // count(DISTINCT collection), 6) AS k FROM e), p AS (SELECT *, row_number() OVER (PARTITION BY qid, collection ORDER BY score DESC, id) AS r FROM e), f AS (SELECT p.* FROM p, n WHERE r <= k) SELECT qid, collection, id, score FROM f QUALIFY row_number() OVER (PARTITION BY qid, id ORDER BY collection) = 1")
def fanout_topk(t):
    e = t.events.groupBy((F.col("event_id") % 20).alias("qid"), F.col("event_type").alias("collection"), F.col("user_id").alias("id")).agg(F.max(F.round("value", 3)).alias("score"))
    return r.fan_out(e)


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def dedup_first(t):
    return r.top(t.events.select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"], 1).drop("rank")


VOCAB_SQL = "vocab AS (SELECT lower(w) AS word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '[^\\pL\\pN]+')) AS w FROM documents) WHERE regexp_matches(w, '^\\pL+$') AND strlen(w) >= 3 GROUP BY 1)"


@query(f"WITH {VOCAB_SQL} SELECT word, n FROM vocab")
def vocab(t):
    return r.vocabulary(_docs(t))


# every third word of a query doubles a letter; queries and vocabulary are ASCII here, as the distance in SQL counts bytes
TYPO_SQL = "tq AS (SELECT item_id AS qid, array_to_string(list_transform(string_split(regexp_replace(text, '[^ -~]', '', 'g'), ' '), lambda w, i: CASE WHEN i % 3 = 0 AND length(w) >= 5 THEN w[1:2] || w[2:2] || w[3:] ELSE w END), ' ') AS q FROM benchmark WHERE item_id % 20 = 0)"


def _ascii_vocabulary(t: Library):
    return r.vocabulary(_docs(t)).where(F.col("word").rlike("^[a-z]+$"))


def _typos(t: Library):
    words = F.split(F.regexp_replace("text", "[^ -~]", ""), " ")
    bad = F.transform(words, lambda w, i: F.when(((i + 1) % 3 == 0) & (F.length(w) >= 5), F.concat(F.substring(w, 1, 2), F.substring(w, 2, 1), w.substr(F.lit(3), F.length(w)))).otherwise(w))
    return t.benchmark.where("item_id % 20 = 0").select(F.col("item_id").alias("qid"), F.array_join(bad, " ").alias("q"))


FIX_SQL = f"""WITH {VOCAB_SQL.replace('vocab AS', 'every_word AS')}, vocab AS (SELECT * FROM every_word WHERE regexp_matches(word, '^[a-z]+$')), {TYPO_SQL}, w AS (SELECT qid, i - 1 AS pos, ws[i] AS word, lower(regexp_replace(ws[i], '[^\\pL\\pN]', '', 'g')) AS low FROM (SELECT qid, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT qid, list_filter(regexp_split_to_array(q, '\\s+'), lambda x: x <> '') AS ws FROM tq))),
  p AS (SELECT qid, pos, levenshtein(low, vocab.word) AS dist, n, vocab.word AS v FROM w JOIN vocab ON low[1] = vocab.word[1] AND abs(strlen(low) - strlen(vocab.word)) <= CASE WHEN strlen(low) > 5 THEN 2 ELSE 1 END AND levenshtein(low, vocab.word) <= CASE WHEN strlen(low) > 5 THEN 2 ELSE 1 END),
  m AS (SELECT qid, pos, min(dist) AS dist, arg_min(v, (dist, -n, v)) AS v FROM p GROUP BY qid, pos), c AS (SELECT w.qid, w.pos, word, CASE WHEN strlen(low) >= 4 AND dist > 0 THEN v END AS best FROM w LEFT JOIN m ON w.qid = m.qid AND w.pos = m.pos)"""


@query(f"{FIX_SQL} SELECT qid, pos, word, best FROM c")
def spell_candidates(t):
    return r.corrections(_typos(t), _ascii_vocabulary(t))


@query(f"{FIX_SQL}, g AS (SELECT qid, string_agg(coalesce(best, word), ' ' ORDER BY pos) AS f, bool_or(best IS NOT NULL) AS changed FROM c GROUP BY qid) SELECT tq.qid, CASE WHEN changed THEN f ELSE q END AS q, coalesce(changed, false) AS changed FROM tq LEFT JOIN g ON tq.qid = g.qid")
def correct_query(t):
    return r.correct(_typos(t), _ascii_vocabulary(t))


@query(f"{FIX_SQL}, g AS (SELECT qid, string_agg(coalesce(best, word), ' ' ORDER BY pos) AS q FROM c GROUP BY qid), terms AS (SELECT DISTINCT qid, unnest({TOK.format('q')}) AS term FROM g), {bm25_sql('terms', 'b')} SELECT qid, id, score, rank FROM b")
def hybrid_corrected(t):
    """Retrieval anew with repaired queries."""
    fixed = r.correct(_typos(t), _ascii_vocabulary(t)).select("qid", "q")
    return r.bm25(r.terms_of(fixed), _docs(t), 10)


@query(f"""WITH u AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prior FROM conversations WHERE role = 'user'), l AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1),
  q AS (SELECT conv_id AS qid, CASE WHEN prior IS NOT NULL AND len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) <= 12 THEN prior || chr(10) || text ELSE text END AS q FROM l), {TERMS_SQL}, {bm25_sql('terms', 'b', 5)} SELECT qid, id, score, rank FROM b""")
def followup_widen(t):
    """The last user turn, together with the one before it where it leans on that, searched as one."""
    u = t.conversations.where("role = 'user'")
    by = W.partitionBy("conv_id").orderBy("turn")
    u = u.withColumn("prior", F.lag("text").over(by)).withColumn("last", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn"))) == 1).where("last")
    lean = F.col("prior").isNotNull() & (F.size(tx.words_of(F.col("text"))) <= 12)
    q = u.select(F.col("conv_id").alias("qid"), F.when(lean, F.concat("prior", F.lit("\n"), "text")).otherwise(F.col("text")).alias("q"))
    return r.bm25(r.terms_of(q), _docs(t), 5)


@query(f"SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))), 9) AS jaccard FROM (SELECT item_id, list_distinct({TOK.format('text')}) AS x FROM benchmark) a JOIN (SELECT item_id, list_distinct({TOK.format('text')}) AS y FROM benchmark) b ON b.item_id = a.item_id + 1")
def jaccard(t):
    words = t.benchmark.select("item_id", F.array_distinct(r.tokens(F.col("text"))).alias("w"))
    a, b = words.alias("a"), words.alias("b")
    both, every = F.size(F.array_intersect("a.w", "b.w")), F.size(F.array_union("a.w", "b.w"))
    return a.join(b, F.col("b.item_id") == F.col("a.item_id") + 1).select(F.col("a.item_id").alias("a"), F.col("b.item_id").alias("b"), F.round(both / every, 9).alias("jaccard"))
