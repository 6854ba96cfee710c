"""Hybrid retrieval: vector, full-text and fuzzy search, fusion, repair, reranking, tiers.

Every search takes a relation of queries and gives the best k rows for each. The
queries are the small side: they are counted, and go along with the tasks in blocks,
so that the corpus is never shuffled whole; only the partial best of
each partition, and the occurrences of the queries' terms, are. Ties go by id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import let_workers_import, stored

QUERY_BLOCK = 4_096
#: Queries and vectors that a task multiplies at once, so that the products take 4 MB whatever the batch and the block hold.
QUERY_SLICE, VECTOR_SLICE = 512, 1_024
#: Distinct terms of queries that are broadcast at most, terms of a block of queries that texts are compared with, and by how much sums that are rounded may be off.
FEW_TERMS, ASKED, SLACK = 1 << 18, 1 << 21, 2e-6
#: Fusion constant, BM25 parameters, and the usual sizes of pools and results.
RRF_K, K1, B = 60, 1.2, 0.75
HYBRID_K, FINAL_K, MIN_RELEVANCE = 24, 8, 0.15


def top(rows: DataFrame, by: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, numbered from 1; Spark limits groups before it shuffles them."""
    return rows.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def in_blocks(queries: DataFrame, run) -> DataFrame:
    """run over queries in blocks that are small enough to broadcast. They are kept, as they are counted here and used more than once."""
    queries = queries.persist()
    n = queries.count()
    if n <= QUERY_BLOCK:
        return run(F.broadcast(queries))
    blocks = -(-n // QUERY_BLOCK)
    part = queries.withColumn("_block", F.pmod(F.xxhash64("qid"), F.lit(blocks)))
    return reduce(DataFrame.unionByName, [run(F.broadcast(part.where(F.col("_block") == i).drop("_block"))) for i in range(blocks)])


def vector_search(queries: DataFrame, vectors: DataFrame, k: int, own: bool = False) -> DataFrame:
    """(qid, id, score, rank) by inner product of (qid, v) with (id, v). Unless own, qid and id name the same rows, and a row is not its own match.

    Each partition multiplies its vectors with the block of queries and sends on its best k. Vectors that are null,
    empty, hold null or non-finite components, or have another length than the query find nothing and are not found.
    """
    let_workers_import(vectors.sparkSession)
    whole = lambda c: F.coalesce((F.size(c) > 0) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    queries = queries.where(whole("v")).withColumn("_d", F.size("v"))
    vectors = vectors.where(whole("v"))
    lengths = [r["_d"] for r in queries.select("_d").distinct().collect()]  # a model has one
    if not lengths:
        return vectors.select(F.lit(0).cast("long").alias("qid"), F.lit(0).cast("long").alias("id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    return reduce(DataFrame.unionByName, [_vector_search(queries.where(F.col("_d") == d), vectors.where(F.size("v") == d), k, own) for d in lengths])


def best_of(held: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best k (row, id, score) of each row of scores and of those held, in order; scores that are not finite count for nothing."""
    bar = np.full(len(scores), -np.inf)
    if scores.shape[1] > k:
        bar = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
    place = np.arange(len(held[0])) - np.searchsorted(held[0], held[0])
    last = place == k - 1
    bar[held[0][last]] = np.maximum(bar[held[0][last]], held[2][last])
    row, at = np.nonzero(np.isfinite(scores) & (scores >= bar[:, None]))
    row, id_, score = np.concatenate([held[0], row]), np.concatenate([held[1], ids[at]]), np.concatenate([held[2], scores[row, at]])
    order = np.lexsort((id_, -score, row))
    row, id_, score = row[order], id_[order], score[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], id_[keep], score[keep]


def _vector_search(queries: DataFrame, vectors: DataFrame, k: int, own: bool) -> DataFrame:
    n = queries.count()
    found = []
    for lo in range(0, n, QUERY_BLOCK):
        some = queries.orderBy("qid").offset(lo).limit(QUERY_BLOCK).toArrow()  # as many rows as a block has
        qid = some.column("qid").to_numpy()
        q = np.array(some.column("v").to_pylist(), float)

        def run(batches: Iterator[pa.RecordBatch], qid=qid, q=q) -> Iterator[pa.RecordBatch]:
            best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))] * -(-len(qid) // QUERY_SLICE)
            for batch in batches:
                for at in range(0, batch.num_rows, VECTOR_SLICE):
                    part = batch.slice(at, VECTOR_SLICE)
                    ids = part.column("id").to_numpy()
                    x = part.column("v").flatten().to_numpy().astype(float).reshape(part.num_rows, -1)
                    for i in range(len(best)):
                        mine = slice(i * QUERY_SLICE, (i + 1) * QUERY_SLICE)
                        s = q[mine] @ x.T
                        if not own:
                            s[ids[None, :] == qid[mine, None]] = -np.inf
                        best[i] = best_of(best[i], ids, s, k)
            for i, (row, ids, score) in enumerate(best):
                if len(row):
                    yield pa.RecordBatch.from_arrays([pa.array(qid[row + i * QUERY_SLICE]), pa.array(ids), pa.array(score)], ["qid", "id", "score"])

        found.append(vectors.select("id", "v").mapInArrow(run, "qid long, id long, score double"))
    return top(reduce(DataFrame.unionByName, found), ["qid"], [F.desc("score"), "id"], k)


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def terms_of(queries: DataFrame) -> DataFrame:
    """(qid, term) once each of rows (qid, q)."""
    return queries.select("qid", F.explode(F.array_distinct(tokens(F.col("q")))).alias("term"))


def _postings(batch: pa.RecordBatch, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(at, doc, weight) of a batch of rows (id, terms, weights): those of the i-th known term lie from at[i] to at[i + 1], by document, once each."""
    lists = batch.column("terms")
    term, weight = lists.flatten().to_numpy(), batch.column("weights").flatten().to_numpy()
    doc = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
    place = np.minimum(np.searchsorted(known, term), len(known) - 1)
    mine = known[place] == term
    place, doc, weight = place[mine], doc[mine], weight[mine]
    order = np.lexsort((doc, place))
    place, doc, weight = place[order], doc[order], weight[order]
    if len(place):
        first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])]))
        place, doc, weight = place[first], doc[first], np.add.reduceat(weight, first)
    return np.searchsorted(place, np.arange(len(known) + 1)), doc, weight


def _best_texts(batches: Iterator[pa.RecordBatch], at: np.ndarray, terms: np.ndarray, idf: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
    """(query, id, score) of what may be among the k best of each query, k of a batch at most; the terms of query i lie from at[i] to at[i + 1], rarest first.

    The rare terms of a query are summed up first. As soon as the terms that are left can't lift a text that has
    none of the others to the k-th best seen, they are looked up only for the texts that may get there. Scores are sums in the order of the terms.
    """
    known, term = np.unique(terms, return_inverse=True)
    held = np.full((len(at) - 1, k), -np.inf)
    for batch in batches:
        if not len(known):
            continue
        batch = batch.take(pc.sort_indices(batch.column("id"), null_placement="at_start"))
        start, docs, weights = _postings(batch, known)
        most = np.zeros(len(known))
        some = np.flatnonzero(np.diff(start))
        if not len(some):
            continue
        most[some] = np.maximum.reduceat(weights, start[some])
        score, many = np.zeros(batch.num_rows), max(batch.num_rows // 32, k)
        out: list[tuple[int, np.ndarray, np.ndarray]] = []
        for q in range(len(at) - 1):
            mine = slice(at[q], at[q + 1])
            mine_there = most[term[mine]] > 0
            t, w = term[mine][mine_there], idf[mine][mine_there]
            if not len(t):
                continue
            lo, hi = start[t], start[t + 1]
            left = np.append(np.cumsum((w * most[t])[::-1])[::-1], 0.0)  # what the terms from the i-th on can add
            bar = held[q, -1] - SLACK
            touched: list[np.ndarray] | None = []
            i = 0
            while i < len(t) and left[i] >= bar:
                if touched and hi[i] - lo[i] > many:
                    seen = np.unique(np.concatenate(touched))
                    touched = None
                    if len(seen) >= k:
                        bar = max(bar, np.partition(score[seen], len(seen) - k)[-k] - SLACK)
                        continue
                mine_docs = docs[lo[i] : hi[i]]
                score[mine_docs] += w[i] * weights[lo[i] : hi[i]]
                if touched is not None:
                    touched.append(mine_docs)
                i += 1
            able = np.flatnonzero((score > 0) & (score >= bar - left[i]))
            s = score[able]
            score[:] = 0.0
            for j in range(i, len(t)):
                if not len(able):
                    break
                theirs = docs[lo[j] : hi[j]]
                where = np.minimum(np.searchsorted(theirs, able), len(theirs) - 1)
                s = s + np.where(theirs[where] == able, w[j] * weights[lo[j] : hi[j]][where], 0.0)
                keep = s >= bar - left[j + 1]
                able, s = able[keep], s[keep]
            s = np.floor(s * 1e6 + 0.5) / 1e6
            keep = s >= held[q, -1]
            if len(s) > k:
                keep &= s >= np.partition(s, len(s) - k)[-k]
            able, s = able[keep], s[keep]
            best = np.argsort(-s, kind="stable")[:k]  # texts are in the order of their ids
            if len(best):
                able, s = able[best], s[best]
                held[q] = -np.sort(-np.concatenate([held[q], s]))[:k]
                out.append((q, able, s))
        if out:
            yield np.repeat([o[0] for o in out], [len(o[1]) for o in out]), batch.column("id").take(pa.array(np.concatenate([o[1] for o in out]))), np.concatenate([o[2] for o in out])


def ranked(terms: DataFrame, postings: Callable[[DataFrame], DataFrame], stats: DataFrame | None, k: int) -> DataFrame:
    """(qid, id, score, rank) for terms (qid, term) by BM25.

    postings gives the rows (id, _n, term, _tf) of some terms (term), stats is one row (_docs, _avg); without it, postings
    gives besides, under the term null, how many texts (_tf) there are of each id and length, and is read once. A text's terms lie together then, and each batch of texts
    is compared with blocks of queries of ASKED terms in all, so that no row is made of a query and a text that can't be among its best.
    """
    let_workers_import(terms.sparkSession)
    terms = stored(terms.select("qid", "term"))
    wanted = terms.select("term").distinct().where("term IS NOT NULL")
    # texts are read once; an index is read where it lies
    keep = stored if stats is None else lambda df: df
    tf = keep(postings(F.broadcast(wanted) if terms.count() <= FEW_TERMS else wanted))
    if stats is None:
        stats = tf.where("term IS NULL").agg(F.sum("_tf").alias("_docs"), (F.sum(F.col("_n") * F.col("_tf")) / F.sum(F.when(F.col("_n").isNotNull(), F.col("_tf")))).alias("_avg"))
    tf = tf.where("term IS NOT NULL")
    whole = stats.first()
    n, avg = F.lit(float(whole["_docs"] or 0)), F.lit(float(whole["_avg"] or 0))
    df = tf.groupBy("term").agg(F.sum(F.least("_tf", F.lit(1).cast("long"))).alias("_df"))
    idf = F.log(F.lit(1.0) + (n - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    known = stored(df.select("term", F.monotonically_increasing_id().alias("_t"), idf.alias("_idf")))
    few = known.count() <= FEW_TERMS
    names = F.broadcast(known.select("term", "_t")) if few else known.select("term", "_t")
    weight = F.col("_tf") * (K1 + 1) / (F.col("_tf") + K1 * (1 - B + B * F.col("_n") / avg))
    texts = keep(tf.join(names, "term").groupBy("id").agg(F.collect_list("_t").alias("terms"), F.collect_list(weight).alias("weights")))
    pairs = terms.join(F.broadcast(known) if few else known, "term").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct((-F.col("_idf")).alias("w"), "_t"))).alias("x"))
    asked = stored(pairs.select("qid", F.col("x._t").alias("terms"), F.transform("x.w", lambda w: -w).alias("idf")))
    count = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-count // ASKED))
    schema = T.StructType([asked.schema["qid"], texts.schema["id"], T.StructField("score", T.DoubleType())])
    found = []
    for block in range(blocks):
        some = asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == block).toArrow().combine_chunks()
        qid, lists, its_idf = (some.column(c).combine_chunks() if some.num_rows else None for c in ("qid", "terms", "idf"))
        if qid is None:
            continue
        at, each, its_idf = lists.offsets.to_numpy(), lists.flatten().to_numpy(), its_idf.flatten().to_numpy()

        def run(batches: Iterator[pa.RecordBatch], qid=qid, at=at, each=each, its_idf=its_idf) -> Iterator[pa.RecordBatch]:
            for q, ids, score in _best_texts(batches, at, each, its_idf, k):
                yield pa.RecordBatch.from_arrays([qid.take(pa.array(q)), ids, pa.array(score)], ["qid", "id", "score"])

        found.append(texts.mapInArrow(run, schema))
    if not found:
        return asked.select("qid").crossJoin(texts.select("id")).select("qid", "id", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    return top(reduce(DataFrame.unionByName, found), ["qid"], [F.desc("score"), "id"], k)


def bm25(terms: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(qid, id, score, rank) of rows (id, text) for terms (qid, term).

    Only the occurrences of query terms leave the scan, counted before they are shuffled, and a row for each text.
    """
    sized = docs.withColumn("_t", tokens(F.col("text"))).withColumn("_n", F.size("_t"))
    # the term null stands for the text itself
    words = sized.select("id", "_n", F.explode(F.concat(F.coalesce("_t", F.array().cast("array<string>")), F.array(F.lit(None).cast("string")))).alias("term"))

    def found(wanted: DataFrame) -> DataFrame:
        some = words.join(wanted.withColumn("_wanted", F.lit(True)), "term", "left").where("term IS NULL OR _wanted")
        return some.groupBy("id", "_n", "term").agg(F.count("*").alias("_tf"))

    return ranked(terms, found, None, k)


def bm25_lists(lists: list[DataFrame], docs: DataFrame, k: int) -> list[DataFrame]:
    """bm25 for several relations of terms (qid, term) at once, so that the texts are read for all of them together."""
    tagged = [x.select(F.struct(F.lit(i).alias("list"), "qid").alias("qid"), "term") for i, x in enumerate(lists)]
    found = bm25(reduce(DataFrame.unionByName, tagged), docs, k)
    return [found.where(F.col("qid.list") == i).select(F.col("qid.qid").alias("qid"), "id", "score", "rank") for i in range(len(lists))]


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of alphabetic words of three bytes or more, in lower case."""
    words = F.filter(F.split("text", r"[^\p{L}\p{N}]+"), lambda w: w.rlike(r"^\p{L}+$") & (F.octet_length(w) >= 3))
    return docs.select(F.explode(words).alias("w")).groupBy(F.lower("w").alias("word")).agg(F.count("*").alias("n"))


#: Edits between two words at most. Known words of more characters meet others by thirds of them instead of by what is left after deletions,
#: so that a known word has 11 keys at most.
EDITS, LONG = 2, 5


def deletions(word: Column, most: Column) -> Column:
    """What is left of a word after up to so many (two at most) of its characters but the first are deleted."""

    def less(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(2), F.greatest(F.length(w), F.lit(2))), lambda i: F.concat(w.substr(F.lit(1), i - 1), w.substr(i + 1, F.length(w))))

    none = F.array().cast("array<string>")
    twice = F.flatten(F.transform(less(word), less))
    return F.array_distinct(F.concat(F.array(word), F.when(most >= 1, less(word)).otherwise(none), F.when(most >= 2, twice).otherwise(none)))


def thirds(word: Column, size: Column, shift: Column) -> Column:
    """The three parts of a known word of so many characters, read from a word with a shift, each with the size and its place."""
    part = F.floor(size / 3).cast("int")
    wide = lambda i: F.when(i == 2, size - 2 * part).otherwise(part)
    read = lambda i: word.substr(F.greatest(part * i + 1 + shift, F.lit(1)), wide(i))
    return F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda i: F.concat_ws(":", size.cast("string"), i.cast("string"), read(i)))


def meeting_keys(word: Column, most: Column, asks: bool) -> Column:
    """Keys of which a word that asks and a known one share one if they begin alike and most (EDITS at most) edits turn one into the other.

    What two words have in common is what is left of either after the deletion of what they have not. Of the thirds of a
    long word, two edits leave one as it was, no more than two places further on in the word that asks.
    """
    n, none = F.length(word), F.array().cast("array<string>")
    if asks:
        short, long = n <= LONG + EDITS, n > LONG - EDITS
        shifts = F.array(*[F.lit(x) for x in range(-EDITS, EDITS + 1)])
        parts = F.flatten(F.transform(F.sequence(n - EDITS, n + EDITS), lambda size: F.flatten(F.transform(shifts, lambda shift: thirds(word, size, shift)))))
    else:
        short, long = n <= LONG, n > LONG
        parts = thirds(word, n, F.lit(0))
    keys = F.concat(F.when(short, deletions(word, most)).otherwise(none), F.when(long, F.array_distinct(parts)).otherwise(none))
    return F.transform(keys, lambda k: F.xxhash64(F.substring(word, 1, 1), k))


def neighbourhoods(known: DataFrame, term: str) -> DataFrame:
    """The index of a vocabulary: each row once for each of its keys."""
    return known.withColumn("_key", F.explode(meeting_keys(F.col(term), F.lit(EDITS), False)))


def meet(asked: DataFrame, index: DataFrame, word: str, term: str, d: str) -> DataFrame:
    """Rows of asked (word, d, ...) with those of an index (term, ...) that begin with the same letter, within d edits.

    The words that ask are a block and broadcast with their keys, which are a few hundred each; the index is looked up as it is scanned.
    """
    keyed = asked.withColumn("_key", F.explode(meeting_keys(F.col(word), F.col(d), True)))
    near = (F.substring(word, 1, 1) == F.substring(term, 1, 1)) & F.levenshtein(word, term, EDITS).between(0, F.col(d))
    return index.join(F.broadcast(keyed), "_key").drop("_key").where(near).distinct()


def near_terms(queries: DataFrame, known: DataFrame) -> DataFrame:
    """(qid, term): known words (term) within the distance that a query word's length allows, with its first letter."""
    words = F.array_distinct(F.filter(F.split(F.lower("q"), "[^0-9a-z]+"), lambda w: w != ""))
    q = queries.select("qid", F.explode(words).alias("w")).withColumn("d", F.when(F.length("w") <= 2, 0).when(F.length("w") <= 5, 1).otherwise(2))
    plain = known.where(F.col("term").rlike("^[0-9a-z]+$"))
    return in_blocks(q, lambda q: meet(q, neighbourhoods(plain, "term"), "w", "term", "d")).select("qid", "term").distinct()


def fuzzy_terms(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(qid, term): words of the corpus within the distance that a query word's length allows, with its first letter."""
    return near_terms(queries, docs.select(F.explode(tokens(F.col("text"))).alias("term")).distinct())


def fuse(lists: list[DataFrame], k: int) -> DataFrame:
    """Reciprocal rank fusion of lists (qid, id, rank): (qid, id, score, rank)."""
    every = reduce(DataFrame.unionByName, [x.select("qid", "id", "rank") for x in lists])
    scores = every.groupBy("qid", "id").agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 9).alias("score"))
    return top(scores, ["qid"], [F.desc("score"), "id"], k)


def corrections(queries: DataFrame, vocab: DataFrame) -> DataFrame:
    """(qid, pos, word, best): of query words of four bytes or more that the vocabulary lacks, the nearest that it has."""
    q = queries.select("qid", F.posexplode(F.filter(F.split("q", r"\s+"), lambda w: w != "")).alias("pos", "word"))
    q = q.withColumn("low", F.lower(F.regexp_replace("word", r"[^\p{L}\p{N}]", "")))
    q = q.withColumn("d", F.when(F.octet_length("low") > 5, 2).otherwise(1))

    def run(q: DataFrame) -> DataFrame:
        pairs = meet(q, neighbourhoods(vocab.select(F.col("word").alias("v"), "n"), "v"), "low", "v", "d").where(F.abs(F.octet_length("low") - F.octet_length("v")) <= F.col("d")).withColumn("dist", F.levenshtein("low", "v"))
        # a word that is known has distance 0 and needs no repair
        best = pairs.groupBy("qid", "pos").agg(F.min(F.struct("dist", -F.col("n"), "v")).alias("m"))
        return q.join(best, ["qid", "pos"], "left").select("qid", "pos", "word", F.when((F.octet_length("low") >= 4) & (F.col("m.dist") > 0), F.col("m.v")).alias("best"))

    return in_blocks(q, run)


def correct(queries: DataFrame, vocab: DataFrame) -> DataFrame:
    """(qid, q, changed): queries with repaired words; unchanged ones as they were."""
    c = corrections(queries, vocab)
    fixed = c.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("best", "word").alias("w")))), lambda x: x["w"]), " ").alias("_q"), F.max(F.col("best").isNotNull()).alias("changed"))
    return queries.join(fixed, "qid", "left").select("qid", F.when(F.col("changed"), F.col("_q")).otherwise(F.col("q")).alias("q"), F.coalesce("changed", F.lit(False)).alias("changed"))


def overlap(query: Column, text: Column) -> Column:
    """The default reranker's score: the share of the query's distinct words that the text has."""
    q = F.array_distinct(tokens(query))
    return F.round(F.size(F.array_intersect(q, tokens(text))) / F.greatest(F.size(q), F.lit(1)), 6)


def rerank(pool: DataFrame, queries: DataFrame, docs: DataFrame, k: int, score=overlap) -> DataFrame:
    """(qid, id, score, rank) of a pool (qid, id) by a scorer of (query, text). A small pool is broadcast, so that texts stay where they are."""
    pool = stored(pool.select("qid", "id").join(queries.select("qid"), "qid", "left_semi"))
    both = docs.join(F.broadcast(pool) if pool.count() <= FEW_TERMS else pool, "id").join(queries, "qid")
    return top(both.select("qid", "id", score(F.col("q"), F.col("text")).alias("score")), ["qid"], [F.desc("score"), "id"], k)


def tiers(ranked: DataFrame, least: float = MIN_RELEVANCE, k: int = FINAL_K) -> DataFrame:
    """Keep rows of the least relevance; where a query has none, those above a floor, as loose. Ranks are given anew."""
    strong = F.max("score").over(W.partitionBy("qid")) >= least
    floor = min(max(0.25 * least, 0.02), 0.06)
    r = ranked.withColumn("loose", ~strong).where(F.col("score") >= F.when(F.col("loose"), floor).otherwise(least))
    return top(r.drop("rank"), ["qid"], [F.desc("score"), "id"], k)


def fan_out(ranked: DataFrame, hybrid_k: int = HYBRID_K) -> DataFrame:
    """Of lists per collection (qid, collection, id, score), each collection's share; an id that comes twice stays where it comes first."""
    n = ranked.select("collection").distinct().count()
    part = top(ranked, ["qid", "collection"], [F.desc("score"), "id"], max(hybrid_k // max(n, 1), 6))
    return top(part.drop("rank"), ["qid", "id"], ["collection"], 1).drop("rank")
