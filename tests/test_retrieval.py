"""Searches do the whole job with work that is bounded for each query."""

import random

import numpy as np
import pyarrow as pa
import pytest

from shelfspark.operators import retrieval


@pytest.mark.parametrize("seed", range(4))
def test_best_texts_are_those_of_all_pairs_without_a_row_for_each(seed):
    r = random.Random(seed)
    texts = [{t: r.choice([0.5, 1.0, 1.5]) for t in range(60) if r.random() < 1 / (1 + t)} for _ in range(1_500)]
    texts += texts[:300]  # copies, which tie
    ids = r.sample(range(10_000), len(texts))
    idf = np.array([0.1 + t / 6 for t in range(60)])
    queries = [sorted(r.sample(range(60), r.randint(1, 12)), key=lambda t: -idf[t]) for _ in range(40)]
    at = np.cumsum([0, *map(len, queries)])
    terms = np.concatenate(queries)
    k, batch = 5, 300

    def batches():
        for lo in range(0, len(texts), batch):
            part = texts[lo : lo + batch]
            yield pa.RecordBatch.from_arrays([pa.array(ids[lo : lo + batch]), pa.array([list(x) for x in part], pa.list_(pa.int64())), pa.array([list(x.values()) for x in part], pa.list_(pa.float64()))], ["id", "terms", "weights"])

    found: dict[int, list] = {q: [] for q in range(len(queries))}
    rows = 0
    for q, their, score in retrieval._best_texts(batches(), at, terms, idf[terms], k):
        rows += len(q)
        for x in zip(q.tolist(), their.to_pylist(), score.tolist(), strict=True):
            found[x[0]].append((-x[2], x[1]))
    assert rows <= k * len(queries) * (len(texts) // batch)  # all pairs with a common term are many more
    for q, mine in enumerate(queries):
        want = [(-float(np.floor(sum(idf[t] * x[t] for t in mine if t in x) * 1e6 + 0.5) / 1e6), i) for i, x in zip(ids, texts, strict=True) if any(t in x for t in mine)]
        assert sorted(found[q])[:k] == sorted(want)[:k]


def test_texts_that_are_null_or_come_twice_are_ranked_as_they_were(spark):
    docs = spark.createDataFrame([(1, "a b b"), (1, "a c c"), (2, None), (3, "b c d e"), (None, "b"), (4, "")], "id long, text string")
    terms = spark.createDataFrame([(7, "a"), (7, "b"), (8, "zz"), (9, "c")], "qid long, term string")
    got = sorted((r["qid"], r["id"] or 0, r["rank"]) for r in retrieval.bm25(terms, docs, 10).collect())
    assert got == [(7, 0, 2), (7, 1, 1), (7, 3, 3), (9, 1, 1), (9, 3, 2)]
    assert retrieval.bm25(terms.where("qid = 8"), docs, 10).count() == 0


def test_known_words_have_few_keys_however_long(spark):
    from pyspark.sql import functions as F

    words = spark.createDataFrame([("a" * 3 + "bcdefghij" * n,) for n in range(4)] + [("abcdefgh"[:n],) for n in range(1, 9)], "w string")
    keys = words.select(F.size(retrieval.meeting_keys(F.col("w"), F.lit(2), False)).alias("n")).collect()
    assert max(r["n"] for r in keys) <= 11


def test_only_queries_that_are_ranked_anew_are_compared_with_all_vectors(spark, monkeypatch):
    from shelfspark.plans import retrieval_queries as rq
    from shelfspark.plans.registry import Library

    rows = {
        "documents": spark.createDataFrame([(i, f"word{i} other") for i in range(30)], "doc_id long, text string"),
        "benchmark": spark.createDataFrame([(0, "word1 word2"), (20, "word3")], "item_id long, text string"),
        "embeddings": spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(400)], "vec_id long, embedding array<float>"),
    }

    class Small(Library):
        def __getattr__(self, name):
            return rows[name]

    seen = []
    search = rq.r.vector_search
    monkeypatch.setattr(rq.r, "vector_search", lambda queries, *rest: seen.append(queries.count()) or search(queries, *rest))
    t = Small(spark, "")
    got = rq._reranked(t).collect()
    whole = rq.r.rerank(rq._hybrid(t), rq._queries(t), rq._docs(t), 12).collect()
    assert seen == [2, 20] and sorted(got) == sorted(whole) and got


def test_postings_are_shuffled_only_as_they_are_written(spark, tmp_path):
    from pyspark.sql import functions as F

    from shelfspark.sources.postings import Postings

    texts = [("p1", "b a b"), ("p2", ""), ("p3", None), ("p4", "c c c"), ("p4", "c d e")]
    fresh = spark.createDataFrame(texts, "id string, text string").withColumn("_t", retrieval.tokens(F.col("text"))).withColumn("n", F.size("_t").cast("long")).withColumn("gen", F.lit(0).cast("long"))
    index = Postings(spark, f"file://{tmp_path}/index", 2)
    once = index._counted(fresh.where("id <> 'p4'"))
    assert {(r["id"], r["n"], r["term"], r["tf"]) for r in once.collect()} == {("p1", 3, "a", 1), ("p1", 3, "b", 2)}
    assert "Exchange" not in once._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["term"], r["tf"]) for r in index._counted(fresh).where("id = 'p4'").collect()) == [("c", 4), ("d", 1), ("e", 1)]
    index.postings.append(once)
    assert "Exchange" not in index.live()._jdf.queryExecution().executedPlan().toString()
    index.dead.append(spark.createDataFrame([("p1", 0)], "id string, gen long"))
    assert index.live().count() == 0
