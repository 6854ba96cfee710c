import math
import random
import re
from collections import Counter

import pytest

from shelfspark.llm import lexical as lx
from . import nasty

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in TERM.findall(text or "")]


def brute(docs, items, best=10):
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    N, L = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in held:
            m = 100 - 90 + ((90 * c.total() * N) // L)
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scored.append((-s, d is None, d))
        out += [(item, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:best])]
    return sorted(out, key=str)


def got(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def corpus(seed, n):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    zipf = [1 / (i + 1) for i in range(300)]
    docs = [(i, " ".join(r.choices(words, zipf, k=r.randint(1, 60)))) for i in range(n)]
    items = [(i, " ".join(r.choices(words, [1] * 300 if i % 2 else zipf, k=r.randint(1, 12)))) for i in range(25)]
    return docs, [*items, (90, docs[5][1]), (91, docs[5][1].upper()), (92, "unknown words only"), (93, None)]


@pytest.mark.parametrize("first,growth", [(1, 8), (20, 3), (4096, 8)])
def test_tiers_are_exact(spark, first, growth):
    docs, items = corpus(first, 400)
    assert got(lx.rank(spark.createDataFrame(docs, "doc_id long, text string"), bench(spark, items), first=first, growth=growth)) == brute(docs, items)


def test_odd_rows(spark):
    data = nasty.rows()
    items = [(1, "One two"), (1, "one TWO"), (2, None), (3, ""), (None, "same line"), (4, data[6][1]), (5, "é 日本 ß hunter2hunter2"), (6, "*** ...")]
    assert got(lx.rank(nasty.table(spark, data), bench(spark, items), first=2, growth=4)) == brute([r[:2] for r in data], items)


def test_empty_tables(spark):
    assert lx.rank(nasty.table(spark, []), bench(spark, [(1, "one")])).collect() == []
    assert lx.rank(nasty.table(spark), bench(spark, [])).collect() == []


def test_an_index_of_all_terms_and_large_vocabularies(spark, monkeypatch):
    docs, items = corpus(9, 200)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    names, asked = lx.numbered(bench(spark, items))
    for small in (lx.SMALL, 3):
        monkeypatch.setattr(lx, "SMALL", small)
        for index in (lx.build(df, first=8, growth=8), lx.build(df, asked, first=8, growth=8)):
            found = lx.search(index, asked).join(names, "item").select("item_id", "rank", "doc_id", "score")
            assert got(found) == brute(docs, items)


def test_proven_items_need_no_lower_tier(spark, monkeypatch):
    docs, items = corpus(3, 600)
    items = [(i, f"{docs[i][1]} only{i}") for i in range(5)]
    docs += [(2000 + 20 * i + k, items[i][1]) for i in range(5) for k in range(12)]
    names, asked = lx.numbered(bench(spark, items))
    index = lx.build(spark.createDataFrame(docs, "doc_id long, text string"), asked, first=64, growth=4)
    assert index.last >= 1
    rounds = []
    monkeypatch.setattr(lx, "stored", lambda df: rounds.append(1) or df)
    found = lx.search(index, asked).join(names, "item").select("item_id", "rank", "doc_id", "score")
    assert got(found) == brute(docs, items)
    assert len(rounds) == 1
