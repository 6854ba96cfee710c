import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import langid

from . import nasty


def language(letters, seed, n):
    r = random.Random(seed)
    pairs = [a + b for a in letters for b in letters]
    weights = [r.random() ** 3 for _ in pairs]
    return [" ".join("".join(r.choices(pairs, weights, k=r.randint(1, 4))) for _ in range(r.randint(20, 60))) for _ in range(n)]


def kneser_ney(words, order, alphabet):
    """A plain interpolated Kneser-Ney model over words: probability of a character after a context."""
    grams = Counter()
    for w in words:
        s = " " * (order - 1) + w + " "
        for i in range(order - 1, len(s)):
            grams[s[i - order + 1 : i + 1]] += 1
    levels = {order: grams}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])

    def d(k):
        one, two = sum(v == 1 for v in levels[k].values()), sum(v == 2 for v in levels[k].values())
        return one / (one + 2 * two) if one and two else 0.5

    disc = {k: d(k) for k in levels}
    total, kinds = defaultdict(Counter), defaultdict(Counter)
    for k, level in levels.items():
        for g, n in level.items():
            total[k][g[:-1]] += n
            kinds[k][g[:-1]] += 1

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / alphabet
        n = total[k][g[:-1]]
        if not n:
            return p(g[1:])
        return max(levels[k][g] - disc[k], 0) / n + disc[k] * kinds[k][g[:-1]] / n * p(g[1:])

    return p


def test_model_is_interpolated_kneser_ney():
    texts = {"x": language("abc", 1, 30), "y": language("bcde", 2, 30)}
    counts = {lang: np.unique(langid.grams(*langid.fold(t), 3)[0], return_counts=True) for lang, t in texts.items()}
    model = langid.fit(counts, 3)
    alphabet = len({c for t in texts.values() for x in t for c in x}) + 1
    for i, lang in enumerate(model.langs):
        p = kneser_ney(" ".join(texts[lang]).split(), 3, alphabet)
        for g in ["  a", " ab", "abc", "bce", "zzz", "ab ", "  z", "dea"]:
            key = np.array([sum(ord(c) << 16 * (len(g) - 1 - k) for k, c in enumerate(g))], np.uint64)
            assert model.log2(key)[0, i] == pytest.approx(math.log2(p(g)), rel=1e-4), (lang, g)


def test_held_out_accuracy_and_und(spark):
    data, i = [], 0
    for lang, letters, seed in (("de", "abcdef", 1), ("en", "abcdeg", 2), ("fr", "éabcfg", 3)):
        for t in language(letters, seed, 150):
            data.append((i, t, lang, "s", 0, *nasty.EXTRA))
            i += 1
    odd = [(9000, None, "de"), (9001, "", "de"), (9002, "12 34 !?", "en"), (9003, "Ab" * 40_000, None), (None, "abc", None)]
    data += [(d, t, lang, None, None, *nasty.EXTRA) for d, t, lang in odd] + [data[0]]
    rows = langid.identify(nasty.table(spark, data)).collect()
    assert len(rows) == len(data)
    want = {x[0]: x[2] for x in data}
    outs = [r for r in rows if r.doc_id is not None and r.doc_id < 9000]
    test = [r for r in outs if r.held_out]
    assert len(test) > 100 and sum(r.lang_pred == want[r.doc_id] for r in test) >= 0.95 * len(test)
    assert all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r for r in rows}
    assert [by[d].lang_pred for d in (9000, 9001, 9002)] == ["und"] * 3 and by[9003].lang_pred in ("de", "en", "fr")


def test_train_and_documents_without_languages(spark):
    data = [(i, t, "en") for i, t in enumerate(language("abcdef", 1, 40))]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    assert langid.train(df).order == langid.ORDER
    assert langid.train(df.where(F.lit(False))) is None
    assert {r.lang_pred for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(df.limit(0)).collect() == []


def test_order_is_kept_beyond_the_broadcast(spark):
    data, i = [], 0
    for lang, letters, seed in (("de", "abcdef", 1), ("en", "abcdeg", 2), ("fr", "éabcfg", 3)):
        for t in language(letters, seed, 30):
            data.append((i, t, lang))
            i += 1
    data += [(900, None, "de"), (901, "", "de"), (902, "12 !?", "en"), (None, "abc dzz", None), (903, "", None), data[0]]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    key = lambda r: (r.doc_id is None, r.doc_id, r.lang_pred)
    whole, cut = (sorted(langid.identify(df, **k).collect(), key=key) for k in ({}, {"cells": 900}))
    assert len(cut) == len(data)
    for a, b in zip(whole, cut, strict=True):
        assert (a.doc_id, a.held_out, a.lang_pred) == (b.doc_id, b.held_out, b.lang_pred)
        assert b.bits == pytest.approx(a.bits, rel=1e-4) and b.score == pytest.approx(a.score, rel=1e-3)


def test_a_hundred_languages_keep_order_four_in_bounded_shards(spark, monkeypatch):
    r, data, held = random.Random(40), [], []
    letters = "abcdefghijklmnopqrstuvwxyzéßñö"
    for k in range(100):
        parts = ["".join(r.choice(letters) for _ in range(r.randint(2, 3))) for _ in range(40)]
        say = lambda n: " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(n))  # noqa: B023,E731
        data += [(k * 10 + i, f"l{k:02}", say(60)) for i in range(6)]
    seen, fit = [], langid.fit
    monkeypatch.setattr(langid, "fit", lambda by, order, whole=None: seen.append((order, sum(len(g) for g, _ in by.values()))) or fit(by, order, whole))
    df = spark.createDataFrame(data, "doc_id long, lang string, text string")
    cells = 4_000_000
    rows = langid.identify(df, cells=cells).collect()
    # no shard holds more than the bound, but for a single context character, and none is of a lower order
    assert len(seen) > 1 and all(order == langid.ORDER and n * 100 <= cells for order, n in seen)
    lang = {i: x for i, x, _ in data}
    held = [x for x in rows if x.held_out]
    assert len(rows) == 600 and len(held) > 150
    assert sum(x.lang_pred == lang[x.doc_id] for x in held) / len(held) >= 0.98
