import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from shelfspark.llm import importance as im
from shelfspark.llm import terms
from . import nasty

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, target, n=3, buckets=10_000, percent=5, least=20):
    def feats(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(x for _, text in docs for x in feats(text)), Counter(x for text in target for x in feats(text))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        f = feats(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[x] for x in f)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("percent", [5, 40, 100])
def test_like_brute_force(spark, percent):
    data = nasty.rows() * 4
    target = ["one two three", None, "", nasty.rows()[6][1]]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    assert got(im.resample(nasty.table(spark, data), bench, percent)) == brute([r[:2] for r in data], target, percent=percent)


def test_empty_tables(spark):
    none, some = nasty.table(spark, []), nasty.table(spark)
    assert im.resample(none, some).collect() == []
    assert got(im.resample(some, none)) == brute([r[:2] for r in nasty.rows()], [])


def test_ring_and_stretches(monkeypatch):
    text = nasty.prose(__import__("random").Random(5), 400).encode()
    whole = text.split(b" ")
    want = [zlib.crc32(b" ".join(whole[i - k + 1 : i + 1])) for i in range(400) for k in range(1, 5) if i - k + 1 >= 0]
    assert list(im.ring(iter(whole), 4)) == want
    for step in (1, 7, 100, 10**6):
        lists = list(terms.runs(text, step))
        assert [w for part in lists for w in part] == whole
        monkeypatch.setattr(im, "runs", lambda data, step=step: terms.runs(data, step))
        for n in (1, 2, 4):
            found = list(im.features(text, n, 1 << 32))
            assert sum(k for k, _ in found) == 400
            assert [x for _, part in found for x in part.tolist()] == list(im.ring(iter(whole), n))


def test_ranks_over_many_parts(spark):
    from pyspark.sql import functions as F

    rows = spark.range(5000).select((F.col("id") % 7).alias("score"), (F.col("id") % 100).alias("doc_id"))
    ranked = im.first_ranked(rows, [F.desc("score"), F.asc_nulls_last("doc_id")], 1234).collect()
    assert sorted(r["rank"] for r in ranked) == list(range(1, 1235))
    want = sorted(((r.score, r.doc_id) for r in rows.collect()), key=lambda x: (-x[0], x[1]))[:1234]
    assert [(r.score, r.doc_id) for r in sorted(ranked, key=lambda r: r["rank"])] == want


def test_target_words_raise_the_weight(spark):
    data = [(i, " ".join(["red", "green", "blue"] * 10 if i % 2 else ["one", "two", "six"] * 10)) for i in range(200)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    bench = spark.createDataFrame([("red green blue " * 5,)], "text string")
    drawn = im.resample(docs, bench).where("rank IS NOT NULL").collect()
    assert len(drawn) == 10 and all(r.doc_id % 2 for r in drawn)
