import hashlib
import random
import re
from collections import defaultdict

import public_tokenizers as P
import pytest

from shelfspark.llm import bpe, secret_scan

from . import nasty
from .test_mixing import water
from .test_ngram_join import brute as classes
from .test_quality_rules import brute as counts
from .test_secret_scan import brute as spans

pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    r = random.Random(21)
    out = []
    for i in range(260):
        text = nasty.prose(r, r.randint(55, 160))
        if i % 13 == 0:
            text += ' token = "hunter2hunter2hunter2" ' + nasty.prose(r, 20)
        out.append([i, text, "en", "abc"[i % 3], len(text)])
    for i in range(30):  # copies and near copies
        words = out[i][1].split()
        words[5] = "changed"
        out.append([300 + i, " ".join(words) if i % 2 else out[i][1], "en", "b", len(out[i][1])])
    out += [[400, "###  " * 90, "en", "a", 450], [401, None, None, None, None], [402, "", "en", "a", 0], [403, "and " * 200, "en", "c", 800]]
    out += [[500 + i, " ".join(w + "#$%" for w in nasty.prose(r, 80).split()), "en", "c", 0] for i in range(20)]
    return [tuple(x) for x in out]


def test_each_stage_against_brute_force(spark, tmp_path):
    data = documents()
    spark.createDataFrame(data, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append(docs.collect())
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    # quality: what the base rules or symbols rule out goes, all prose stays
    kept = {x.doc_id for x in seen[0]}
    for i, t, *_ in data:
        n, _, symbols, _, _, repeats = counts(t)
        assert (i in kept) == (n >= 50 and 2 * repeats <= n and symbols < n), i
    # near duplicates: those that name their component
    want = {int(i) for i, _, c in classes([(x.doc_id, x.text) for x in seen[0]]) if int(i) == c}
    assert {x.doc_id for x in seen[1]} == want and len(seen[1]) == len(want) < len(kept)
    # secrets
    before = {x.doc_id: x.text for x in seen[1]}
    for x in seen[2]:
        found = sorted((int(a), int(b)) for _, a, b in (s.split(":") for s in filter(None, spans(before[x.doc_id])[1].split(","))))
        text, upto = "", 0
        for a, b in found:
            if a >= upto:
                text += before[x.doc_id][upto:a] + "[SECRET]"
            upto = max(upto, b)
        assert x.text == text + before[x.doc_id][upto:] and x.n_chars == len(x.text)
    assert any("[SECRET]" in x.text for x in seen[2]) and len(seen[2]) == len(seen[1])
    # mixing: words by source meet their targets, each row a document or its beginning, at most twice
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    whole = {x.doc_id: x.text for x in seen[2]}
    total, got, times = defaultdict(int), defaultdict(int), defaultdict(int)
    for x in seen[2]:
        total[x.source] += size(x.text)
    for x in seen[3]:
        got[x.source] += size(x.text)
        times[x.doc_id] += 1
        assert whole[x.doc_id].startswith(x.text) and x.n_chars == len(x.text)
    assert max(times.values()) <= 2
    for s, t in water(total).items():
        assert abs(got[s] - t) <= 1
    # tokens
    enc = bpe.encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    have = sorted((x.doc_id, x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in seen[4])
    def coded(t):
        ids = enc.encode_ordinary(t)
        return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()
    assert have == sorted((x.doc_id, *coded(x.text)) for x in seen[3])


def test_run_over_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).collect() == []


def test_mixed_rows_come_in_the_order_of_slots(spark, tmp_path):
    r = random.Random(5)
    data = [(i, nasty.prose(r, 700), "en", "ab"[i % 2], 0) for i in range(60)]
    spark.createDataFrame(data, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    rows = pipeline.mixed(spark, docs, str(tmp_path)).collect()
    # both sources from the first rows on, in about the shares of their targets
    share = [sum(x.source == "a" for x in rows[:k]) / k for k in (20, 40, len(rows))]
    assert all(abs(x - share[-1]) < 0.2 for x in share) and len(rows) > 80


def test_nasty_rows_do_not_crash(spark, tmp_path):
    df = nasty.table(spark)  # with columns of clashing names
    df.write.parquet(str(tmp_path / "documents.parquet"))
    rows = pipeline.run(spark, str(tmp_path)).collect()
    assert rows and all(r.n_tokens > 0 for r in rows)
