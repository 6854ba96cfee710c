import hashlib

import numpy as np
import pyarrow as pa

from shelfspark.llm import ngram_join, quality_rules, shared


def thue_morse(n):
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_unlike_strings_do_not_share_a_hash():
    texts = [t for n in (8, 16, 64, 120, 128, 129, 1024, 4096) for t in thue_morse(n)]
    texts += ["a" * n for n in range(1, 300)] + [f"{'x' * n}\x00" for n in range(1, 20)]
    data, offsets = shared.buffers(pa.array(texts))
    h = shared.span_hash(data, offsets[:-1], offsets[1:], lower=False)
    assert len(set(h.tolist())) == len(set(texts)) == len(texts)


def test_case_and_place_do_not_matter():
    data, offsets = shared.buffers(pa.array(["Some WORDS é ß here " + "Q" * 200, None, "", "some words É ß here " + "q" * 200]))
    w = shared.Words(data, offsets, lower=True)
    a, b = w.hash[w.first[0] : w.first[1]], w.hash[w.first[3] : w.first[4]]
    assert [x == y for x, y in zip(a, b)] == [True, True, False, True, True, True]


def test_long_words_keep_documents_apart():
    for n in (1024, 4096):
        a, b = thue_morse(n)
        one, two = ngram_join.sets_of(pa.array([a, b]))
        assert not np.array_equal(one, two)
        counts = dict(zip(quality_rules.COUNTS, quality_rules.count_batch(pa.array([f"{a}\n{b}\n{a} x {b} x {a} x"]))))
        assert counts["n_dup_lines"][0] == 0 and counts["n_lines"][0] == 3
    assert hashlib.sha1(a.encode()).digest() != hashlib.sha1(b.encode()).digest()


def test_shuffles_go_with_the_query_that_made_them(spark):
    """What a checkpointed or written step shuffled does not lie on the executors' disks until the driver collects garbage."""
    from shelfspark.llm import shared

    def shuffled():
        manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        files = manager.getAllFiles()
        return {files.apply(i).getPath() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    before = shuffled()
    held = spark.conf.get(shared.SWEEP)
    rows = spark.range(10_000).repartition(3, "id")
    kept = [shared.durable(rows), shared.stored(rows)]
    assert shuffled() <= before
    assert spark.conf.get(shared.SWEEP) == held
    assert [x.count() for x in kept] == [10_000, 10_000]
    assert rows.count() == rows.count() == 10_000
