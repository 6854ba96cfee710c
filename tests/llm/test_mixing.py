import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from shelfspark.llm import mixing

from . import nasty


def water(sizes, share=1.5, weights=(5, 2, 1)):
    """Targets by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(w[s] for s in open_)
        full = {s for s in open_ if left * w[s] / total > 2 * sizes[s]}
        if not full:
            return out | {s: left * w[s] / total for s in open_}
        for s in full:
            out[s] = 2 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


@pytest.mark.parametrize("block", [16, 2048])
def test_targets_and_words(spark, block):
    df = nasty.table(spark).select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), "rank")
    placed, taken = mixing.mix(df.drop("rank"), block=block)
    rows = mixing.taken_words(placed, taken).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(r["size"] for r in rows) == sorted(count(x[1]) for x in nasty.rows())
    sizes, got = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += r["size"]
        got[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r["size"]
    want = water(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for s in sizes:
        assert abs(got[s] - want[s]) <= 1
    again = mixing.taken_words(*mixing.mix(df.drop("rank"), block=block)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_slots_are_a_permutation_evenly_spread(spark):
    plan = spark.createDataFrame([("a", 5000.0, 1), ("b", 2500.0, 2), (None, 10.0, 3)], "source string, target double, _place int")
    slots = mixing.schedule(plan, 10).collect()
    by = defaultdict(list)
    for s in sorted(slots, key=lambda x: x.slot):
        assert s["rank"] == len(by[s.source])
        by[s.source].append(s.slot)
    assert {k: len(v) for k, v in by.items()} == {"a": 500, "b": 250, None: 1}
    assert len({s.slot for s in slots}) == 751
    gaps = [y - x for x, y in zip(by["a"], by["a"][1:])]
    assert max(gaps) <= 4


@pytest.mark.parametrize("targets", [(5000.0, 2500.0, 10.0), (70.0, 9000.0, 333.0, 1.0), (40960.0,)])
def test_any_stretch_of_slots_holds_the_sources_in_proportion(spark, targets):
    plan = spark.createDataFrame([(f"s{i}", t, i + 1) for i, t in enumerate(targets)], "source string, target double, _place int")
    slots = mixing.schedule(plan, 10).collect()
    bits = mixing.slot_bits(plan, 10)
    blocks = {f"s{i}": -(-round(t) // 10) for i, t in enumerate(targets)}
    assert len(slots) == sum(blocks.values()) and all(0 <= x.slot < 1 << bits for x in slots)
    for source, n in blocks.items():
        mine = sorted(x.slot for x in slots if x.source == source)
        for k, at in enumerate(mine):
            assert abs(k - n * at / 2**bits) <= bits + 1


def test_documents_are_read_in_slot_order(spark):
    # the result depends on the schedule: the first slot of each document is that of the block where it begins
    df = spark.createDataFrame([(i, "ab"[i % 2], 37) for i in range(200)], "doc_id long, source string, size long")
    placed, taken = mixing.mix(df, block=16)
    rows = mixing.taken_words(placed, taken).collect()
    slots = {(x.source, x["rank"]): x.slot for x in mixing.schedule(mixing.targets(df.groupBy("source").agg(F.sum("size").alias("source_size"))), 16).collect()}
    for x in rows:
        assert x.first_slot == (slots[x.source, x.begin // 16] if x.taken else None)
        assert (x.n_runs == 0) == (x.taken == 0) and x.n_runs <= 8
    assert len({x.first_slot for x in rows if x.taken}) > 100


def test_empty_and_wordless(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, size long")
    assert mixing.taken_words(*mixing.mix(empty)).collect() == []
    none = spark.createDataFrame([(1, "a", 0), (2, None, 0)], "doc_id long, source string, size long")
    assert [(r.target, r.taken) for r in mixing.taken_words(*mixing.mix(none)).collect()] == [(0.0, 0), (0.0, 0)]
