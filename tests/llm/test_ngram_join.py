import random
import re

import numpy as np
import pyarrow as pa
import pytest

from shelfspark.llm import ngram_join
from shelfspark.llm.components import components

from . import nasty

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(data):
    """(doc_id, set size, component) of each row, by comparing all pairs."""
    sets, parent = [shingle_set(t) for _, t in data], list(range(len(data)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(data):
        ids = [d for k, (d, _) in enumerate(data) if find(k) == find(i) and d is not None]
        out.append((str(doc), len(sets[i]), min(ids, default=None)))
    return sorted(out, key=str)


def got(spark, data):
    df = spark.createDataFrame(data, "doc_id long, text string")
    return sorted(((str(x.doc_id), x.n_shingles, x.component_id) for x in ngram_join.join(df).collect()), key=str)


def test_nasty_rows(spark):
    data = [x[:2] for x in nasty.rows()]
    assert got(spark, data) == brute(data)


def test_chains_and_short_texts(spark):
    r = random.Random(8)
    data, text = [], nasty.prose(r, 120).split()
    for i in range(60):  # each a little further from the first
        text[r.randrange(len(text))] = f"w{i}"
        data.append((1000 - i, " ".join(text)))
    for i in range(120):
        data.append((2000 + i, " ".join(r.choice("abc") for _ in range(r.randint(1, 9)))))
    assert got(spark, data) == brute(data)


def test_empty_table(spark):
    assert got(spark, []) == []


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 20, 63, 64, 96, 300, 2000])
def test_similar_sets_share_a_signature(n):
    r = np.random.default_rng(n)
    cost = np.zeros(1 << ngram_join.COST_BITS, np.int64)
    cost[r.integers(0, len(cost), 60_000)] = r.integers(1, 6, 60_000)
    by = ngram_join.Allocation(cost)
    for k in range(60):
        a = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
        if k % 3 == 0:  # thrown together into few segments
            a = np.unique((a >> np.uint64(5)) | np.uint64(0xA8 << 56))
        drop = int(r.integers(0, len(a) // 4 + 1))
        add = int(r.integers(0, max(1, (4 * (len(a) - drop) - 3 * len(a)) // 3 + 1)))
        b = np.unique(np.concatenate([r.permutation(a)[drop:], r.integers(0, 2**64, add, dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        x, y = ngram_join.signatures(a, by), ngram_join.signatures(b, by)
        if both and 4 * both >= 3 * (len(a) + len(b) - both):
            assert len(np.intersect1d(x, y))


def test_seven_shingles_in_one_segment():
    by = ngram_join.Allocation(np.zeros(1 << ngram_join.COST_BITS, np.int64))
    a = np.arange(7, dtype=np.uint64) + np.uint64(5)
    for k in range(7):
        b = np.delete(a, k)
        assert len(np.intersect1d(ngram_join.signatures(a, by), ngram_join.signatures(b, by)))


def test_allocation_weighs_costs_in_every_band():
    r = np.random.default_rng(1)
    even = ngram_join.allocate(np.zeros(1 << ngram_join.COST_BITS, np.int64))
    assert set(even[3:]) == {-1}  # contents alone are cheapest where nothing is common
    steep = np.where(r.random(1 << ngram_join.COST_BITS) < 0.3, 0, 6)
    assert (ngram_join.allocate(steep)[14:20] >= 0).all()  # neighbourhoods of cheap segments rather than dear segments


def test_large_groups_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    r = random.Random(3)
    base, data = nasty.prose(r, 80).split(), []
    for i in range(90):  # two clusters that share many shingles but do not link, and stragglers at the ends of chains
        words = list(base)
        if i % 2:
            words[30:62] = nasty.prose(random.Random(1), 32).split()
        for _ in range(i % 4):
            words[r.randrange(len(words))] = f"w{i}"
        data.append((i, " ".join(words)))
    assert got(spark, data) == brute(data)


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5)]
    roots = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({roots[i] for i in range(301)}) == 1 and len({roots[1000 + i] for i in range(300)}) == 1 and roots[0] != roots[1000]
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_sets_are_shuffled_in_turns_and_hashes_in_parts(spark, monkeypatch):
    for name, value in (("PART_LEAST", 0), ("TURN_LEAST", 3000), ("SET_SHARE", 1 << 40), ("BLOCK", 8)):
        monkeypatch.setattr(ngram_join, name, value)
    turns, held = [], ngram_join.key_filter
    monkeypatch.setattr(ngram_join, "key_filter", lambda keys: turns.append(1) or held(keys))
    r = random.Random(12)
    base, data = nasty.prose(r, 80).split(), []
    for i in range(40):
        words = list(base)
        for _ in range(i % 4):
            words[r.randrange(len(words))] = f"w{i}"
        data.append((i, " ".join(words)))
    assert got(spark, data) == brute(data) and len(turns) > 2


def test_a_row_on_both_sides_is_no_partner_of_its_own():
    s = np.unique(np.random.default_rng(2).integers(0, 2**64, 50, dtype=np.uint64))
    columns = [[7, 7], [-1, -1], [0, 0], [-1, 0], [5, 5], [len(s)] * 2, [ngram_join.sketch(s)] * 2]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [*ngram_join.BLOCK_KEYS, "side", "fp", "n", "sketch"])
    assert list(ngram_join._prune(iter([batch]))) == []
