import numpy as np
from pyspark.sql import functions as F

from shelfspark.llm import nn_descent as nn

SCHEMA = "vec_id long, embedding array<float>, rank int, node string, score double"


def frame(spark, data):
    return spark.createDataFrame([(i, v, 1, "clash", 0.5) for i, v in data], SCHEMA)


def brute(data, k, every):
    """{query: [(vec_id, score)]} by comparing all rows."""
    rows = []
    for i, v in data:
        ok = v is not None and len(v) and all(x is not None and np.isfinite(np.float32(x)) for x in v) and any(np.float32(x) for x in v)
        if ok:
            rows.append((i, np.array(v, np.float32).astype(float)))
    out = {}
    for n, (i, x) in enumerate(rows):
        if i is not None and i % every == 0:
            scored = [(-float(x @ y), j is None, j) for m, (j, y) in enumerate(rows) if m != n and len(y) == len(x)]
            out[i] = [(j, -s) for s, _, j in sorted(scored, key=lambda z: (z[0], z[1], z[2] or 0))[:k]]
    return out


def got(df):
    out: dict = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        mine = out.setdefault(r.query_id, [])
        mine.append((r.vec_id, r.score))
        assert r["rank"] == len(mine)
    return out


def recall(found, want):
    hits = [sum(s >= w[-1][1] - 1e-9 for _, s in found.get(q, [])) / len(w) for q, w in want.items() if w]
    return np.mean(hits)


def check(spark, data, k=20, every=20, least=0.95):
    found, want = got(nn.nearest(frame(spark, data), F.col("vec_id") % every == 0, k)), brute(data, k, every)
    assert set(found) <= set(want) and all(len(found.get(q, [])) == len(w) for q, w in want.items())
    assert recall(found, want) >= least
    vectors = {i: np.array(v, np.float32).astype(float) for i, v in data if v and all(x is not None for x in v)}
    for q, rows in list(found.items())[:50]:
        assert all(abs(s - vectors[q] @ vectors[j]) < 1e-9 for j, s in rows if j is not None)
    return found, want


def test_groups_and_noise(spark, monkeypatch):
    monkeypatch.setattr(nn, "LEAF", 128)
    monkeypatch.setattr(nn, "GROUP", 64)
    monkeypatch.setattr(nn, "BLOCK", 100)
    monkeypatch.setattr(nn, "ASKING", 20)
    r = np.random.default_rng(3)
    data = [(i, r.normal(size=24).tolist()) for i in range(900)]
    data += [(1000 + 50 * g + j, (c + r.normal(size=24) * 0.2).tolist()) for g, c in enumerate(r.normal(size=(10, 24)) * 2) for j in range(50)]
    check(spark, data)


def test_odd_rows_are_left_out_and_copies_stay(spark):
    r = np.random.default_rng(4)
    data = [(i, r.normal(size=8).tolist()) for i in range(30)]
    data += [(100 + i, data[0][1]) for i in range(40)] + [data[20], (None, data[20][1]), (None, None)]
    data += [(200 + i, v) for i, v in enumerate([None, [], [0.0] * 8, [1.0, None] * 4, [float("nan")] * 8, [float("inf")] + [1.0] * 7, [1.0] * 7, [2.0] * 7, [-0.0] * 7 + [1.0], [0.0] * 7 + [1.0]])]
    found, want = check(spark, data, 5, 20, 1.0)
    assert all([j for j, _ in found[q]] == [j for j, _ in w] for q, w in want.items() if q != 20)
    assert [j for j, _ in found[20]][:2] == [20, None] and [j for j, _ in found[100]] == [0, 101, 102, 103, 104]


def test_lengths_matter(spark, monkeypatch):
    monkeypatch.setattr(nn, "LEAF", 128)
    r = np.random.default_rng(5)
    data = [(i, (r.normal(size=16) * r.lognormal(0, 0.7)).tolist()) for i in range(1200)]
    check(spark, data, 10)


def test_few_rows(spark):
    assert nn.nearest(frame(spark, []), F.col("vec_id") % 20 == 0, 20).collect() == []
    assert nn.nearest(frame(spark, [(0, [1.0, 2.0])]), F.col("vec_id") % 20 == 0, 20).collect() == []
    two = nn.nearest(frame(spark, [(0, [1.0, 2.0]), (1, [3.0, -1.0])]), F.col("vec_id") % 20 == 0, 20).collect()
    assert [tuple(x) for x in two] == [(0, 1, 1, 1.0)]


def test_a_beam_too_narrow_is_widened(spark, monkeypatch):
    monkeypatch.setattr(nn, "LEAF", 64)
    r = np.random.default_rng(6)
    data = [(i, r.normal(size=64).tolist()) for i in range(2000)]
    df, want = frame(spark, data), brute(data, 10, 20)
    narrow = got(nn.nearest(df, F.col("vec_id") % 20 == 0, 10, beam=11, recall=0.0))
    wide = got(nn.nearest(df, F.col("vec_id") % 20 == 0, 10, beam=11, recall=1.0))
    assert recall(wide, want) >= 0.99 and recall(narrow, want) < recall(wide, want)


def test_codes_keep_the_angles():
    x = np.random.default_rng(7).normal(size=(300, 64)) * 1e-30
    y = nn.directions([c.tobytes() for c in nn.coded(x)])
    u = nn.unit(x)
    assert np.abs(y @ y.T - u @ u.T).max() < 0.01


def shuffled(spark):
    """Bytes that all stages so far have shuffled."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._gateway.jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_vectors_travel_a_few_times_only(spark):
    r = np.random.default_rng(8)
    data = [(i, r.normal(size=32).tolist()) for i in range(4000)]
    df, before = frame(spark, data), shuffled(spark)
    found = got(nn.nearest(df, F.col("vec_id") % 20 == 0, 20))
    assert shuffled(spark) - before < 12 * 4000 * 32 * 4
    assert recall(found, brute(data, 20, 20)) >= 0.95


def test_later_cells_send_back_what_is_nearer(spark, monkeypatch):
    for name, value in {"LEAF": 32, "FEW": 1, "WIDER": 2, "ASKING": 16, "SAMPLE": 24}.items():
        monkeypatch.setattr(nn, name, value)
    r = np.random.default_rng(9)
    # two heaps far from each other, rows of several sizes, whole numbers with equal scores, copies
    data = [(i, (r.normal(size=12) + 20 * (i % 2)).tolist()) for i in range(900)] + [(1000 + i, (r.normal(size=12) * r.lognormal(0, 1)).tolist()) for i in range(500)]
    data += [(2000 + i, r.integers(-1, 2, 12).astype(float).tolist()) for i in range(300)] + [(3000 + i, data[40][1]) for i in range(25)]
    check(spark, data)


def test_a_walk_reaches_what_the_graph_does_not():
    r = np.random.default_rng(10)
    mean = r.normal(size=(40, 8)).astype(np.float32)
    alone = nn.Cells(np.arange(40, dtype=np.int32), np.zeros(40, np.int32), mean, np.arange(40, dtype=np.int32)[:, None], np.array([3]), 1)
    x = r.normal(size=(5, 8)).astype(np.float32)
    way = nn.ways(x, np.arange(5), alone, 10)
    assert (way == np.argsort(-(x @ mean.T), axis=1)[:, :10]).all()


def test_sizes_beyond_single_precision(spark):
    r = np.random.default_rng(11)
    data = [(i, (r.normal(size=6) * 10.0 ** r.integers(-25, 25)).astype(np.float32).astype(float).tolist()) for i in range(300)]
    found, want = got(nn.nearest(frame(spark, data), F.col("vec_id") % 20 == 0, 5, recall=1.0)), brute(data, 5, 20)
    assert {q: [j for j, _ in rows] for q, rows in found.items()} == {q: [j for j, _ in w] for q, w in want.items()}
