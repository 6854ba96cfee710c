import numpy as np
import pytest

from shelfspark.llm import embed_dedup as e

SCHEMA = "vec_id long, embedding array<float>, label int, node string, n int"


def brute(data):
    """(vec_id, links, component) by comparing all pairs."""
    vectors = []
    for _, v in data:
        ok = v is not None and len(v) and all(x is not None and np.isfinite(np.float32(x)) for x in v) and any(np.float32(x) for x in v)
        vectors.append(np.array(v, np.float32).astype(float) if ok else None)
    n, parent = len(data), list(range(len(data)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * n
    for i in range(n):
        for j in range(i):
            a, b = vectors[i], vectors[j]
            if a is not None and b is not None and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= e.COSINE:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    out = []
    for i in range(n):
        ids = [d for k, (d, _) in enumerate(data) if find(k) == find(i) and d is not None]
        out.append((str(data[i][0]), links[i], min(ids, default=None)))
    return sorted(out, key=str)


def got(spark, data):
    df = spark.createDataFrame([(i, v, 1, "clash", 2) for i, v in data], SCHEMA)
    rows = e.link(df).collect()
    assert all(x.kept == (x.vec_id == x.component_id) for x in rows)
    return sorted(((str(x.vec_id), x.n_links, x.component_id) for x in rows), key=str)


def test_like_all_pairs(spark):
    r = np.random.default_rng(4)
    data = []
    for g in range(12):
        c = r.normal(size=24)
        for _ in range(int(r.integers(1, 30))):
            data.append((len(data) * 7 % 1000, (c + r.normal(size=24) * r.choice([0.02, 0.15])).tolist()))
    data += [data[0], data[1], (5000, data[0][1]), (5001, [x * 1000 for x in data[0][1]])]
    data += [(6000 + i, v) for i, v in enumerate([None, [], [0.0] * 24, [1.0, None] * 12, [float("nan")] * 24, [float("inf")] + [1.0] * 23, [1.0] * 23, [1.0] * 23, [5.0], [-3.0], [1e-38] * 24])]
    data += [(None, data[2][1]), (None, None)]
    assert got(spark, data) == brute(data)


def test_blocks_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(e, "BLOCK", 40)
    r = np.random.default_rng(5)
    c = r.normal(size=16)
    data = [(i, (c + r.normal(size=16) * 0.12).tolist()) for i in range(200)]
    assert got(spark, data) == brute(data)


def test_empty_table(spark):
    assert got(spark, []) == []


@pytest.mark.parametrize("cosine", [0.95, 0.97, 0.99])
def test_recall_of_buckets(cosine):
    r = np.random.default_rng(6)
    x = e.unit(r.normal(size=(4000, 64)))
    z = r.normal(size=x.shape)
    z = e.unit(z - (z * x).sum(1, keepdims=True) * x)
    a, b = e.buckets(x), e.buckets(cosine * x + np.sqrt(1 - cosine**2) * z)
    assert np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(a, b)]) >= 0.999


def test_transform_keeps_lengths():
    x = np.random.default_rng(7).normal(size=(5, 64))
    assert np.allclose((e.turned(x, 3) ** 2).sum(1), (x**2).sum(1))
    h = e.hadamard(np.eye(8)) * np.sqrt(8)
    assert set(np.unique(h.round(9))) == {-1.0, 1.0} and np.allclose(h @ h.T, 8 * np.eye(8))


def test_more_vectors_get_more_hashes_at_the_same_recall():
    plans = [e.plan(n, 64) for n in (0, 10**3, 10**6, 10**9)]
    assert [h for _, h in plans] == sorted(h for _, h in plans) and plans[-1][1] > plans[0][1] == 2
    for tables, hashes in plans:
        assert 1 - (1 - e.chance(64, hashes)) ** tables >= e.RECALL
        assert 10**9 / 128 ** plans[-1][1] <= e.PER_BUCKET


@pytest.mark.parametrize("hashes", [2, 3])
def test_planned_recall_holds(hashes):
    r = np.random.default_rng(16)
    tables = int(np.ceil(np.log(1 - 0.999) / np.log(1 - e.chance(64, hashes))))
    x = e.unit(r.normal(size=(3000, 64)))
    z = r.normal(size=x.shape)
    z = e.unit(z - (z * x).sum(1, keepdims=True) * x)
    a, b = e.buckets(x, tables, hashes), e.buckets(0.95 * x + np.sqrt(1 - 0.95**2) * z, tables, hashes)
    assert np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(a, b)]) >= 0.997
