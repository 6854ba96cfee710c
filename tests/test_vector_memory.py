"""The vector search multiplies slices, so that its memory depends on neither the block of queries nor the batch."""

import tracemalloc

import numpy as np
import pyarrow as pa

from shelfspark.operators import retrieval as r


class _Rows:
    """As much of a DataFrame as _vector_search asks of it; what it maps over batches is kept."""

    def __init__(self, table):
        self.table = table

    def count(self):
        return self.table.num_rows

    def __getattr__(self, name):
        return lambda *_: self

    def toArrow(self):  # noqa: N802
        return self.table

    def mapInArrow(self, run, _):  # noqa: N802
        self.run = run
        return self


def _table(ids, v, name):
    return pa.table({name: pa.array(ids), "v": pa.array(list(v), pa.list_(pa.float32()))})


def test_slices_of_a_wide_block(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.integers(-2, 3, (10_000, 8)).astype(np.float32)  # few values: many ties
    ids = rng.permutation(10_000)
    queries, vectors = _Rows(_table(np.arange(2_000), x[:2_000], "qid")), _Rows(_table(ids, x, "id"))
    monkeypatch.setattr(r, "top", lambda rows, *_: rows)
    found = r._vector_search(queries, vectors, 10, False)
    batches = vectors.table.combine_chunks().to_batches()
    tracemalloc.start()
    got = pa.Table.from_batches(list(found.run(iter(batches))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6  # all products at once are 160 MB
    want = []
    for i in range(0, 2_000, 97):
        s = x[i].astype(float) @ x.T.astype(float)
        s[ids == i] = -np.inf
        want += [(i, int(ids[j]), s[j]) for j in np.lexsort((ids, -s))[:10]]
    rows = [t for t in zip(*(got.column(c).to_pylist() for c in ("qid", "id", "score")), strict=True) if t[0] % 97 == 0]
    assert rows == want
