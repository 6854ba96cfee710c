"""Near-duplicate embeddings by cross-polytope hashing.

Each table turns a vector by three rounds of random signs and a fast Hadamard
transform and takes the nearest corner of the cross-polytope: the coordinate of
largest size, and its sign. Several such corners, of turns of their own, make a bucket; how many, and
how many tables, follows from the number of vectors and the recall wanted (plan). Each
vector goes to its own bucket and, as probes, to those where one corner is the
runner-up, so that a pair is missed only if it falls apart in all tables.

Vectors that are equal are one node, weighted by their number. The buckets with
the same first node form one group, dealt out as pairs of blocks if it is large;
there every pair is verified by its cosine in double precision. A pair that meets in
several groups counts in the first of them. A block pair sends on the number of
links per node, and no more of the links themselves than join its nodes.

Vectors that are null, empty, zero, or hold null or non-finite components link with
nothing, nor do vectors of different length. Repeated rows are vectors of their own and link with
each other. Only ids that aren't null name components.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .ngram_join import BLOCK, BLOCK_KEYS, _groups, grouped
from .shared import durable, mix, small_batches

#: Least cosine of a link.
COSINE = 0.95
#: Runners-up tried for each corner; vectors in a bucket on average; share of pairs at the least cosine that must meet.
PROBES, PER_BUCKET, RECALL = 2, 64, 1 - 1e-9
#: Tables where no vector says how many there should be.
TABLES = 8
_U = np.uint64


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def turned(x: np.ndarray, seed: int) -> np.ndarray:
    """Rows turned by three rounds of signs, drawn from the seed, and the transform."""
    d = x.shape[1]
    for k in range(3):
        bits = mix(np.arange(d, dtype=_U) + _U((seed * 3 + k + 1) << 32)) >> _U(63)
        x = hadamard(x * (1.0 - 2.0 * bits.astype(float)))
    return x


def buckets(x: np.ndarray, tables: int = TABLES, hashes: int = 2, probes: int = PROBES) -> np.ndarray:
    """The buckets of each row: tables * (1 + hashes * probes) of them, its own before its probes."""
    n, d = x.shape
    wide = np.zeros((n, max(2, 1 << (d - 1).bit_length())))
    wide[:, :d] = x
    out = []
    for t in range(tables):
        corners = []
        for h in range(hashes):
            y = turned(wide, t * hashes + h)
            best = np.argsort(-np.abs(y), axis=1, kind="stable")[:, : probes + 1]
            corners.append(best * 2 + (np.take_along_axis(y, best, axis=1) < 0))
        name = lambda parts, t=t: mix(mix(sum(p.astype(_U) << _U(24 * k) for k, p in enumerate(parts))) + _U(t * 131 + d))
        own = [c[:, 0] for c in corners]
        out.append(name(own))
        for h in range(hashes):
            for p in range(1, min(probes, corners[h].shape[1] - 1) + 1):
                out.append(name([*own[:h], corners[h][:, p], *own[h + 1 :]]))
    return np.stack(out, axis=1)


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column end to end, and the offsets of its rows."""
    at = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False).astype(float)[at[0] : at[-1]], at - at[0]


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _hash(batches: Iterator[pa.RecordBatch], tables: int, hashes: int, probes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        node = batch.column("node").to_numpy()
        values, at = matrix(batch.column("vector"))
        for d in np.unique(np.diff(at)):
            rows = np.flatnonzero(np.diff(at) == d)
            found = buckets(unit(values[at[rows][:, None] + np.arange(d)]), tables, hashes, probes)
            yield pa.RecordBatch.from_arrays([pa.array(found.reshape(-1).view(np.int64)), pa.array(np.repeat(node[rows], found.shape[1]))], ["bucket", "node"])


def _link(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """(a, b, n): n links of node a if b is null, else a link that joins two nodes."""
    for t in _groups(batches, BLOCK_KEYS):
        node, side, weight = (t.column(c).to_numpy() for c in ("node", "side", "weight"))
        values, at = matrix(t.column("vector").combine_chunks())
        leader, across = t.column("leader")[0].as_py(), t.column("i")[0] != t.column("j")[0]
        first = t.column("leaders").combine_chunks()
        lead_at, lead = first.offsets.to_numpy(), first.values.to_numpy()
        mine = [lead[lead_at[k] : lead_at[k + 1]] for k in range(len(node))]
        earlier = [x[x < leader] for x in mine]
        links, root = np.zeros(len(node), np.int64), np.arange(len(node))
        joined: list[tuple[int, int]] = []
        for d in np.unique(np.diff(at)):
            rows = np.flatnonzero(np.diff(at) == d)
            x = unit(values[at[rows][:, None] + np.arange(d)])
            width = max((len(earlier[r]) for r in rows), default=0)
            before = np.full((len(rows), max(width, 1)), leader, np.int64)
            for k, r in enumerate(rows):
                before[k, : len(earlier[r])] = earlier[r]
            for lo in range(0, len(rows), 256):
                near = x[lo : lo + 256] @ x.T >= cosine
                for k in range(near.shape[0]):
                    i = lo + k
                    p = np.flatnonzero(near[k, i + 1 :]) + i + 1
                    p = p[side[rows[p]] != side[rows[i]]] if across else p
                    if len(p):  # not those that meet in an earlier group too
                        e = earlier[rows[i]]
                        again = (before[p][:, :, None] == e[None, None, :]).any(axis=(1, 2)) if len(e) else np.zeros(len(p), bool)
                        p = p[~again]
                    links[rows[i]] += weight[rows[p]].sum()
                    links[rows[p]] += weight[rows[i]]
                    for q in p[root[rows[p]] != root[rows[i]]]:
                        if root[rows[q]] != root[rows[i]]:
                            root[root == root[rows[q]]] = root[rows[i]]
                            joined.append((node[rows[i]], node[rows[q]]))
        some = np.flatnonzero(links)
        a = np.concatenate([node[some], np.array([x for x, _ in joined], np.int64)]).astype(np.int64)
        b = pa.array([None] * len(some) + [int(y) for _, y in joined], pa.int64())
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(np.concatenate([links[some], np.zeros(len(joined), np.int64)]))], ["a", "b", "n"])


@functools.lru_cache(64)
def chance(d: int, hashes: int, cosine: float = COSINE, probes: int = PROBES, pairs: int = 2_000) -> float:
    """The share of pairs at that cosine that meet in one table, measured on pairs drawn from a seed."""
    r = np.random.default_rng(17)
    x, y = r.standard_normal((pairs, d)), r.standard_normal((pairs, d))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.maximum(np.sqrt((y * y).sum(axis=1, keepdims=True)), 1e-300)
    one, two = buckets(x, 1, hashes, probes), buckets(cosine * x + np.sqrt(1 - cosine**2) * y, 1, hashes, probes)
    return float((one[:, :, None] == two[:, None, :]).any(axis=(1, 2)).mean())


def plan(n: int, d: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """(tables, hashes) for n vectors of d components.

    There are so many hashes that a bucket holds PER_BUCKET vectors on average if they fall
    evenly, two at least, and so many tables that the share of pairs at the least cosine that meet is the recall.
    """
    corners = 2 * max(2, 1 << (d - 1).bit_length())
    hashes = max(2, math.ceil(math.log(max(n / PER_BUCKET, 1)) / math.log(corners)))
    p = chance(d, hashes, cosine)
    return (math.ceil(math.log(1 - recall) / math.log(1 - p)) if 0 < p < 1 else TABLES), hashes


def block_pairs(members: DataFrame) -> DataFrame:
    """Deal rows (leader, node) out as pairs of blocks: each row once for each block that its own is paired with."""
    sizes = members.groupBy("leader").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks"))
    m = members.join(sizes, "leader").withColumn("side", F.pmod(F.xxhash64("node", F.lit(7)), F.col("_blocks")).cast("int"))
    m = m.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return m.withColumn("i", F.least("side", "_other")).withColumn("j", F.greatest("side", "_other")).drop("_blocks", "_other")


def link(vectors: DataFrame, cosine: float = COSINE, tables: int | None = None, hashes: int | None = None, probes: int = PROBES) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of rows (vec_id, embedding). Tables and hashes that aren't given come from plan()."""
    small_batches(vectors.sparkSession, 4000)
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = F.coalesce((F.size("vector") > 0) & finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    v = durable(v.withColumn("good", good).withColumn("vector", F.when(F.col("good"), F.transform("vector", lambda x: x + F.lit(0.0)))).withColumn("node", F.when(F.col("good"), F.xxhash64("vector"))))
    nodes = durable(v.where("good").groupBy("node").agg(F.first("vector").alias("vector"), F.count("*").alias("weight"), F.min("vec_id").alias("least")))
    if tables is None or hashes is None:
        size = nodes.agg(F.count("*").alias("n"), F.percentile_approx(F.size("vector"), 0.5).alias("d")).first()
        planned = plan(size["n"], size["d"], cosine) if size["n"] else (TABLES, 2)
        tables, hashes = tables or planned[0], hashes or planned[1]
    met = durable(nodes.select("node", "vector").mapInArrow(lambda b: _hash(b, tables, hashes, probes), "bucket long, node long"))
    # two reduced keys for each bucket, so that a bucket of many vectors is no task's alone
    first = met.groupBy("bucket").agg(F.min("node").alias("leader"), F.max("node").alias("_last")).where("leader <> _last")
    met = durable(met.join(first.select("bucket", "leader"), "bucket").select("leader", "node").distinct())
    # a node has as many groups as buckets at most
    leaders = met.groupBy("node").agg(F.sort_array(F.collect_set("leader")).alias("leaders"))
    rows = block_pairs(met.select("leader", "node")).join(nodes.select("node", "vector", "weight").join(leaders, "node"), "node")
    rows = grouped(rows.withColumn("fp", F.col("node"))).select(*BLOCK_KEYS, "side", "node", "weight", "vector", "leaders")
    found = durable(rows.mapInArrow(lambda b: _link(b, cosine), "a long, b long, n long"))
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    roots = components(found.where("b IS NOT NULL").select("a", "b"))
    named = nodes.select("node", "weight", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").join(counts, "node", "left").select("node", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    out = v.where("good").select("vec_id", "node").join(named, "node").select("vec_id", "n_links", "component_id")
    alone = v.where("NOT good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
