"""Approximate nearest neighbours by inner product: NN-descent builds a graph of cells, queries walk it.

Rows near each other share a cell of about LEAF of them: distinct vectors are dealt to the cell of the nearest centre, which
are fitted on a sample of about SAMPLE rows a cell, first within groups of cells, then among all (vectors of other lengths, or of other
sizes, have their own). A product of two blocks costs less than moving one row, so a node of the graph is a cell.

Every cell starts with its best neighbours among those that share a leaf with its centre, a leaf being the signs of some
random projections. Then, round by round, the neighbours of each node and a sample of the nodes that it is a neighbour of
meet: a join brings their centres to the node, every pair with a link that is new since the last round is compared, and
whoever gains by it keeps its LINKS best. It ends when few links are new. While the graph is built, directions count, not
lengths, and a component travels as one byte.

A query starts at its own cell, at a few cells drawn by chance and at those of the longest means. Each step looks at the
neighbours of the best `beam` cells known, until none of these is new. The query is then sent, once, to each group that holds some
of these cells, and there compared with all of their rows: screened by a product of blocks, then scored in
double precision. The first cells tell how near the k best are at least, so that later ones send back few rows. PROBES queries are compared with
all vectors, and the beam is as wide as it takes to find RECALL of their nearest.

Vectors that are null, empty, zero, or hold null or non-finite components take no part; vectors meet those of their own
length only. Repeated rows are candidates of their own (a query's own row is left out once), and a row without an
id may be found but asks nothing. Equal scores go by the smaller id, nulls last.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .embed_dedup import matrix, unit
from .shared import mix, small_batches, stored

#: Neighbours of a node, and how many of the nodes that it is a neighbour of it meets besides.
LINKS, BACK = 32, 16
#: Partitions of space that first neighbours come from, and the nodes of a leaf, or rows of a cell.
TREES, LEAF = 8, 1_024
#: Rounds end when a smaller share of links is new, or after so many.
SETTLED, ROUNDS = 0.1, 8
#: Nodes whose links, or queries whose nearest, one group of a task keeps; queries that walk, and rows that are compared with queries, at once; queries
#: that meet a group of cells in one task at least.
GROUP, BLOCK, ASKING = 512, 1_024, 2_048
#: Cells that a query visits at least; queries compared with all vectors, and the share of their nearest that must be found.
BEAM, PROBES, RECALL = 8, 64, 0.95
#: Cells drawn by chance, and those of the longest means, at which every query starts.
STARTS = 8
#: Rows of a cell, and of a group, that centres are fitted on; turns of the fit within a group, and among all cells. Beyond so many cells, or components of their centres, which go along with the
#: tasks, cells hold more rows.
SAMPLE, TURNS, MOVES, CELLS, COMPONENTS = 48, 10, 3, 16_384, 1 << 22
#: Groups up to which queries go to all of their cells at once; otherwise they go to so many times as many as before.
FEW, WIDER = 8, 16


@dataclass(frozen=True)
class Graph:
    """nodes (node, vector), rows (vec_id, node) of good vectors, links (node, near); size: number of nodes."""

    nodes: DataFrame
    rows: DataFrame
    links: DataFrame
    size: int


def group_of(node: str, size: int, each: int) -> Column:
    """The group of about so many nodes; nodes are hashes, so their remainders are even."""
    return F.pmod(F.col(node), F.lit(max(1, math.ceil(size / each)))).cast("int")


def _by_length(values: np.ndarray, at: np.ndarray):
    """(rows, matrix) for each length of vector."""
    sizes = np.diff(at)
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield rows, values[at[rows][:, None] + np.arange(d)]


def coded(x: np.ndarray) -> np.ndarray:
    """Directions in one byte a component; comparing them is right to about a thousandth."""
    x = unit(x)
    return np.rint(x * (127 / np.abs(x).max(axis=1, keepdims=True))).astype(np.int8)


def _codes(batches):
    for batch in batches:
        values, at = matrix(batch.column("vector"))
        codes: list = [b""] * batch.num_rows
        for rows, x in _by_length(values, at):
            for r, c in zip(rows, coded(x), strict=True):
                codes[r] = c.tobytes()
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(codes, pa.binary())], ["node", "code"])


def directions(codes: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(codes), np.int8).reshape(len(codes), -1).astype(np.float32)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _leaves(batches, depth: int):
    for batch in batches:
        codes = batch.column("code").to_pylist()
        sizes = np.array([len(c) for c in codes])
        for d in np.unique(sizes):
            rows = np.flatnonzero(sizes == d)
            x = directions([codes[r] for r in rows])
            for t in range(TREES):
                planes = np.random.default_rng([t, d]).standard_normal((d, depth)).astype(np.float32)
                sign = (x @ planes > 0) @ (1 << np.arange(depth, dtype=np.int64))
                leaf = (sign.astype(np.int64) * TREES + t) * 65_536 + d
                yield pa.RecordBatch.from_arrays([pa.array(leaf), batch.column("node").take(pa.array(rows))], ["leaf", "node"])


def best_of(a: np.ndarray, b: np.ndarray, s: np.ndarray, fresh: np.ndarray, k: int):
    """The k best links a -> b of each a, each once, an old one before a fresh one."""
    o = np.lexsort((fresh, b, a))
    o = o[np.concatenate([[True], (a[o][1:] != a[o][:-1]) | (b[o][1:] != b[o][:-1])])] if len(o) else o
    o = o[np.lexsort((b[o], -s[o], a[o]))]
    first = np.searchsorted(a[o], a[o], "left")
    return o[np.arange(len(o)) - first < k]


def _meet(table: pa.Table, k: int) -> pa.Table:
    """(a, b, s): links that a leaf's nodes gain from each other."""
    node, codes = table.column("node").to_numpy(), table.column("code").to_pylist()
    x, out = directions(codes), []
    for lo in range(0, len(node), 256):
        s = x[lo : lo + 256] @ x.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -2
        near = np.argpartition(-s, min(k, len(node) - 1) - 1, axis=1)[:, : min(k, len(node) - 1)] if len(node) > 1 else np.zeros((len(s), 0), int)
        out.append((np.repeat(node[lo : lo + 256], near.shape[1]), node[near].ravel(), np.take_along_axis(s, near, axis=1).ravel()))
    return _links(*(np.concatenate([o[i] for o in out]) for i in range(3)))


def _links(a: np.ndarray, b: np.ndarray, s: np.ndarray) -> pa.Table:
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "s": pa.array(s, pa.float32())})


def _join(table: pa.Table, k: int) -> pa.Table:
    """(a, b, s): links that nodes gain that meet at some of this group's centers."""
    centre = table.column("centre").to_numpy()
    o = np.argsort(centre, kind="stable")
    centre, member, fresh, floor = (table.column(c).to_numpy()[o] for c in ("centre", "member", "fresh", "floor"))
    codes = table.column("code").take(pa.array(o)).to_pylist()
    sizes = np.array([len(c) for c in codes])
    a, b, s = [], [], []
    for d in np.unique(sizes):
        mine = np.flatnonzero(sizes == d)
        x = directions([codes[i] for i in mine])
        starts = np.flatnonzero(np.concatenate([[True], centre[mine][1:] != centre[mine][:-1]]))
        many = np.diff(np.append(starts, len(mine)))
        for lo in range(0, len(starts), 64):
            n = many[lo : lo + 64]
            at = starts[lo : lo + 64][:, None] + np.minimum(np.arange(n.max()), n[:, None] - 1)
            there = np.arange(n.max()) < n[:, None]
            g = np.matmul(x[at], x[at].transpose(0, 2, 1))
            ids, new = member[mine][at], fresh[mine][at]
            good = there[:, :, None] & there[:, None, :] & (new[:, :, None] | new[:, None, :]) & (ids[:, :, None] != ids[:, None, :])
            c, i, j = np.nonzero(good & (g > floor[mine][at][:, :, None]))
            a.append(ids[c, i])
            b.append(ids[c, j])
            s.append(g[c, i, j])
    a, b, s = (np.concatenate(z) if z else np.zeros(0) for z in (a, b, s))
    keep = best_of(a, b, s, np.zeros(len(a)), k)
    return _links(a[keep], b[keep], s[keep])


def _keep(held: pa.Table, gained: pa.Table, k: int) -> pa.Table:
    """(node, near, s, fresh) with the k best of the links that a node holds and gains."""
    node = held.column("node").to_numpy()
    lists = [held.column(c).combine_chunks() for c in ("near", "s")]
    many = np.diff(lists[0].offsets.to_numpy())
    a = np.concatenate([np.repeat(node, many), gained.column("a").to_numpy()])
    b = np.concatenate([lists[0].flatten().to_numpy(), gained.column("b").to_numpy()])
    s = np.concatenate([lists[1].flatten().to_numpy(), gained.column("s").to_numpy()])
    fresh = np.arange(len(a)) >= many.sum()
    keep = best_of(a, b, s, fresh, k)
    node = np.sort(node)
    at = pa.array(np.append(np.searchsorted(a[keep], node), len(keep)).astype(np.int32))
    columns = [pa.ListArray.from_arrays(at, pa.array(x[keep])) for x in (b, s.astype(np.float32), fresh)]
    return pa.table([pa.array(node), *columns], ["node", "near", "s", "fresh"])


GRAPH = "node long, near array<long>, s array<float>, fresh array<boolean>"


def meetings(graph: DataFrame, turn: int) -> DataFrame:
    """(centre, member, fresh): the neighbours of each node, and BACK of those that it is a neighbour of, drawn by hash."""
    out = graph.select(F.col("node").alias("centre"), F.explode(F.arrays_zip("near", "fresh")).alias("x")).select("centre", F.col("x.near").alias("member"), F.col("x.fresh").alias("fresh"))
    back = out.select(F.col("member").alias("centre"), F.col("centre").alias("member"), "fresh")
    drawn = F.row_number().over(W.partitionBy("centre").orderBy(F.xxhash64("member", F.lit(turn)), "member"))
    return out.unionByName(back.withColumn("turn", drawn).where(F.col("turn") <= BACK).drop("turn"))


def build(vectors: DataFrame, k: int = LINKS) -> Graph:
    """The neighbour graph of rows (vec_id, embedding)."""
    small_batches(vectors.sparkSession, 4000)
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    v = v.where(F.coalesce((F.size("vector") > 0) & finite & F.exists("vector", lambda x: x != 0), F.lit(False)))
    v = v.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))  # no -0.0
    v = stored(v.withColumn("node", F.xxhash64("vector")))
    nodes = stored(v.groupBy("node").agg(F.first("vector").alias("vector")))
    size = nodes.count()
    codes = stored(nodes.mapInArrow(_codes, "node long, code binary"))
    depth = max(0, math.ceil(math.log2(max(size, 1) / LEAF)))
    leaves = stored(codes.mapInArrow(lambda b: _leaves(b, depth), "leaf long, node long"))
    # a leaf that is too large is dealt out by hash
    parts = leaves.groupBy("leaf").agg(F.ceil(F.count("*") / LEAF).cast("int").alias("parts"))
    met = leaves.join(parts, "leaf").withColumn("part", F.pmod(F.xxhash64("node", "leaf"), F.col("parts")).cast("int")).join(codes, "node")
    gained = met.groupBy("leaf", "part").applyInArrow(lambda t: _meet(t, k), "a long, b long, s float")
    empty = codes.select("node", F.array().cast("array<long>").alias("near"), F.array().cast("array<float>").alias("s"))

    def kept(graph: DataFrame, gained: DataFrame) -> DataFrame:
        held = graph.select("node", "near", "s").groupBy(group_of("node", size, GROUP).alias("g"))
        return stored(held.cogroup(gained.groupBy(group_of("a", size, GROUP).alias("g"))).applyInArrow(lambda x, y: _keep(x, y, k), GRAPH))

    graph = kept(empty, gained)
    for turn in range(ROUNDS if size > LEAF else 0):  # a single leaf has compared all
        share = graph.agg(F.sum(F.size(F.filter("fresh", lambda x: x))).alias("new"), F.sum(F.size("near")).alias("all")).first()
        if not share["new"] or share["new"] < SETTLED * share["all"]:
            break
        floor = F.when(F.size("near") >= k, F.array_min("s")).otherwise(F.lit(-2.0)).cast("float")
        known = codes.join(graph.select("node", floor.alias("floor")), "node").withColumnRenamed("node", "member")
        rows = meetings(graph, turn).join(known, "member").withColumn("g", group_of("centre", size, GROUP))
        graph = kept(graph, rows.groupBy("g").applyInArrow(lambda t: _join(t, k), "a long, b long, s float"))
    links = meetings(graph, ROUNDS).groupBy(F.col("centre").alias("node")).agg(F.collect_set("member").alias("near"))
    return Graph(nodes, v.select("vec_id", "node"), stored(links), size)


# ----------------------------------------------------------------- rows in cells


def packed(x: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    at = np.arange(len(x) + 1, dtype=np.int32) * np.int32(x.shape[1] * x.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(x))])


def unpacked(column, dtype) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of bytes end to end, and the offsets of its rows."""
    column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.large_binary())
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if at is not None else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.frombuffer(data.tobytes(), dtype), (at - at[0]) // np.dtype(dtype).itemsize


def _hashed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of doubles."""
    h = np.full(len(x), x.shape[1], np.uint64)
    for c in np.ascontiguousarray(x, float).view(np.uint64).T:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) ^ c)
    return h.view(np.int64)


KEPT = "vec_id long, node long, d int, band int, vector binary"


def _kept(batches, dtype: str):
    """Good vectors, with the band of their size, which is a factor of 1.4 wide."""
    for batch in batches:
        column = batch.column("embedding")
        at, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype(dtype)
        sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(at), 0)
        for d in np.unique(sizes[sizes > 0]):
            rows = np.flatnonzero(sizes == d)
            x = flat[at[rows][:, None] + np.arange(d)] + np.dtype(dtype).type(0)  # no -0.0
            good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            rows, x = rows[good], x[good]
            most = np.abs(x).max(axis=1, keepdims=True).astype(float) if len(x) else np.ones((0, 1))
            band = np.rint(2 * np.log2(most[:, 0]) + np.log2(((x / most) ** 2).sum(axis=1))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rows)), pa.array(_hashed(x)), pa.array(np.full(len(x), d, np.int32)), pa.array(band), packed(x)], ["vec_id", "node", "d", "band", "vector"])


def _drawn(batches, rates: dict, salt: int):
    """A share of the nodes of each (d, band), by hash."""
    for batch in batches:
        at = mix(batch.column("node").to_numpy().view(np.uint64) ^ np.uint64(salt)) / 2.0**64
        kind = zip(batch.column("d").to_pylist(), batch.column("band").to_pylist(), strict=True)
        yield batch.filter(pa.array(at < np.array([rates[x] for x in kind], float)))


def centres(x: np.ndarray, k: int) -> np.ndarray:
    """k centres of directions."""
    r = np.random.default_rng(k)
    c = x[r.permutation(len(x))[:k]]
    for _ in range(TURNS if len(x) > k else 0):
        near = nearest_of(x, c)
        o = np.argsort(near, kind="stable")
        some, first = np.unique(near[o], return_index=True)
        c = c.copy()
        sums = np.add.reduceat(x[o], first, axis=0)
        fine = (sums != 0).any(axis=1)
        c[some[fine]] = unit(sums[fine])
    return c


def nearest_of(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmax(x[lo : lo + 256] @ c.T, axis=1) for lo in range(0, len(x), 256)]) if len(x) else np.zeros(0, np.int64)


def _dealt(batches, dtype: str, places: dict, groups: np.ndarray | None):
    """Each row with the number of its place: {(d, band): (numbers, centres)}; g, or cell and the g of these."""
    for batch in batches:
        values, at = unpacked(batch.column("vector"), dtype)
        band, place = batch.column("band").to_numpy(), np.zeros(batch.num_rows, np.int32)
        for rows, x in _by_length(values, at):
            x = unit(x.astype(float)).astype(np.float32)
            for b in np.unique(band[rows]):
                mine = np.flatnonzero(band[rows] == b)
                numbers, c = places[x.shape[1], int(b)]
                place[rows[mine]] = numbers[nearest_of(x[mine], c)]
        more = {"g": place} if groups is None else {"g": groups[place], "cell": place}
        yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, more.values())], [*batch.schema.names, *more])


def _split(table: pa.Table, dtype: str, each: dict) -> pa.Table:
    """The centres of a group's cells, and the means of the rows that are nearest to them."""
    kind = table.column("d")[0].as_py(), table.column("band")[0].as_py()
    order = np.argsort(table.column("node").to_numpy())
    values, _ = unpacked(table.column("vector"), dtype)
    raw = values.reshape(table.num_rows, -1)[order].astype(float)
    x = unit(raw).astype(np.float32)
    c = centres(x, max(1, math.ceil(len(x) / each[kind])))
    near = nearest_of(x, c)
    some, where = np.unique(near, return_inverse=True)
    o = np.argsort(where, kind="stable")
    means = np.add.reduceat(raw[o], np.searchsorted(where[o], np.arange(len(some))), axis=0) / np.bincount(where)[:, None]
    g = pa.array(np.full(len(some), table.column("g")[0].as_py(), np.int32))
    return pa.table([g, packed(c[some].astype(np.float32)), packed(means.astype(np.float32))], ["g", "centre", "mean"])


def _mean(batches, dtype: str):
    """The mean of each cell's rows in a partition that holds all of them, in order."""
    rows = pa.Table.from_batches(batches)
    if rows.num_rows:
        cell = rows.column("cell").to_numpy()
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        values, at = unpacked(rows.column("vector"), dtype)
        ends = np.append(first[1:], len(cell))
        means = [values[at[a] : at[b]].reshape(b - a, -1).mean(axis=0, dtype=float).astype(np.float32).tobytes() for a, b in zip(first, ends, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(cell[first]), pa.array(means, pa.binary())], ["cell", "mean"])


@dataclass(frozen=True)
class Cells:
    """What a query of d components needs to walk: numbers, groups and mean of its cells, their neighbours (places, own where there are fewer), and where to start."""

    number: np.ndarray
    group: np.ndarray
    mean: np.ndarray
    links: np.ndarray
    starts: np.ndarray
    least: int


@dataclass(frozen=True)
class Index:
    """nodes (node, id, many, vector, g, cell), rows (vec_id, node), cells by length of vector; the numbers of nodes and groups, and the type of components."""

    nodes: DataFrame
    rows: DataFrame
    cells: dict[int, Cells]
    size: int
    groups: int
    dtype: str


def index(vectors: DataFrame, k: int) -> Index:
    """Rows (vec_id, embedding) in cells, with the graph of these."""
    spark = vectors.sparkSession
    small_batches(spark, 4000)
    dtype = "float32" if dict(vectors.dtypes)["embedding"] == "array<float>" else "float64"
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if dtype == "float32" else "array<double>").alias("embedding"))
    v = stored(v.mapInArrow(lambda b: _kept(b, dtype), KEPT))
    count = {(r["d"], r["band"]): r["n"] for r in v.groupBy("d", "band").agg(F.count("*").alias("n")).collect()}
    leaf = max([LEAF, sum(count.values()) / CELLS, *[sum(n for (e, _), n in count.items() if e == d) * d / COMPONENTS for d in {d for d, _ in count}]])
    many = {kind: math.ceil(n / leaf) for kind, n in count.items()}
    rates = {kind: min(1.0, max(SAMPLE * many[kind], 256) / n) for kind, n in count.items()}
    sample = stored(v.mapInArrow(lambda b: _drawn(b, rates, 1), KEPT).dropDuplicates(["node"]))
    # groups are fitted here, on at most SAMPLE rows each; their cells in a task for each group
    parts = {kind: max(1, round(math.sqrt(n))) for kind, n in many.items()}
    fewer = {kind: min(1.0, max(SAMPLE * parts[kind], 256) / max(1.0, rates[kind] * n)) for kind, n in count.items()}
    some = sample.mapInArrow(lambda b: _drawn(b, fewer, 2), KEPT).select("node", "d", "band", "vector").toArrow().sort_by("node")
    values, at = unpacked(some.column("vector"), dtype)
    d, band = some.column("d").to_numpy(), some.column("band").to_numpy()
    groups, n = {}, 0
    for kind in sorted(count):
        rows = np.flatnonzero((d == kind[0]) & (band == kind[1]))
        x = unit(values[at[rows][:, None] + np.arange(kind[0])].astype(float)) if len(rows) else np.eye(1, kind[0])
        c = centres(x.astype(np.float32), parts[kind])
        groups[kind] = np.arange(n, n + len(c), dtype=np.int32), c
        n += len(c)
    each = {kind: leaf * rates[kind] for kind in count}
    placed = sample.mapInArrow(lambda b: _dealt(b, dtype, groups, None), KEPT + ", g int")
    found = placed.groupBy("g").applyInArrow(lambda t: _split(t, dtype, each), "g int, centre binary, mean binary").toArrow()
    mine: dict = {}
    for g, c, m in zip(*(found.column(x).to_pylist() for x in ("g", "centre", "mean")), strict=True):
        mine.setdefault(g, []).append((np.frombuffer(c, np.float32), np.frombuffer(m, np.float32)))
    of, group, mean, centre, places = [], [], [], [], {}
    for kind, (numbers, c) in groups.items():
        first = len(of)
        for g, own in zip(numbers.tolist(), c, strict=True):
            # no row of the sample is in this group: its own centre is that of its cell
            lists = mine.get(g) or [(own, (own * 2.0 ** (kind[1] / 2)).astype(np.float32))]
            of += [kind[0]] * len(lists)
            group += [g] * len(lists)
            centre += [x for x, _ in lists]
            mean += [m for _, m in lists]
        places[kind] = np.arange(first, len(of), dtype=np.int32), np.stack(centre[first:])
    group = np.array(group, np.int32)
    # rows may be nearer to a cell of another group: centres follow the rows that are nearest among all
    for _ in range(MOVES if n > FEW else 0):
        dealt = sample.mapInArrow(lambda b, places=places: _dealt(b, dtype, places, group), KEPT + ", g int, cell int")
        for r in dealt.select("cell", "vector").repartition("cell").sortWithinPartitions("cell").mapInArrow(lambda b: _mean(b, dtype), "cell int, mean binary").toArrow().to_pylist():
            m = np.frombuffer(r["mean"], np.float32)
            if m.any():
                mean[r["cell"]], centre[r["cell"]] = m, unit(m[None].astype(float))[0].astype(np.float32)
        places = {kind: (numbers, np.stack([centre[c] for c in numbers])) for kind, (numbers, _) in places.items()}
    nodes = v.groupBy("node").agg(F.first("d").alias("d"), F.first("band").alias("band"), F.min("vec_id").alias("id"), F.count("*").alias("many"), F.first("vector").alias("vector"))
    nodes = stored(nodes.mapInArrow(lambda b: _dealt(b, dtype, places, group), "node long, d int, band int, id long, many long, vector binary, g int, cell int"))
    held = np.zeros(len(of), np.int64)
    for r in nodes.groupBy("cell").agg(F.count("*").alias("n")).collect():
        held[r["cell"]] = r["n"]
    near = neighbours(spark, centre, of)
    out = {}
    for d in sorted(set(of)):
        number = np.flatnonzero((np.array(of) == d) & (held > 0)).astype(np.int32)
        if not len(number):
            continue
        place = np.full(len(of), -1, np.int32)
        place[number] = np.arange(len(number))
        lists = [[p for p in place[near[c]].tolist() if p >= 0] or [int(place[c])] for c in number]
        links = np.stack([np.resize(np.array(x, np.int32), max(map(len, lists))) for x in lists])
        m = np.stack([mean[c] for c in number])
        first = np.union1d(np.random.default_rng(0).permutation(len(number))[:STARTS], np.argsort(-(m.astype(float) ** 2).sum(axis=1), kind="stable")[:STARTS])
        # so many cells hold more than k rows, whichever they are
        least = int(np.searchsorted(np.cumsum(np.sort(held[number])), k + 1)) + 1
        out[d] = Cells(number, group[number], m, links, first, least)
    return Index(nodes, v.select("vec_id", "node"), out, int(held.sum()), n, dtype)


def neighbours(spark, centre: list[np.ndarray], of: list[int]) -> list[np.ndarray]:
    """The numbers of each cell's neighbours in the graph of their centres; where there are few cells, all others."""
    if len(centre) <= LINKS + 1:
        return [np.array([j for j, e in enumerate(of) if e == d and j != i], np.int64) for i, d in enumerate(of)]
    rows = pa.table({"vec_id": pa.array(range(len(centre)), pa.int64()), "embedding": pa.array(centre, pa.list_(pa.float32()))})
    graph = build(spark.createDataFrame(rows))
    at = graph.rows.toArrow()
    cells: dict = {}
    for c, node in zip(at.column("vec_id").to_pylist(), at.column("node").to_pylist(), strict=True):
        cells.setdefault(node, []).append(c)
    near = {r["node"]: r["near"] for r in graph.links.collect()}
    out = [np.zeros(0, np.int64)] * len(centre)
    for node, mine in cells.items():
        for c in mine:
            out[c] = np.array([x for y in [node, *near.get(node, [])] for x in cells[y] if x != c], np.int64)
    return out


# ----------------------------------------------------------------- queries


def ways(x: np.ndarray, home: np.ndarray, cells: Cells, width: int) -> np.ndarray:
    """The places of the `width` cells (all, if fewer) that each query visits, the most promising first."""
    n, m = len(x), len(cells.number)
    width = min(max(width, cells.least), m)
    with np.errstate(over="ignore", invalid="ignore"):
        every = np.nan_to_num(x.astype(np.float32) @ cells.mean.T, neginf=-3e38)
    if width == m:
        return np.argsort(-every, axis=1, kind="stable").astype(np.int32)
    s, opened = np.full((n, m), -np.inf, np.float32), np.zeros(n * m, bool)
    seen = (np.arange(n)[:, None] * m + np.append(np.broadcast_to(cells.starts, (n, len(cells.starts))), home[:, None], axis=1)).ravel()
    while True:
        s.ravel()[seen] = every.ravel()[seen]
        pool = np.argpartition(-s, width - 1, axis=1)[:, :width]
        at = (np.arange(n)[:, None] * m + pool).ravel()
        at = at[~opened[at] & ~np.isneginf(s.ravel()[at])]
        if not len(at):
            break
        opened[at] = True
        seen = (at[:, None] + (cells.links[at % m] - (at % m)[:, None])).ravel()
    # the graph may be in pieces
    lost = np.flatnonzero((~np.isneginf(s)).sum(axis=1) < width)
    if len(lost):
        s[lost] = every[lost]
        pool = np.argpartition(-s, width - 1, axis=1)[:, :width]
    order = np.argsort(-np.take_along_axis(s, pool, axis=1), axis=1, kind="stable")
    return np.take_along_axis(pool, order, axis=1).astype(np.int32)


def _walk(batches, dtype: str, cells: dict[int, Cells], width: int):
    """(q, vector, ways) of queries (node, vector, cell)."""
    for batch in batches:
        values, at = unpacked(batch.column("vector"), dtype)
        home = batch.column("cell").to_numpy()
        for rows, x in _by_length(values, at):
            c = cells[x.shape[1]]
            step = max(1, min(BLOCK, (1 << 22) // len(c.number), (1 << 22) // (width * c.links.shape[1])))
            for lo in range(0, len(rows), step):
                some = rows[lo : lo + step]
                way = ways(x[lo : lo + step], np.searchsorted(c.number, home[some]), c, width)
                yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(some)), packed(x[lo : lo + step]), packed(way.astype(np.uint16))], ["q", "vector", "ways"])


ASKED = "g int, q long, vector binary, floor double, cells array<int>"


def _asked(batches, dtype: str, cells: dict[int, Cells], lo: int, hi: int):
    """Queries (q, vector, ways, floor), once for each group that holds some of the cells from lo to hi on their way."""
    for batch in batches:
        way, ends = unpacked(batch.column("ways"), np.uint16)
        sizes = np.diff(unpacked(batch.column("vector"), dtype)[1])
        for start in range(0, batch.num_rows, 256):
            part = np.arange(start, min(start + 256, batch.num_rows))
            row, g, cell = [], [], []
            for d in np.unique(sizes[part]):
                rows, c = part[sizes[part] == d], cells[d]
                first = lo if lo == 0 else max(lo, c.least)
                w = way[ends[rows][:, None] + np.arange(ends[rows[0] + 1] - ends[rows[0]])][:, first : max(hi, c.least)].astype(np.int64)
                row.append(np.repeat(rows, w.shape[1]))
                g.append(c.group[w].ravel())
                cell.append(c.number[w].ravel())
            row, g, cell = np.concatenate(row), np.concatenate(g), np.concatenate(cell)
            if not len(row):
                continue
            o = np.lexsort((cell, g, row))
            row, g, cell = row[o], g[o], cell[o]
            at = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (g[1:] != g[:-1])]))
            lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(row)).astype(np.int32)), pa.array(cell.astype(np.int32)))
            take = pa.array(row[at])
            yield pa.RecordBatch.from_arrays([pa.array(g[at].astype(np.int32)), *[batch.column(c).take(take) for c in ("q", "vector", "floor")], lists], ["g", "q", "vector", "floor", "cells"])


def _first(q: np.ndarray, s: np.ndarray, i: np.ndarray, k: int) -> np.ndarray:
    """The places of the k best of each q, equal scores by id."""
    o = np.lexsort((i, -s, q))
    return o[np.arange(len(o)) - np.searchsorted(q[o], q[o], "left") < k]


NONE = np.iinfo(np.int64).max
FOUND = "q long, near array<long>, id array<long>, score array<double>"


def _lists(q: np.ndarray, b: np.ndarray, i: np.ndarray, s: np.ndarray) -> pa.Table:
    """One row for each q, which are in order."""
    some, at = np.unique(q, return_index=True)
    at = pa.array(np.append(at, len(q)).astype(np.int32))
    return pa.table([pa.array(some, pa.int64()), *[pa.ListArray.from_arrays(at, pa.array(x, t)) for x, t in ((b, pa.int64()), (i, pa.int64()), (s, pa.float64()))]], ["q", "near", "id", "score"])


def _visit(asked: pa.Table, block: pa.Table, dtype: str, k: int) -> pa.Table:
    """The k best of the rows of the cells that each query asks for, if they reach its floor."""
    none = np.zeros(0, np.int64)
    if not asked.num_rows or not block.num_rows:
        return _lists(none, none, none, np.zeros(0))
    o = np.argsort(block.column("cell").to_numpy(), kind="stable")
    cell, node, ids = (block.column(c).to_numpy()[o] for c in ("cell", "node", "id"))
    x = unpacked(block.column("vector"), dtype)[0].reshape(len(o), -1)[o]
    y, q, floor = unpacked(asked.column("vector"), dtype)[0].reshape(asked.num_rows, -1), asked.column("q").to_numpy(), asked.column("floor").to_numpy().copy()
    asks = asked.column("cells").combine_chunks()
    of, row = asks.flatten().to_numpy(), np.repeat(np.arange(len(q)), np.diff(asks.offsets.to_numpy()))
    o = np.argsort(of, kind="stable")
    of, row = of[o], row[o]
    # where single precision could overflow, products are double too
    sizes = np.concatenate([np.abs(z).max(axis=1) for z in (x, y)])
    if dtype == "float32" and (sizes.min() < 1e-9 or sizes.max() > 1e9):
        x, y = x.astype(float), y.astype(float)
    slack = 0.0 if x.dtype == float else 3e-7 * x.shape[1]
    long_x, long_y = (np.sqrt(np.einsum("ij,ij->i", z, z, dtype=float)) for z in (x, y))
    got: list = []
    tile = np.empty(512 * BLOCK, x.dtype)
    for c in np.unique(of):
        rows, first, last = row[np.searchsorted(of, c) : np.searchsorted(of, c, "right")], np.searchsorted(cell, c), np.searchsorted(cell, c, "right")
        for lo in range(first, last, BLOCK):
            there = slice(lo, min(lo + BLOCK, last))
            for at in range(0, len(rows), 512):
                r = rows[at : at + 512]
                s = np.matmul(y[r], x[there].T, out=tile[: len(r) * (there.stop - lo)].reshape(len(r), -1))
                loose = slack * long_y[r] * long_x[there].max()
                above = s >= (floor[r] - loose)[:, None].astype(s.dtype)
                if s.shape[1] > k and np.count_nonzero(above) > 2 * k * len(r):
                    best = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                    floor[r] = np.maximum(floor[r], best - loose)
                    above = s >= (floor[r] - loose)[:, None].astype(s.dtype)
                i, j = np.divmod(np.flatnonzero(above), s.shape[1])  # numpy finds places in two dimensions four times slower
                j += lo
                exact = np.empty(len(i))
                for part in range(0, len(i), 16_384):
                    p = slice(part, part + 16_384)
                    exact[p] = np.einsum("ij,ij->i", y[r[i[p]]].astype(float), x[j[p]].astype(float))
                i = r[i]
                fine = exact >= floor[i]
                i, j, exact = i[fine], j[fine], exact[fine]
                if len(i) > 2 * k * len(r):
                    keep = _first(i, exact, ids[j], k)
                    i, j, exact = i[keep], j[keep], exact[keep]
                got.append((i, j, exact))
    i, j, s = (np.concatenate([g[n] for g in got]) for n in range(3)) if got else (none, none, np.zeros(0))
    i = q[i]
    keep = _first(i, s, ids[j], k)
    return _lists(i[keep], node[j[keep]], ids[j[keep]], s[keep])


def _merge(held: pa.Table, gained: pa.Table, k: int) -> pa.Table:
    """The k best of what queries held and gained."""
    columns = []
    for t in (held, gained):
        lists = [t.column(c).combine_chunks() for c in ("near", "id", "score")]
        columns.append([np.repeat(t.column("q").to_numpy(), np.diff(lists[0].offsets.to_numpy())), *[x.flatten().to_numpy() for x in lists]])
    q, b, i, s = (np.concatenate(x) for x in zip(*columns, strict=True))
    keep = _first(q, s, i, k)
    return _lists(q[keep], b[keep], i[keep], s[keep])


def _exact(batches, dtype: str, q: np.ndarray, x: list[np.ndarray], k: int):
    """The k best scores of a few queries within a task's vectors but their own, and the cells of these."""
    best = [(np.zeros(0), np.zeros(0, np.int32))] * len(q)
    for batch in batches:
        values, at = unpacked(batch.column("vector"), dtype)
        node, cell = batch.column("node").to_numpy(), batch.column("cell").to_numpy()
        for rows, m in _by_length(values, at):
            mine = [i for i, y in enumerate(x) if len(y) == m.shape[1]]
            scores = m.astype(float) @ np.array([x[i] for i in mine], float).reshape(len(mine), m.shape[1]).T
            for n, i in enumerate(mine):
                other = node[rows] != q[i]
                s, c = np.concatenate([best[i][0], scores[other, n]]), np.concatenate([best[i][1], cell[rows][other]])
                o = np.argsort(-s, kind="stable")[:k]
                best[i] = s[o], c[o]
    if len(q):
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q, [len(s) for s, _ in best])), *[pa.array(np.concatenate([b[n] for b in best])) for n in range(2)]], ["q", "score", "cell"])


def wide(known: Index, queries: DataFrame, k: int, beam: int, recall: float) -> int:
    """How many cells have to be visited so that PROBES queries, drawn by hash, find the share `recall` of their k nearest of all nodes."""
    some = queries.orderBy(F.xxhash64("node")).limit(PROBES).toArrow()
    q, home = some.column("node").to_numpy(), some.column("cell").to_numpy()
    values, at = unpacked(some.column("vector"), known.dtype)
    vectors, dtype = [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], known.dtype
    found = known.nodes.mapInArrow(lambda b: _exact(b, dtype, q, vectors, k), "q long, score double, cell int")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score")))).where(F.col("rank") <= k).select("q", "cell").collect()
    where: dict = {}
    for r in ranked:
        where.setdefault(r["q"], []).append(r["cell"])
    most = max(len(c.number) for c in known.cells.values())
    while True:
        got = 0
        for rows, x in _by_length(values, at):
            c = known.cells[x.shape[1]]
            for r, way in zip(rows, ways(x, np.searchsorted(c.number, home[rows]), c, beam), strict=True):
                got += int(np.isin(where.get(int(q[r]), []), c.number[way]).sum())
        if got >= recall * len(ranked) or beam >= most:
            return min(beam, most)
        beam = math.ceil(beam * 1.15)


def search(known: Index, queries: DataFrame, k: int, beam: int = BEAM, recall: float = RECALL) -> DataFrame:
    """(q, node, id, score): the k best nodes found for each query (node, vector, cell), its own among them."""
    dtype, cells, size = known.dtype, known.cells, queries.count()
    if not size:
        return known.nodes.select(F.col("node").alias("q"), "node", "id", F.lit(0.0).alias("score")).limit(0)
    width = wide(known, queries, k - 1, beam, recall)
    asking = stored(queries.select("node", "vector", "cell").mapInArrow(lambda b: _walk(b, dtype, cells, width), "q long, vector binary, ways binary"))
    held = None
    # a group's rows are sent to as many tasks as its queries outweigh them
    parts = math.ceil(size / max(ASKING, 6 * known.size / known.groups))
    nodes = known.nodes.select("g", "node", F.coalesce("id", F.lit(NONE)).alias("id"), "cell", "vector").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    lo, hi = 0, width if known.groups <= FEW else min(width, max(2, width // (2 * WIDER * WIDER)))
    while lo < width:
        if held is None:
            turn = asking.withColumn("floor", F.lit(float("-inf")))
        else:
            floor = F.when(F.size("score") >= k, F.array_min("score")).otherwise(F.lit(float("-inf")))
            turn = asking.join(held.select("q", floor.alias("floor")), "q", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        left = turn.mapInArrow(lambda b, lo=lo, hi=hi: _asked(b, dtype, cells, lo, hi), ASKED).withColumn("part", F.pmod(F.xxhash64("q"), F.lit(parts)).cast("int"))
        gained = left.groupBy("g", "part").cogroup(nodes.groupBy("g", "part")).applyInArrow(lambda x, y: _visit(x, y, dtype, k), FOUND)
        before = held if held is not None else gained.limit(0)
        group = group_of("q", size, GROUP).alias("h")
        held = stored(before.groupBy(group).cogroup(gained.groupBy(group)).applyInArrow(lambda x, y: _merge(x, y, k), FOUND))
        lo, hi = hi, width if hi * WIDER * 2 >= width else hi * WIDER
    return held.select("q", F.explode(F.arrays_zip("near", "id", "score")).alias("x")).select("q", F.col("x.near").alias("node"), F.col("x.id").alias("id"), F.col("x.score").alias("score"))


def nearest(vectors: DataFrame, asking: Column, k: int, beam: int = BEAM, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row (vec_id, embedding) that is asking, by a condition on vec_id."""
    known = index(vectors, k)
    who = known.rows.where(asking).where("vec_id IS NOT NULL").distinct()
    queries = known.nodes.join(who.select("node").distinct(), "node", "left_semi")
    found = search(known, queries, k + 1, beam, recall)
    # of a vector that several rows have, the k + 1 smallest ids are enough, of which one may be the query's own
    copies = known.rows.join(known.nodes.where("many > 1").select("node"), "node", "left_semi")
    turn = F.row_number().over(W.partitionBy("node").orderBy(F.asc_nulls_last("vec_id")))
    ids = copies.withColumn("turn", turn).where(F.col("turn") <= k + 1).groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "vec_id"))), lambda x: x["vec_id"]).alias("ids"))
    some = found.join(ids, "node", "left").withColumn("ids", F.coalesce("ids", F.array(F.when(F.col("id") != NONE, F.col("id")))))
    rows = who.withColumnRenamed("vec_id", "query_id").withColumnRenamed("node", "q").join(some, "q")
    own = F.when(F.col("node") == F.col("q"), F.array_position("ids", F.col("query_id")) - 1).otherwise(-1)
    rows = rows.select("query_id", "q", "score", own.alias("own"), F.posexplode("ids").alias("pos", "vec_id")).where(F.col("pos") != F.col("own"))
    rank = F.row_number().over(W.partitionBy("query_id", "q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
