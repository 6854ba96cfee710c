"""Exact Jaccard self-join of n-gram sets by partition of the universe.

Two sets r and s with Jaccard similarity of at least 3/4 differ in at most
(|r| + |s|) / 7 elements. The universe of shingles is cut by hash into
segments, twice as many in each band of sizes as in the one below. Each set
is looked at in its own band and, if it can link with sets of the next band, in that
one too, so that any pair that can link shares a band. There, H is the most that
the set can differ from a partner.

A segment of a set can absorb one difference less than its value: value 1 means
that its content is indexed as it is, so that it must be equal; value 2, for two elements
or more, that the contents with one element left out are indexed besides, so that it may differ in one
element. If all segments of a linked pair differed by their values or more, they would
differ in more than H elements once the values add up to H + 1. So each set
indexes segments in one common order until their values exceed H, and a linked
pair meets in the first segment that both have within its value.

Order and values are allocated by cost: segments with common shingles, as counted over all
documents, come last and are hardly ever indexed; and in each band the neighbourhoods of
one deletion are used for segments up to that cost at which what all sets of the band together
index is expected to be cheapest (allocate).

A set whose segments hold too little value (the hash threw too many of its elements together) is
indexed again by another hash, and so is any that could link with such a set: as a
difference changes the value by one at most, that is each set whose value exceeds H by no more than H.
Both of a pair go on from hash to hash like that until neither lacks value, and meet there.

Documents with the same set are one node. Nodes that share an indexed content
are candidates. The contents with the same first node are taken together as
one group, so that pairs which share many contents are looked at once. Groups of more than
a block are compared with one block of theirs first; as only components
matter, just the nodes that this did not connect with most of the group are then compared
with all of it. Within a block pair, a bound on the overlap, from
the hash ranges that hold shingles of either, rules most pairs out; only for nodes that have
a partner left are the sets themselves fetched, and compared exactly unless the two are
connected already. A block pair sends on no more links than join its nodes.

Null and empty texts have empty sets and link with nothing. Rows are never
dropped; repeated rows and rows with a null id are members like others, but
only ids name components. Columns of the input other than id and text are not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import components
from .shared import Words, buffers, durable, mix, pieces, shingles, small_batches

#: Words in a shingle, and the least similarity.
SHINGLE, SIMILARITY = 5, Fraction(3, 4)
#: Bits of a shingle's hash by which shingles are counted for the cost of segments.
COST_BITS = 17
#: Tasks that add up the counts of all.
COUNT_TASKS = 32
#: A band of sets of up to 2^(b + 1) elements has 2^(b + SEGMENT_BITS) segments.
SEGMENT_BITS = 2
#: Parts in which hashes are shuffled where there are more shingles than so many.
PARTS, PART_LEAST = 2, 1 << 24
#: Of all shingles the share, one in so many, that is shuffled at once to be compared; but so many at least.
SET_SHARE, TURN_LEAST = 4, 1 << 24
#: Distinct sets that a task keeps in mind so as not to index them again.
SEEN = 1 << 20
_U = np.uint64


def sets_of(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, at = shingles(Words(*buffers(texts), lower=True), size)
    out = []
    for i in range(len(texts)):
        s = np.sort(h[at[i] : at[i + 1]])
        out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s)
    return out


def fingerprint(s: np.ndarray) -> int:
    """A 64-bit hash of a set, signed."""
    return int(mix(np.array([(mix(s ^ _U(0x5DEECE66D))).sum(dtype=_U) + _U(len(s))], _U)).view(np.int64)[0])


def _summary(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_key, n, fp) for each document and, at the end, one row with the counts of shingles by hash."""
    counts = np.zeros(1 << COST_BITS, np.int64)
    names = ["doc_id", "text_key", "n", "fp", "sketch", "counts"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32())]
    for batch in pieces(batches, "text"):
        sets = sets_of(batch.column("text"), size)
        for s in sets:
            counts += np.bincount((s >> _U(64 - COST_BITS)).astype(np.int64), minlength=len(counts))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array([len(s) for s in sets], pa.int64()), pa.array([fingerprint(s) for s in sets], pa.int64()), pa.array([sketch(s) for s in sets], pa.binary()), pa.nulls(len(sets), kinds[5])], names)
    if counts.any():
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, k) for k in kinds[:5]), pa.array([np.minimum(counts, 2**31 - 1).astype(np.int32)], kinds[5])], names)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of counts: the sum of all."""
    total = np.zeros(1 << COST_BITS, np.int64)
    for batch in batches:
        for row in batch.column(0):
            total += row.values.to_numpy()
    yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.int64()))], ["counts"])


def levels(counts: np.ndarray) -> np.ndarray:
    """The cost of each hash range: 0 for the usual, more for each doubling beyond."""
    usual = max(float(np.median(counts)), 1.0)
    return np.maximum(np.ceil(np.log2(np.maximum(counts, 1) / usual / 1.5)), 0).astype(np.int64)


def bands(n: int) -> list[tuple[int, int, int]]:
    """(band, H, the most H of a partner) of a set of n elements in each band where it can meet a partner."""
    out = []
    for band in (n.bit_length() - 1, n.bit_length()):
        top = 2 ** (band + 1) - 1
        if band == n.bit_length() - 1 or 4 * n // 3 >= 2**band:
            most = lambda k, top=top: (k + min(4 * k // 3, top)) // 7
            out.append((band, most(n), most(min(4 * n // 3, top))))
    return out


def allocate(cost: np.ndarray) -> np.ndarray:
    """For each band, the highest cost of segments whose neighbourhoods of one deletion are indexed; -1 for none.

    Reckoned for a set in the middle of the band whose elements fall evenly: segments are
    gone through by rising cost until their values reach H + 1, each indexed content counting 2^cost.
    """
    out = []
    for band in range(40):
        bits = band + SEGMENT_BITS
        level = cost.reshape(1 << bits, -1).max(axis=1) if bits < COST_BITS else cost
        n = 1.5 * 2**band
        need = (n + min(4 * n / 3, 2 ** (band + 1) - 1)) / 7 + 1
        rate = n / 2**bits
        one, some = rate * np.exp(-rate), 1 - np.exp(-rate)
        more = some - one
        # values and contents of a segment on average, without and with neighbourhoods
        plain, deep = (some, some), (one + 2 * more, some + rate - one)
        share = np.bincount(level) / len(level) * 2**bits
        best = (np.inf, -1)
        for limit in range(-1, len(share)):
            left, total = need, 0.0
            for c, many in enumerate(share):
                value, rows = deep if c <= limit else plain
                part = min(1.0, left / (value * many)) if many else 0.0
                left, total = left - part * value * many, total + part * rows * many * 2.0**c
                if left <= 1e-9:
                    break
            best = min(best, (total + max(left, 0) * 2.0 ** len(share) * 4, limit))
        out.append(best[1])
    return np.array(out)


def _indexed(s: np.ndarray, band: int, most: int, level: np.ndarray | None, limit: int, seed: int) -> tuple[list[np.ndarray], int]:
    """The hashes under which a set is indexed in a band, and the value of all its segments."""
    bits = band + SEGMENT_BITS
    segment = (s >> _U(64 - bits)).astype(np.int64)
    start = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
    size = np.diff(np.append(start, len(s)))
    element = mix(s + _U(band + 1))
    total = np.add.reduceat(element, start)
    which = segment[start]
    if level is None:
        cost = np.zeros(len(which), np.int64)
    else:
        cost = level[which >> (bits - COST_BITS)] if bits >= COST_BITS else level[which]
    value = np.where((size >= 2) & (cost <= limit), 2, 1)
    order = np.argsort(cost, kind="stable")
    upto = np.cumsum(value[order])
    order = order[: int(np.searchsorted(upto, most, "right")) + 1]
    tag = mix(which[order].astype(_U) + _U(((band + 1) << 40) + (seed << 48)))
    out = [mix(total[order] ^ tag)]
    for i in np.flatnonzero(value[order] == 2):
        k = order[i]
        out.append(mix((total[k] - element[start[k] : start[k] + size[k]]) ^ tag[i]))
    return out, int(upto[-1])


class Allocation:
    """Costs of segments by band, and up to which of them neighbourhoods are used."""

    def __init__(self, cost: np.ndarray):
        self.limit = allocate(cost)
        self.level = {band: cost.reshape(1 << (band + SEGMENT_BITS), -1).max(axis=1) if band + SEGMENT_BITS < COST_BITS else cost for band in range(40)}


def signatures(s: np.ndarray, by: Allocation) -> np.ndarray:
    """The hashes under which a set is indexed."""
    out = []
    for band, most, other in bands(len(s)):
        seed, value = 0, 0
        while value <= most + other:
            turned = np.sort(mix(s ^ _U(seed))) if seed else s
            level, limit = (by.level[band], int(by.limit[band])) if not seed else (None, 0)
            some, value = _indexed(turned, band, most, level, limit, seed)
            out += some
            seed += 1
    return np.unique(np.concatenate(out))


def _index(batches: Iterator[pa.RecordBatch], size: int, by: Allocation, part: int = 0, parts: int = 1) -> Iterator[pa.RecordBatch]:
    """(sig, fp) for each distinct set and each hash under which it is indexed, of one part of the hashes."""
    seen: set[int] = set()
    for batch in pieces(batches, "text"):
        sig, fp = [], []
        for s in sets_of(batch.column("text"), size):
            if len(s) and (f := fingerprint(s)) not in seen:
                seen.add(f)
                some = signatures(s, by)
                some = some[some % _U(parts) == part]
                sig.append(some.view(np.int64))
                fp.append(np.full(len(some), f, np.int64))
        if len(seen) > SEEN:
            seen.clear()
        if sig:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sig)), pa.array(np.concatenate(fp))], ["sig", "fp"])


def sketch(s: np.ndarray) -> bytes:
    """Which of 2 n to 4 n hash ranges, 64 at least, hold elements: a bit each."""
    bits = max(len(s).bit_length() + 1, 6)
    held = np.zeros(1 << bits, bool)
    held[(s >> _U(64 - bits)).astype(np.int64)] = True
    return np.packbits(held).tobytes()


def similar(na: np.ndarray, nb: np.ndarray, overlap: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes with this overlap link."""
    return overlap * SIMILARITY.denominator >= (na + nb - overlap) * SIMILARITY.numerator


def survivors(n: np.ndarray, fp: np.ndarray, side: np.ndarray, sketches: list[bytes], across: bool) -> Iterator[tuple[int, np.ndarray]]:
    """For each row, the later rows that sizes and sketches leave as partners; across: of the other side only.

    A range that holds elements of one set and none of the other stands for an element that they don't share.
    """
    width = np.array([len(x) for x in sketches])
    order = np.lexsort((np.arange(len(n)), -width))
    table: dict[int, np.ndarray] = {}
    for w in set(width.tolist()):
        table[w] = np.zeros((len(n), w // 8), _U)
        for v in set(width[width >= w].tolist()):  # finer ranges are put together
            some = np.flatnonzero(width == v)
            bits = np.frombuffer(b"".join(sketches[k] for k in some), np.uint8).reshape(len(some), v)
            if v > w:
                bits = np.packbits(np.unpackbits(bits, axis=1).reshape(len(some), w * 8, v // w).any(axis=2), axis=1)
            table[w][some] = bits.view(_U)
    for k, i in enumerate(order):
        rest = order[k + 1 :]
        if across:
            rest = rest[(side[rest] != side[i]) & (fp[rest] != fp[i])]  # an outer row is on either side
        rest = rest[similar(n[i], n[rest], np.minimum(n[i], n[rest]))]
        if not len(rest):
            continue
        fine = np.zeros(len(rest), bool)
        for w in set(width[rest].tolist()):
            some = np.flatnonzero(width[rest] == w)
            one, others = table[w][i], table[w][rest[some]]
            both = np.minimum(n[i] - np.bitwise_count(one & ~others).sum(axis=1, dtype=np.int64), n[rest[some]] - np.bitwise_count(others & ~one).sum(axis=1, dtype=np.int64))
            fine[some] = similar(n[i], n[rest[some]], both)
        if fine.any():
            yield int(i), rest[fine]


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Rows that follow each other with the same keys, as one table each."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[lo] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.Table.from_batches(held)


BLOCK_KEYS = ("leader", "i", "j")


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of block pairs that have a partner left."""
    for t in _groups(batches, BLOCK_KEYS):
        n, fp, side = (t.column(c).to_numpy() for c in ("n", "fp", "side"))
        alive = np.zeros(len(n), bool)
        for i, partners in survivors(n, fp, side, t.column("sketch").to_pylist(), t.column("i")[0] != t.column("j")[0]):
            alive[i] = True
            alive[partners] = True
        if alive.any():
            yield from t.select([*BLOCK_KEYS, "side", "fp"]).filter(pa.array(alive)).combine_chunks().to_batches()


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) that connect the rows of each block pair as all its links do."""
    for t in _groups(batches, BLOCK_KEYS):
        column = t.column("set").combine_chunks()
        at = column.offsets.to_numpy()
        values = column.values.to_numpy()
        n = np.diff(at)
        _, ids = np.unique(values[at[0] : at[-1]], return_inverse=True)
        at = at - at[0]
        members = [ids[at[k] : at[k + 1]] for k in range(len(n))]
        sketches = [sketch(values[at[k] + column.offsets[0].as_py() : at[k + 1] + column.offsets[0].as_py()].view(_U)) for k in range(len(n))]
        fp, side = t.column("fp").to_numpy(), t.column("side").to_numpy()
        mark, root = np.zeros(int(ids.max(initial=0)) + 1, bool), np.arange(len(n))
        a, b = [], []
        for i, partners in survivors(n, fp, side, sketches, t.column("i")[0] != t.column("j")[0]):
            partners = partners[root[partners] != root[i]]
            if not len(partners):
                continue
            mark[members[i]] = True
            total = np.add.reduceat(mark[np.concatenate([members[k] for k in partners])].astype(np.int64), np.concatenate([[0], np.cumsum(n[partners])[:-1]]))
            mark[members[i]] = False
            for k in partners[similar(n[i], n[partners], total)]:
                if root[k] != root[i]:
                    root[root == root[k]] = root[i]
                    a.append(fp[i])
                    b.append(fp[k])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


#: Rows in a block; bits of a filter for each key, and at most.
BLOCK, KEY_BITS, MOST_BITS = 1_024, 8, 27


def hub_pairs(rows: DataFrame) -> DataFrame:
    """Deal rows (leader, fp, blocks) out as pairs (i, j) of blocks: each block of a group with the group's block 0."""
    side = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int")
    last = F.col("blocks").cast("int") - 1
    dealt = rows.withColumn("side", side).withColumn("j", F.explode(F.when(F.col("side") == 0, F.sequence(F.lit(0), last)).otherwise(F.array("side"))))
    return dealt.select("leader", F.lit(0).alias("i"), "j", "side", "fp")


def outer_pairs(rows: DataFrame) -> DataFrame:
    """Deal rows (leader, fp, outer) out: the blocks of each group's outer rows, i below 0, with all blocks of the group."""
    sizes = rows.groupBy("leader").agg(F.count("*").alias("all"), F.sum(F.col("outer").cast("long")).alias("some")).where("some > 0")
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    r = rows.join(sizes.select("leader", blocks("all").alias("_all"), blocks("some").alias("_some")), "leader")
    r = r.withColumn("_i", -1 - F.pmod(F.xxhash64("fp", F.lit(8)), F.col("_some")).cast("int")).withColumn("_j", F.pmod(F.xxhash64("fp", F.lit(9)), F.col("_all")).cast("int"))
    left = r.where("outer").select("leader", F.col("_i").alias("i"), F.explode(F.sequence(F.lit(0), F.col("_all") - 1)).alias("j"), F.col("_i").alias("side"), "fp")
    right = r.select("leader", F.explode(F.sequence(-F.col("_some"), F.lit(-1))).alias("i"), F.col("_j").alias("j"), F.col("_j").alias("side"), "fp")
    return left.unionByName(right)


def outer_of(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Rows (leader, fp) with outer: whether the links so far leave one apart from most of its group."""
    root = F.coalesce("root", "fp").alias("root")
    named = rows.select("leader", "fp").join(components(links).select(F.col("node").alias("fp"), "root"), "fp", "left").select("leader", "fp", root)
    main = named.groupBy("leader", "root").agg(F.count("*").alias("n")).groupBy("leader").agg(F.max(F.struct("n", "root"))["root"].alias("main"))
    return durable(named.join(main, "leader").select("leader", "fp", (F.col("root") != F.col("main")).alias("outer")))


def connect(rows: DataFrame, compare) -> DataFrame:
    """Links (a, b) that connect the rows (leader, fp, blocks) of each group as all links between them do.

    compare gives such links of dealt rows (leader, i, j, side, fp).
    """
    links = durable(compare(hub_pairs(rows)))
    large = rows.where("blocks > 1")
    if large.isEmpty():
        return links
    return links.unionByName(compare(outer_pairs(outer_of(large, links))))


def grouped(rows: DataFrame) -> DataFrame:
    """Rows of one block pair together and in order."""
    return rows.repartition(*BLOCK_KEYS).sortWithinPartitions(*BLOCK_KEYS, "fp")


def key_filter(keys: DataFrame) -> np.ndarray | None:
    """A filter with the bits of the column key set, KEY_BITS for each key, folded in Spark; None where that would exceed 2^MOST_BITS.

    Without it nothing is left out before the join that follows, which decides in any case.
    """
    count = keys.count()
    bits = max(10, (count * KEY_BITS).bit_length())
    if bits > MOST_BITS:
        return None
    slot = F.col("key").bitwiseAND(F.lit((1 << bits) - 1))
    words = keys.select(F.shiftright(slot, 5).cast("int").alias("word"), F.expr("shiftleft(1L, cast(key & 31 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(1 << (bits - 5), np.uint32)
    out[words.column("word").to_numpy()] = words.column("bit").to_numpy().astype(np.uint32)
    return out


def passes(key: np.ndarray, bits: np.ndarray | None) -> np.ndarray:
    """Which keys a filter lets through."""
    if bits is None:
        return np.ones(len(key), bool)
    slot = key & (len(bits) * 32 - 1)
    return ((bits[slot >> 5] >> (key & 31).astype(np.uint32)) & 1) == 1


def _sets(batches: Iterator[pa.RecordBatch], size: int, wanted: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        batch = batch.filter(pa.array(passes(batch.column("text_key").to_numpy(), wanted)))
        for part in pieces(iter([batch]), "text"):
            sets = sets_of(part.column("text"), size)
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            values = pa.array(np.concatenate([np.zeros(0, _U), *sets]).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([fingerprint(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), values)], ["fp", "set"])


def classes(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, n_shingles, root, component_id) of rows (doc_id, text).

    text_key is the xxhash64 of the text, and root tells components apart; it is null for empty sets.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = docs.withColumn("text_key", F.xxhash64("text"))
    seen = durable(keyed.mapInArrow(lambda b: _summary(b, size), "doc_id long, text_key long, n long, fp long, sketch binary, counts array<int>"))
    summary = seen.where("counts IS NULL").drop("counts")
    # each task's counts are added in a few tasks first, so that what is added bin by bin does not grow with the tasks
    few = seen.where("counts IS NOT NULL").select("counts").repartition(COUNT_TASKS).mapInArrow(_added, "counts array<long>")
    usual = few.select(F.posexplode("counts").alias("bin", "n")).groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    cost = np.zeros(1 << COST_BITS, np.int64)  # as many rows as there are bins
    cost[usual.column("bin").to_numpy()] = usual.column("n").to_numpy()
    by = spark.sparkContext.broadcast(Allocation(levels(cost)))
    # the hashes of a part are shuffled at a time, as they are as large as the texts; a set has about one for two shingles
    shingled = summary.agg(F.sum("n")).first()[0] or 0
    parts = PARTS if shingled > PART_LEAST else 1
    found = []
    for part in range(parts):
        rows = docs.select("text").mapInArrow(lambda b, part=part: _index(b, size, by.value, part, parts), "sig long, fp long")
        # a task indexes a set once, so a content has about as many rows as distinct sets, or tasks
        same = W.partitionBy("sig")
        met = rows.withColumn("leader", F.min("fp").over(same)).withColumn("_last", F.max("fp").over(same))
        met = met.where("leader <> _last").select("leader", "fp").distinct()
        found.append(durable(met) if parts > 1 else met)
    met = reduce(DataFrame.unionByName, found).distinct() if parts > 1 else found[0]
    nodes = durable(summary.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("least"), F.min("text_key").alias("text_key"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    # a cell holds sizes within a factor of 4/3, so sets that link stand in the same or in neighbouring cells
    cell = F.floor(F.log(F.col("n").cast("double")) / float(np.log(4 / 3))).cast("int")
    met = durable(met.join(nodes.select("fp", cell.alias("cell")), "fp"))
    groups = met.groupBy("leader", "cell").agg(F.count("*").alias("n")).groupBy("leader").agg(F.collect_list(F.struct("cell", "n")).alias("cells"), F.sum("n").alias("all"))
    beside = F.aggregate(F.filter("cells", lambda x: F.abs(x["cell"] - F.col("cell")) <= 1), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    candidates = met.join(groups, "leader").where(beside > 1).select("leader", "fp", F.ceil(F.col("all") / BLOCK).cast("int").alias("blocks"))

    def compare(dealt: DataFrame) -> DataFrame:
        # the sketches come last, as they are the widest
        wide = dealt.join(nodes.select("fp", "n", "sketch"), "fp").select(*BLOCK_KEYS, "side", "fp", "n", "sketch")
        alive = durable(grouped(wide).mapInArrow(_prune, "leader long, i int, j int, side int, fp long"))
        # sets are shuffled for some block pairs at a time, so that they take no more than a share of what all sets would
        volume = alive.join(nodes.select("fp", "n"), "fp").agg(F.sum("n")).first()[0] or 0
        turns = -(-volume // max(shingled // SET_SHARE, TURN_LEAST)) or 1
        found = []
        for turn in range(turns):
            some = alive.where(F.pmod(F.xxhash64(*BLOCK_KEYS), F.lit(turns)) == turn)
            wanted = nodes.join(some.select("fp").distinct(), "fp", "left_semi").select("fp", F.col("text_key").alias("key"))
            bits = spark.sparkContext.broadcast(key_filter(wanted))
            sets = keyed.select("text_key", "text").mapInArrow(lambda b, bits=bits: _sets(b, size, bits.value), "fp long, set array<long>")
            sets = sets.join(wanted.select("fp"), "fp", "left_semi").groupBy("fp").agg(F.first("set").alias("set"))
            found.append(durable(grouped(some.join(sets, "fp")).mapInArrow(_verify, "a long, b long")))
        return reduce(DataFrame.unionByName, found)

    links = connect(candidates, compare)
    roots = components(links)
    named = nodes.select("fp", "least").join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("fp", "root", "component_id")
    n = F.col("n").alias("n_shingles")
    out = summary.where("n > 0").join(named, "fp", "left").select("doc_id", "text_key", n, "root", "component_id")
    return out.unionByName(summary.where("n = 0").select("doc_id", "text_key", n, F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("component_id")))


def join(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id) of rows (doc_id, text)."""
    return classes(docs, size).select("doc_id", "n_shingles", "component_id")
