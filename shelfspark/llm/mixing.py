"""Mixing sources to target weights by a low-discrepancy schedule.

Every source's documents form a stream in shuffled order (by the md5 of
their ids), twice over, which is cut into blocks of equally many words. Slot k of
the schedule takes the van der Corput point of k; the points, counted in units
of one block, fall on the cumulative numbers of blocks that the sources'
targets ask for, so that each source gets exactly its blocks, evenly spread.
Slots are ranked within their source, and the slot of rank r takes block r of
its source's stream; the last block of a source ends where its target is met. The slots
are the order in which the mix is read: any stretch of them holds the sources in proportion.

All of it is DataFrame code. Prefix sums and ranks are made in two levels, over
buckets and then within each, so a source with most of the rows is dealt out
like any other.

Null and empty texts have size 0 and are never taken. A null source is a source
of its own, behind all others. Repeated rows are documents of their own, told
apart by where they begin in their stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import WORD, durable

#: Words in a block.
BLOCK = 2_048
#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: Words that the mix takes of all sources together, as a share of all words; how often a source may be gone through.
SHARE, EPOCHS = 1.5, 2
#: Hex digits of the order key that make a bucket of a source's stream; consecutive slots that are ranked together.
BUCKET_DIGITS, SLOT_BITS = 3, 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """From (source, source_size), the words to take of each source.

    The weights share the total; where a source would exceed epochs times its
    size, it stops there and the rest is shared anew. With the sources ordered
    by size over weight, those that stop are a prefix, and the first prefix whose
    remaining level fits the next source is the answer.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("_place") - 1) % len(weights) + 1).cast("int"))
    everywhere = W.partitionBy(F.lit(0))
    s = sizes.withColumn("_place", F.row_number().over(everywhere.orderBy(F.col("source").asc_nulls_last()))).withColumn("_w", w)
    s = s.withColumn("_cap", F.col("source_size") * F.lit(float(epochs))).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    order = everywhere.orderBy("_ratio", "_place")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("_left", F.sum("source_size").over(everywhere) * F.lit(share) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
    s = s.withColumn("_level", F.col("_left") / (F.sum("_w").over(everywhere) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
    s = s.withColumn("_level", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_place", "_level"))).over(everywhere)["_level"])
    return s.select("source", "source_size", "_place", F.least("_cap", F.coalesce(F.col("_level"), F.lit(0.0)) * F.col("_w")).alias("target"))


def streams(docs: DataFrame) -> DataFrame:
    """Add, to rows of (doc_id, source, size), where each begins in its source's shuffled stream."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    d = docs.withColumn("_key", key).withColumn("_bucket", F.substring("_key", 1, BUCKET_DIGITS))
    buckets = d.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    before = W.partitionBy("source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    buckets = buckets.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = W.partitionBy("source", "_bucket").orderBy("_key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("_within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    b = buckets.select(F.col("source").alias("_bs"), F.col("_bucket").alias("_bb"), "_base")
    d = d.join(b, F.col("source").eqNullSafe(F.col("_bs")) & (F.col("_bucket") == F.col("_bb")))
    return d.withColumn("begin", F.col("_base") + F.col("_within")).drop("_bs", "_bb", "_base", "_within", "_key", "_bucket")


def slot_bits(plan: DataFrame, block: int = BLOCK) -> int:
    """The slots are numbers of so many binary digits."""
    return int(plan.select(F.coalesce(F.sum(F.ceil(F.round("target") / block)), F.lit(0))).first()[0]).bit_length() or 1


def schedule(plan: DataFrame, block: int = BLOCK) -> DataFrame:
    """From (source, target), the slots: (slot, source, rank), rank from 0 within the source.

    Slot k of 2^m looks at the point whose bits are those of k reversed. Points
    beyond the last source's blocks stay empty. Among the first k slots, a source holds its
    share of them but for m + 1 at most.
    """
    n = plan.withColumn("_blocks", F.ceil(F.round("target") / block).cast("long")).where("_blocks > 0")
    upto = W.partitionBy(F.lit(0)).orderBy("_place").rowsBetween(W.unboundedPreceding, 0)
    n = n.withColumn("_hi", F.sum("_blocks").over(upto)).withColumn("_lo", F.col("_hi") - F.col("_blocks"))
    bits = F.length(F.conv(F.max("_hi").over(W.partitionBy(F.lit(0))).cast("string"), 10, 2))
    # each source's points, in runs, so that no task makes all of a large source's
    runs = n.withColumn("_bits", bits).withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_blocks - 1) div {1 << SLOT_BITS}"))))
    at = F.col("_lo") + F.col("_run") * (1 << SLOT_BITS)
    points = runs.repartition("source", "_run").withColumn("_point", F.explode(F.sequence(at, F.least(at + ((1 << SLOT_BITS) - 1), F.col("_hi") - 1))))
    slot = F.conv(F.reverse(F.lpad(F.conv(F.col("_point").cast("string"), 10, 2), F.col("_bits"), "0")), 2, 10).cast("long")
    s = points.select("source", slot.alias("slot")).withColumn("_bucket", F.shiftright("slot", SLOT_BITS))
    counts = s.groupBy("source", "_bucket").agg(F.count("*").alias("_n"))
    before = W.partitionBy("source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(F.col("source").alias("_bs"), F.col("_bucket").alias("_bb"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    s = s.withColumn("_within", F.row_number().over(W.partitionBy("source", "_bucket").orderBy("slot")) - 1)
    s = s.join(counts, F.col("source").eqNullSafe(F.col("_bs")) & (F.col("_bucket") == F.col("_bb")))
    return s.select("slot", "source", (F.col("_base") + F.col("_within")).alias("rank"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, block: int = BLOCK, epochs: int = EPOCHS) -> tuple[DataFrame, DataFrame]:
    """The documents with their sizes, targets and begins, and the pieces that the slots take.

    docs has doc_id, source and size. The first result adds source_size, target
    and begin. A row of the second is a run of words of one document: slot,
    source, begin (of the document in its stream), epoch, from_word and n_words.
    """
    base = durable(docs.select("doc_id", "source", "size"))
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = durable(targets(sizes, weights, share, epochs))
    p = plan.select(F.col("source").alias("_ps"), "source_size", "target")
    placed = streams(base).join(F.broadcast(p), F.col("source").eqNullSafe(F.col("_ps"))) if plan.count() <= 10_000 else streams(base).join(p, F.col("source").eqNullSafe(F.col("_ps")))
    placed = durable(placed.drop("_ps"))
    goal = F.round("target").cast("long")
    turn = placed.where("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    turn = turn.withColumn("_at", F.col("begin") + F.col("epoch") * F.col("source_size")).where(F.col("_at") < goal)
    turn = turn.withColumn("_end", F.least(F.col("_at") + F.col("size"), goal))
    parts = turn.withColumn("rank", F.explode(F.sequence(F.expr(f"_at div {block}"), F.expr(f"(_end - 1) div {block}"))))
    lo = F.greatest(F.col("_at"), F.col("rank") * block)
    parts = parts.select("source", "begin", "epoch", "rank", (lo - F.col("_at")).alias("from_word"), (F.least(F.col("_end"), (F.col("rank") + 1) * block) - lo).alias("n_words"))
    slots = schedule(plan, block).select("slot", F.col("source").alias("_ss"), F.col("rank").alias("_sr"))
    taken = parts.join(slots, F.col("source").eqNullSafe(F.col("_ss")) & (F.col("rank") == F.col("_sr"))).drop("_ss", "_sr", "rank")
    return placed, taken


def taken_words(placed: DataFrame, taken: DataFrame) -> DataFrame:
    """Per document the words that all slots take together, 0 where none does, the first of those slots, and the number of runs that slots take.

    A document's begin and source tell it from all others but those of size 0.
    """
    sums = taken.groupBy("source", "begin").agg(F.sum("n_words").alias("taken"), F.min("slot").alias("first_slot"), F.count("*").alias("n_runs"))
    sums = sums.select(F.col("source").alias("_ts"), F.col("begin").alias("_tb"), F.struct("taken", "first_slot", "n_runs").alias("_t"))
    both = placed.join(sums, F.col("source").eqNullSafe(F.col("_ts")) & (F.col("begin") == F.col("_tb")) & (F.col("size") > 0), "left")
    none = F.lit(0).cast("long")
    return both.select(*placed.columns, F.coalesce("_t.taken", none).cast("long").alias("taken"), F.col("_t.first_slot").alias("first_slot"), F.coalesce("_t.n_runs", none).cast("long").alias("n_runs"))
