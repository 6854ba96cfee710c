"""Resampling documents by importance towards a target distribution of hashed n-grams.

One scan of a document keeps a ring of running CRC-32 states, one for each of the
last n words at which a feature may start. A word opens a state of its own and extends the
others by a space and itself, so each state is the checksum of one run of 1 to n words,
and is emitted as a bucket without the run ever being put together.

The corpus and the target are counted by bucket, each task summing what it has seen. A
bucket's gain is the logarithm of its share in the target over that in the corpus, with
one added to each count; the gains are BUCKETS integers, whatever the input. A
document's weight sums the gains of its features in a second scan, and its score adds
Gumbel noise drawn from a hash of its id. The highest scores are a sample without
replacement with chances in proportion to exp(weight / 1000).

Null and empty texts have no features, weight 0, and are never drawn, nor are documents of under
LEAST_WORDS words. Texts are scanned in steps of bounded size, so a text of any length
takes bounded memory beside itself. Repeated rows count and are drawn on their own; equal scores go by
the smaller id, nulls last. Without any corpus or target the counts are 0. A null id hashes as the empty text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import durable, pieces, small_batches
from .terms import runs

BUCKETS, WORDS = 10_000, 3
#: Documents of fewer words are not drawn; the share drawn of the others in percent; what noise is drawn from.
LEAST_WORDS, PERCENT, SEED = 20, 5, 42


def ring(words: Iterator[bytes], n: int) -> Iterator[int]:
    """The CRC-32 of each run of 1 to n words joined by one space, by the word at which it ends, shortest first."""
    crc, states = zlib.crc32, []
    for word in words:
        more = b" " + word
        states = [crc(word), *[crc(more, s) for s in states[: n - 1]]]
        yield from states


def features(data: bytes, n: int = WORDS, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the features that end in them) for one stretch of a text after another."""
    carried: list[bytes] = []  # the last n - 1 words before the stretch
    for words in runs(data):
        states = np.fromiter(ring(chain(carried, words), n), np.int64)
        before = sum(min(i + 1, n) for i in range(len(carried)))
        yield len(words), states[before:] % buckets
        carried = (carried + words[-n:])[-(n - 1) :] if n > 1 else []


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in pieces(batches, "text"):
        yield batch, [x or b"" for x in batch.column("text").cast(pa.large_binary()).to_pylist()]


def _count(batches: Iterator[pa.RecordBatch], n: int, buckets: int) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(buckets, np.int64)
    for _, texts in _texts(batches):
        for data in texts:
            for _, found in features(data, n, buckets):
                seen += np.bincount(found, minlength=buckets)
    some = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], ["bucket", "n"])


def counts(texts: DataFrame, n: int = WORDS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts by bucket, for buckets that have any; a task sends on one row for each."""
    small_batches(texts.sparkSession)
    found = texts.select("text").mapInArrow(lambda b: _count(b, n, buckets), "bucket long, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) for every bucket, of counts (bucket, n)."""
    every = target.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    c = every.join(corpus.select("bucket", F.col("n").alias("s")), "bucket", "left").join(target.select("bucket", F.col("n").alias("t")), "bucket", "left").fillna(0)
    total = W.partitionBy()  # of as many rows as there are buckets
    add = lambda x, by: x.cast("double") + F.lit(float(by))
    ratio = add(F.col("t"), 1) * add(F.sum("s").over(total), buckets) / (add(F.col("s"), 1) * add(F.sum("t").over(total), buckets))
    return c.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def _weigh(batches: Iterator[pa.RecordBatch], gain: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    for batch, texts in _texts(batches):
        rows = np.zeros((len(texts), 3), np.int64)
        for i, data in enumerate(texts):
            for words, found in features(data, n, len(gain)):
                rows[i] += words, len(found), gain[found].sum()
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(rows[:, k]) for k in range(3)]], ["doc_id", "n_words", "n_features", "weight"])


def weigh(docs: DataFrame, gain: DataFrame, n: int = WORDS) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of rows (doc_id, text). The gains go along with the tasks: eight bytes a bucket."""
    small_batches(docs.sparkSession)
    held = gain.toArrow().sort_by("bucket").column("gain").to_numpy()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda b: _weigh(b, held, n), "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """A thousand times standard Gumbel noise, rounded down, from the first 32 bits of a hash."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def first_ranked(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first rows by order, with their rank from 1.

    Rows are dealt by ranges of the order, counted by range, and numbered within the ranges that are
    needed, so that no task sees more than its range. Repeated rows are dealt by themselves.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = durable(rows.withColumn("_turn", F.rand(SEED)).repartitionByRange(parts, *order, "_turn").withColumn("_part", F.spark_partition_id()))
    sizes = {r["_part"]: r["n"] for r in dealt.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # a row for each partition
    before, starts = 0, []
    for part in sorted(sizes):
        if before >= most:
            break
        starts.append((part, before))
        before += sizes[part]
    if not starts:
        return dealt.drop("_turn", "_part").withColumn("rank", F.lit(0).cast("long")).limit(0)
    offsets = F.create_map(*[F.lit(x) for pair in starts for x in pair])
    within = F.row_number().over(W.partitionBy("_part").orderBy(*order, "_turn"))
    some = dealt.where(F.col("_part") <= starts[-1][0]).withColumn("rank", (within + offsets[F.col("_part")]).cast("long"))
    return some.where(F.col("rank") <= most).drop("_turn", "_part")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, n: int = WORDS, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of docs (doc_id, text); rank is null for what isn't drawn.

    Of the documents of so many words, the given percentage of highest scores is drawn, rounded down.
    """
    gain = gains(counts(docs, n, buckets), counts(target, n, buckets), buckets)
    scored = weigh(docs, gain, n).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = durable(scored.withColumn("row", F.monotonically_increasing_id()))
    able = scored.where(F.col("n_words") >= least_words).select("score", "doc_id", "row")
    drawn = first_ranked(able, [F.desc("score"), F.asc_nulls_last("doc_id")], able.count() * percent // 100)
    return scored.join(drawn.select("row", "rank"), "row", "left").drop("row")
