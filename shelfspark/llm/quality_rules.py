"""Quality rules whose thresholds come from the corpus.

Each document gets counts (words, symbols, repeated lines, repeated windows)
and from them whole-numbered features. A quantile sketch counts, per language and
source, the documents in each bin of each feature. Bins are as wide as a 32nd of their
lower edge, so a quantile is told to within 1/32 of its value and a sketch has fewer than 1,900 bins
however many documents it holds; sketches merge by adding counts, so they are
built with partial aggregates and merged again for languages and for the whole corpus.

A group's own sketch is blended with PRIOR documents' worth of its language's, which itself is
blended with as many of the corpus's, so small groups lean on larger ones without any
switch by size. From the blended sketch a threshold is an upper quantile, plus SPREAD times its distance
from a lower one, plus a tolerance for features that hardly vary; quantile and tolerance are
the feature's (FEATURES). Documents beyond a threshold go. The base rules (too few words, mostly
repeated words) stay.

Null text has no words. Null languages and sources are groups of their own.
Rows are judged each for itself, so repeated rows get the same verdict. Columns
of the input with the names of the results are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import SPACE, Words, buffers, durable, mix, pieces, small_batches, span_hash

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: Rules that hold everywhere.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Documents that a sketch borrows from the next larger one.
PRIOR = 50
#: Sub-buckets of each power of two, as a power of two.
SUB_BITS = 5
#: Feature: percent of the lower and upper quantile, the spread, and the tolerance. Values are hundredths of a
#: character or tenths of a percent. Where a few percent of clean documents have any, the upper quantile lies higher.
FEATURES = {"symbol_rate": (25, 75, 8, 60), "dup_line_rate": (50, 90, 1, 400), "repeat_rate": (50, 90, 3, 300), "word_length": (25, 75, 6, 40)}


def _repeats(key: np.ndarray) -> np.ndarray:
    """Which values occur twice or more."""
    ordered = np.sort(key)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(key), bool)
    return twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key


def count_batch(texts: pa.Array) -> list[np.ndarray]:
    """COUNTS of each text."""
    data, offsets = buffers(texts)
    words = Words(data, offsets, lower=False)
    first, many = words.first, np.diff(words.first)

    def per_text(flag: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flag)])
        return total[offsets[1:]] - total[offsets[:-1]]

    solid = ~SPACE[data]
    chars = per_text(solid & ((data & 0xC0) != 0x80))
    # lines
    breaks = np.flatnonzero(data == 10)
    start = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    start = start[start < len(data)]
    end = np.append(start[1:], len(data)) if len(start) else start
    end = end - ((end > start) & (data[np.maximum(end - 1, 0)] == 10)) if len(start) else end
    seen = np.concatenate([[0], np.cumsum(solid)])
    full = seen[end] > seen[start] if len(start) else np.zeros(0, bool)
    start, end = start[full], end[full]
    of = np.searchsorted(offsets, start, "right") - 1
    n_lines = np.bincount(of, minlength=len(many))
    # only lines that share text, length and first bytes with another can be equal to one
    size, lead = end - start, np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", lead, strides=(1,))[start] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.minimum(size, 8).astype(np.uint64) * np.uint64(8)))
    alike = np.flatnonzero(_repeats(mix(mix(eight) ^ size.astype(np.uint64)) ^ mix(of.astype(np.uint64))))
    raw, o = span_hash(data, start[alike], end[alike], False), of[alike]
    order = np.lexsort((raw, o))
    o, r = o[order], raw[order]
    dup = np.bincount(o[1:][(o[1:] == o[:-1]) & (r[1:] == r[:-1])], minlength=len(many))
    # windows of three words
    h = words.hash
    covered = np.zeros(len(h) + 1, np.int64)
    if len(h) >= 3:
        text = np.repeat(np.arange(len(many)), many)
        at = np.flatnonzero(text[2:] == text[:-2])
        a, b, c = h[at], h[at + 1], h[at + 2]
        window = mix(mix(a) * np.uint64(3) + mix(b) * np.uint64(5) + c * np.uint64(7) + mix(text[at].astype(np.uint64)))
        at = at[_repeats(window)]
        flag = np.zeros(len(h), bool)
        for i in range(3):
            flag[at + i] = True
        covered[1:] = np.cumsum(flag)
    return [many, chars, per_text(SYMBOLS[data]), n_lines, dup, covered[first[1:]] - covered[first[:-1]]]


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def _counts(texts: pa.Array) -> pa.Array:
    batch = pa.RecordBatch.from_arrays([texts], ["text"])
    parts = [count_batch(x.column(0)) for x in pieces(iter([batch]), "text")]
    columns = [np.concatenate([np.zeros(0, np.int64), *(p[i] for p in parts)]).astype(np.int64) for i in range(len(COUNTS))]
    return pa.StructArray.from_arrays([pa.array(c) for c in columns], list(COUNTS))


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add COUNTS."""
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in COUNTS]
    counted = docs.select(*kept, _counts(F.col(text)).alias("\x00counts"))
    return counted.select(*kept, *[F.col("\x00counts")[c].alias(c) for c in COUNTS])


def features() -> dict[str, Column]:
    """The binned features, from COUNTS."""
    rate = lambda a, b, k: F.expr(f"{k} * {a} div greatest({b}, 1)")
    return {"symbol_rate": rate("n_symbols", "n_words", 1000), "dup_line_rate": rate("n_dup_lines", "n_lines", 1000), "repeat_rate": rate("n_repeat_words", "n_words", 1000), "word_length": rate("word_chars", "n_words", 100)}


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)


def bin_of(value: Column) -> Column:
    """The lower edge of a value's bin: the value with all but its first SUB_BITS + 1 binary digits set to 0."""
    drop = F.greatest(F.length(F.bin(value)) - (SUB_BITS + 1), F.lit(0)).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def sketch(counted: DataFrame) -> DataFrame:
    """(lang, source, feature, bin, n) of the documents that pass the base rules."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), bin_of(v).alias("bin")) for k, v in features().items()]))
    binned = counted.where(~base_failed()).select("lang", "source", each.alias("x")).select("lang", "source", "x.*")
    return binned.groupBy("lang", "source", "feature", "bin").agg(F.count("*").alias("n"))


def _whole(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def blend(own: DataFrame, larger: DataFrame, keys: list[str], shared: list[str], prior: int = PRIOR) -> DataFrame:
    """(keys, feature, bin, n): sketches own by keys plus prior documents of the larger sketches by shared keys.

    Counts are whole numbers, scaled by the total of the larger sketch, so that no rounding depends on the order of sums.
    """
    of_larger = W.partitionBy(*shared, "feature")
    big = larger.withColumn("_all", F.sum("n").over(of_larger)).select(*[F.col(c).alias(f"_{c}") for c in shared], F.col("feature").alias("_f"), F.col("bin").alias("_bin"), _whole(F.col("n")).alias("_n"), _whole(F.col("_all")).alias("_all"))
    same = F.col("feature") == F.col("_f")
    for c in shared:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    groups = own.select(*keys, "feature").distinct()
    lent = groups.join(F.broadcast(big) if not shared else big, same).select(*keys, "feature", F.col("_bin").alias("bin"), (F.col("_n") * prior).cast("decimal(38,0)").alias("n"))
    totals = big.groupBy(*[f"_{c}" for c in shared], "_f").agg(F.max("_all").alias("_all"))
    mine = own.join(F.broadcast(totals) if not shared else totals, same).select(*keys, "feature", "bin", (_whole(F.col("n")) * F.col("_all")).cast("decimal(38,0)").alias("n"))
    return mine.unionByName(lent).groupBy(*keys, "feature", "bin").agg(F.sum("n").cast("decimal(38,0)").alias("n"))


def quantiles(sketches: DataFrame, *group: str) -> DataFrame:
    """(group, feature, lo, hi) of sketches: the smallest bins that the feature's shares of the documents do not exceed."""
    whole = W.partitionBy(*group, "feature")
    upto = whole.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    m = sketches.withColumn("_sum", _whole(F.sum("n").over(upto))).withColumn("_all", _whole(F.sum("n").over(whole)))
    share = lambda i: F.create_map(*[x for k, v in FEATURES.items() for x in (F.lit(k), F.lit(v[i]))])[F.col("feature")]
    at = lambda i: F.min(F.when(F.col("_sum") * 100 >= F.col("_all") * share(i), F.col("bin")))
    return m.groupBy(*group, "feature").agg(at(0).alias("lo"), at(1).alias("hi"))


def thresholds(counted: DataFrame) -> DataFrame:
    """One row per language and source: the highest value of each feature that is kept."""
    s = durable(sketch(counted))
    every = s.groupBy("feature", "bin").agg(F.sum("n").alias("n"))
    lang = blend(s.groupBy("lang", "feature", "bin").agg(F.sum("n").alias("n")), every, ["lang"], [])
    q = quantiles(blend(s, lang, ["lang", "source"], ["lang"]), "lang", "source")
    part = lambda i: F.create_map(*[x for k, v in FEATURES.items() for x in (F.lit(k), F.lit(v[i]))])[F.col("feature")]
    most = F.col("hi") + (F.col("hi") - F.col("lo")) * part(2) + part(3)
    return q.groupBy("lang", "source").agg(*[F.max(F.when(F.col("feature") == k, most)).alias(f"most_{k}") for k in FEATURES])


#: Groups up to which thresholds are broadcast; beyond it they are joined by shuffle.
BROADCAST_GROUPS = 100_000


def judge(counted: DataFrame, limits: DataFrame) -> DataFrame:
    """Add base_failed and kept to rows with COUNTS, lang and source."""
    # names that no column of the input has
    most = {k: f"\x00most_{k}" for k in FEATURES}
    t = limits.select(F.col("lang").alias("\x00lang"), F.col("source").alias("\x00source"), *[F.col(f"most_{k}").alias(v) for k, v in most.items()])
    t = F.broadcast(t) if limits.count() <= BROADCAST_GROUPS else t
    kept = [c for c in counted.columns if c not in ("base_failed", "kept")]
    both = counted.join(t, F.col("lang").eqNullSafe(F.col("\x00lang")) & F.col("source").eqNullSafe(F.col("\x00source")), "left")
    fine = F.lit(True)
    for k, v in features().items():
        fine = fine & ~F.coalesce(v > F.col(most[k]), F.lit(False))
    return both.select(*kept, base_failed().alias("base_failed"), (~base_failed() & fine).alias("kept"))
