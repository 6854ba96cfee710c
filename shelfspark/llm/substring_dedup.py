"""Passages that repeat across documents, by banded MinHash of paragraphs.

Texts are cut into paragraphs in two ways: lines of LEAST_WORDS words or more,
and, as repeated passages may begin and end anywhere, stretches of WINDOW words that
begin at anchors. An anchor is a word whose pair hash is the least for some
words around, ties included, so that a passage has the same anchors wherever it stands,
and one that repeats a few words has one in each period. A
paragraph is the set of its five-word shingles. MinHash values in bands give the keys under
which lines meet: as many as find LINE_RECALL of the pairs of similarity 3/4. Lines that meet are
compared exactly and linked at a similarity of 3/4; components of links are clusters. A stretch has
its set's fingerprint as its only key, so equal stretches meet: with one word of 24 changed the similarity is 3/5,
so a near copy of a passage inside other lines is told by the equal stretches around its changes.

A cluster with paragraphs of two documents or more is a repeated passage: it stays in the
document of the smallest id, and is to be removed from the others. Spans of a
document that overlap or touch are merged. Only documents with a repeated
passage are in the result. Paragraphs of few distinct shingles (a word over and over) are compared like others.

Null and empty texts have no paragraphs. A passage that repeats inside one document only is none.
Rows of the same id and text give the same spans once. Rows without an id are told apart by their texts, come
behind all others where the first document is chosen, and have a null id in the result; ids lie below NAMELESS.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import components
from .ngram_join import BLOCK, _verify, connect, grouped, key_filter, passes
from .shared import Words, buffers, durable, mix, pieces, shingles, small_batches, stored

SHINGLE = 5
#: Words of a line from which it is a paragraph; words of a stretch; words on each side that no anchor exceeds.
LEAST_WORDS, WINDOW, REACH = 24, 24, 2
#: Least similarity of a link, and the share of pairs at that similarity that bands of lines must find.
SIMILARITY, LINE_RECALL = 0.75, 0.998


def tuned(rows: int, recall: float, similarity: float = SIMILARITY) -> tuple[int, int]:
    """(bands, rows): the fewest bands of so many rows that find that share of the pairs of a similarity."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)), rows


LINE_BANDS = tuned(2, LINE_RECALL)
#: From here on numbers stand for documents without an id.
NAMELESS = 1 << 62
#: Rows of keys that a task folds together before it sends them on.
FOLD = 1 << 20
_U = np.uint64
_FACTORS = mix(np.arange(32, dtype=_U) + _U(4242)) | _U(1)


def _keys(minima: np.ndarray, bands: tuple[int, int], kind: int) -> np.ndarray:
    """The band keys of rows of bands * rows MinHash values."""
    n, r = bands
    out = np.empty((len(minima), n), _U)
    for b in range(n):
        k = np.full(len(minima), b + 97 * kind, _U)
        for i in range(r):
            k = mix(k * _U(31) ^ minima[:, b * r + i])
        out[:, b] = k
    return out


def _fingerprints(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hashes of the distinct values (first) of each row, as ngram_join.fingerprint gives them."""
    return mix((mix(sets ^ _U(0x5DEECE66D)) * first).sum(axis=1, dtype=_U) + first.sum(axis=1).astype(_U)).view(np.int64)


def paragraphs(data: np.ndarray, offsets: np.ndarray, words: Words, keyed: bool = False) -> list[tuple[np.ndarray, ...]]:
    """Of the lines and the stretches of a batch: text number, first word, behind the last word, fingerprint, band keys if asked for, and a function that gives the set of each line."""
    shingle, at = shingles(words, SHINGLE)
    first, many = words.first, np.diff(words.first)
    of_word = np.repeat(np.arange(len(many)), many)
    shift = at[:-1] - first[:-1]  # from a word to the shingle that begins there
    out = []
    # lines
    breaks = np.searchsorted(words.start, np.flatnonzero(data == 10))
    start = np.unique(np.concatenate([first[:-1], breaks]))
    end = np.append(start[1:], len(of_word))
    keep = end - start >= LEAST_WORDS
    start, end = start[keep], end[keep]
    if len(start):
        text = of_word[start]
        many_of = end - start - SHINGLE + 1
        bound = np.concatenate([[0], np.cumsum(many_of)])
        flat = shingle[np.arange(bound[-1]) + np.repeat(start + shift[text] - bound[:-1], many_of)]
        for lo, hi in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True):
            flat[lo:hi].sort()
        first_of = np.ones(len(flat), bool)
        first_of[1:] = flat[1:] != flat[:-1]
        first_of[bound[:-1]] = True
        total = lambda v: np.add.reduceat(v, bound[:-1])
        n_distinct = total(first_of.astype(np.int64))
        fp = mix(total(mix(flat ^ _U(0x5DEECE66D)) * first_of) + n_distinct.astype(_U)).view(np.int64)
        n = LINE_BANDS[0] * LINE_BANDS[1]
        keys = _keys(np.stack([np.minimum.reduceat(flat * _FACTORS[i], bound[:-1]) for i in range(n)], axis=1), LINE_BANDS, 1) if keyed else None

        def line_set(i: int) -> np.ndarray:
            lo, hi = bound[i], bound[i + 1]
            return flat[lo:hi][first_of[lo:hi]]

        out.append((text, start, end, fp, keys, line_set))
    # stretches from anchors
    h = words.hash
    if len(h) >= WINDOW:
        pair = mix(h[:-1] * _U(3) + h[1:] * _U(5))
        pair[of_word[1:] != of_word[:-1]] = _U(0xFFFFFFFFFFFFFFFF)
        least, of_pair = np.ones(len(pair), bool), of_word[:-1]
        for k in range(1, REACH + 1):  # neighbours of the same text only, so that the batch does not matter
            other = of_pair[k:] != of_pair[:-k]
            least[k:] &= other | (pair[k:] <= pair[:-k])
            least[:-k] &= other | (pair[:-k] <= pair[k:])
        start = np.flatnonzero(least)
        start = start[start + WINDOW <= len(h)]
        start = start[of_word[start] == of_word[start + WINDOW - 1]]
        text = of_word[start]
        table = np.sort(shingle[(start + shift[text])[:, None] + np.arange(WINDOW - SHINGLE + 1)], axis=1)
        distinct = np.ones(table.shape, bool)
        distinct[:, 1:] = table[:, 1:] != table[:, :-1]
        fp = _fingerprints(table, distinct)
        keys = mix(fp.view(_U) ^ _U(2 * 97)).reshape(-1, 1) if keyed else None
        out.append((text, start, start + WINDOW, fp, keys, None))
    return out


def _folded(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """(key, fp, least, most): each key and fingerprint once, with the smallest and largest document."""
    key, fp, doc = (np.concatenate(c) for c in zip(*held, strict=True))
    order = np.lexsort((fp, key))
    key, fp, doc = key[order], fp[order], doc[order]
    start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])]))
    return pa.RecordBatch.from_arrays([pa.array(key[start]), pa.array(fp[start]), pa.array(np.minimum.reduceat(doc, start)), pa.array(np.maximum.reduceat(doc, start))], ["key", "fp", "least", "most"])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a line common to many documents gives is folded to a row for each run of FOLD rows."""
    held, size = [], 0
    for batch in pieces(batches, "text"):
        ids = batch.column("doc_id").to_numpy()
        data, offsets = buffers(batch.column("text"))
        for text, _, _, fp, keys, _ in paragraphs(data, offsets, Words(data, offsets, lower=True), keyed=True):
            # a passage that repeats inside a text gives the same rows again and again
            _, once = np.unique(mix(fp.view(_U)) ^ text.astype(_U), return_index=True)
            n = keys.shape[1]
            held.append((keys[once].reshape(-1).view(np.int64), np.repeat(fp[once], n), np.repeat(ids[text[once]], n)))
            size += n * len(once)
        if size >= FOLD:
            yield _folded(held)
            held, size = [], 0
    if size:
        yield _folded(held)


def _sets(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        data, offsets = buffers(batch.column("text"))
        for _, _, _, fp, _, of in paragraphs(data, offsets, Words(data, offsets, lower=True)):
            if of is None:
                continue
            some = np.flatnonzero(passes(fp, bits))
            _, once = np.unique(fp[some], return_index=True)
            some = some[once]
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(fp[some]), pa.array([of(int(i)).view(np.int64) for i in some], pa.list_(pa.int64()))], ["fp", "set"])


def _spans(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(doc_id, fp, start, end, from_word, to_word) of paragraphs that the filter lets pass; start and end in code points."""
    for batch in pieces(batches, "text"):
        data, offsets = buffers(batch.column("text"))
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        words = Words(data, offsets, lower=True)
        ids = batch.column("doc_id").to_numpy()
        for text, start, end, fp, _, _ in paragraphs(data, offsets, words):
            k = np.flatnonzero(passes(fp, bits))
            k = k[np.lexsort((start[k], fp[k], text[k]))]
            t, a, b, f = text[k], start[k], end[k], fp[k]
            # equal stretches of a text that overlap or touch, as in a word over and over, are one
            new = np.ones(len(k), bool)
            new[1:] = (t[1:] != t[:-1]) | (f[1:] != f[:-1]) | (a[1:] > b[:-1])
            t, a, b, f = t[new], a[new], b[np.append(new[1:], True)[: len(k)]], f[new]
            base = lead[offsets[t]]
            columns = [ids[t], f, lead[words.start[a]] - base, lead[words.end[b - 1]] - base, a - words.first[t], b - words.first[t]]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["doc_id", "fp", "start", "end", "from_word", "to_word"])


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, n_words, first_doc, n_docs, removed) of rows (doc_id, text).

    One row for each stretch of a document that repeats and is to be treated alike:
    first_doc has the smallest id of those that share it, n_docs is how many do.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    nameless = F.xxhash64("text").bitwiseAND(F.lit(NAMELESS - 1)) + F.lit(NAMELESS)
    docs = docs.withColumn("doc_id", F.coalesce("doc_id", nameless))
    by = W.partitionBy("key")
    met = docs.mapInArrow(_index, "key long, fp long, least long, most long")
    met = met.withColumn("leader", F.min("fp").over(by)).withColumn("_fp", F.max("fp").over(by)).withColumn("_a", F.min("least").over(by)).withColumn("_b", F.max("most").over(by))
    near = F.max((F.col("leader") != F.col("_fp")).cast("int")).alias("near")
    met = durable(met.where("_a <> _b").groupBy("leader", "fp").agg(near, F.min("least").alias("least"), F.max("most").alias("most")))
    # paragraphs that meet others: compared exactly, in blocks
    rows = met.where("near = 1").select("leader", "fp")
    sizes = rows.groupBy("leader").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))

    def compare(dealt: DataFrame) -> DataFrame:
        fps = durable(dealt.select("fp").distinct())
        bits = spark.sparkContext.broadcast(key_filter(fps.select(F.col("fp").alias("key"))))
        sets = docs.select("text").mapInArrow(lambda b: _sets(b, bits.value), "fp long, set array<long>").groupBy("fp").agg(F.first("set").alias("set"))
        return grouped(dealt.join(sets, "fp")).mapInArrow(_verify, "a long, b long")

    roots = components(connect(rows.join(sizes, "leader"), compare)).select(F.col("node").alias("fp"), "root")
    # clusters of two documents or more
    member = met.groupBy("fp").agg(F.min("least").alias("least"), F.max("most").alias("most")).join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    each = member.groupBy("root").agg(F.min("least").alias("first_doc"), F.max("most").alias("_last")).where("first_doc <> _last").drop("_last")
    shared = durable(member.select("fp", "root").join(each, "root"))
    wanted = spark.sparkContext.broadcast(key_filter(shared.select(F.col("fp").alias("key"))))
    spans = docs.mapInArrow(lambda b: _spans(b, wanted.value), "doc_id long, fp long, start long, end long, from_word long, to_word long").join(shared, "fp")
    spans = stored(spans.select("doc_id", "fp", "start", "end", "from_word", "to_word", "root", "first_doc"))
    counts = spans.select("root", "doc_id").distinct().groupBy("root").agg(F.count("*").alias("n_docs"))
    spans = spans.join(counts, "root").withColumn("removed", F.col("doc_id") != F.col("first_doc"))
    # merge what overlaps or touches
    order = W.partitionBy("doc_id", "removed").orderBy("from_word", "to_word", "fp")
    ends = F.max("to_word").over(order.rowsBetween(W.unboundedPreceding, -1))
    spans = spans.withColumn("_island", F.sum(F.when(F.col("from_word") <= ends, 0).otherwise(1)).over(order.rowsBetween(W.unboundedPreceding, 0)))
    merged = spans.groupBy("doc_id", "removed", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.max("to_word") - F.min("from_word")).alias("n_words"), F.min("first_doc").alias("first_doc"), F.max("n_docs").alias("n_docs"))
    named = lambda c: F.when(F.col(c) < NAMELESS, F.col(c)).alias(c)
    return merged.select(named("doc_id"), "start", "end", "n_words", named("first_doc"), "n_docs", "removed")
