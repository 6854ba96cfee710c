"""Byte-level BPE encoding and decoding over overlapping chunks.

A long text is cut into overlapping chunks that are pre-tokenised in parallel,
each from its own arbitrary start. A match of the pattern depends only on the
text from its start to two characters past its end, so as soon as a chunk and
its successor agree on one pre-token boundary inside their overlap, all later
boundaries of the successor are those of the whole text. The text is cut at the
first such place of each overlap that follows a letter or digit; there the pieces can be encoded on their own,
each by itself wherever it is, and only their ids are put together by text. Chunks from the first
overlap without such a place onwards are joined into one piece, so that the
result is exact whatever the text. A text of one chunk is one piece. Decoding
concatenates the bytes of the ids.

Null and empty texts have no ids. Rows are never dropped or merged; repeated
rows give repeated results. All columns of the input are kept but for the text
and any whose names the results take.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import release, small_batches

#: Code points that a chunk starts after its predecessor, and that it runs on beyond its successor's start.
CHUNK, OVERLAP = 16_384, 1_024
#: A match looks at so many characters beyond its end at most.
LOOKS = 2


@functools.lru_cache(4)
def encoding(path: str, pattern: str):
    """The tokenizer of a file of base64 tokens and ranks."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(4)
def token_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all tokens end to end, and where each rank's begin."""
    with open(path, "rb") as lines:
        tokens = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    ordered = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
    return np.frombuffer(b"".join(ordered), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in ordered])])


def boundaries(text: str, pattern: str) -> list[int]:
    """Where the matches of the pattern start."""
    return [m.start() for m in regex.finditer(pattern, text)]


def encode_texts(texts: list[str | None], path: str, pattern: str) -> pa.Array:
    release()
    enc = encoding(path, pattern)
    ids = [enc.encode_to_numpy(t, disallowed_special=()) if t else np.zeros(0, np.uint32) for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    values = np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def decode_ids(column: pa.Array, path: str) -> pa.Array:
    release()
    data, at = token_table(path)
    out = []
    for ids in column:
        v = ids.values.to_numpy() if ids.is_valid else np.zeros(0, np.int32)
        size = at[v + 1] - at[v]
        ends = np.cumsum(size)
        index = np.arange(ends[-1] if len(ends) else 0) + np.repeat(at[v] - (ends - size), size)
        out.append(data[index].tobytes())
    return pa.array(out, pa.large_binary()).cast(pa.binary()) if sum(map(len, out)) < 2**31 else pa.array(out, pa.large_binary())


def chunk_spans(n: int, step: int, overlap: int) -> list[tuple[int, int]]:
    """Start and end of the overlapping chunks of n code points."""
    starts = range(0, max(n - overlap, 1), step)
    return [(s, min(s + step + overlap, n)) for s in starts]


def _cut(batches: Iterator[pa.RecordBatch], step: int, overlap: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, text in zip(batch.column("_row").to_pylist(), batch.column("_text").to_pylist(), strict=True):
            spans = chunk_spans(len(text), step, overlap)
            for k in range(0, len(spans), 64):
                some = spans[k : k + 64]
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(some)), pa.array(range(k, k + len(some)), pa.int32()), pa.array([s for s, _ in some], pa.int64()), pa.array([e == len(text) for _, e in some]), pa.array([text[s:e] for s, e in some])], ["_row", "_seq", "_start", "_last", "_chunk"])


def _marks(batches: Iterator[pa.RecordBatch], pattern: str, step: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """Of each chunk, the boundaries inside its first and its last overlap, as positions in the text."""
    for batch in batches:
        head, tail = [], []
        for seq, start, last, chunk in zip(*(batch.column(c).to_pylist() for c in ("_seq", "_start", "_last", "_chunk")), strict=True):
            marks = np.array(boundaries(chunk, pattern), np.int64)
            ends = np.append(marks[1:], len(chunk))
            # a boundary can be trusted if the match before it could not have gone on beyond the chunk
            trusted = marks[np.concatenate([[True], ends[:-1] + LOOKS <= len(chunk)])] if len(marks) else marks
            trusted = trusted[[m > 0 and chunk[m - 1].isalnum() for m in trusted]] if len(trusted) else trusted
            head.append((trusted[trusted < overlap] + start).tolist() if seq else [])
            tail.append([] if last else (trusted[trusted >= step] + start).tolist())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_row", "_seq", "_start", "_last", "_chunk")), pa.array(head, pa.list_(pa.int64())), pa.array(tail, pa.list_(pa.int64()))], ["_row", "_seq", "_start", "_last", "_chunk", "_head", "_tail"])


def _encoder(path: str, pattern: str):
    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        return encode_texts(texts.to_pylist(), path, pattern)

    return encode


def _decoder(path: str):
    @F.arrow_udf("binary")
    def decode(ids: pa.Array) -> pa.Array:
        return decode_ids(ids, path)

    return decode


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids", step: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Put the ids of every whole text (array of int, never null), as column out, in place of the text."""
    spark = docs.sparkSession
    small_batches(spark, 256)
    size = F.coalesce(F.length(F.col(text)), F.lit(0))
    rest = [c for c in docs.columns if c not in (text, out)]
    one = docs.where(size <= step + overlap).withColumn(out, _encoder(path, pattern)(F.col(text))).select(*rest, out)
    # the other columns travel as one, so that none of their names matters
    long = docs.where(size > step + overlap).select(F.sha2(F.col(text), 256).alias("_row"), F.col(text).alias("_text"), F.struct(F.lit(0).alias("\x00"), *rest).alias("_rest"))
    # long texts go by their digest, so that equal ones are encoded once; only chunks travel with text
    cut = long.select("_row", "_text").mapInArrow(lambda b: _cut(b, step, overlap), "_row string, _seq int, _start long, _last boolean, _chunk string")
    chunks = cut.groupBy("_row", "_seq").agg(*[F.first(c).alias(c) for c in ("_start", "_last", "_chunk")])
    marks = chunks.mapInArrow(lambda b: _marks(b, pattern, step, overlap), "_row string, _seq int, _start long, _last boolean, _chunk string, _head array<long>, _tail array<long>")
    by = W.partitionBy("_row").orderBy("_seq")
    so_far = by.rowsBetween(W.unboundedPreceding, 0)
    meets = F.array_min(F.array_intersect(F.col("_head"), F.lag("_tail").over(by)))
    placed = (
        marks.withColumn("_meets", F.when(F.col("_seq") == 0, F.lit(0)).otherwise(meets))
        .withColumn("_sure", F.max(F.col("_meets").isNull()).over(so_far) == F.lit(False))
        .withColumn("_from", F.when(F.col("_sure"), F.col("_meets")).otherwise(F.col("_start")))
        .withColumn("_piece", F.sum(F.col("_sure").cast("int")).over(so_far))
        .withColumn("_to", F.lead("_from").over(by))
    )
    taken = F.expr("substring(_chunk, int(_from - _start + 1), int(coalesce(_to - _from, length(_chunk))))")
    parts = placed.select("_row", "_piece", "_seq", taken.alias("_part"))
    piece = parts.groupBy("_row", "_piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_seq", "_part"))), lambda x: x["_part"]), "").alias("_text"))
    coded = piece.select("_row", "_piece", _encoder(path, pattern)(F.col("_text")).alias("_ids"))
    whole = coded.groupBy("_row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_piece", "_ids"))), lambda x: x["_ids"])).alias("_ids"))
    many = long.select(F.col("_row").alias("_of"), "_rest").join(whole, F.col("_of") == F.col("_row")).select(*[F.col("_rest")[c].alias(c) for c in rest], F.col("_ids").alias(out))
    return one.unionByName(many)


def decode(coded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the bytes that the ids stand for, as column out (binary; null ids: empty)."""
    small_batches(coded.sparkSession, 256)
    return coded.withColumn(out, _decoder(path)(F.col(ids)))


def ids_text(ids: Column) -> Column:
    """The decimal ids joined by one space."""
    return F.array_join(ids.cast("array<string>"), " ")
