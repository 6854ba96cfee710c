"""What several operators of this subpackage need: durable cuts of lineage,
vectorised word and shingle hashing over Arrow strings, and the word rule."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import hashlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..session import let_workers_import

#: Words are maximal runs of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    A folder of our own is made only where that setting is absent on one machine, as
    in tests; on a cluster that is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = held.get() if held.isDefined() else "file://" + tempfile.mkdtemp(prefix="shelfspark-")
    return where


#: Whether what a query shuffled goes when it ends. Otherwise it stays until the driver happens to collect its garbage, which may be after the last step.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def swept(df: DataFrame) -> Iterator[DataFrame]:
    """df as a query whose shuffles are deleted once it has run; for results that are written, so that nobody reads the shuffles again."""
    conf = df.sparkSession.conf
    held = conf.get(SWEEP)
    conf.set(SWEEP, "true")
    try:
        yield df.select("*")
    finally:
        conf.set(SWEEP, held)


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of df with a checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    with swept(df) as d:
        return d.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage of df with a table written in the shared folder, which is smaller than a checkpoint."""
    where = f"{shared_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    with swept(df) as d:
        d.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


#: Bytes of one Arrow batch; rows of long texts, or of their sets, fill it sooner than they count to the rows of a batch.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows and bytes that one Arrow batch carries to a Python worker, and let workers import this package.

    Texts are wide, so the columnar reader takes fewer rows at once too: with its
    usual batch, a column of texts is one array of many megabytes.
    """
    let_workers_import(spark)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", 512)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


# ----------------------------------------------------------------- hashing

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (xor-shift and multiply, twice)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Spans of more bytes are hashed one by one by BLAKE2b, shorter ones in step, eight bytes at a time.
LONG_SPAN = 512


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of the bytes of each span.

    Each eight bytes go through a bijective scrambling before the next are added, so
    spans of equal length of up to eight bytes never collide and longer ones do only by chance.
    """
    if lower:
        data = _LOWER[data]
    size = end - start
    out = mix(size.astype(_U) * _U(_BASE) + _U(1))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    some = np.flatnonzero((size > 0) & (size <= LONG_SPAN))
    at = 0
    while len(some):
        left = np.minimum(size[some] - at, 8).astype(_U)
        word = eight[start[some] + at] & (_U(0xFFFFFFFFFFFFFFFF) >> (_U(64) - left * _U(8)))
        out[some] = mix(out[some] * _U(_BASE) ^ word)
        at += 8
        some = some[size[some] > at]
    for i in np.flatnonzero(size > LONG_SPAN):
        digest = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest()
        out[i] = mix(out[i : i + 1] ^ _U(int.from_bytes(digest, "little")))[0]
    return out


class Words:
    """The words of a batch of texts.

    ``start`` and ``end`` are byte positions, ``hash`` a 64-bit hash of each
    word's bytes, and words ``first[d]`` to ``first[d + 1]`` belong to text d.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool):
        n = len(data)
        word = ~SPACE[data]
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        before = np.empty(n, bool)
        before[:1] = False
        before[1:] = word[:-1]
        after = np.empty(n, bool)
        after[-1:] = False
        after[:-1] = word[1:]
        self.start = np.flatnonzero(word & (~before | cut[:-1]))
        self.end = np.flatnonzero(word & (~after | cut[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.hash = span_hash(data, self.start, self.end, lower)


_PLACE = mix((np.arange(64, dtype=_U) + _U(77)) * _U(_BASE)) | _U(1)


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of each text, in order, and their offsets by text.

    A text with fewer words than size has its whole sequence as its one shingle,
    and a text without words has none.
    """
    h, first = words.hash, words.first
    n = np.diff(first)
    many = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    at = np.concatenate([[0], np.cumsum(many)])
    rolled = np.zeros(max(len(h) - size + 1, 0), _U)
    for i in range(size if len(rolled) else 0):
        rolled += h[i : len(h) - size + 1 + i] * _PLACE[i]
    out = np.empty(at[-1], _U)
    pos = np.arange(at[-1]) + np.repeat(first[:-1] - at[:-1], many)
    full = np.repeat(n >= size, many)
    out[full] = rolled[pos[full]]
    for d in np.flatnonzero((n > 0) & (n < size)):
        w = h[first[d] : first[d + 1]]
        out[at[d]] = np.append(w * _PLACE[: len(w)], _PLACE[40 + len(w) : 41 + len(w)]).sum(dtype=_U)
    return mix(out), at


@functools.lru_cache(1)
def _trim():
    """The C library's way to give free memory back, if it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return None


def release() -> None:
    """Give back what Arrow's memory pool and the C library hold in reserve, as a worker that waits for its next task would keep it."""
    pa.default_memory_pool().release_unused()
    if _trim() is not None:
        _trim()(0)


def pieces(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about most text bytes, at least a row each."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends, i = np.cumsum(sizes), 0
        while i < len(sizes):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
            yield batch.slice(i, j - i)
            i = j
        release()
