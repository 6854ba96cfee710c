"""Sectioning and chunking of texts as DataFrame plans."""

from __future__ import annotations

import itertools
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import words_of
from ..session import let_workers_import, shared_dir, stored


def _in_order(value: Column, order: str, sep: str) -> Column:
    """value over a group, joined in order; nulls left out."""
    rows = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(F.col(order), value.alias("_v")))))
    return F.array_join(F.transform(rows, lambda x: x["_v"]), sep)


def by_heading(lines: DataFrame, is_head: str, strip: str) -> DataFrame:
    """(doc_id, sec, heading, body) of rows (doc_id, i, line): each heading opens a section, 0 is what comes before the first."""
    head = F.col("line").rlike(is_head)
    upto = W.partitionBy("doc_id").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    s = lines.withColumn("_head", head).withColumn("sec", F.sum(F.col("_head").cast("int")).over(upto))
    heading = F.max(F.when(F.col("_head"), F.trim(F.regexp_replace("line", strip, ""))))
    return s.groupBy("doc_id", "sec").agg(heading.alias("heading"), _in_order(F.when(~F.col("_head"), F.col("line")), "i", "\n").alias("body"))


def joined(lines: DataFrame, opens: Column) -> DataFrame:
    """(doc_id, sec, body): lines from one that opens a section up to the next."""
    upto = W.partitionBy("doc_id").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    return lines.withColumn("sec", F.sum(opens.cast("int")).over(upto)).groupBy("doc_id", "sec").agg(_in_order(F.col("line"), "i", "\n").alias("body"))


def split_paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, text, start) of the paragraphs between empty lines; start is the code point where the trimmed text begins."""
    parts = F.split("text", r"\n[ \t]*\n")
    at = F.aggregate(parts, F.array(F.lit(0).cast("long")), lambda acc, p: F.array_append(acc, F.element_at(acc, -1) + F.length(p) + 2))
    d = docs.select("doc_id", F.posexplode(F.arrays_zip(parts.alias("p"), F.slice(at, F.lit(1), F.size(parts)).alias("a"))).alias("pos", "x"))
    lead = F.length("x.p") - F.length(F.ltrim("x.p"))
    return d.where(F.trim("x.p") != "").select("doc_id", F.col("pos").cast("long").alias("pos"), F.trim("x.p").alias("text"), (F.col("x.a") + lead).alias("start"))


def split_oversize(docs: DataFrame, target: int) -> DataFrame:
    """(doc_id, part, text) of texts of more than target words, in runs of so many."""
    w = docs.withColumn("_w", words_of(F.col("text"))).where(F.size("_w") > target)
    w = w.withColumn("part", F.explode(F.sequence(F.lit(0), F.expr(f"(size(_w) - 1) div {target}").cast("int"))))
    return w.select("doc_id", F.col("part").cast("long").alias("part"), F.array_join(F.slice("_w", F.col("part") * target + 1, F.lit(target)), " ").alias("text"))


def sliding_windows(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """(doc_id, win, text) of windows of size words, each overlap behind the end of the one before."""
    step = size - overlap
    w = docs.withColumn("_w", words_of(F.col("text"))).where(F.size("_w") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("_w") - overlap) / step).cast("int") - 1)
    w = w.withColumn("win", F.explode(F.sequence(F.lit(0), last)))
    return w.select("doc_id", F.col("win").cast("long").alias("win"), F.array_join(F.slice("_w", F.col("win") * step + 1, F.lit(size)), " ").alias("text"))


def islands(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Number the runs of equal values, nulls included, in order within keys, from 1."""
    by = W.partitionBy(*keys).orderBy(order)
    new = ~F.col(value).eqNullSafe(F.lag(value).over(by)) | (F.row_number().over(by) == 1)
    return rows.withColumn("_new", new.cast("int")).withColumn("island", F.sum("_new").over(by.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def first_run_texts(rows: DataFrame, keys: list[str], order: str, label: str, text: str) -> DataFrame:
    """The text of the first run of each label."""
    runs = islands(rows, keys, order, label).withColumn("_first", F.min("island").over(W.partitionBy(*keys, label)))
    return runs.where("island = _first").groupBy(*keys, label).agg(_in_order(F.col(text), order, "").alias(text))


def preview(rows: DataFrame, key: str, order: str, label: str, text: str) -> DataFrame:
    """Blocks joined by empty lines, with a heading where the label changes."""
    new = ~F.col(label).eqNullSafe(F.lag(label).over(W.partitionBy(key).orderBy(order)))
    head = F.when(new & F.col(label).isNotNull(), F.concat(F.lit("## "), label, F.lit("\n\n"))).otherwise(F.lit(""))
    return rows.withColumn("_p", F.concat(head, text)).groupBy(key).agg(_in_order(F.col("_p"), order, "\n\n").alias("preview"))


# --------------------------------------------------- windows that look back


#: Units of a segment on average, the number that several tasks share a long book by.
SEGMENT = 16_384
#: Characters of a book that one task packs.
LONG_BOOK = 8 << 20
CHUNK = "id string, book_id string, chapter string, page long, loc_start long, loc_end long, text string"
UNIT = "book_id string, pos long, u int, chapter string, page long, start long, piece string, tokens long"


def _rows(pdf: pd.DataFrame) -> list[tuple]:
    """(book_id, pos, chapter, page, text) of blocks, with None where there is nothing."""
    return list(zip(*(pdf[c].astype(object).where(pdf[c].notna(), None) for c in ("book_id", "pos", "chapter", "page", "text")), strict=True))


def _units(rows: list[tuple], target: int, on: bool) -> Iterator[tuple]:
    """(book_id, pos, u, chapter, page, start, piece, tokens) of blocks: paragraphs, or runs of target words of those that are longer.

    start counts on from block to block, or from the beginning of its own.
    """
    base = 0
    for book, pos, chapter, page, text in rows:
        text, at, u = text or "", 0, 0
        for m in [*re.finditer(r"\n[ \t]*\n", text), None]:
            part = text[at : m.start() if m else len(text)]
            words, start = part.split(), base + at + len(part) - len(part.lstrip())
            for k in range(0, len(words), target):
                some = words[k : k + target]
                piece = part.strip() if len(words) <= target else " ".join(some)
                yield book, pos, u, chapter, page, start, piece, len(some)
                start, u = start + len(piece) + 1, u + 1
            at = m.end() if m else len(text)
        base += (len(text) + 2) * on


def units(blocks: DataFrame, target: int) -> DataFrame:
    """UNITs of rows (book_id, pos, chapter, page, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame(_units(_rows(pdf), target, False), columns=[x.split()[0] for x in UNIT.split(", ")]).astype({"page": "Int64", "pos": "Int64"})

    return blocks.select("book_id", "pos", "chapter", "page", "text").mapInPandas(run, UNIT)


class Windows:
    """Windows over units in order, each a function of the unit it starts at.

    A run is what is next to each other of one book and chapter; no window leaves it, and each run's first unit starts one. head: the first unit starts a run.
    For each unit: end and next, the window from it and the start of the one behind; tail, that it belongs to the window
    before as it is the last of its run and small; whole, the end with such a tail.
    """

    def __init__(self, run: np.ndarray, tokens: np.ndarray, head: bool, target: int, overlap: int, least: int):
        n, at = len(tokens), np.arange(len(tokens))
        c = np.concatenate([[0], np.cumsum(tokens)])
        first = np.concatenate([[head], run[1:] != run[:-1]])
        ends = np.append(np.flatnonzero(run[1:] != run[:-1]) + 1, n)
        last = ends[np.searchsorted(ends, at, "right")]
        end = np.minimum(np.maximum(np.searchsorted(c, c[at] + target, "right") - 1, at + 1), last)
        back = np.maximum(np.searchsorted(c, c[end] - overlap, "right") - 1, at) if overlap > 0 else end
        self.next = np.where(end >= last, last, np.maximum(at + 1, back))
        self.tail = (end >= last) & (c[end] - c[at] < least) & ~first
        self.whole = np.where((self.next < last) & self.tail[np.minimum(self.next, n - 1)], last, end)

    def path(self, at: int, until: int) -> tuple[list[int], int]:
        """The units before until at which the windows from one on start, without tails, and where the next one starts."""
        out = []
        while at < until:
            if not self.tail[at]:
                out.append(at)
            at = int(self.next[at])
        return out, at


def chunk_books(blocks: DataFrame, target: int = 350, overlap: int = 60, least: int = 80) -> DataFrame:
    """(id, book_id, chapter, page, loc_start, loc_end, text) of rows (book_id, pos, chapter, page, text).

    Blocks are cut into paragraphs, and these, if they are too long, into runs of words;
    runs of one chapter are packed into chunks, which never cross chapters.

    A book of up to LONG_BOOK characters is packed by one task, which holds one such book at a time. Longer ones are shared:
    a chunk's end and the start of the next depend on where it starts alone. So all units, in order, are dealt to
    tasks in segments, whatever the size of a book, each with as many of the units behind it as two chunks may need. A segment tells for
    each place where the chunks of those before may hand over to it where it hands over in turn; the driver follows these
    numbers from segment to segment, and then each segment makes the chunks that start in it.
    """
    let_workers_import(blocks.sparkSession)
    blocks = blocks.where("book_id IS NOT NULL").select("book_id", "pos", "chapter", "page", "text")
    long = blocks.groupBy("book_id").agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 2).alias("_n")).where(F.col("_n") > LONG_BOOK).select("book_id")
    if long.isEmpty():
        return _whole_books(blocks, target, overlap, least)
    long = stored(long)
    return _whole_books(blocks.join(long, "book_id", "left_anti"), target, overlap, least).unionByName(_shared_books(blocks.join(long, "book_id", "left_semi"), target, overlap, least))


def _whole_books(blocks: DataFrame, target: int, overlap: int, least: int) -> DataFrame:
    names = [x.split()[0] for x in CHUNK.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come in the order of books and positions; a book may go on in the next batch."""
        held: list[tuple] = []
        for pdf in batches:
            rows, out = _rows(pdf), []
            for book, some in itertools.groupby(rows, lambda r: r[0]):
                if held and held[0][0] != book:
                    out += _packed(list(_units(held, target, True)), target, overlap, least)
                    held = []
                held += some
            yield pd.DataFrame(out, columns=names).astype({"page": "Int64"})
        yield pd.DataFrame(_packed(list(_units(held, target, True)), target, overlap, least), columns=names).astype({"page": "Int64"})

    return blocks.repartition("book_id").sortWithinPartitions("book_id", "pos").mapInPandas(run, CHUNK)


def _packed(found: list[tuple], target: int, overlap: int, least: int) -> list[tuple]:
    """The chunks of a whole book's units."""
    if not found:
        return []
    run = np.cumsum([0, *(a[3] != b[3] for a, b in zip(found[1:], found[:-1], strict=True))])
    w = Windows(run, np.array([u[7] for u in found]), True, target, overlap, least)
    out = []
    for k, i in enumerate(w.path(0, len(found))[0]):
        some = found[i : int(w.whole[i])]
        out.append((f"{some[0][0]}:{k}", some[0][0], some[0][3], some[0][4], some[0][5], some[-1][5] + len(some[-1][6]), "\n\n".join(u[6] for u in some)))
    return out


def _shared_books(blocks: DataFrame, target: int, overlap: int, least: int) -> DataFrame:
    spark = blocks.sparkSession
    sizes = blocks.groupBy("book_id", "pos").agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 2).alias("_n"))
    before = F.sum("_n").over(W.partitionBy("book_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select(F.col("book_id").alias("_b"), F.col("pos").alias("_p"), F.coalesce(before, F.lit(0)).alias("_at"))
    order = ["book_id", "pos", "u", "start"]
    found = units(blocks, target).persist()
    try:
        placed = found.join(offsets, (F.col("book_id") == F.col("_b")) & F.col("pos").eqNullSafe(F.col("_p"))).withColumn("start", F.col("start") + F.col("_at")).drop("_b", "_p", "_at")
        dealt = placed.repartitionByRange(-(-found.count() // SEGMENT) or 1, *order).sortWithinPartitions(*order)
        where = f"{shared_dir(spark)}/units-{uuid.uuid4().hex}"
        dealt.select("*", F.spark_partition_id().alias("seg"), (F.monotonically_increasing_id() % F.lit(1 << 33)).alias("i")).write.parquet(where)
    finally:
        found.unpersist()
    held = spark.read.schema(f"{UNIT}, seg int, i long").parquet(where)
    counts = dict(sorted(tuple(r) for r in held.groupBy("seg").agg(F.count("*")).collect()))  # a row for each segment
    if not counts:
        return spark.createDataFrame([], CHUNK)
    starts = np.concatenate([[0], np.cumsum(list(counts.values()))]).astype(np.int64)
    numbers = np.array(list(counts))
    halo = 2 * target + 2  # units have a token at least, so two chunks have no more of them

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each unit for its own segment, for those that end shortly before it, and the last of a segment for the one behind, too."""
        for batch in batches:
            own = np.searchsorted(numbers, batch.column("seg").to_numpy())
            i = batch.column("i").to_numpy() + starts[own]
            low = np.minimum(np.searchsorted(starts[1:], i - halo, "right"), own)
            high = np.minimum(own + (starts[own + 1] == i + 1), len(starts) - 2)
            many = high - low + 1
            take = np.repeat(np.arange(len(i)), many)
            part = low[take] + np.arange(len(take)) - np.repeat(np.cumsum(many) - many, many)
            names = [c for c in batch.schema.names if c not in ("seg", "i")]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(i[take]), *[batch.column(c).take(pa.array(take)) for c in names]], ["part", "i", *names])

    def segments(*columns: str):
        some = held.select("seg", "i", "book_id", "chapter", "tokens", *columns)
        return some.mapInArrow(spread, some.select(F.lit(0).alias("part"), *some.drop("seg").columns).schema).groupBy("part")

    def opened(pdf: pd.DataFrame) -> tuple[pd.DataFrame, int, int, Windows]:
        """The units of a segment and those behind it, its number, how many are its own, and their windows."""
        part = int(pdf["part"].iloc[0])
        pdf = pdf.sort_values("i", ignore_index=True)
        names = list(zip(pdf.book_id, pdf.chapter.astype(object).where(pdf.chapter.notna(), None), strict=True))
        run = np.cumsum([0, *(a != b for a, b in zip(names[1:], names[:-1], strict=True))])
        ahead = int(pdf["i"].iloc[0] < starts[part])  # the last unit of the segment before
        head = ahead == 0 or bool(run[ahead] != run[0])
        pdf = pdf.iloc[ahead:].reset_index(drop=True)
        return pdf, part, int(starts[part + 1] - starts[part]), Windows(run[ahead:], pdf.tokens.to_numpy(), head, target, overlap, least)

    def hand_over(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, part, n, w = opened(pdf)
        leaves = np.arange(n + halo + 1)
        for i in range(n - 1, -1, -1):
            leaves[i] = leaves[w.next[i]]
        return pd.DataFrame({"part": [part], "leaves": [(leaves[: halo + 1] - n).tolist()]})

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, part, n, w = opened(pdf)
        book = pdf.book_id.to_numpy()[:n]
        made = sum(book[i] == book[-1] for i in w.path(entries[part], n)[0])
        return pd.DataFrame({"part": [part], "first": [book[0]], "last": [book[-1]], "made": [made]})

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, part, n, w = opened(pdf)
        out, book, k = [], pdf.book_id.iloc[0], ordinals[part]
        pages = pdf.page.astype(object).where(pdf.page.notna(), None)
        for i in w.path(entries[part], n)[0]:
            if pdf.book_id[i] != book:
                book, k = pdf.book_id[i], 0
            z = int(w.whole[i])
            end = int(pdf.start[z - 1]) + len(pdf.piece[z - 1])
            out.append((f"{book}:{k}", book, pdf.chapter[i], pages[i], int(pdf.start[i]), end, "\n\n".join(pdf.piece[i:z])))
            k += 1
        return pd.DataFrame(out, columns=[x.split()[0] for x in CHUNK.split(", ")]).astype({"page": "Int64"})

    # what the driver holds is a few hundred numbers for each segment that begins inside a run
    entries, ordinals = [0], [0]
    if len(starts) > 2:
        for r in segments().applyInPandas(hand_over, "part int, leaves array<long>").orderBy("part").toLocalIterator():
            entries.append(int(r["leaves"][entries[-1]]))
        told = segments().applyInPandas(count, "part int, first string, last string, made long").orderBy("part").collect()
        for one, two in zip(told, told[1:], strict=False):
            so_far = one["made"] + (ordinals[-1] if one["first"] == one["last"] else 0)
            ordinals.append(so_far if one["last"] == two["first"] else 0)
    return segments("page", "start", "piece").applyInPandas(make, CHUNK)
