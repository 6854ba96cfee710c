"""What is told of scanned files by their pages: whether they are images, and the lines that run through them."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx

#: Characters below which a page has no text, the share of such pages of a scan; pages that a file must have for running heads, and the share that one is on.
THIN_CHARS, SCANNED = 50, 0.6
HEAD_PAGES, HEAD_SHARE = 5, 0.3


def looks_scanned(blocks: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """(key, thin, pages, scanned) of blocks (key, page, text) and the pages that the files themselves count (key, pages).

    A page without a block is thin, and only the file knows of it. A file that counts no pages is a scan if it has no block.
    """
    known = blocks.groupBy(key, "page").agg(F.sum(F.length("text")).alias("n"))
    has = known.groupBy(key).agg(F.count("*").alias("blocks"))
    full = known.join(totals, key).where(F.col("page").between(1, F.col("pages")) & (F.col("n") >= THIN_CHARS)).groupBy(key).agg(F.count("*").alias("full"))
    rows = totals.join(full, key, "left").join(has, key, "left").fillna(0, ["full", "blocks"])
    thin = F.col("pages") - F.col("full")
    scanned = F.when(F.col("pages") == 0, F.col("blocks") == 0).otherwise(thin / F.col("pages") >= SCANNED)
    return rows.select(key, thin.alias("thin"), "pages", scanned.alias("scanned"))


def composed(lines: DataFrame, column: str) -> DataFrame:
    """Lines in the form NFKC; only those with characters beyond ASCII go through Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index(column)
            text = pa.array([x if x is None else unicodedata.normalize("NFKC", x) for x in batch.column(i).to_pylist()], pa.string())
            yield batch.set_column(i, column, text)

    plain = F.col(column).isNull() | F.col(column).rlike(r"^[\x00-\x7F]*$")
    return lines.where(plain).unionByName(lines.where(~plain).mapInArrow(run, lines.schema))


def running_heads(pages: DataFrame, key: str) -> DataFrame:
    """(key, line, pages) of lines that run through the pages (key, page, text) of a file, in the form for comparison."""
    n = pages.groupBy(key).agg(F.count_distinct("page").alias("_n")).where(F.col("_n") >= HEAD_PAGES)
    lines = composed(pages.select(key, "page", F.explode(F.split("text", "\n")).alias("line")), "line")
    seen = lines.select(key, "page", tx.line_norm(F.col("line")).alias("line")).where("line <> ''").distinct().groupBy(key, "line").agg(F.count("*").alias("pages"))
    return seen.join(n, key).where(F.col("pages") >= F.greatest(F.lit(HEAD_PAGES), F.floor(F.col("_n") * HEAD_SHARE))).drop("_n")


def dehyphenated(lines: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """(key, order, line): a line that ends in a letter and a hyphen takes in the next one if that begins with a letter, and so on; order is the first one's."""
    by = W.partitionBy(key).orderBy(order)
    letter = r"\p{L}"
    goes_on = F.lag(line).over(by).rlike(f"{letter}-$") & F.col(line).rlike(f"^{letter}")
    marked = lines.withColumn("_new", (~F.coalesce(goes_on, F.lit(False))).cast("int")).withColumn("_group", F.sum("_new").over(by))
    last = F.row_number().over(W.partitionBy(key, "_group").orderBy(F.desc(order))) == 1
    part = F.when(last, F.col(line)).otherwise(F.regexp_replace(line, "-$", ""))
    rows = marked.withColumn("_part", part).groupBy(key, "_group").agg(F.min(order).alias(order), F.array_sort(F.collect_list(F.struct(order, "_part"))).alias("_x"))
    return rows.select(key, order, F.array_join(F.transform("_x", lambda x: x["_part"]), "").alias(line))
