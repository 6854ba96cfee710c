"""Roll-ups of a library: titles, books, chapters, themes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx


def titles(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("title").agg(F.count("*").alias("n"))


def books(chunks: DataFrame) -> DataFrame:
    """One row for each book: what its first chunk by id says, and how many there are."""
    first = F.min_by(F.struct("title", "author", "source_path", "format"), "id")
    return chunks.groupBy("book_id").agg(first.alias("x"), F.count("*").alias("n")).select("book_id", "x.*", "n")


def chapters(chunks: DataFrame) -> DataFrame:
    """(title, chapter, page, source_path): first page of each chapter, nulls left out, and the path of its first chunk."""
    c = chunks.withColumn("chapter", F.trim("chapter")).where("chapter <> ''")
    return c.groupBy("title", "chapter").agg(F.min(F.when(F.col("page") >= 0, F.col("page"))).alias("page"), F.min_by("source_path", "id").alias("source_path"))


def library(books: DataFrame) -> DataFrame:
    """(title, author, format, source_path, n): author and format of the title's first book, path and count of its largest."""
    return books.groupBy("title").agg(F.min_by("author", "book_id").alias("author"), F.min_by("format", "book_id").alias("format"), F.min_by("source_path", F.struct(-F.col("n"), "book_id")).alias("source_path"), F.max("n").alias("n"))


def themes(titles: DataFrame) -> DataFrame:
    """(theme, title, n): titles that are one work, shown as the most frequent."""
    t = titles.withColumn("theme", tx.normalize_title(F.col("title"))).where("theme <> ''")
    return t.groupBy("theme").agg(F.min_by("title", F.struct(-F.col("n"), "title")).alias("title"), F.sum("n").alias("n"))


def even_sample(rows: DataFrame, order: str, most: int) -> DataFrame:
    """At most so many rows, evenly over their order: row int(i * n / most) for each i."""
    n = rows.count()
    if n <= most:
        return rows
    spark = rows.sparkSession
    wanted = spark.range(most).select(F.floor(F.col("id") * F.lit(n) / F.lit(most)).cast("long").alias("_i"))
    # ranks in two levels, so that no task sorts all rows: by first letters, then within
    head = rows.withColumn("_h", F.substring(order, 1, 3))
    sizes = head.groupBy("_h").agg(F.count("*").alias("_n"))
    base = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_h").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_h", "_base")
    at = head.withColumn("_r", F.row_number().over(W.partitionBy("_h").orderBy(order))).join(base, "_h")
    return at.withColumn("_i", F.col("_base") + F.col("_r") - 1).join(F.broadcast(wanted), "_i", "left_semi").select(*rows.columns)


def search(rows: DataFrame, needle: str, columns: list[str], most: int) -> DataFrame:
    """Rows that contain the needle, whatever its case, the first in order, with how many there are in all."""
    text = F.lower(F.concat_ws("\0", *columns))
    hits = rows.where(F.contains(text, F.lit(needle.lower())))
    total = hits.agg(F.count("*").alias("total"))
    return hits.orderBy(*columns).limit(most).crossJoin(F.broadcast(total))
