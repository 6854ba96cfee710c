"""Do citations still lead to their passages? Classification of each, and rates by stratum."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import formats as fm
from ..functions import text as tx
from ..session import let_workers_import
from ..sources.readers import read_blocks
from . import models
from .retrieval import top
from .sections import _in_order, first_run_texts


def classify_book(chapter: Column, probe: Column, run: Column, whole: Column) -> Column:
    """run is the text of the chapter that the stored label resolves to, null if to none."""
    anywhere = F.contains(whole, probe)
    found = F.when(anywhere, "located")
    return (
        F.when(probe == "", "cold miss")
        .when(chapter.isNull(), F.when(anywhere, "chapterless located").otherwise("chapterless miss"))
        .when(run.isNull(), F.coalesce(found, F.lit("cold miss")))
        .when(F.contains(run, probe), "direct")
        .otherwise(F.coalesce(found, F.lit("miss in chapter")))
    )


def classify_pdf(page: Column, probe: Column, on: Column, near: Column, whole: Column) -> Column:
    """on: the text of the stored page; near: those of the pages around it, end to end."""
    anywhere = F.contains(whole, probe)
    return (
        F.when(probe == "", "cold miss")
        .when(page.isNull(), F.when(anywhere, "chapterless located").otherwise("chapterless miss"))
        .when(F.coalesce(F.contains(on, probe), F.lit(False)), "direct")
        .when(F.coalesce(F.contains(near, probe), F.lit(False)), "near")
        .when(anywhere, "located")
        .otherwise("miss in chapter")
    )


RUNGS = ("page", "page before", "page behind", "prefix")
#: Words that are looked for where all of them are not found.
SHORT = 4


def ladder(cites: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, rung, found): where the words of a citation (id, path, page, words) are found in the pages (path, page, text) of its file.

    All words, with any white space between them and in either case, on the cited page, the one before, the one
    behind; else the first SHORT of more on the cited page; else none. A join by path and page meets three pages for each citation.
    """
    pattern = lambda words: F.concat(F.lit("(?is)"), F.array_join(F.transform(words, lambda w: F.concat(F.lit("\\Q"), w, F.lit("\\E"))), "\\s*"))
    c = cites.where(F.size("words") > 0).withColumn("_whole", pattern(F.col("words"))).withColumn("_short", F.when(F.size("words") > SHORT, pattern(F.slice("words", 1, SHORT))))
    near = c.withColumn("_page", F.explode(F.array(F.col("page") - 1, F.col("page"), F.col("page") + 1))).join(pages.select(F.col("path").alias("_path"), F.col("page").alias("_p"), "text"), (F.col("path") == F.col("_path")) & (F.col("_page") == F.col("_p")))
    whole = F.regexp_like("text", F.col("_whole"))
    here = F.col("_p") == F.col("page")
    rung = F.when(here & whole, 1).when((F.col("_p") < F.col("page")) & whole, 2).when((F.col("_p") > F.col("page")) & whole, 3).when(here & F.coalesce(F.regexp_like("text", F.col("_short")), F.lit(False)), 4)
    best = near.select("id", rung.alias("_r"), "_p").where("_r IS NOT NULL").groupBy("id").agg(F.min(F.struct("_r", "_p")).alias("x"))
    named = F.coalesce(*[F.when(F.col("x._r") == i + 1, name) for i, name in enumerate(RUNGS)], F.lit("none"))
    return cites.join(best, "id", "left").select("id", named.alias("rung"), F.col("x._p").alias("found"))


def label_tier(stored: Column, label: Column) -> tuple[Column, Column]:
    """(tier, score) at which a stored label fits one of a table of contents; tier null if it doesn't. Both are normalized."""
    words = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: F.length(w) >= 3))
    w, l = words(stored), words(label)
    common = F.size(F.array_intersect(w, l))
    score = common / F.greatest(F.size(w) + F.size(l) - common, F.lit(1))
    long = (F.length(stored) >= 6) & (F.length(label) >= 6) & (F.contains(label, stored) | F.contains(stored, label))
    tier = F.when(stored == "", None).when(stored == label, 1).when(long, 2).when((F.size(w) >= 2) & (common >= 2) & (score >= 0.6), 3)
    return tier, F.round(F.when(tier == 3, score).otherwise(F.lit(0.0)), 9)


#: Bytes of a text file that are shown, and so looked at.
SHOWN_BYTES = 8 << 20
#: Outcomes in the order of a report.
OUTCOMES = ("direct", "near", "located", "miss in chapter", "cold miss", "chapterless located", "chapterless miss", "unverifiable", "unverified family", "extract error")


def sample(meta: DataFrame, books: int, per_book: int, seed: int = 1) -> DataFrame:
    """The rows of meta (id, book_id, title, source_path, ...) of some books of each family and script, and some of each book, by a hash of their ids; with family and script."""
    path = F.col("source_path")
    of_book = meta.groupBy("book_id").agg(F.min(F.struct("source_path", "title")).alias("x")).select("book_id", "x.*")
    named = of_book.select("book_id", fm.render_family(fm.ext_of(path)).alias("family"), tx.script_of(F.col("title")).alias("script"), path)
    some = top(named.withColumn("_h", F.xxhash64("book_id", F.lit(seed))), ["family", "script"], ["_h", "book_id"], books).select("book_id", "family", "script", F.col("source_path").alias("_path"))
    chunks = meta.join(some, "book_id").where(path == F.col("_path")).drop("_path").withColumn("_h", F.xxhash64("id", F.lit(seed)))
    return top(chunks, ["book_id"], ["_h", "id"], per_book).drop("_h", "rank")


def _shown(text: Column) -> Column:
    return F.lower(tx.norm_text(text))


def outcomes(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """(id, family, script, outcome) of sampled chunks (id, family, script, source_path, chapter, page, text): their files are read anew, and each passage is looked for where its citation points.

    files (path, content). A file that is missing or cannot be read gives extract errors. chapter and page are null where there is none.
    """
    c = chunks.withColumn("probe", F.lower(tx.probe_of(F.col("text"))))
    fixed = c.where(F.col("family").isin("book-unverifiable", "unverified", "unknown")).select("id", "family", "script", F.when(F.col("family") == "book-unverifiable", "unverifiable").otherwise("unverified family").alias("outcome"))
    wanted = c.where(F.col("family").isin("book", "pdf", "text")).select("source_path").distinct()
    here = files.join(wanted, F.col("path") == F.col("source_path"), "left_semi")

    # books and PDF files, as blocks
    blocks = read_blocks(here.select("path", "content")).select("path", "pos", "chapter", "page", _shown(F.col("text")).alias("text"), "reason")
    good = blocks.where("reason IS NULL")
    whole = good.groupBy("path").agg(_in_order(F.col("text"), "pos", " ").alias("whole"))
    labels = first_run_texts(good.withColumn("label", tx.norm_chapter(F.col("chapter"))).where("label <> ''"), ["path"], "pos", "label", "text")
    book = c.where("family = 'book'").withColumn("stored", tx.norm_chapter(F.coalesce("chapter", F.lit(""))))
    tier, score = label_tier(F.col("stored"), F.col("label"))
    fits = book.select("id", "source_path", "stored").join(labels, F.col("source_path") == F.col("path")).select("id", tier.alias("tier"), score.alias("score"), "label", F.col("text").alias("run")).where("tier IS NOT NULL")
    run = fits.groupBy("id").agg(F.min(F.struct("tier", -F.col("score"), "label", "run"))["run"].alias("run"))
    book = book.join(whole.withColumnRenamed("path", "source_path"), "source_path", "left").join(run, "id", "left")
    said = book.select("id", "family", "script", F.when(F.col("whole").isNull(), "extract error").otherwise(classify_book(F.col("chapter"), F.col("probe"), F.col("run"), F.col("whole"))).alias("outcome"))

    pages = good.where("page IS NOT NULL").select(F.col("path").alias("source_path"), F.col("page").alias("_page"), "text")
    pdf = c.where("family = 'pdf'")
    beside = pdf.select("id", "source_path", "page").join(pages, "source_path").where(F.abs(F.col("_page") - F.col("page")) <= 1)
    around = beside.groupBy("id").agg(F.max(F.when(F.col("_page") == F.col("page"), F.col("text"))).alias("on"), _in_order(F.col("text"), "_page", " ").alias("near"))
    pdf = pdf.join(whole.withColumnRenamed("path", "source_path"), "source_path", "left").join(around, "id", "left")
    paged = pdf.select("id", "family", "script", F.when(F.col("whole").isNull(), "extract error").otherwise(classify_pdf(F.col("page"), F.col("probe"), F.col("on"), F.col("near"), F.col("whole"))).alias("outcome"))

    # text files are shown as they are
    let_workers_import(chunks.sparkSession)

    @F.pandas_udf("boolean")
    def matches(passage: pd.Series, content: pd.Series) -> pd.Series:
        known: dict[str, list[str]] = {}
        return pd.Series([models.md_match(p or "", known.setdefault(t, models.md_blocks(t))) for p, t in zip(passage, content, strict=True)], dtype="boolean")

    text = c.where("family = 'text'").join(here.select(F.col("path").alias("source_path"), fm.read_capped(F.col("content"), SHOWN_BYTES)["text"].alias("content")), "source_path", "left")
    found = text.where("content IS NOT NULL").select("id", "family", "script", F.when(matches("text", "content"), "chapterless located").otherwise("chapterless miss").alias("outcome"))
    lost = text.where("content IS NULL").select("id", "family", "script", F.lit("extract error").alias("outcome"))
    return fixed.unionByName(said).unionByName(paged).unionByName(found).unionByName(lost)


def tally(found: DataFrame) -> DataFrame:
    """(family, script, outcome, n, percent) of outcomes, in the order of a report."""
    n = found.groupBy("family", "script", "outcome").agg(F.count("*").alias("n"))
    share = F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(W.partitionBy("family", "script")), 1)
    place = F.array_position(F.array(*map(F.lit, OUTCOMES)), F.col("outcome"))
    return n.withColumn("percent", share).orderBy("family", "script", place)


def metric(passages: DataFrame, files: DataFrame, books: int = 8, per_book: int = 4, seed: int = 1) -> DataFrame:
    """The tally of a sample of a passage table's view, whose files are read anew."""
    return tally(outcomes(sample(passages, books, per_book, seed), files))
