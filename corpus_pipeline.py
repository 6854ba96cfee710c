"""The training-data pipeline: quality rules, near-duplicates, secrets, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents, with n_chars brought up to date where the text changes.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfspark.llm import bpe, mixing, ngram_join, quality_rules, secret_scan
from shelfspark.llm.shared import WORD, durable, shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Texts are counted twice so that they need not be shuffled or stored."""
    counted = durable(quality_rules.counts(docs.select("lang", "source", "text")).drop("text"))
    limits = durable(quality_rules.thresholds(counted))
    return quality_rules.judge(quality_rules.counts(docs), limits).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the one of the smallest id, and all documents without a word.

    Rows go by id and text together. Among rows of the smallest id, the text of
    the smallest hash stays, once; a row without an id stays only where none has one.
    """
    found = ngram_join.classes(docs.select("doc_id", "text"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))
    kept = found.where("root IS NOT NULL").groupBy("root").agg(first.alias("x"))
    kept = kept.select(F.xxhash64("x.doc_id", "x.text_key").alias("kept"))
    text_key = F.xxhash64("text")
    # the whole row goes as one column, so that no name of its columns matters
    rows = docs.select(F.struct("*").alias("doc"), F.xxhash64("doc_id", text_key).alias("key"), text_key.alias("text_key"))
    words = F.coalesce(F.col("doc.text").rlike(WORD), F.lit(False))
    once = F.row_number().over(W.partitionBy("key").orderBy("text_key"))
    stay = rows.where(words).join(kept, F.col("key") == F.col("kept"), "left_semi").withColumn("turn", once).where("turn = 1")
    return stay.select("doc.*").unionByName(rows.where(~words).select("doc.*"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of every secret."""
    scanned = secret_scan.scan(docs)
    clean = secret_scan.redact(scanned)
    n_chars = F.when(F.size("spans") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")
    return clean.withColumn("n_chars", n_chars).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, as a row for each time a document is gone through.

    The slots of one round take a document's words from its first on without a gap,
    so a round's row is the text up to the last word taken. Rows come in the order of
    the first slot that takes of them, part by part, so that any stretch holds the sources in proportion.
    """
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    placed, taken = mixing.mix(sized)
    rounds = taken.groupBy("source", "begin", "epoch").agg(F.sum("n_words").alias("take"), F.min("slot").alias("slot"))
    rounds = rounds.select(F.col("source").alias("of_source"), F.col("begin").alias("of_begin"), "epoch", "take", "slot")
    plan = placed.where("size > 0").join(rounds, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("begin") == F.col("of_begin")))
    # repeated ids: the documents of an id are told apart by size and turn
    turn = W.partitionBy("doc_id", "source", "size")
    plan = plan.withColumn("turn", F.dense_rank().over(turn.orderBy("begin"))).select("doc_id", "source", "size", "turn", "epoch", "begin", "take", "slot")
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("d"), F.col("source").alias("s"), mixing.word_count(F.col("text")).alias("n")).where("n > 0")
    rows = rows.withColumn("place", F.row_number().over(W.partitionBy("d", "s", "n").orderBy(F.xxhash64("doc.text"))))
    same = F.col("d").eqNullSafe(F.col("doc_id")) & F.col("s").eqNullSafe(F.col("source")) & (F.col("n") == F.col("size")) & (F.col("place") == F.col("turn"))
    both = rows.join(plan, same)
    # the first words, each with the white space before it
    pieces = F.regexp_extract_all("doc.text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.array_join(F.slice(pieces, F.lit(1), F.col("take").cast("int")), "")
    text = F.when(F.col("take") >= F.col("n"), F.col("doc.text")).otherwise(cut)
    both = both.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long"))
    columns = [F.col(c) if c in ("text", "n_chars") else F.col("doc")[c].alias(c) for c in docs.columns]
    # parts of equally many slots, in order
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    last = taken.agg(F.coalesce(F.max("slot"), F.lit(0)).alias("last")).first()["last"]
    part = F.floor(F.col("slot") * F.lit(float(parts)) / F.lit(last + 1)).cast("int")
    cut_rows = both.select(F.struct(*columns).alias("doc"), "slot", "epoch", "begin", part.alias("part"))
    return cut_rows.repartitionById(parts, F.col("part")).sortWithinPartitions("slot", "epoch", "begin").select("doc.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, ids_sha256, decoded_sha256) of every row."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.decode(bpe.encode(docs.select("doc_id", "lang", "source", "text"), path, public_tokenizers.PATTERN), path)
    n_tokens = F.size("ids").cast("long").alias("n_tokens")
    digest = F.sha2(bpe.ids_text(F.col("ids")).cast("binary"), 256).alias("ids_sha256")
    return coded.select("doc_id", "lang", "source", n_tokens, "ids", digest, F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixed), ("tokens", tokens)]

#: Byte-pair encoding has no SQL form; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read by the next."""
    import uuid

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    where = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            out.write.parquet(f"{where}/{k}")
            docs = spark.read.parquet(f"{where}/{k}")
    return out
