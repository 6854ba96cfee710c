"""Asking a library: retrieval for a question in its conversation, the prompt, and the answer as a stream."""

from __future__ import annotations

import queue
import threading
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import text as tx
from ..session import let_workers_import
from . import models
from . import retrieval as r

#: Seconds without a line after which an answer is given up.
IDLE = 120.0
#: A generator gives the lines of a provider's stream for a prompt.
Generator = Callable[[str], Iterable[str]]


def pools(asked: DataFrame, chunks: DataFrame, settings: Settings, embedder: Callable[[], models.Embedder] | None, index=None) -> DataFrame:
    """The fused hits (qid, id, score, rank) of questions (qid, q) in chunks (id, text, vector): vector, full-text and fuzzy lists.

    With an index (sources.postings) of the chunks, full-text lists come from it and no text is read for them.
    """
    docs = chunks.select("id", "text")
    if index is None:
        lists = r.bm25_lists([r.terms_of(asked), r.fuzzy_terms(asked, docs)], docs, settings.hybrid_k)
    else:
        lists = [index.search(r.terms_of(asked), settings.hybrid_k), index.search(index.fuzzy_terms(asked), settings.hybrid_k)]
    if embedder is not None:
        # the search goes by numbers
        keyed = chunks.where(F.size("vector") > 0).withColumn("_key", F.xxhash64("id"))
        vectors = keyed.select(F.col("_key").alias("id"), F.col("vector").cast("array<double>").alias("v"))
        wanted = models.embed(asked, embedder, text="q", out="v").select("qid", F.col("v").cast("array<double>").alias("v"))
        found = r.vector_search(wanted, vectors, settings.hybrid_k, own=True).withColumnRenamed("id", "_key")
        lists.append(found.join(keyed.select("_key", "id"), "_key").select("qid", "id", "score", "rank"))
    return r.fuse(lists, settings.hybrid_k)


def widened(asked: DataFrame, prior: DataFrame, embedder: Callable[[], models.Embedder] | None) -> DataFrame:
    """(qid, q) of the questions that lean on the one before them, from prior (qid, prior), both together; nothing for others."""
    both = asked.join(prior, "qid").where("prior IS NOT NULL AND trim(prior) <> ''")
    cosine: Column = F.lit(None).cast("double")
    if embedder is not None:
        both = models.embed(models.embed(both, embedder, text="q", out="_a"), embedder, text="prior", out="_b")
        cosine = tx.cosine(F.col("_a").cast("array<double>"), F.col("_b").cast("array<double>"))
    return both.where(tx.fuse_followup(F.col("q"), cosine)).select("qid", F.concat("prior", F.lit("\n"), "q").alias("q"))


def retrieve(asked: DataFrame, chunks: DataFrame, settings: Settings = Settings(), embedder: Callable[[], models.Embedder] | None = None, prior: DataFrame | None = None, score=r.overlap, index=None) -> DataFrame:
    """The best chunks (qid, id, score, rank, ...) of questions (qid, q).

    Words that the library does not know are repaired, and a repaired question is searched anew in all lists in place
    of what was asked. A question that leans on the one before it is searched together with that too; reranking goes by the question alone.
    """
    docs = chunks.select("id", "text")
    fixed = r.correct(asked, r.vocabulary(docs) if index is None else index.vocabulary()).select("qid", "q")
    pool = pools(fixed, chunks, settings, embedder, index)
    if prior is not None:
        more = pools(widened(fixed, prior, embedder), chunks, settings, embedder, index)
        pool = pool.select("qid", "id", "score").unionByName(more.select("qid", "id", "score")).groupBy("qid", "id").agg(F.max("score").alias("score"))
    ranked = r.rerank(pool.select("qid", "id"), fixed, docs, settings.hybrid_k, score)
    return r.tiers(ranked, settings.min_relevance, settings.final_k)


class Idle(TimeoutError):
    """A provider said nothing for too long."""


def lines_within(lines: Iterable[str], idle: float = IDLE, stopped: Callable[[], bool] = lambda: False) -> Iterator[str]:
    """The lines as they come; raises Idle after so many seconds without one, and ends when asked to stop."""
    inbox: queue.Queue = queue.Queue(maxsize=64)

    def pump() -> None:
        try:
            for line in lines:
                inbox.put((line, None))
            inbox.put((None, None))
        except BaseException as e:  # handed to the reader
            inbox.put((None, e))

    threading.Thread(target=pump, daemon=True).start()
    while not stopped():
        try:
            line, error = inbox.get(timeout=idle)
        except queue.Empty:
            raise Idle(f"no answer for {idle:g} seconds") from None
        if error is not None:
            raise error
        if line is None:
            return
        yield line


def answer_lines(prompts: DataFrame, make: Callable[[], Generator], idle: float = IDLE) -> DataFrame:
    """(qid, seq, line, error) of rows (qid, prompt): what a generator streams. make is called once in each task; a failure is a row, not a failed job."""
    let_workers_import(prompts.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate = make()
        for pdf in frames:
            for x in pdf.itertuples():
                rows, error = [], None
                try:
                    for i, line in enumerate(lines_within(generate(x.prompt), idle)):
                        rows.append((x.qid, i, line, None))
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"
                if error or not rows:
                    rows.append((x.qid, len(rows), None, error))
                yield pd.DataFrame(rows, columns=["qid", "seq", "line", "error"])

    return prompts.select("qid", "prompt").mapInPandas(run, "qid long, seq long, line string, error string")


def usage(parsed: DataFrame) -> DataFrame:
    """(qid, in_tokens, out_tokens) of rows (qid, seq, in_tokens, out_tokens): the last that was told, since providers repeat running totals."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return parsed.groupBy("qid").agg(last("in_tokens"), last("out_tokens"))


def answers(lines: DataFrame, provider: str) -> DataFrame:
    """(qid, said, thought, in_tokens, out_tokens, error) of lines of a provider's stream; thoughts in tags count as such."""
    from ..streaming.think import split_whole

    x = lines.select("qid", "seq", "error", tx.stream_line(F.col("line"), F.lit(provider)).alias("x")).select("qid", "seq", "error", "x.*")
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("seq", c)))), lambda p: p[c]), "")
    whole = x.groupBy("qid").agg(joined("content").alias("_said"), joined("reasoning").alias("_thought"), F.max("error").alias("error"))
    said, thought = split_whole(F.col("_said"))
    return whole.join(usage(x), "qid").select("qid", said.alias("said"), F.concat("_thought", thought).alias("thought"), "in_tokens", "out_tokens", "error")


def extractive() -> Generator:
    """A generator without a model: repeats the first sentence of the first source, as lines of the plain form."""
    import json
    import re

    def generate(prompt: str) -> Iterator[str]:
        source = re.search(r"Sources:\n\[(\d+)\] [^\n]*\n(.*?)(?<=[.!?])(?:\s|$)", prompt, re.S)
        text = f"{source[2].strip()} [{source[1]}]" if source else "The sources hold no answer."
        for word in re.findall(r"\S+\s*", text):
            yield json.dumps({"response": word, "done": False})
        yield json.dumps({"response": "", "done": True, "prompt_eval_count": len(prompt) // 4, "eval_count": len(text) // 4})

    return generate


