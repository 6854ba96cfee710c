"""From a question with its sources, history and notes to a prompt that fits the model's window."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..session import let_workers_import

SYSTEM = "Use only the numbered sources below. Mark what you take from them with their numbers, as [n]. Say so if they hold no answer, and add nothing that they do not say."
#: Characters of an older turn in the digest, by role.
DIGEST_CHARS = {"assistant": 250, "user": 150}
META = "notes_injected boolean, notes_tokens long, notes_truncated boolean, digest_lines long, recent_turns long, dropped_turns long, prompt_tokens long"


def estimate(text: str) -> int:
    """Tokens by characters, more of them where a fifth is Cyrillic; as functions.text.estimate_tokens."""
    n = len(text)
    if sum("Ѐ" <= c <= "ӿ" for c in text) * 5 >= n and n:
        return -(-n * 2 // 5)
    return -(-n // 4)


def _cut(text: str, most: int) -> str:
    return text if len(text) <= most else f"{text[:most]}…"


def _plain(text: str) -> str:
    return re.sub(r"\[[0-9, ]*[0-9][0-9, ]*\]", "", text)


@dataclass
class Prompt:
    text: str
    notes_injected: bool = False
    notes_tokens: int = 0
    notes_truncated: bool = False
    digest_lines: int = 0
    recent_turns: int = 0
    dropped_turns: int = 0
    prompt_tokens: int = 0


def assemble(question: str, sources: list[tuple[int, str, str]], history: list[tuple[str, str]] = (), notes: str | None = None, settings: Settings = Settings()) -> Prompt:
    """A prompt of sources (rank, citation, text), turns (role, text) and notes.

    Notes are cut by tenths to their share. Turns before the recent ones become lines of a digest,
    whose oldest go until it fits its share. If the whole exceeds the budget, the oldest digest lines
    go, then the oldest turns; sources and question never do.
    """
    out = Prompt("")
    note = (notes or "").strip()
    out.notes_injected = bool(note)
    while estimate(note) > settings.note_tokens:
        note, out.notes_truncated = note[: len(note) * 9 // 10], True
    out.notes_tokens = estimate(note)
    first = max(0, len(history) - settings.recent_turns)
    digest = []
    for role, text in history[:first]:
        who = "assistant" if role == "assistant" else "user"
        body = " ".join((_plain(text) if who == "assistant" else text).split())
        digest.append(f"- {who.capitalize()}: {_cut(body, DIGEST_CHARS[who])}")
    while sum(map(estimate, digest)) > settings.digest_tokens:
        digest.pop(0)
    turns = [f"Assistant: {_cut(_plain(t), settings.turn_chars)}" if role == "assistant" else f"User: {_cut(t, settings.turn_chars)}" for role, t in history[first:]]
    numbered = "".join(f"[{rank}] {citation}\n{text}\n\n" for rank, citation, text in sources)

    def whole() -> str:
        parts = [SYSTEM, "\n\n"]
        if note:
            parts += ["Notes of the reader, as background; they are no source and come after the sources:\n", note, "\n\n"]
        if digest:
            parts += ["Earlier turns in short:\n", *(f"{x}\n" for x in digest), "\n"]
        if turns:
            parts += ["The last turns:\n", *(f"{x}\n" for x in turns), "\n"]
        return "".join([*parts, "Sources:\n", numbered, f"\nQuestion: {question}\nAnswer, with [n] for each source used:"])

    text = whole()
    while estimate(text) > settings.prompt_budget and (digest or turns):
        (digest or turns).pop(0)
        text = whole()
    out.text, out.digest_lines, out.recent_turns = text, len(digest), len(turns)
    out.dropped_turns, out.prompt_tokens = len(history) - len(digest) - len(turns), estimate(text)
    return out


def prompts(asks: DataFrame, sources: DataFrame, history: DataFrame | None = None, notes: DataFrame | None = None, settings: Settings = Settings()) -> DataFrame:
    """(qid, prompt, META) of asks (qid, question).

    sources (qid, rank, citation, text) hold final_k rows for each question at most; history (qid, turn, role, text)
    one conversation's turns before it; notes (qid, note) at most one row.
    """
    spark = asks.sparkSession
    let_workers_import(spark)
    by = lambda df, order, *columns: df.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("x"))
    rows = asks.select("qid", "question").join(by(sources, "rank", "citation", "text").withColumnRenamed("x", "sources"), "qid", "left")
    empty = F.lit(None)
    if history is None:
        rows = rows.withColumn("history", empty.cast("array<struct<turn:long,role:string,text:string>>"))
    else:
        rows = rows.join(by(history, "turn", "role", "text").withColumnRenamed("x", "history"), "qid", "left")
    rows = rows.withColumn("note", empty.cast("string")) if notes is None else rows.join(notes.groupBy("qid").agg(F.max("note").alias("note")), "qid", "left")
    names = [x.split()[0] for x in META.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for x in pdf.itertuples():
                found = [(s["rank"], s["citation"] or "", s["text"] or "") for s in (x.sources if x.sources is not None else [])]
                turns = [(h["role"] or "user", h["text"] or "") for h in (x.history if x.history is not None else [])]
                p = assemble(x.question or "", found, turns, x.note, settings)
                out.append((x.qid, p.text, *(getattr(p, n) for n in names)))
            yield pd.DataFrame(out, columns=["qid", "prompt", *names])

    return rows.select("qid", "question", "sources", "history", "note").mapInPandas(run, f"qid long, prompt string, {META}")
