"""Splitting streamed answers into what is said and what is thought.

Tags may be cut anywhere between two pieces, so the state of a message holds
whether it is inside a tag and the end of the text that may be the beginning
of one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import let_workers_import

TAGS = ("<think>", "</think>")


def feed(inside: bool, held: str, piece: str) -> tuple[bool, str, str, str]:
    """(inside, held, said, thought) after one more piece."""
    out = ["", ""]
    text = held + piece
    while True:
        tag = TAGS[inside]
        before, found, after = text.partition(tag)
        if not found:
            keep = next((k for k in range(min(len(tag) - 1, len(text)), 0, -1) if tag.startswith(text[-k:])), 0)
            out[inside] += text[: len(text) - keep]
            return inside, text[len(text) - keep :], out[0], out[1]
        out[inside] += before
        inside, text = not inside, after


#: Milliseconds of processing time without a piece after which a message is given up.
IDLE_MS = 120_000


def split_stream(pieces: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """(message, said, thought, ended) of a stream (message, seq, piece, last).

    ended is open while more may come, done with the last piece, and idle if none came for so long; what is held is let go with either.
    """
    let_workers_import(pieces.sparkSession)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        inside, held = state.get if state.exists else (False, "")
        said = thought = ""
        ended = state.hasTimedOut
        for pdf in () if ended else frames:
            for x in pdf.sort_values("seq").itertuples():
                inside, held, a, b = feed(inside, held, x.piece or "")
                said, thought = said + a, thought + b
                ended = ended or bool(x.last)
        if ended:
            said, thought = (said, thought + held) if inside else (said + held, thought)
            over = "idle" if state.hasTimedOut else "done"
            state.remove()
        else:
            over = "open"
            state.update((inside, held))
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"message": [key[0]], "said": [said], "thought": [thought], "ended": [over]})

    return pieces.groupBy("message").applyInPandasWithState(run, "message long, said string, thought string, ended string", "inside boolean, held string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def split_whole(text: Column) -> tuple[Column, Column]:
    """(said, thought) of a whole text: the same without a stream."""
    said = F.regexp_replace(text, r"(?s)<think>.*?(?:</think>|\z)", "")
    thought = F.array_join(F.regexp_extract_all(text, F.lit(r"(?s)<think>(.*?)(?:</think>|\z)"), F.lit(1)), "")
    return said, thought
