"""Pluggable models: token counters, embedders, and their defaults without a download.

An embedder is a function from texts to rows of a matrix. The default hashes
words into dimensions with signs and scales to length 1: texts that share words are near.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words_of
from ..session import let_workers_import

Embedder = Callable[[list[str]], np.ndarray]


def token_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def hashed_words(dim: int = 64) -> Embedder:
    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", t.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % dim] += 1 if h >> 63 else -1
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(size == 0, 1, size)

    return embed


def embed(rows: DataFrame, make: Callable[[], Embedder], text: str = "text", out: str = "vector", batch: int = 64) -> DataFrame:
    """Add vectors; make is called once in each task and its model is used in batches."""
    let_workers_import(rows.sparkSession)

    @F.pandas_udf("array<float>")
    def run(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in columns:
            values = texts.fillna("").tolist()
            yield pd.Series([v.astype(np.float32) for k in range(0, len(values), batch) for v in model(values[k : k + batch])])

    return rows.withColumn(out, run(F.col(text)))


def md_blocks(text: str) -> list[str]:
    """The text of a Markdown file's blocks without marks: paragraphs, list items, headings up to level 4, code."""
    blocks, held, code = [], [], None

    def close() -> None:
        if held:
            blocks.append(" ".join(held))
            held.clear()

    for raw in text.split("\n"):
        line = raw.rstrip()
        fence = line.lstrip().startswith("```")
        if code is not None:
            if fence:
                blocks.append("\n".join(code))
                code = None
            else:
                code.append(raw)
        elif fence:
            close()
            code = []
        elif m := re.match(r"\s*(?:#{1,4}|[-*]|\d+\.)\s+(.*)$", line):
            close()
            blocks.append(m[1])
        elif line.strip():
            held.append(line)
        else:
            close()
    if code is not None:
        blocks.append("\n".join(code))
    close()
    bare = [re.sub(r"\*\*([^*]+)\*\*|\*([^*]+)\*|`([^`]+)`|\[[\d,\s]+\]", lambda m: m[1] or m[2] or m[3] or "", b) for b in blocks]
    return [b for b in bare if b.strip()]


def md_match(passage: str, blocks: list[str]) -> bool:
    """Whether a block has the first 40 characters of the passage, or of what follows its first line."""
    plain = lambda s: " ".join(s.split()).lower()
    needles = {n for n in (plain(passage)[:40], plain(passage.partition("\n")[2])[:40]) if n}
    return any(n in b for b in map(plain, blocks) for n in needles)


def slices(text: str, size: int = 512 * 1024) -> list[int]:
    """Where a long text is cut for display: at the first empty line behind each so many characters."""
    out, at = [0], 0
    while at + size < len(text):
        cut = text.find("\n\n", at + size)
        if cut < 0:
            break
        at = cut + 2
        out.append(at)
    return out


def trim_tail(text: str, most: int) -> str:
    """The last bytes of a text, from a character's first byte on."""
    data = text.encode()
    return text if len(data) <= most else data[-most:].decode(errors="ignore")


def fnv1a(data: bytes, value: int = 0xCBF29CE484222325) -> int:
    """64-bit FNV-1a."""
    for b in data:
        value = (value ^ b) * 0x100000001B3 % (1 << 64)
    return value


def copy_key(data: bytes, sample: int = 64 * 1024) -> str:
    """The name of a file's searchable copy: FNV-1a of its length, its first bytes and, if it is longer, its last."""
    h = fnv1a(data[:sample], fnv1a(len(data).to_bytes(8, "little")))
    return f"{fnv1a(data[-sample:], h) if len(data) > sample else h:016x}"


def dehyphenate(lines: list[str]) -> list[str]:
    """Join a line that ends in a hyphen behind a letter with the next if that begins with one."""
    out: list[str] = []
    for line in lines:
        if out and re.search(r"[^\W\d_]-$", out[-1]) and re.match(r"[^\W\d_]", line):
            out[-1] = out[-1][:-1] + line
        else:
            out.append(line)
    return out
