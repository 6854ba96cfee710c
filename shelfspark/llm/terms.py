"""Runs of letters and digits of a text, as its UTF-8 bytes with A-Z lower-cased."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: ASCII digits and letters, and all characters beyond ASCII, byte by byte; a byte of such a character is never an ASCII one.
_RUN, _GAP = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9a-z\x80-\xff]")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes that are looked at in one step.
STEP = 1 << 20


def runs(data: bytes, step: int = STEP) -> Iterator[list[bytes]]:
    """The runs of a text in order, in lists of those that start in about so many bytes."""
    data = data.translate(_LOWER)
    at = 0
    while at < len(data):
        gap = _GAP.search(data, at + step)
        end = gap.start() if gap else len(data)
        yield _RUN.findall(data, at, end)
        at = end
