"""Text of MOBI and AZW3 files: the records of a Palm database, unpacked."""

from __future__ import annotations

import struct


class Broken(ValueError):
    """No book that can be read."""


def unpack(data: bytes) -> bytes:
    """PalmDOC's packing undone: runs of plain bytes, copies of what came before, and letters with a space before them."""
    out, at = bytearray(), 0
    while at < len(data):
        c = data[at]
        at += 1
        if 1 <= c <= 8:
            out += data[at : at + c]
            at += c
        elif c < 0x80:
            out.append(c)
        elif c >= 0xC0:
            out += bytes([32, c ^ 0x80])
        else:
            if at >= len(data):
                break
            pair = (c << 8 | data[at]) & 0x3FFF
            at += 1
            back, size = pair >> 3, (pair & 7) + 3
            if not 0 < back <= len(out):
                raise Broken("damaged packing")
            for _ in range(size):
                out.append(out[-back])
    return bytes(out)


def _without_tail(data: bytes, flags: int) -> bytes:
    """A text record without the entries that may follow its text."""
    for _ in range(bin(flags >> 1).count("1")):
        size = shift = 0
        for c in reversed(data[-4:]):
            size |= (c & 0x7F) << shift
            shift += 7
            if c & 0x80:
                break
        data = data[: len(data) - size] if 0 < size <= len(data) else data
    if flags & 1 and data:
        data = data[: len(data) - (data[-1] & 3) - 1]
    return data


def read(data: bytes) -> tuple[str, str | None]:
    """(HTML, title) of a book."""
    if len(data) < 80 or data[60:68] not in (b"BOOKMOBI", b"TEXtREAd"):
        raise Broken("not a mobi file")
    many = struct.unpack(">H", data[76:78])[0]
    starts = [struct.unpack(">I", data[78 + 8 * i : 82 + 8 * i])[0] for i in range(many)] + [len(data)]
    record = lambda i: data[starts[i] : starts[i + 1]]
    head = record(0)
    packing, _, _, texts, _, locked = struct.unpack(">HHIHHH", head[:14])
    if locked:
        raise Broken("book with copy protection")
    if packing not in (1, 2):
        raise Broken("no reader of this packing")
    encoding, flags, title = "cp1252", 0, None
    if head[16:20] == b"MOBI":
        size, _, code = struct.unpack(">III", head[20:32])
        encoding = "utf-8" if code == 65001 else "cp1252"
        where, long = struct.unpack(">II", head[84:92])
        title = head[where : where + long].decode(encoding, "replace").strip() or None
        flags = struct.unpack(">H", head[242:244])[0] if size >= 228 and len(head) >= 244 else 0
    parts = [_without_tail(record(i), flags) for i in range(1, min(texts, many - 1) + 1)]
    return b"".join(unpack(p) if packing == 2 else p for p in parts).decode(encoding, "replace"), title
