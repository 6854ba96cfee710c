"""WARC archives: writing them, and reading them back record by record.

An archive is a run of gzip members, one for each record, the first a warcinfo. Archives are bounded in
size and kept as rows (archive, content) of a table, which any store that Spark
can write holds, and can be exported as .warc.gz files. The reader goes through an
archive once: it inflates a member at a time, takes the header lines, takes as
many bytes as Content-Length says, and checks them against the digests that are given. It reads
archives of other writers too: records of any type, of HTTP messages or not, with or without digests,
and several records in one member.

Pages are written as HTTP responses. Of records with equal payloads of at least MIN_REVISIT bytes the one of the
largest id is a response and the others are revisits without a payload, which refer to its record id.
The id of a record is a UUID of version 8 that holds the page's id and a check of it, so it can be told
from ids of other writers. Rows of the largest id that repeat are all responses, of one record id. A row without an id is a response
unless an equal payload has an id. Null payloads are empty. A file that is read by its path
is one cell, so it can have 2 GB at most.
"""

from __future__ import annotations

import hashlib
import os
import string
import uuid
import zlib
from base64 import b32decode, b32encode
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shared_dir, small_batches

#: Payload bytes from which equal payloads are written once only.
MIN_REVISIT = 1_000
#: Compressed bytes after which the writer starts another archive.
ARCHIVE_BYTES = 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


class Damaged(ValueError):
    """An archive whose framing or digest is wrong."""


def record_id(page_id: int | None, low: int | None = None) -> str:
    """The URI of a record: the page's id, 26 bits of a checksum of it, and 32 bits low, by chance if None."""
    if page_id is None:
        return f"urn:uuid:{uuid.uuid4()}"
    v = page_id & (1 << 64) - 1
    low = int.from_bytes(os.urandom(4), "big") if low is None else low
    tag = (zlib.crc32(v.to_bytes(8, "big")) >> 6) << 32 | low
    return f"urn:uuid:{uuid.UUID(int=(v >> 16) << 80 | 8 << 76 | (v >> 4 & 0xFFF) << 64 | 2 << 62 | (v & 15) << 58 | tag)}"


def page_of(uri: str | None) -> int | None:
    """The page's id in the URI of a record, None if it holds none."""
    try:
        n = uuid.UUID((uri or "").strip("<>").removeprefix("urn:uuid:")).int
    except ValueError:
        return None
    v = (n >> 80) << 16 | (n >> 64 & 0xFFF) << 4 | n >> 58 & 15
    if n >> 76 & 15 != 8 or n >> 62 & 3 != 2 or n >> 32 & (1 << 26) - 1 != zlib.crc32(v.to_bytes(8, "big")) >> 6:
        return None
    return v - (1 << 64) if v >> 63 else v


def _member(headers: list[str], block: bytes) -> bytes:
    squeeze = zlib.compressobj(1, wbits=31)
    head = [*headers, f"WARC-Block-Digest: sha1:{b32encode(hashlib.sha1(block).digest()).decode()}", f"Content-Length: {len(block)}"]
    return squeeze.compress("\r\n".join(["WARC/1.1", *head]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def information(name: str) -> bytes:
    """The warcinfo record of an archive."""
    return _member(["WARC-Type: warcinfo", f"WARC-Record-ID: <{record_id(None)}>", f"WARC-Date: {DATE}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields"], b"software: shelfspark\r\nformat: WARC File Format 1.1\r\n")


def record(kind: str, url: str | None, payload: bytes, digest: str, page_id: int | None, refers_to: int | None, length: int, least: int = MIN_REVISIT) -> bytes:
    """One record as a gzip member. A revisit's block is the HTTP header of the payload it stands for."""
    low = int(digest[:8], 16)  # what others may refer to has an id that they can work out
    own = record_id(page_id, low if kind == "response" and length >= least else None)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{own}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{b32encode(bytes.fromhex(digest)).decode()}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=string.punctuation)}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_id(refers_to, low)}>"]
    return _member([*lines, "Content-Type: application/http; msgtype=response"], http + (payload if kind == "response" else b""))


#: Bytes of a member that are inflated at once, and of a record's headers at most.
PIECE, HEADERS = 1 << 20, 1 << 20


def streams(content: bytes | memoryview, step: int = 1 << 16) -> Iterator[Iterator[bytes]]:
    """Each gzip member of an archive as the pieces that it inflates to, PIECE bytes at most; each is read to its end before the next."""
    view, at = memoryview(content), 0

    def inflated() -> Iterator[bytes]:
        nonlocal at
        inflate = zlib.decompressobj(wbits=31)
        while not inflate.eof:
            held = inflate.unconsumed_tail
            some = held or view[at : at + step]
            if not held and not len(some):
                raise Damaged("the archive ends inside a member")
            try:
                piece = inflate.decompress(some, PIECE)
            except zlib.error as e:
                raise Damaged(str(e)) from e
            if not held:
                at += len(some)
            if inflate.eof:
                at -= len(inflate.unused_data)
            if piece:
                yield piece

    while at < len(view):
        member = inflated()
        yield member
        for _ in member:  # what the reader has left
            pass


def members(content: bytes | memoryview, step: int = 1 << 16) -> Iterator[bytes]:
    """Each gzip member of an archive as a whole."""
    return (b"".join(pieces) for pieces in streams(content, step))


def _fields(lines: list[str]) -> dict[str, str]:
    """Header fields by lower-case name; a line that begins with white space goes on with the one before."""
    out: dict[str, str] = {}
    name = ""
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            out[name] = f"{out[name]} {line.strip()}".strip()
        else:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def _digest(said: str) -> tuple[str, bytes] | None:
    """Algorithm and digest of a digest field; None if it is of no known kind."""
    name, _, value = said.partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in hashlib.algorithms_guaranteed or not value:
        return None
    size = hashlib.new(name).digest_size
    try:
        return name, bytes.fromhex(value) if len(value) == 2 * size else b32decode(value.strip().upper() + "=" * (-len(value.strip()) % 8))
    except ValueError:
        return None


def _agrees(said: str, data: bytes) -> bool:
    known = _digest(said)
    return known is None or hashlib.new(known[0], data).digest() == known[1]


def parse(member: bytes | Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers by lower-case name, and the block, of each record of a member, framed as its pieces come; raises Damaged unless framing and digest are right.

    Only the record at hand and a piece beyond it are held.
    """
    pieces = iter([member]) if isinstance(member, bytes) else member
    held, at = bytearray(), 0

    def upto(size: int) -> bool:
        """Have so many bytes from at on; False if the member ends before."""
        while len(held) - at < size:
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while upto(1):
        if at > PIECE:
            del held[:at]
            at = 0
        seen = at
        while (end := held.find(b"\r\n\r\n", seen)) < 0:
            seen = max(at, len(held) - 3)
            if len(held) - at > HEADERS or not upto(len(held) - at + 1):
                raise Damaged("no WARC header")
        lines = held[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise Damaged("no WARC header")
        headers = _fields(lines[1:])
        said = headers.get("content-length", "")
        n = int(said) if said.isdecimal() else -1
        at = end + 4
        if n < 0 or not upto(n + 4) or held[at + n : at + n + 4] != b"\r\n\r\n":
            raise Damaged("Content-Length does not frame the block")
        block = bytes(memoryview(held)[at : at + n])
        at += n + 4
        if not _agrees(headers.get("warc-block-digest", ""), block):
            raise Damaged("the block does not match its digest")
        yield headers, block


def _unchunked(body: bytes) -> bytes | None:
    """What a chunked HTTP body holds; None if it is not well formed."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        try:
            n = int(size, 16)
        except ValueError:
            return None
        if n == 0:
            return b"".join(out)
        if len(body) < end + 2 + n:
            return None
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


def payload_of(headers: dict[str, str], block: bytes) -> tuple[bytes, int]:
    """The payload of a record and its full length; raises Damaged where a digest of it is given and does not match.

    A record of an HTTP message has the body as its payload, any other its block. A revisit has none, but may tell the length.
    """
    kind, said = headers.get("warc-type", ""), headers.get("warc-payload-digest", "")
    if not headers.get("content-type", "").lower().startswith("application/http"):
        if kind == "revisit":
            return b"", 0
        body, http = block, {}
    else:
        head, _, body = block.partition(b"\r\n\r\n")
        http = _fields(head.decode("utf-8", "replace").split("\r\n")[1:])
    if kind == "revisit":
        length = http.get("content-length", "")
        return b"", int(length) if length.isdecimal() else 0
    plain = _unchunked(body) if http.get("transfer-encoding", "").lower() == "chunked" else None
    if said and "warc-truncated" not in headers and not (_agrees(said, body) or plain is not None and _agrees(said, plain)):
        raise Damaged("the payload does not match its digest")
    body = plain if plain is not None else body
    return body, len(body)


def roles(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to is null for responses."""
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    p = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    p = p.withColumn("digest", F.sha1("payload")).withColumn("length", F.octet_length("payload").cast("long"))
    last = p.where(F.col("length") >= least).groupBy("digest", "length").agg(F.max("page_id").alias("_last"), F.count("*").alias("_n")).where("_n > 1 AND _last IS NOT NULL")
    last = last.select(F.col("digest").alias("_d"), F.col("length").alias("_l"), "_last")
    p = p.join(last, (F.col("digest") == F.col("_d")) & (F.col("length") == F.col("_l")), "left")
    return p.select("page_id", "url", "payload", "digest", "length", F.when(~F.col("page_id").eqNullSafe(F.col("_last")), F.col("_last")).alias("refers_to"))


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def archive() -> pa.RecordBatch:
        name = f"{uuid.uuid4().hex}.warc.gz"
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join([information(name), *held])], pa.binary())], ["archive", "content"])

    for batch in batches:
        for page_id, url, payload, digest, length, to in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            held.append(record("response" if to is None else "revisit", url, payload, digest, page_id, to, length))
            size += len(held[-1])
            if size >= ARCHIVE_BYTES:
                yield archive()
                held, size = [], 0
    if held:
        yield archive()


def write(pages: DataFrame, path: str, **columns) -> None:
    """Write the archives of all rows as a table at path."""
    small_batches(pages.sparkSession, 256)
    rows = roles(pages, **columns)
    # a revisit needs no payload, so it does not travel to the writer
    rows = rows.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b"")))
    rows.mapInArrow(_write, "archive string, content binary").write.mode("errorifexists").option("compression", "uncompressed").parquet(path)


RECORD = "archive string, record_id string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
_KINDS = [("archive", pa.string()), ("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _KINDS, strict=True)], [n for n, _ in _KINDS])

    for batch in batches:
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows, size = [], 0
            for pieces in streams(content.as_buffer()):
                for h, block in parse(pieces):
                    kind, own = h.get("warc-type", ""), h.get("warc-record-id", "").strip("<>") or None
                    payload, length = payload_of(h, block)
                    known = _digest(h.get("warc-payload-digest", "")) if kind == "revisit" else None
                    digest = (known[1].hex() if known and known[0] == "sha1" else None) if kind == "revisit" else hashlib.sha1(payload).hexdigest()
                    rows.append((name, own, page_of(own), h.get("warc-target-uri", "").strip("<>") or None, kind, page_of(h.get("warc-refers-to")), length, digest, payload))
                    size += len(payload)
                    if size >= 4 << 20:
                        yield table(rows)
                        rows, size = [], 0
            if rows:
                yield table(rows)


def read(archives: DataFrame) -> DataFrame:
    """The records of archives (archive, content): one row each, with its payload (empty for revisits).

    payload_digest is the SHA-1 of the payload in hexadecimal; of a revisit, what its header says, null if that is no SHA-1.
    page_id and refers_to are null for records of other writers; payload_bytes of a revisit is 0 where it does not tell.
    """
    small_batches(archives.sparkSession, 4)
    return archives.select("archive", "content").mapInArrow(_read, RECORD)


def archives_path(pages: DataFrame) -> str:
    """A new place for archives in the shared folder."""
    return f"{shared_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"


def read_files(spark, path: str) -> DataFrame:
    """The records of .warc.gz files, from any store that Spark reads."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(path)
    return read(files.select(F.col("path").alias("archive"), "content"))


def round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Write the archives of all rows in the shared folder and read the pages back."""
    path = archives_path(pages)
    write(pages, path, **columns)
    return read(pages.sparkSession.read.parquet(path)).where(F.col("record_type").isin("response", "revisit"))
