import gzip
import hashlib
import uuid
from base64 import b32encode

import pytest

from shelfspark.llm import warc

BIG = "<html>" + "é" * 700
ROWS = [(1, "http://a/x y", BIG), (2, "u", BIG), (9, "u", BIG), (4, None, None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (8, "u", "\r\n\r\nWARC/1.1\r\n" * 200), (None, "u", BIG), (None, "u", "x" * 1000), (9, "u", BIG), (10, "u", "long " * 400_000)]


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, "clash", 1) for r in ROWS], "page_id long, url string, html string, digest string, length int")
    rows = warc.round_trip(df).collect()
    last = {}
    for i, _, h in ROWS:
        n = len((h or "").encode())
        if i is not None and n >= 1000:
            last[h] = max(last.get(h, i), i)
    want = []
    for i, _, h in ROWS:
        b = (h or "").encode()
        to = last.get(h) if len(b) >= 1000 and last.get(h, i) != i else None
        want.append((str(i), len(b), hashlib.sha1(b).hexdigest(), "revisit" if to is not None else "response", to, b if to is None else b""))
    got = [(str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload)) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_files_and_damage(spark, tmp_path):
    block = b"hello"
    one = warc.record("response", "http://a/x y", block, hashlib.sha1(block).hexdigest(), 3, None, 5)
    (tmp_path / "a.warc.gz").write_bytes(warc.information("a.warc.gz") + one * 3)
    got = [(r.page_id, r.url, r.record_type, bytes(r.payload)) for r in warc.read_files(spark, str(tmp_path)).collect()]
    assert got[1:] == [(3, "http://a/x%20y", "response", b"hello")] * 3 and got[0][0] is None and got[0][2] == "warcinfo"
    assert len(list(warc.members(one * 3, step=7))) == 3
    with pytest.raises(warc.Damaged):
        list(warc.members(one[:-3]))
    member = next(warc.members(one))
    assert b"Content-Type: application/http; msgtype=response\r\n" in member and b"X-" not in member
    for bad in (member.replace(b"hello", b"hellx"), member.replace(b"\r\nContent-Length: ", b"\r\nContent-Length: 1", 1), b"x" + member):
        with pytest.raises(warc.Damaged):
            list(warc.parse(bad))


@pytest.mark.parametrize("page_id", [0, 1, 15, 16, 2**40 + 7, 2**63 - 1, -1, -(2**63)])
def test_record_ids_hold_page_ids(page_id):
    uri = warc.record_id(page_id)
    assert warc.page_of(f"<{uri}>") == page_id and uuid.UUID(uri.removeprefix("urn:uuid:")).version == 8
    assert warc.record_id(page_id) != uri and warc.record_id(page_id, 5) == warc.record_id(page_id, 5)
    assert warc.page_of(f"urn:uuid:{uuid.uuid4()}") is None and warc.page_of("urn:x") is None and warc.page_of(None) is None


def hand_made(kind, block, *fields, version="WARC/1.0"):
    lines = [version, f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:92283950-ef2f-4d72-b224-f54c6ec90bb0>", "WARC-Date: 2020-02-02T02:02:02Z", *fields, f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def test_archives_of_other_writers(spark):
    body, http = b"<html>page</html>", "Content-Type: application/http; msgtype=response"
    sha = lambda name, data: f"{name}:{b32encode(hashlib.new(name, data).digest()).decode()}"
    response = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n" + body
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\n<html\r\nc;a=b\r\n>page</html>\r\n0\r\n\r\n"
    content = b"".join([
        hand_made("warcinfo", b"software: other\r\n", "Content-Type: application/warc-fields"),
        hand_made("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "Content-Type: application/http; msgtype=request", "WARC-Target-URI: <http://a/>"),
        hand_made("response", response, http, "WARC-Target-URI: http://a/", f"WARC-Payload-Digest: {sha('sha1', body)}", f"WARC-Block-Digest: {sha('sha1', response)}"),
        hand_made("response", response, http, "WARC-Target-URI:", "  http://b/", f"WARC-Payload-Digest: {sha('sha256', body)}", version="WARC/1.1"),
        hand_made("response", chunked, http, f"WARC-Payload-Digest: sha1:{hashlib.sha1(body).hexdigest()}"),
        hand_made("response", response, http),
        hand_made("response", response[:-3], http, f"WARC-Payload-Digest: {sha('sha1', body)}", "WARC-Truncated: length"),
        hand_made("revisit", b"", f"WARC-Payload-Digest: {sha('sha1', body)}", f"WARC-Profile: {warc.PROFILE}", "WARC-Refers-To: <urn:uuid:16da6da0-bcdc-49c3-927e-57494593dddd>"),
        hand_made("resource", body, "Content-Type: text/html"),
        gzip.compress(b"".join(gzip.decompress(hand_made("resource", x, "Content-Type: text/plain")) for x in (b"one", b"", b"three"))),
    ])
    rows = warc.read(spark.createDataFrame([("a", content)], "archive string, content binary")).collect()
    assert [r.record_type for r in rows] == ["warcinfo", "request", *["response"] * 5, "revisit", *["resource"] * 4]
    assert [bytes(r.payload) for r in rows] == [b"software: other\r\n", b"", body, body, body, body, body[:-3], b"", body, b"one", b"", b"three"]
    assert [r.url for r in rows[1:4]] == ["http://a/", "http://a/", "http://b/"]
    assert all(r.page_id is None and r.refers_to is None and r.record_id for r in rows)
    assert all(r.payload_digest == hashlib.sha1(body).hexdigest() for r in rows[2:6] + rows[7:9])
    for bad in (hand_made("response", response, http, f"WARC-Payload-Digest: {sha('sha1', b'x')}"), hand_made("resource", body, f"WARC-Block-Digest: {sha('sha256', b'x')}")):
        with pytest.raises(warc.Damaged):
            [warc.payload_of(*x) for m in warc.members(bad) for x in warc.parse(m)]


def test_many_records_in_one_member_are_framed_as_they_inflate(monkeypatch):
    import gzip
    import time

    def text(i, n=1000):
        block = bytes([65 + i % 26]) * n
        return b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (n, block)

    archive = gzip.compress(b"".join(text(i) for i in range(20_000)), 1) + gzip.compress(text(7, 0)) + gzip.compress(b"")
    began = time.perf_counter()
    found = [len(block) for pieces in warc.streams(archive) for _, block in warc.parse(pieces)]
    assert found == [1000] * 20_000 + [0] and time.perf_counter() - began < 10
    # pieces of any size give the same, and a member that blows up is framed without being held
    for piece in (1, 7, 300):
        monkeypatch.setattr(warc, "PIECE", piece)
        assert [b for p in warc.streams(gzip.compress(text(1) + text(2, 3)), 5) for _, b in warc.parse(p)] == [b"B" * 1000, b"CCC"]
    monkeypatch.setattr(warc, "PIECE", 1 << 16)
    bomb = gzip.compress(b"x" * (1 << 26))
    with pytest.raises(warc.Damaged):
        for pieces in warc.streams(bomb):
            list(warc.parse(pieces))
