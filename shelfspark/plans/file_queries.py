"""Readers of file formats, over files made from the supplied texts: what comes back is what went in.

A file has one chapter with a heading, and the text as its body. As a reader may clean white space and join
hyphenated words, bodies are compared by their letters and digits. PAD makes each body long enough to stand alone.
"""

from __future__ import annotations

import io
import plistlib
import struct
import zipfile
import zlib
from html import escape

import pandas as pd
from pyspark.sql import functions as F

from ..functions import formats as fm
from ..operators import ask
from ..session import let_workers_import
from ..sources.readers import read_blocks
from .registry import query


def _packed(**files: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), text)
    return out.getvalue()


def _lines(text: str) -> list[str]:
    """Without characters that XML has no place for."""
    return [escape("".join(c for c in line if c >= " " or c == "\t")) for line in text.splitlines()]


def docx(head: str, text: str) -> bytes:
    rows = "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in _lines(text))
    return _packed(word__document_dot_xml=f"<w:d xmlns:w='urn:w'><w:p><w:pPr><w:pStyle w:val='Heading 1'/></w:pPr><w:r><w:t>{escape(head)}</w:t></w:r></w:p>{rows}</w:d>")


def odt(head: str, text: str) -> bytes:
    rows = "".join(f"<t:p>{x}</t:p>" for x in _lines(text))
    return _packed(content_dot_xml=f"<d xmlns:t='urn:t'><t:h t:outline-level='1'>{escape(head)}</t:h>{rows}</d>")


def rtf(head: str, text: str) -> bytes:
    def letter(c: str) -> str:
        if c in "\\{}":
            return f"\\{c}"
        if c == "\n":
            return "\\par\n"
        return c if " " <= c < "\x7f" else "".join(f"\\u{n - 65536 if n > 32767 else n}?" for n in struct.unpack(f"<{len(c.encode('utf-16-le')) // 2}H", c.encode("utf-16-le"))) if c >= "\x80" else " "

    return ("{\\rtf1\\ansi\\uc1 " + "".join(map(letter, text)) + "}").encode()


def fb2(head: str, text: str) -> bytes:
    rows = "".join(f"<p>{x}</p>" for x in _lines(text))
    return f"<FictionBook><body><section><title><p>{escape(head)}</p></title>{rows}</section></body></FictionBook>".encode()


def fb2_zip(head: str, text: str) -> bytes:
    return _packed(book_dot_fb2=fb2(head, text).decode())


def _page(head: str, text: str) -> str:
    return f"<html><body><h1>{escape(head)}</h1>{''.join(f'<p>{x}</p>' for x in _lines(text))}</body></html>"


def epub(head: str, text: str) -> bytes:
    return _packed(
        mimetype="application/epub+zip",
        **{"META-INF__container_dot_xml": "<container><rootfiles><rootfile full-path='book.opf'/></rootfiles></container>"},
        book_dot_opf="<package><metadata/><manifest><item id='a' href='a.html'/><item id='n' href='toc.ncx' media-type='application/x-dtbncx+xml'/></manifest><spine toc='n'><itemref idref='a'/></spine></package>",
        toc_dot_ncx=f"<ncx><navMap><navPoint><navLabel><text>{escape(head)}</text></navLabel><content src='a.html'/></navPoint></navMap></ncx>",
        a_dot_html=f"<html><body>{''.join(f'<p>{x}</p>' for x in _lines(text))}</body></html>",
    )


def webarchive(head: str, text: str) -> bytes:
    return plistlib.dumps({"WebMainResource": {"WebResourceData": _page(head, text).encode()}}, fmt=plistlib.FMT_BINARY)


def pdf(head: str, text: str) -> bytes:
    """A page for each 2,000 characters, in a font whose codes are numbered as characters come."""
    codes = {c: i + 1 for i, c in enumerate(dict.fromkeys(text))}
    shown_as = {ord(c): f"{i:04X}" for c, i in codes.items()}
    pairs = list(codes.items())
    cmap = "1 begincodespacerange <0000> <FFFF> endcodespacerange\n"
    for k in range(0, len(pairs), 100):
        some = pairs[k : k + 100]
        cmap += f"{len(some)} beginbfchar\n" + "".join(f"<{i:04X}> <{c.encode('utf-16-be').hex()}>\n" for c, i in some) + "endbfchar\n"
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 4: b"<< /Type /Font /Subtype /Type0 /ToUnicode 5 0 R >>"}

    def stream(data: str) -> bytes:
        body = zlib.compress(data.encode())
        return b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(body), body)

    objects[5] = stream(cmap)
    parts = [text[k : k + 2000] for k in range(0, len(text), 2000)] or [""]
    for i, part in enumerate(parts):
        shown = "".join(f"<{x.translate(shown_as)}> Tj T* " for x in part.splitlines())
        objects[10 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (11 + 2 * i)
        objects[11 + 2 * i] = stream(f"BT /F 12 Tf {shown}ET")
    kids = " ".join(f"{10 + 2 * i} 0 R" for i in range(len(parts)))
    objects[2] = f"<< /Type /Pages /Kids [{kids}] /Resources << /Font << /F 4 0 R >> >> >>".encode()
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in objects.items()) + b"trailer << /Root 1 0 R >>"


def mobi(head: str, text: str) -> bytes:
    body = _page(head, text).encode()
    records = [body[i : i + 4096] for i in range(0, len(body), 4096)]
    first = struct.pack(">HHIHHHH", 1, 0, len(body), len(records), 4096, 0, 0) + b"MOBI" + struct.pack(">III", 232, 2, 65001)
    every = [first.ljust(248, b"\0"), *records]
    at, index = 78 + 8 * len(every) + 2, b""
    for i, x in enumerate(every):
        index += struct.pack(">II", at, i)
        at += len(x)
    return b"book".ljust(60, b"\0") + b"BOOKMOBI" + b"\0" * 8 + struct.pack(">H", len(every)) + index + b"\0\0" + b"".join(every)


PAD = "\n" + "pad " * 160
#: Extension: what makes a file, and whether the reader tells the chapter.
MADE = {"docx": (docx, True), "odt": (odt, True), "rtf": (rtf, False), "fb2": (fb2, True), "fb2.zip": (fb2_zip, True), "epub": (epub, True), "webarchive": (webarchive, True), "pdf": (pdf, False), "mobi": (mobi, False)}
LETTERS = r"[^\p{L}\p{N}]+"


def _register(ext: str) -> None:
    make, chaptered = MADE[ext]
    head = "'Chapter ' || doc_id" if chaptered else "NULL::VARCHAR"
    # a book of one chapterless section begins with its heading
    text = "'Chapter' || doc_id || " if ext == "mobi" else ""

    @query(f"SELECT doc_id, {head} AS chapter, md5({text}regexp_replace(text, '[^\\pL\\pN]+', '', 'g') || repeat('pad', 160)) AS letters FROM documents", f"extract_{ext.replace('.', '_')}")
    def extract(t):
        let_workers_import(t.spark)

        @F.pandas_udf("binary")
        def build(ids: pd.Series, texts: pd.Series) -> pd.Series:
            return pd.Series([make(f"Chapter {i}", x) for i, x in zip(ids, texts, strict=True)])

        path = F.concat(F.lit("/lib/"), F.col("doc_id").cast("string"), F.lit(f".{ext}"))
        body = F.concat("text", F.lit(PAD))
        files = t.documents.select(path.alias("path"), build("doc_id", body).alias("content"))
        blocks = read_blocks(files).select(F.regexp_extract("path", r"/(\d+)\.", 1).cast("long").alias("doc_id"), "pos", "chapter", "text")
        whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n")
        joined = blocks.groupBy("doc_id").agg(F.max("chapter").alias("chapter"), whole.alias("text"))
        return joined.select("doc_id", "chapter", F.md5(F.regexp_replace("text", LETTERS, "").cast("binary")).alias("letters"))


for _ext in MADE:
    _register(_ext)


@query("SELECT doc_id, printf('%x', strlen(text)) || ':' || sha256(text)[1:32] AS csig FROM documents")
def content_sig_file(t):
    """Signatures of the texts as files; none here is longer than the two samples."""
    content = F.encode("text", "UTF-8")
    return t.documents.select("doc_id", fm.content_signature(content, F.octet_length(content).cast("long")).alias("csig"))


@query("SELECT doc_id, printf('%x', strlen(text)) || ':' || sha256(CASE WHEN strlen(text) > 128 THEN encode(text)[1:64] || encode(text)[strlen(text) - 63:] ELSE encode(text) END)[1:32] AS csig FROM documents")
def content_sig_sampled(t):
    """The same with samples of 64 bytes, so that longer texts are sampled at both ends."""
    content = F.encode("text", "UTF-8")
    return t.documents.select("doc_id", fm.content_signature(content, F.octet_length(content).cast("long"), 64).alias("csig"))


@query("""SELECT doc_id, right('x' || text, 0) || left(text, list_max(list_filter(range(0, 501), lambda k: strlen(left(text, k::INT)) <= 500))::INT) AS head, strlen(text) > 500 AS truncated, strlen(text)::BIGINT AS total FROM documents""")
def read_capped_bytes(t):
    x = fm.read_capped(F.encode("text", "UTF-8"), 500)
    return t.documents.select("doc_id", x.alias("x")).select("doc_id", F.col("x.text").alias("head"), "x.truncated", F.col("x.bytes").alias("total"))


@query("SELECT conv_id AS qid, arg_max(length(text), turn) FILTER (turn % 3 <> 2)::BIGINT AS in_tokens, arg_max(length(role) + turn, turn) FILTER (turn % 2 = 0)::BIGINT AS out_tokens FROM conversations GROUP BY conv_id")
def usage_last(t):
    """Token counts that are told now and then: the last of each counts."""
    told = t.conversations.select(F.col("conv_id").alias("qid"), F.col("turn").alias("seq"), F.when(F.col("turn") % 3 != 2, F.length("text").cast("long")).alias("in_tokens"), F.when(F.col("turn") % 2 == 0, (F.length("role") + F.col("turn")).cast("long")).alias("out_tokens"))
    return ask.usage(told)


@query("SELECT path, CASE WHEN ext = 'pages' THEN path || '.pdf' WHEN ext = 'pdf' AND pos % 20 = 0 THEN path || '.ocr' ELSE path END AS shown FROM fx_books")
def display_paths(t):
    b = t.fx_books
    copies = b.where("ext = 'pages'").select("path", F.lit("pdf").alias("kind"), F.concat("path", F.lit(".pdf")).alias("copy_path"))
    copies = copies.unionByName(b.where("ext = 'pdf' AND pos % 20 = 0").select("path", F.lit("ocr").alias("kind"), F.concat("path", F.lit(".ocr")).alias("copy_path")))
    return fm.display_paths(b, copies.unionByName(b.where("ext = 'md'").select("path", F.lit("html").alias("kind"), F.lit("/no").alias("copy_path"))))
