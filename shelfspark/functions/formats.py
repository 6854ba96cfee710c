"""Document formats: extensions, families, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Known extensions and the families they belong to.
FAMILY = {
    "pdf": "pdf", "epub": "epub", "mobi": "mobi", "azw3": "mobi", "md": "md", "markdown": "md", "txt": "txt", "text": "txt", "rst": "txt",
    "adoc": "txt", "org": "txt", "tex": "txt", "ipynb": "md", "html": "html", "htm": "html", "docx": "docx", "rtf": "rtf", "odt": "odt",
    "doc": "doc", "fb2": "fb2", "fb2.zip": "fb2", "pages": "pages", "webarchive": "webarchive", "djvu": "djvu", "xps": "xps",
}
# Which of one work's same-stem variants is preferred, best first.
VARIANT_RANK = {"epub": 0, "pdf": 1, "fb2": 2, "fb2.zip": 2, "mobi": 3, "azw3": 4, "docx": 5, "odt": 6, "rtf": 7, "doc": 8, "pages": 9, "djvu": 10}
# Marker in a path and the provider that syncs it, first match first.
CLOUD = (
    ("/Library/Mobile Documents", "iCloud Drive"), ("/Library/CloudStorage/", "a cloud drive (File Provider)"), ("/Dropbox", "Dropbox"), ("/.dropbox", "Dropbox"),
    ("/Google Drive", "Google Drive"), ("/GoogleDrive", "Google Drive"), ("/OneDrive", "OneDrive"), ("/pCloud", "pCloud"),
)
# Formats that a pipeline leaves to the other, and the reason that is recorded.
SKIPS = {
    "cpu": {"xps": "xps: handled by Fast (GPU) indexing where available"},
    "gpu": {
        "doc": ".doc: handled by standard indexing where a converter is available",
        "pages": ".pages: handled by standard indexing — needs an embedded PDF preview",
        "webarchive": ".webarchive: handled by standard indexing",
        "djvu": "djvu/chm: handled by standard indexing where djvutxt/7z is installed",
    },
}
# How formats are rendered for the citation metric.
RENDERED = {
    "book": ("epub", "fb2", "fb2.zip"), "book-unverifiable": ("mobi", "azw3"), "text": ("md", "markdown", "txt", "text"), "pdf": ("pdf",),
    "unverified": ("html", "htm", "docx", "rtf", "odt", "doc", "pages", "webarchive", "djvu", "rst", "adoc", "org", "tex", "ipynb", "xps"),
}
#: Longest first, so that a compound extension wins over its last part.
EXT_PATTERN = "|".join(sorted((e.replace(".", r"\.") for e in FAMILY), key=lambda e: (-len(e), e)))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def ext_of(path: Column) -> Column:
    """The longest known extension of the file name, in lower case; null without one or without a stem."""
    return F.nullif(F.regexp_extract(F.lower(base_name(path)), rf"(?s)^.+?\.({EXT_PATTERN})$", 1), F.lit(""))


def _lookup(values: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def family(ext: Column) -> Column:
    return F.when(ext.isNotNull(), F.try_element_at(F.create_map(*[F.lit(x) for kv in FAMILY.items() for x in kv]), F.lower(ext)))


def variant_rank(ext: Column) -> Column:
    return F.when(ext.isNotNull(), F.try_element_at(F.create_map(*[F.lit(x) for kv in VARIANT_RANK.items() for x in kv]), ext))


def stem(path: Column) -> Column:
    """The lower-case file name without its known extension."""
    return F.regexp_extract(F.lower(base_name(path)), rf"(?s)^(.+?)\.(?:{EXT_PATTERN})$", 1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def title_of(path: Column) -> Column:
    """The file name without what follows its last dot; Untitled if that is empty."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.coalesce(F.nullif(F.when(name.rlike(r"^\.[^.]*$"), name).otherwise(F.regexp_replace(name, r"\.[^.]*$", "")), F.lit("")), F.lit("Untitled"))


def book_id(path: Column) -> Column:
    return F.substring(F.sha1(path.cast("binary")), 1, 16)


def fingerprint(length: Column, mtime: Column) -> Column:
    return F.coalesce(F.concat(length.cast("string"), F.lit(":"), mtime.cast("string")), F.lit("missing"))


def is_sentinel(signature: Column) -> Column:
    """Whether a fingerprint or signature must never match another."""
    return signature.isNull() | signature.isin("", "missing")


def under_root(path: Column, root: Column) -> Column:
    trimmed = F.regexp_replace(root, "/+$", "")
    return (path == trimmed) | F.startswith(path, F.concat(trimmed, F.lit("/")))


def cloud_marker(path: Column) -> Column:
    out = F.lit(None).cast("string")
    for marker, name in reversed(CLOUD):
        out = F.when(path.contains(marker), F.lit(name)).otherwise(out)
    return out


def directed_skip(ext: Column, pipeline: Column) -> Column:
    """Why a pipeline does not take a format; null if it does."""
    out = F.lit(None).cast("string")
    for name, reasons in SKIPS.items():
        for e, reason in reasons.items():
            out = F.when((pipeline == name) & (ext == e), F.lit(reason)).otherwise(out)
    return out


def render_family(ext: Column) -> Column:
    """How a citation of a format is shown, which is how it can be verified."""
    out = F.lit("unknown")
    for name, exts in RENDERED.items():
        out = F.when(ext.isin(*exts), F.lit(name)).otherwise(out)
    return out


#: Bytes of a file's beginning and of its end that its signature samples; files of up to twice as many are read whole.
SAMPLE = 256 * 1024


def content_signature(content: Column, length: Column, sample: int = SAMPLE) -> Column:
    """The length in hex and a hash of a file's bytes, the same wherever the file lies and whenever it was written; missing if bytes are."""
    n = F.octet_length(content)
    ends = F.concat(F.substring(content, 1, sample), F.substring(content, -sample, sample))
    hashed = F.sha2(F.when(n > 2 * sample, ends).otherwise(content), 256)
    whole = content.isNotNull() & length.eqNullSafe(n.cast("long"))
    return F.when(whole, F.concat(F.lower(F.hex(length)), F.lit(":"), F.substring(hashed, 1, 32))).otherwise(F.lit("missing"))


def caps_version(parts: Column) -> Column:
    """A hash of an array of capabilities (names with versions), whatever their order."""
    ends = F.transform(F.array_sort(F.array_distinct(F.filter(parts, lambda x: x.isNotNull()))), lambda x: F.concat(x, F.lit("\x00")))
    return F.substring(F.sha2(F.array_join(ends, "").cast("binary"), 256), 1, 16)


def read_capped(content: Column, most: int) -> Column:
    """struct(text, truncated, bytes): no more than so many bytes of UTF-8, cut between characters; what is none becomes U+FFFD."""
    head = F.substring(content, 1, most)
    # a character that the cut goes through ends in one to three bytes that don't make it whole
    tail = F.hex(F.substring(head, -3, 3))
    cut = F.when(tail.rlike("(?:[CDEF][0-9A-F])$"), 1).when(tail.rlike("(?:[EF][0-9A-F][89AB][0-9A-F])$"), 2).when(tail.rlike("F[0-9A-F][89AB][0-9A-F][89AB][0-9A-F]$"), 3).otherwise(0)
    over = F.octet_length(content) > most
    kept = F.when(over, F.substring(head, F.lit(1), F.lit(most) - cut)).otherwise(content)
    return F.struct(F.make_valid_utf8(kept.cast("string")).alias("text"), over.alias("truncated"), F.octet_length(content).cast("long").alias("bytes"))


#: How a file is shown if a copy of the kind exists: extension, kind of the copy.
SHOWN = (("pages", "pdf"), ("pdf", "ocr"), ("webarchive", "html"), ("rtf", "html"), ("odt", "html"), ("doc", "html"))


def display_paths(files, copies):
    """(path, shown): rows (path) with the copy that is shown in place of each, from copies (path, kind, copy_path); else the file itself."""
    best = copies.groupBy("path", "kind").agg(F.min("copy_path").alias("copy_path")).withColumnRenamed("path", "_p").withColumnRenamed("kind", "_k")
    want = F.lit(None).cast("string")
    for ext, kind in SHOWN:
        want = F.when(ext_of(F.col("path")) == ext, F.lit(kind)).otherwise(want)
    j = files.select("path").join(best, (F.col("path") == F.col("_p")) & (want == F.col("_k")), "left")
    return j.select("path", F.coalesce("copy_path", "path").alias("shown"))
