"""Queries over the supplied tables, with the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Portable SQL for the relations that stand for a library: {documents} is the table of texts.
_EXT = "CASE doc_id % 10 WHEN 0 THEN 'pdf' WHEN 1 THEN 'epub' WHEN 2 THEN 'md' WHEN 3 THEN 'txt' WHEN 4 THEN 'html' WHEN 5 THEN 'docx' WHEN 6 THEN 'fb2.zip' WHEN 7 THEN 'mobi' WHEN 8 THEN 'markdown' ELSE 'pages' END"
FIXTURES = f"""
fx_books AS (SELECT doc_id AS pos, doc_id, source, lang, text, n_chars, {_EXT} AS ext, '/lib/' || source || '/book' || CAST(doc_id AS STRING) || '.' || {_EXT} AS path FROM {{documents}}),
fx_candidates AS (SELECT pos, path, substr(sha1(path), 1, 16) AS book_id, CASE WHEN doc_id % 97 = 5 THEN 'missing' ELSE CAST(n_chars AS STRING) || ':' || CAST(1700000000 + doc_id AS STRING) END AS fp, md5(text) AS csig FROM fx_books),
fx_book_state AS (
  SELECT 'c1' AS collection_id,
    CASE b.doc_id % 7 WHEN 1 THEN 'legacy-' || CAST(b.doc_id AS STRING) WHEN 2 THEN 'moved-' || CAST(b.doc_id AS STRING) WHEN 4 THEN 'clash-' || CAST(b.doc_id AS STRING) ELSE c.book_id END AS book_id,
    CASE WHEN b.doc_id % 7 = 3 THEN 'stale:' || CAST(b.doc_id AS STRING) ELSE CAST(b.n_chars AS STRING) || ':' || CAST(1700000000 + b.doc_id AS STRING) END AS fingerprint,
    CASE WHEN b.doc_id % 7 = 4 THEN 'deadbeef' ELSE c.csig END AS content_sig,
    CASE WHEN b.doc_id % 7 IN (1, 2) THEN b.doc_id % 2 ELSE 1 END AS chunker_ver,
    CASE b.doc_id % 7 WHEN 1 THEN '' WHEN 2 THEN '/old' || c.path WHEN 4 THEN '/other' || c.path WHEN 3 THEN CASE WHEN b.doc_id % 3 = 2 THEN '' ELSE c.path END ELSE c.path END AS source_path
  FROM fx_books b JOIN fx_candidates c ON b.pos = c.pos WHERE b.doc_id % 7 IN (0, 1, 2, 3, 4)),
fx_skip_state AS (
  SELECT 'c1' AS collection_id, c.path AS source_path, CASE WHEN b.doc_id % 11 = 5 THEN 'gpu' ELSE 'cpu' END AS pipeline, c.fp AS fingerprint, 'no extractable text' AS reason,
    CASE WHEN b.doc_id % 11 = 4 THEN 'caps-v0' ELSE 'caps-v1' END AS caps_ver
  FROM fx_books b JOIN fx_candidates c ON b.pos = c.pos WHERE b.doc_id % 11 IN (3, 4, 5) AND c.fp <> 'missing'),
fx_store AS (
  SELECT book_id, CASE WHEN source_path = '' THEN path ELSE source_path END AS source_path FROM (
    SELECT s.book_id, s.source_path, c.path FROM fx_book_state s JOIN fx_candidates c ON (s.source_path = '' AND s.book_id = 'legacy-' || CAST(c.pos AS STRING)) AND NOT (c.pos % 7 = 3 AND c.pos % 3 <> 0)
    UNION ALL SELECT s.book_id, s.source_path, c.path FROM fx_book_state s JOIN fx_candidates c ON (s.source_path = c.path OR s.source_path = '/old' || c.path OR s.source_path = '/other' || c.path) AND NOT (c.pos % 7 = 3 AND c.pos % 3 <> 0)) x
  UNION ALL SELECT CASE WHEN b.doc_id % 2 = 0 THEN c.book_id ELSE 'import-' || CAST(b.doc_id AS STRING) END, c.path FROM fx_books b JOIN fx_candidates c ON b.pos = c.pos WHERE b.doc_id % 7 = 5),
fx_chunks AS (
  SELECT c.book_id || ':' || CAST(b.doc_id % 5 AS STRING) AS id, c.book_id, 'Book ' || CAST(b.doc_id % 40 AS STRING) || CASE WHEN b.doc_id % 3 = 0 THEN ' v2' ELSE '' END AS title,
    CASE WHEN b.doc_id % 4 = 0 THEN '' ELSE 'Author ' || b.lang END AS author, c.path AS source_path, b.ext AS format, CASE WHEN b.doc_id % 5 = 0 THEN '' ELSE 'Ch ' || CAST(b.doc_id % 5 AS STRING) END AS chapter,
    CASE WHEN b.ext = 'pdf' THEN b.doc_id % 30 ELSE -1 END AS page, b.n_chars AS loc_start, b.n_chars * 2 AS loc_end, b.text, b.doc_id, b.source
  FROM fx_books b JOIN fx_candidates c ON b.pos = c.pos)
"""

#: In Spark the places of a candidate are rows of their own, so that a stored book finds its candidate by an equi-join: by the OR above each is compared with all.
_EITHER = "fx_candidates c ON (s.source_path = c.path OR s.source_path = '/old' || c.path OR s.source_path = '/other' || c.path)"
_PLACES = "(SELECT pos, path, explode(array(path, '/old' || path, '/other' || path)) AS place FROM fx_candidates) c ON s.source_path = c.place"
SPARK_FIXTURES = FIXTURES.replace(_EITHER, _PLACES)


class Library:
    """The supplied tables of a folder, and the relations made from them, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("fx_"):
            return self.spark.sql(f"WITH {SPARK_FIXTURES.format(documents=f'parquet.`{self.sf_dir}/documents.parquet`')} SELECT * FROM {name}")
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None):
    """Register a function of a Library as a query; fx_ relations in its SQL are put before it."""

    def register(f: Callable[[Library], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Library(spark, sf_dir))
        if sql:
            text = sql.strip()
            if "fx_" in text:
                fixtures = FIXTURES.format(documents="documents").strip()
                text = f"WITH RECURSIVE {fixtures}, {text[5:]}" if text.startswith("WITH ") else f"WITH {fixtures} {text}"
            SQL[key] = text
        return f

    return register
