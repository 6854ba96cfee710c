"""Queries whose logic is sequential or a model's; most have no SQL form and are tested on their own."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..operators import models
from ..operators.sections import chunk_books
from ..session import let_workers_import
from ..streaming import think
from .registry import query


def _blocks(t):
    d = t.documents.select(F.col("doc_id").cast("string").alias("book_id"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return d.withColumn("chapter", F.concat(F.lit("Ch "), F.floor(F.col("pos") / 5).cast("string"))).withColumn("page", F.lit(None).cast("long"))


CHUNKS_SQL = """WITH RECURSIVE b AS (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
  o AS (SELECT *, coalesce(sum(length(line) + 2) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(line) - length(regexp_replace(line, '^\\s+', '')) AS lead_in, list_filter(regexp_split_to_array(line, '\\s+'), lambda x: x <> '') AS w FROM b),
  k AS (SELECT doc_id, pos, pos // 5 AS ch, lead_in, line, w, unnest(range((len(w) + 99) // 100)) AS k FROM o),
  p AS (SELECT doc_id, pos, ch, k, lead_in, CASE WHEN len(w) <= 100 THEN regexp_replace(line, '^\\s+|\\s+$', '', 'g') ELSE array_to_string(w[k * 100 + 1:(k + 1) * 100], ' ') END AS piece, least(len(w) - k * 100, 100) AS tokens FROM k),
  u AS (SELECT *, lead_in + coalesce(sum(length(piece) + 1) OVER (PARTITION BY doc_id, pos ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, sum(tokens) OVER (PARTITION BY doc_id, ch ORDER BY pos, k) AS upto FROM p),
  r AS (SELECT doc_id, ch, list(piece ORDER BY pos, k) AS pieces, list(start ORDER BY pos, k) AS starts, list_prepend(0::HUGEINT, list(upto ORDER BY pos, k)) AS c FROM u GROUP BY doc_id, ch),
  s AS (SELECT doc_id, ch, c, 0::BIGINT AS i, greatest(1, len(list_filter(c, lambda x: x <= 100)) - 1)::BIGINT AS j FROM r
    UNION ALL
    SELECT doc_id, ch, c, n AS i, greatest(n + 1, len(list_filter(c, lambda x: x <= c[n + 1] + 100)) - 1)::BIGINT AS j
    FROM (SELECT doc_id, ch, c, greatest(i + 1, len(list_filter(c, lambda x: x <= c[j + 1] - 20)) - 1)::BIGINT AS n FROM s WHERE j < len(c) - 1)),
  l AS (SELECT *, j = len(c) - 1 AND i > 0 AND c[j + 1] - c[i + 1] < 25 AS tail FROM s),
  f AS (SELECT doc_id, ch, i, CASE WHEN coalesce(lead(tail) OVER (PARTITION BY doc_id, ch ORDER BY i), false) THEN len(c) - 1 ELSE j END AS j, tail FROM l)
  SELECT doc_id || ':' || (row_number() OVER (PARTITION BY doc_id ORDER BY ch, i) - 1) AS id, doc_id::VARCHAR AS book_id, 'Ch ' || ch AS chapter, NULL::BIGINT AS page, starts[i + 1]::BIGINT AS loc_start, (starts[j] + length(pieces[j]))::BIGINT AS loc_end, array_to_string(pieces[i + 1:j], chr(10) || chr(10)) AS text
  FROM f JOIN r USING (doc_id, ch) WHERE NOT tail"""


@query(CHUNKS_SQL)
def chunks(t):
    return chunk_books(_blocks(t), 100, 20, 25)


@query("SELECT doc_id::VARCHAR AS book_id, sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')))::BIGINT AS words FROM documents GROUP BY doc_id HAVING words > 0")
def chunk_coverage(t):
    """Without overlap, the chunks of a book hold each of its words once."""
    c = chunk_books(_blocks(t), 100, 0, 0)
    return c.groupBy("book_id").agg(F.sum(models.token_count(F.col("text"))).alias("words"))


@query()
def embed_default(t):
    return models.embed(t.benchmark.select("item_id", "text"), models.hashed_words).select("item_id", F.transform("vector", lambda x: F.round(x, 5)).alias("vector"))


@query()
def html_sections(t):
    from ..sources import readers

    let_workers_import(t.spark)

    def run(frames):
        for pdf in frames:
            rows = [(p, i, h, readers.clean(b)) for p, page in zip(pdf.page_id, pdf.html) for i, (h, b) in enumerate(readers.html(page or ""))]
            yield pd.DataFrame(rows, columns=["page_id", "sec", "heading", "body"])

    return t.pages.select("page_id", "html").mapInPandas(run, "page_id long, sec long, heading string, body string")


def _python(name, kind):
    def run(t):
        let_workers_import(t.spark)

        @F.pandas_udf(kind)
        def f(texts: pd.Series) -> pd.Series:
            return texts.map(FUNCTIONS[name])

        return t.documents.select("doc_id", f("text").alias("value"))

    return query(SQL.get(name), name)(run)


def _rst(text):
    from ..sources import readers

    ruled = "\n".join(x + ("\n" + "=" * len(x) if i % 3 == 1 else "") for i, x in enumerate(text.split("\n")))
    return "\n".join(f"{h or ''}|{len(b)}" for h, b in readers.rst(ruled))


FUNCTIONS = {
    "rst_sections": _rst,
    "md_match": lambda text: models.md_match(text, models.md_blocks("# Head\n\n" + text)),
    "slice_offsets": lambda text: ",".join(map(str, models.slices(text.replace("\n", "\n\n"), 500))),
    "trim_tail": lambda text: models.trim_tail(text, 101),
    "decode_text": lambda text: __import__("shelfspark.sources.readers", fromlist=["decode"]).decode(text.encode("utf-8")),
}
SQL = {
    "trim_tail": "SELECT doc_id, right(text, list_max(list_filter(range(0, 102), lambda k: strlen(right(text, k::INT)) <= 101))::INT) AS value FROM documents",
    "slice_offsets": """WITH RECURSIVE t AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS x FROM documents),
  s(doc_id, x, pos) AS (SELECT doc_id, x, 0::BIGINT FROM t UNION ALL
    SELECT doc_id, x, pos + 500 + strpos(substr(x, pos + 501), chr(10) || chr(10)) + 1 FROM s WHERE pos + 500 < length(x) AND strpos(substr(x, pos + 501), chr(10) || chr(10)) > 0)
  SELECT doc_id, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS value FROM s GROUP BY doc_id""",
    "decode_text": "SELECT doc_id, text AS value FROM documents",
}
for _name, _kind in (("rst_sections", "string"), ("md_match", "boolean"), ("slice_offsets", "string"), ("trim_tail", "string"), ("decode_text", "string")):
    _python(_name, _kind)


@query("SELECT conv_id, turn, 'a' || text AS said, CASE WHEN turn % 2 = 0 THEN role ELSE '' END AS thought FROM conversations")
def think_split(t):
    """Answers with a thought in tags, and some with none."""
    raw = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("a<think>"), "role", F.lit("</think>"), "text")).otherwise(F.concat(F.lit("a"), "text"))
    said, thought = think.split_whole(F.col("raw"))
    return t.conversations.withColumn("raw", raw).select("conv_id", "turn", said.alias("said"), thought.alias("thought"))
