"""Ranked lexical search over an index in tiers of impact.

A posting is a term's occurrence in a document, with its impact: the part of the
score that is the document's, before the term's weight. The postings of a term are
binned by impact, and the bins, from the highest, fill tiers of FIRST_TIER, then GROWTH
times as many postings and so on; a term that fits has no lower tier. Of each term and tier the
index keeps the residual bound: the highest impact below it.

A search reads the first tier and sums what it finds by item and document. What is not
found yet is bounded by the residuals: a document is worth no more than its sum and
those of the terms it was not seen with, and an unseen document no more than all of
them. The best documents by sum are completed from the lower tiers, and if the last of these is
worth more than any unseen document can be, the item has its proof: only documents
whose bound reaches that score are completed, and the best are exact. Items
without proof fall through to the next tier, and at the last one nothing is missing, so every result is exact,
and only the work depends on the texts.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z
lower-cased. Null and empty texts have no terms: such documents don't count and are
never found, and such items find nothing. Repeated rows are documents, or items, of their own;
equal scores go by the smaller document id, nulls last. All arithmetic of scores is in 64-bit integers.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import durable, pieces, shared_dir, small_batches, stored
from .terms import runs

#: Postings of a term in its first tier, and how much larger each next one is.
FIRST_TIER, GROWTH, TIERS = 4_096, 8, 16
#: Bins of impact, which is below IMPACT.
BINS, IMPACT = 64, 1_000_000
#: Rows that may be sent to every task; what has more is joined by shuffling.
SMALL = 65_536
BEST = 10


def small(rows: DataFrame) -> DataFrame:
    """rows, to be broadcast if a count shows that they are few."""
    return F.broadcast(rows) if rows.limit(SMALL + 1).count() <= SMALL else rows


def _terms(batches: Iterator[pa.RecordBatch], wanted: dict[bytes, int] | None) -> Iterator[pa.RecordBatch]:
    """A row for each term of each text, and one without a term for each text that has any; terms by number if wanted has those."""
    for batch in pieces(batches, "text"):
        texts, terms, tfs, held, sizes = batch.column("text").cast(pa.large_binary()), [], [], [], []
        for text in texts.to_pylist():
            found: Counter = Counter()
            for part in runs(text or b""):
                found.update(part)
            if wanted is None:
                mine = list(found.items())
            else:
                mine = [(wanted[t], found[t]) for t in (found.keys() & wanted.keys())]
            size = found.total()
            if size:
                mine.append((b"" if wanted is None else -1, 1))
            held.append(len(mine))
            sizes.append(size)
            terms += [t for t, _ in mine]
            tfs += [k for _, k in mine]
        many = np.array(held, np.int64)
        take = pa.array(np.repeat(np.arange(len(many)), many))
        what = pa.array(terms, pa.binary()).cast(pa.string()) if wanted is None else pa.array(terms, pa.int64())
        columns = [batch.column("row").take(take), batch.column("doc_id").take(take), what, pa.array(tfs, pa.int64()), pa.array(np.repeat(np.array(sizes, np.int64), many))]
        yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "tid" if wanted is not None else "term", "tf", "n"])


def terms_of(texts: DataFrame, wanted: dict[bytes, int] | None = None) -> DataFrame:
    """(row, doc_id, term or its number tid, tf, n) of rows (row, doc_id, text); the row without a term has term '' or tid -1."""
    small_batches(texts.sparkSession)
    what = "term string" if wanted is None else "tid long"
    return texts.select("row", "doc_id", "text").mapInArrow(lambda b: _terms(b, wanted), f"row long, doc_id long, {what}, tf long, n long")


def numbered(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((item, item_id), (item, term)) of rows (item_id, text), with a number for each item and its terms once each."""
    rows = items.select(F.monotonically_increasing_id().alias("row"), F.col("item_id").alias("item_id"), "text")
    rows = durable(rows)
    found = terms_of(rows.select("row", F.lit(0).cast("long").alias("doc_id"), "text")).where("term <> ''")
    return rows.select(F.col("row").alias("item"), "item_id"), found.select(F.col("row").alias("item"), "term")


@dataclass(frozen=True)
class Index:
    """postings (tier, tid, row, doc_id, impact) in folders by tier; terms (tid, term, weight, rest), where rest[j] is the residual bound after tier j."""

    postings: DataFrame
    terms: DataFrame
    last: int


def impact(tf: Column, n: Column, docs: int, length: int) -> Column:
    """What a document of n terms, one of them tf times, is worth for it before the term's weight."""
    whole = lambda x: F.lit(x).cast("long")
    m = whole(100 - 90) + F.call_function("div", whole(90) * n * whole(docs), whole(max(length, 1)))
    return F.call_function("div", whole(1_000_000_000) * tf, whole(1000) * tf + whole(8) * m)


def weight(df: Column, docs: int) -> Column:
    return F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * docs + 2.0) / (F.lit(2.0) * df + F.lit(1.0)))).cast("long")


def build(docs: DataFrame, vocabulary: DataFrame | None = None, first: int = FIRST_TIER, growth: int = GROWTH) -> Index:
    """The index of rows (doc_id, text), of all terms or those of a vocabulary (term)."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    if vocabulary is not None:
        names = durable(vocabulary.select("term").distinct().withColumn("tid", F.monotonically_increasing_id()))
        if names.count() <= SMALL:
            raw = stored(terms_of(rows, {r["term"].encode(): r["tid"] for r in names.collect()}))
        else:
            both = names.unionByName(names.sparkSession.createDataFrame([("", -1)], "term string, tid long"))
            raw = stored(terms_of(rows).join(both, "term").drop("term"))
    else:
        found = stored(terms_of(rows))
        names = durable(found.where("term <> ''").select("term").distinct().withColumn("tid", F.monotonically_increasing_id()))
        raw = found.join(names, "term", "left").withColumn("tid", F.coalesce("tid", F.lit(-1).cast("long"))).drop("term")
    whole = raw.where("tid = -1").agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    raw = raw.where("tid >= 0").select("tid", "row", "doc_id", impact(F.col("tf"), F.col("n"), whole["docs"], whole["length"]).alias("impact"))
    step = F.expr(f"(impact * {BINS}L) div {IMPACT}L").cast("int")
    bins = durable(raw.groupBy("tid", step.alias("bin")).agg(F.count("*").alias("n"), F.max("impact").alias("most")))
    filled = F.sum("n").over(W.partitionBy("tid").orderBy(F.desc("bin")))  # of BINS rows at most
    bounds = F.array(*[F.lit(first * growth**k).cast("long") for k in range(TIERS)])
    tiers = bins.withColumn("filled", filled).withColumn("tier", F.size(F.filter(bounds, lambda b: b < F.col("filled"))))
    of_tier = durable(tiers.groupBy("tid", "tier").agg(F.sum("n").alias("n"), F.max("most").alias("most"), F.min("bin").alias("low")))
    last = of_tier.agg(F.coalesce(F.max("tier"), F.lit(0)).alias("last")).first()["last"]
    pairs = F.collect_list(F.struct("tier", "most", "low"))  # of TIERS + 1 rows at most
    terms = of_tier.groupBy("tid").agg(F.sum("n").alias("df"), pairs.alias("pairs"))
    below = lambda j: F.coalesce(F.array_max(F.transform(F.filter("pairs", lambda p: p["tier"] > j), lambda p: p["most"])), F.lit(0).cast("long"))
    rest = F.array(*[below(j) for j in range(last + 1)])
    # the lowest bin of each tier or those above it
    down_to = lambda j: F.coalesce(F.array_min(F.transform(F.filter("pairs", lambda p: p["tier"] <= j), lambda p: p["low"])), F.lit(BINS))
    cuts = F.array(*[down_to(j) for j in range(last + 1)])
    terms = durable(terms.join(names, "tid").select("tid", "term", weight(F.col("df"), whole["docs"]).alias("weight"), rest.alias("rest"), cuts.alias("cuts")))
    tier = F.size(F.filter("cuts", lambda c: c > step))
    placed = raw.join(small(terms.select("tid", "cuts")), "tid").select(tier.alias("tier"), "tid", "row", "doc_id", "impact")
    where = f"{shared_dir(docs.sparkSession).rstrip('/')}/index-{uuid.uuid4().hex}"
    placed.write.partitionBy("tier").parquet(where)
    postings = docs.sparkSession.read.schema("tid long, row long, doc_id long, impact long, tier int").parquet(where)
    return Index(postings, terms.drop("cuts"), last)


def search(index: Index, asked: DataFrame, best: int = BEST) -> DataFrame:
    """(item, rank, doc_id, score): for each item of rows (item, term), its best documents of a score above 0."""
    terms = durable(asked.join(index.terms, "term").select("item", "tid", "weight", "rest"))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]

    def top(rows: DataFrame) -> DataFrame:
        # Spark limits the groups before it shuffles them
        return rows.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order))).where(F.col("rank") <= best)

    def whole(some: DataFrame, mine: DataFrame, j: int) -> DataFrame:
        """(item, row, doc_id, score) of documents (item, row, doc_id, known), completed from the tiers below j."""
        lower = index.postings.where(F.col("tier") > j).select("tid", "row", "impact").join(small(some.select("item", "row")), "row")
        more = lower.join(small(mine.select("item", "tid", "weight")), ["item", "tid"]).groupBy("item", "row").agg(F.sum(F.col("weight") * F.col("impact")).alias("more"))
        return some.join(more, ["item", "row"], "left").select("item", "row", "doc_id", (F.col("known") + F.coalesce("more", F.lit(0))).alias("score"))

    found: DataFrame | None = None
    for j in range(index.last + 1):
        mine = terms.select("item", "tid", "weight", (F.col("weight") * F.element_at("rest", j + 1)).alias("bound"))
        hits = index.postings.where(F.col("tier") <= j).join(small(mine), "tid")
        sums = hits.groupBy("item", "row").agg(F.first("doc_id").alias("doc_id"), F.sum(F.col("weight") * F.col("impact")).alias("known"), F.sum("bound").alias("covered"))
        unseen = mine.groupBy("item").agg(F.sum("bound").alias("unseen"))
        if j == index.last:  # nothing lies below
            exact = top(sums.where("known > 0").withColumnRenamed("known", "score"))
        else:
            seen = stored(sums.where("known > 0"))
            # the best by what is known, in full, bound the last score that counts from below
            leaders = durable(top(seen.withColumnRenamed("known", "score")).withColumnRenamed("score", "known").drop("rank"))
            least = whole(leaders, mine, j).groupBy("item").agg(F.when(F.count("*") >= best, F.min("score")).otherwise(F.lit(0)).alias("least"))
            state = unseen.join(least, "item", "left").withColumn("least", F.coalesce("least", F.lit(0).cast("long")))
            state = durable(state.withColumn("proven", (F.col("unseen") == 0) | (F.col("unseen") < F.col("least"))))
            proven = state.where("proven").select("item", "unseen", "least")
            close = seen.join(small(proven), "item").where(F.col("known") + F.col("unseen") - F.col("covered") >= F.col("least"))
            exact = top(whole(durable(close.select("item", "row", "doc_id", "known")), mine, j))
            terms = durable(terms.join(state.where("NOT proven").select("item"), "item", "left_semi"))
        exact = durable(exact.select("item", "rank", "doc_id", "score"))
        found = exact if found is None else found.unionByName(exact)
        if terms.isEmpty():
            break
    return found


def rank(docs: DataFrame, items: DataFrame, best: int = BEST, first: int = FIRST_TIER, growth: int = GROWTH) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item (item_id, text) the best of the documents (doc_id, text), by an index of the items' terms."""
    names, asked = numbered(items)
    asked = durable(asked)
    found = search(build(docs, asked, first, growth), asked, best)
    return found.join(names, "item").select("item_id", "rank", "doc_id", "score")
