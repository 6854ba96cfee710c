"""Language identification by interpolated Kneser-Ney character models.

Letters, in lower case, are grouped into words by anything that is no letter; a
word is preceded and followed by a boundary, and contexts don't cross it. For each
language, counts of character n-grams over all its documents give a Kneser-Ney
model: absolute discounts, estimated from the counts of counts, and continuation
counts for the lower orders, down to a uniform share for characters never seen.
The models of all languages are stored together in sorted arrays of n-gram hashes,
one for each order, with a row of log-probabilities by language. A text's language
is that of the lowest cross-entropy per character, the first by name in a tie.
Rejection is calibrated: a text is not accepted where its cross-entropy exceeds what
all but a few of the language's own training documents have.

Counting covers all documents and is a partial aggregate. The model is broadcast
whole while the n-grams times the languages are CELLS at most. Beyond that it is cut into
shards by the last character of the context, which an n-gram, its shorter ends and all
their contexts share; only single characters, discounts and the alphabet are common to
all. The shards are broadcast one after the other, each adds up its part of each text's
cross-entropy, and the parts are added by text, so the order is the same at any size. The n-grams
of one context character are the unit that must fit. train() makes the whole model at once.

Null texts and texts without a letter get the language und, score 0, and are
not accepted. Rows are judged each for itself. Documents without an id count as
training documents.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import durable, mix, pieces, small_batches

ORDER, CELLS = 4, 12_000_000
#: Characters at most that the score takes as independent evidence.
EVIDENCE = 40
#: The share of a language's training documents, in thousandths, that are accepted at least.
ACCEPT = 995
UNKNOWN = "und"
_U = np.uint64
_SPACE = 0x20


@functools.lru_cache(1)
def _folded() -> np.ndarray:
    """For each code point of the basic plane, its lower-case letter, or the boundary."""
    out = np.full(1 << 16, _SPACE, np.uint16)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else i
    return out


def fold(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The folded characters of texts, a boundary before and after each text, and where each text starts."""
    joined = " " + " ".join(t or "" for t in texts) + " "
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    start = np.concatenate([[0], np.cumsum([len(t or "") + 1 for t in texts])])
    chars = _folded()[np.minimum(points, 0xFFFF)]
    for i in np.flatnonzero(points > 0xFFFF):  # letters beyond the basic plane share the private area
        chars[i] = 0xE000 + int(points[i]) % 4096 if chr(points[i]).isalpha() else _SPACE
    return chars, start


def grams(chars: np.ndarray, start: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each character but repeated boundaries, packed in 16 bits each, and their offsets by text."""
    prev = np.empty_like(chars)
    prev[0], prev[1:] = _SPACE, chars[:-1]
    at = np.flatnonzero((chars != _SPACE) | (prev != _SPACE))
    key, before, live = chars[at].astype(_U), at - 1, np.ones(len(at), bool)
    for k in range(1, order):
        c = np.where(live, chars[np.maximum(before, 0)], np.uint16(_SPACE))
        live &= c != _SPACE
        key |= c.astype(_U) << _U(16 * k)
        before = before - 1
    # the boundary that ends a text's last word stands where the next text starts
    return key, np.searchsorted(at, start, "right")


def _count(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def rows(lang: str) -> pa.RecordBatch:
        keys, n = held.pop(lang)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    for batch in pieces(batches, "text", 16 << 20):
        langs = np.array(batch.column("lang").to_pylist(), object)
        texts = np.array(batch.column("text").to_pylist(), object)
        for lang in dict.fromkeys(langs):
            keys, n = np.unique(grams(*fold(list(texts[langs == lang])), order)[0], return_counts=True)
            if lang in held:
                keys, back = np.unique(np.concatenate([held[lang][0], keys]), return_inverse=True)
                n = np.bincount(back, np.concatenate([held[lang][1], n]), len(keys)).astype(np.int64)
            held[lang] = keys, n
            if len(keys) > 500_000:
                yield rows(lang)
    for lang in list(held):
        yield rows(lang)


def gram_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n) over all rows (lang, text)."""
    small_batches(docs.sparkSession, 4000)
    part = docs.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), "text")
    return part.mapInArrow(lambda b: _count(b, order), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Table:
    """Sorted hashes of packed n-grams, an index of them by their first bits, and a row of values for each."""

    keys: np.ndarray
    values: np.ndarray = field(repr=False)

    def __post_init__(self):
        hashes = mix(self.keys)
        order = np.argsort(hashes)
        self.hashes = np.append(hashes[order], _U(0xFFFFFFFFFFFFFFFF))
        self.values = np.concatenate([self.values[order], self.values[:1]]) if len(order) else self.values
        self.keys = None
        self.shift = _U(64 - max(1, len(order).bit_length() + 1))
        self.index = np.searchsorted(self.hashes, np.arange(1 << int(64 - self.shift), dtype=_U) << self.shift).astype(np.int32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row of each key, and whether it is there."""
        h = mix(keys)
        pos = self.index[h >> self.shift]
        behind = np.flatnonzero(self.hashes[pos] < h)
        while len(behind):
            pos[behind] += 1
            behind = behind[self.hashes[pos[behind]] < h[behind]]
        return pos, self.hashes[pos] == h


@dataclass
class Model:
    langs: list[str]
    order: int
    floor: np.ndarray  #: log2 of the probability of a character never seen, by language
    grams: list[Table]  #: by order from 1: log2 of the probability of the last character
    contexts: list[Table]  #: by order from 2: log2 of what is left to the lower order

    def log2(self, keys: np.ndarray, order: int | None = None) -> np.ndarray:
        """log2 of the probability of each n-gram's last character, by language."""
        order = order or self.order
        table = self.grams[order - 1]
        row, found = table.find(keys)
        if found.all():
            return table.values[row]
        out = np.empty((len(keys), len(self.langs)), np.float32)
        out[found] = table.values[row[found]]
        rest = np.flatnonzero(~found)
        if order == 1:
            out[rest] = self.floor
            return out
        lower = self.log2(keys[rest] & _U((1 << 16 * (order - 1)) - 1), order - 1)
        row, seen = self.contexts[order - 2].find(keys[rest] >> _U(16))
        lower[seen] += self.contexts[order - 2].values[row[seen]]
        out[rest] = lower
        return out


def _discount(n: np.ndarray) -> float:
    one, two = int((n == 1).sum()), int((n == 2).sum())
    return one / (one + 2 * two) if one and two else 0.5


@dataclass
class Whole:
    """What all shards of a model share."""

    alphabet: int
    discounts: dict[tuple[str, int], float]  #: by language and order
    single: dict[str, tuple[np.ndarray, np.ndarray]]  #: continuation counts of characters by language


def fit(counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int, whole: Whole | None = None) -> Model:
    """The models of the languages from the counts of their packed n-grams of that order; with whole, of a shard's n-grams."""
    langs = sorted(counts)
    L = len(langs)
    per: list[dict] = []
    for lang in langs:
        keys, n = counts[lang]
        levels = {order: (keys, n)}
        for k in range(order - 1, 0, -1):  # continuation counts: distinct n-grams one longer
            levels[k] = np.unique(levels[k + 1][0] & _U((1 << 16 * k) - 1), return_counts=True)
        if whole:
            levels[1] = whole.single[lang]
        per.append(levels)
    alphabet = whole.alphabet if whole else max(1, len(np.unique(np.concatenate([p[1][0] for p in per])))) + 1
    model = Model(langs, order, np.zeros(L, np.float32), [], [])
    for k in range(1, order + 1):
        union = np.unique(np.concatenate([p[k][0] for p in per]))
        contexts = np.unique(union >> _U(16)) if k > 1 else np.zeros(1, _U)
        value, left = np.zeros((len(union), L)), np.zeros((len(contexts), L))
        lower = np.exp2(model.log2(union & _U((1 << 16 * (k - 1)) - 1), k - 1).astype(float)) if k > 1 else np.full((len(union), L), 1 / alphabet)
        for i, p in enumerate(per):
            keys, n = p[k]
            d = whole.discounts[langs[i], k] if whole else _discount(n)
            of = np.searchsorted(contexts, keys >> _U(16)) if k > 1 else np.zeros(len(keys), np.int64)
            total, kinds = np.bincount(of, n, len(contexts)), np.bincount(of, minlength=len(contexts))
            share = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
            n_all = np.zeros(len(union))
            n_all[np.searchsorted(union, keys)] = np.maximum(n - d, 0)
            where = np.searchsorted(contexts, union >> _U(16)) if k > 1 else np.zeros(len(union), np.int64)
            value[:, i] = n_all / np.maximum(total[where], 1) + share[where] * lower[:, i]
            left[:, i] = share
            if k == 1:
                model.floor[i] = np.log2(share[0] / alphabet)
        model.grams.append(Table(union, np.log2(value).astype(np.float32)))
        if k > 1:
            model.contexts.append(Table(contexts, np.log2(np.maximum(left, 1e-12)).astype(np.float32)))
    return model


def _by_lang(table: pa.Table) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    lang = np.array(table.column("lang").to_pylist(), object)
    gram, n = table.column("gram").to_numpy().view(_U), table.column("n").to_numpy()
    by = {}
    for x in dict.fromkeys(lang):
        order_by = np.argsort(gram[lang == x])
        by[x] = gram[lang == x][order_by], n[lang == x][order_by]
    return by


def train(docs: DataFrame, order: int = ORDER) -> Model | None:
    """The whole model of all rows (lang, text) that have both, on the driver; None without any."""
    by = _by_lang(gram_counts(docs, order).toArrow())
    return fit(by, order) if by else None


def score_texts(texts: list[str | None], model: Model | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Of each text its language, its score, and its cross-entropy in bits per character."""
    if model is None or not texts:
        return _judged(np.zeros((len(texts), 1)), np.zeros(len(texts), int), [UNKNOWN])
    keys, at = grams(*fold(texts), model.order)
    return _judged(_sums(keys, at, model), np.diff(at), model.langs)


def _sums(keys: np.ndarray, at: np.ndarray, model: Model) -> np.ndarray:
    """Of each text, whose n-grams begin at at, the sum of log2 by language."""
    many = len(at) - 1
    sums = np.zeros((many, len(model.langs)))
    step = 1 << 19
    # whole texts together, in steps of about so many characters; a longer text in several
    d = 0
    while d < many:
        e = max(d + 1, int(np.searchsorted(at, at[d] + step, "right")) - 1)
        if e == d + 1:
            for lo in range(at[d], at[e], step):
                sums[d] += model.log2(keys[lo : min(lo + step, at[e])]).sum(axis=0, dtype=float)
        else:
            values = model.log2(keys[at[d] : at[e]]).astype(float)
            full = np.flatnonzero(at[d + 1 : e + 1] > at[d:e]) + d
            if len(full):
                sums[full] = np.add.reduceat(values, at[full] - at[d], axis=0)
        d = e
    return sums


def _judged(sums: np.ndarray, n: np.ndarray, langs: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, scores and cross-entropies from sums of log2 over n characters."""
    pred, score, bits = [UNKNOWN] * len(n), np.zeros(len(n)), np.zeros(len(n))
    for d in np.flatnonzero(n > 0):
        cross = -sums[d] / n[d]
        best = int(cross.argmin())
        pred[d], bits[d] = langs[best], cross[best]
        score[d] = 1 / np.exp2(-(cross - cross[best]) * min(int(n[d]), EVIDENCE)).sum()
    return pred, score, bits


def classify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Replace column text by lang_pred, score and bits; all other columns stay."""
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in (text, "lang_pred", "score", "bits")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            pred, score, bits = score_texts(batch.column(text).to_pylist(), held.value)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(pred, pa.string()), pa.array(score), pa.array(bits)], [*kept, "lang_pred", "score", "bits"])

    part = docs.select(*kept, text)
    schema = part.select(*kept, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits")).schema
    return part.mapInArrow(run, schema)


def _parts(counts: DataFrame, langs: int, cells: int) -> tuple[np.ndarray, int]:
    """The shard of each context character, and how many there are; one of more than cells is a shard alone."""
    rows = counts.groupBy(_context("gram").alias("c")).agg(F.count("*").alias("n")).orderBy("c").toArrow()
    shard_of, shard, held = np.zeros(1 << 16, np.int32), 0, 0
    for c, n in zip(rows.column("c").to_pylist(), rows.column("n").to_pylist(), strict=True):
        if held and (held + n) * langs > cells:
            shard, held = shard + 1, 0
        shard_of[c], held = shard, held + n
    return shard_of, shard + 1


def _context(gram: str) -> Column:
    return F.shiftright(F.col(gram), 16).bitwiseAND(F.lit(0xFFFF)).cast("int")


def _whole(counts: DataFrame, order: int) -> Whole:
    level, discounts = counts, {}
    for k in range(order, 0, -1):
        if k < order:
            short = F.col("gram").bitwiseAND(F.lit((1 << 16 * k) - 1))
            level = level.select("lang", short.alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("n"))
        for r in level.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("one"), F.count_if(F.col("n") == 2).alias("two")).collect():
            discounts[r.lang, k] = r.one / (r.one + 2 * r.two) if r.one and r.two else 0.5
    single = _by_lang(level.toArrow())  # at most 65,536 rows a language
    return Whole(len(np.unique(np.concatenate([g for g, _ in single.values()]))) + 1, discounts, single)


def classify_in_shards(docs: DataFrame, counts: DataFrame, order: int, cells: int) -> DataFrame:
    """As classify() with a model of all counts, of which no more than one shard is held at a time.

    What a text gets depends on the text alone, so parts are added by two hashes of it.
    """
    spark = docs.sparkSession
    whole = _whole(counts, order)
    langs = sorted(whole.single)
    shard_of, shards = _parts(counts, len(langs), cells)
    keyed = docs.withColumn("_a", F.xxhash64("text")).withColumn("_b", F.xxhash64(F.lit(1), "text"))
    texts = keyed.select("_a", "_b", "text").where("text IS NOT NULL")
    small_batches(spark)
    lookup = spark.sparkContext.broadcast(shard_of)
    of_char = F.udf(lambda c: int(lookup.value[c]), "int")
    sharded = durable(counts.join(F.broadcast(counts.select(_context("gram").alias("_c")).distinct().withColumn("shard", of_char("_c"))), _context("gram") == F.col("_c")).drop("_c"))
    added = None
    for shard in range(shards):
        by = _by_lang(sharded.where(F.col("shard") == shard).select("lang", "gram", "n").toArrow())
        none = np.zeros(0, _U), np.zeros(0, np.int64)
        held = spark.sparkContext.broadcast(fit({x: by.get(x, none) for x in langs}, order, whole))

        def run(batches: Iterator[pa.RecordBatch], held=held, shard=shard) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, "text"):
                keys, at = grams(*fold(batch.column("text").to_pylist()), order)
                mine = lookup.value[(keys >> _U(16)) & _U(0xFFFF)] == shard
                start = np.concatenate([[0], np.cumsum(mine)])[at]
                yield pa.RecordBatch.from_arrays([batch.column("_a"), batch.column("_b"), pa.array(np.diff(start)), pa.array(list(_sums(keys[mine], start, held.value)), pa.list_(pa.float64()))], ["_a", "_b", "n", "sums"])

        part = texts.mapInArrow(run, "_a long, _b long, n long, sums array<double>").where("n > 0")
        part = part.groupBy("_a", "_b").agg(F.first("n").alias("n"), F.first("sums").alias("sums"))
        if added is not None:
            both = added.unionByName(part).groupBy("_a", "_b").agg(F.sum("n").alias("n"), F.collect_list("sums").alias("_l"))
            part = both.select("_a", "_b", "n", F.aggregate("_l", F.array_repeat(F.lit(0.0), len(langs)), lambda x, y: F.zip_with(x, y, lambda p, q: p + q)).alias("sums"))
        added = durable(part)
        held.unpersist()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sums = np.array(batch.column("sums").to_pylist(), float)
                pred, score, bits = _judged(sums, batch.column("n").to_numpy(), langs)
                yield pa.RecordBatch.from_arrays([batch.column("_a"), batch.column("_b"), pa.array(pred, pa.string()), pa.array(score), pa.array(bits)], ["_a", "_b", "lang_pred", "score", "bits"])

    judged = added.mapInArrow(judge, "_a long, _b long, lang_pred string, score double, bits double")
    kept = [c for c in docs.columns if c not in ("text", "lang_pred", "score", "bits")]
    out = keyed.select(*kept, "_a", "_b").join(judged, ["_a", "_b"], "left")
    return out.select(*kept, F.coalesce("lang_pred", F.lit(UNKNOWN)).alias("lang_pred"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("bits", F.lit(0.0)).alias("bits"))


def limits(scored: DataFrame) -> DataFrame:
    """(lang_pred, most_bits): the least hundredth of a bit that ACCEPT of the rows don't exceed, from rows of training documents told rightly."""
    b = scored.where("lang = lang_pred").groupBy("lang_pred", F.floor(F.col("bits") * 100).alias("bin")).agg(F.count("*").alias("n"))
    whole = W.partitionBy("lang_pred")
    b = b.withColumn("_sum", F.sum("n").over(whole.orderBy("bin").rowsBetween(W.unboundedPreceding, 0))).withColumn("_all", F.sum("n").over(whole))
    return b.where(F.col("_sum") * 1000 >= F.col("_all") * ACCEPT).groupBy("lang_pred").agg(((F.min("bin") + 1) / 100).alias("most_bits"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, cells: int = CELLS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, bits, accepted) of rows (doc_id, lang, text)."""
    docs = docs.select("doc_id", "lang", "text").withColumn("held_out", held_out(F.col("doc_id")))
    counts = durable(gram_counts(docs.where(~F.col("held_out"))))
    langs = counts.select("lang").distinct().count()
    if counts.count() * langs > cells:
        scored = durable(classify_in_shards(docs, counts, ORDER, cells))
    else:
        by = _by_lang(counts.toArrow())  # at most cells / langs rows
        scored = durable(classify(docs, fit(by, ORDER) if by else None))
    most = limits(scored.where(~F.col("held_out"))).select(F.col("lang_pred").alias("_l"), "most_bits")
    both = scored.join(F.broadcast(most) if most.count() <= 10_000 else most, F.col("lang_pred") == F.col("_l"), "left")
    return both.select("doc_id", "held_out", "lang_pred", "score", "bits", F.coalesce(F.col("bits") <= F.col("most_bits"), F.lit(False)).alias("accepted"))
