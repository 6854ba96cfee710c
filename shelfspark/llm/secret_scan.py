"""Scanning texts for secrets, with DataFrame functions alone.

Base patterns give spans of three kinds: assignments to names such as
password, access keys, and long hex strings. Besides, every candidate string is
gone through by a sliding window whose Shannon entropy is kept up to date by
counts: as the window moves, one count rises and one falls, and the sum of
c * log2(c) changes by two terms. The counts of all characters are packed in a few
longs, so that a step costs the same however long the candidate. Where a window's entropy
reaches the limit of the candidate's character class (CLASSES), the stretch
from the first to the last such window is a span of kind entropy. An allow-list
suppresses candidates that are no secrets: words with or without numbers behind them, alone or
joined by hyphens or slashes, upper-case names, UUIDs, and numbers; it has no say over base spans.
None of its patterns repeats a group, so that candidates of any length are safe.

Positions count code points and ends are exclusive. Matches of one kind don't
overlap. Spans come in order of start, then kind, then end. Null and empty texts
have no spans. Each row is scanned for itself; columns of the input stay, but for
those named like the results.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kind: pattern, group whose length counts, least length. All matches are found first, then short ones dropped.
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
KINDS = (*BASE, "entropy")
#: What a text must hold, after lower-casing for assign, to have a match at all.
HINTS = {"assign": ("passw", "secret", "token", "api"), "access": ("AKIA",)}
#: Candidates for entropy and the window.
CANDIDATE, WINDOW = r"[A-Za-z0-9+/_=-]{20,}", 20
#: Tells faster whether a text has a candidate: it looks no further where the character before is one of a candidate's.
QUICK = {CANDIDATE: r"(?<![\w+/=-])[\w+/=-]{20}"}
#: Character classes in order: pattern of the whole candidate, and the least bits of a window. Twenty characters drawn
#: evenly from 16, 36 and 64 have 3.4, 3.9 and 4.1 bits on average; each limit lies about three deviations lower.
CLASSES = {"hex": (r"^[0-9a-fA-F]*$", 3.0), "lower": (r"^[a-z0-9+/_=-]*$", 3.5), "upper": (r"^[A-Z0-9+/_=-]*$", 3.5), "base64": (r"", 3.8)}
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: (pattern that must hold, pattern that must not) of candidates that are no secrets.
ALLOWED = (
    (r"^[A-Za-z0-9_/=+-]*$", r"[A-Za-z0-9][A-Z]|[0-9][a-z]"),  # words, each perhaps with a capital and a number behind it
    (r"^[A-Z_/=+-]*$", None),
    (r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$", None),
    (r"^[0-9=_+/-]*$", None),
)
#: Matches whose positions are added up together; counts of characters in one long, of so many bits each.
TOGETHER, PACKED, BITS = 256, 12, 5

_SPAN = "struct<start:int,end:int,kind:string>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _positions(parts: Column) -> Column:
    """From array<struct(before, long)>, the array of struct(start, end) of each; added up in runs of TOGETHER, then over the runs."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def one(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["before"]
        return F.struct((start + x["long"]).alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), (start + x["long"]).alias("end")))).alias("out"))

    def run(acc: Column, r: Column) -> Column:
        moved = F.transform(r["out"], lambda x: F.struct((x["start"] + acc["at"]).alias("start"), (x["end"] + acc["at"]).alias("end")))
        return F.struct((acc["at"] + r["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    first = F.sequence(F.lit(1), F.size(parts), F.lit(TOGETHER))
    runs = F.transform(first, lambda i: F.aggregate(F.slice(parts, i, F.lit(TOGETHER)), zero, one))
    nested = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,end:int>>>").alias("out"))
    return F.flatten(F.aggregate(runs, nested, run)["out"])


def _placed(text: Column, pattern: str, group: int, least: int) -> Column:
    """array of struct(start, end, match) of the matches whose group has least characters; null without a match.

    The pieces that the pattern splits the text into, and the matches, add up to the text.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    parts = F.struct(found.alias("found"), F.split(text, pattern, -1).alias("between"), value.alias("value"))

    def place(z: Column) -> Column:
        sizes = F.zip_with(z["found"], F.slice(z["between"], F.lit(1), F.size(z["found"])), lambda m, b: F.struct(F.length(b).alias("before"), F.length(m).alias("long")))
        at = _let(sizes, _positions)
        rows = F.zip_with(F.zip_with(at, z["found"], lambda p, m: F.struct(p["start"].alias("start"), p["end"].alias("end"), m.alias("match"))), z["value"], lambda x, v: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["match"].alias("match"), v.alias("value")))
        return F.filter(rows, lambda x: F.length(x["value"]) >= least)

    return F.when(text.rlike(QUICK.get(pattern, pattern)), _let(parts, place))


def base_spans(text: Column, kind: str) -> Column:
    pattern, group, least = BASE[kind]
    spans = F.transform(_placed(text, pattern, group, least), lambda x: F.struct(x["start"], x["end"], F.lit(kind).alias("kind")))
    held = F.lower(text) if kind == "assign" else text
    may = F.lit(kind not in HINTS)
    for hint in HINTS.get(kind, ()):
        may = may | held.contains(hint)
    return F.coalesce(F.when(may, spans), F.array()).cast(f"array<{_SPAN}>")


def entropy_stretch(string: Column) -> Column:
    """struct(first, last): starts of the first and last window of enough entropy; first is null without one.

    The state has the counts of the alphabet's characters in the window, packed in longs, and the sum of c * log2(c).
    """
    least = F.coalesce(*[F.when(string.rlike(p), F.lit(bits)) if p else F.lit(bits) for p, bits in CLASSES.values()])
    weight = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 2)])
    term = lambda c: F.element_at(weight, c + 1)
    longs = -(-len(ALPHABET) // PACKED)

    def place(c: Column) -> Column:
        code = F.instr(F.lit(ALPHABET), c) - 1
        return F.struct(F.floor(code / PACKED).cast("int").alias("word"), ((code % PACKED) * BITS).cast("int").alias("bit"))

    def step(acc: Column, x: Column) -> Column:
        new, old, i = x["new"], x["old"], acc["i"]
        mask = F.lit((1 << BITS) - 1).cast("long")
        count = lambda at: F.call_function("shiftright", F.element_at(acc["n"], at["word"] + 1), at["bit"]).bitwiseAND(mask).cast("int")
        one = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), at["bit"])
        same = F.coalesce(new == old, F.lit(False))
        rise = term(count(new) + 1) - term(count(new))
        fall = F.when(old.isNotNull(), term(count(old) - 1) - term(count(old))).otherwise(F.lit(0.0))
        s = acc["s"] + F.when(same, F.lit(0.0)).otherwise(rise + fall)
        moved = F.transform(acc["n"], lambda v, j: v + F.when(j == new["word"], one(new)).otherwise(F.lit(0).cast("long")) - F.when(old.isNotNull() & (j == old["word"]), one(old)).otherwise(F.lit(0).cast("long")))
        return F.struct((i + 1).alias("i"), F.when(same, acc["n"]).otherwise(moved).alias("n"), s.alias("s"), acc["least"].alias("least"), acc["first"].alias("first"), acc["last"].alias("last"))

    def judged(acc: Column, x: Column) -> Column:
        def rich(b: Column) -> Column:
            at = b["i"] - WINDOW
            enough = (at >= 0) & (F.lit(math.log2(WINDOW)) - b["s"] / WINDOW >= b["least"])
            return F.struct(b["i"].alias("i"), b["n"].alias("n"), b["s"].alias("s"), b["least"].alias("least"), F.when(b["first"].isNull() & enough, at).otherwise(b["first"]).alias("first"), F.when(enough, at).otherwise(b["last"]).alias("last"))

        return _let(step(acc, x), rich)

    none = F.lit(None).cast("int")
    zero = F.struct(F.lit(0).alias("i"), F.array(*[F.lit(0).cast("long")] * longs).alias("n"), F.lit(0.0).alias("s"), least.alias("least"), none.alias("first"), none.alias("last"))

    def go(places: Column) -> Column:
        behind = F.concat(F.array_repeat(F.lit(None).cast("struct<word:int,bit:int>"), WINDOW), F.slice(places, F.lit(1), F.size(places) - WINDOW))
        moves = F.zip_with(places, behind, lambda new, old: F.struct(new.alias("new"), old.alias("old")))
        return F.aggregate(moves, zero, judged, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))

    return _let(F.transform(F.split(string, ""), place), go)


def entropy_spans(text: Column) -> Column:
    def suspect(x: Column) -> Column:
        allowed = F.lit(False)
        for must, not_ in ALLOWED:
            allowed = allowed | (x["match"].rlike(must) & ~x["match"].rlike(not_) if not_ else x["match"].rlike(must))
        return ~allowed

    some = F.filter(_placed(text, CANDIDATE, 0, WINDOW), suspect)
    found = F.transform(some, lambda x: F.struct(x["start"].alias("at"), entropy_stretch(x["match"]).alias("w")))
    rich = F.filter(found, lambda x: x["w"]["first"].isNotNull())
    spans = F.transform(rich, lambda x: F.struct(x["at"] + x["w"]["first"], x["at"] + x["w"]["last"] + WINDOW, F.lit("entropy")))
    return F.coalesce(spans, F.array()).cast(f"array<{_SPAN}>")


def ordered(spans: Column) -> Column:
    """Spans by start, kind in the order of KINDS, and end."""
    place = lambda k: F.array_position(F.array(*map(F.lit, KINDS)), k)
    keyed = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), place(x["kind"]).alias("p"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return F.transform(keyed, lambda x: F.struct(x["start"], x["end"], x["kind"])).cast(f"array<{_SPAN}>")


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add base_spans and spans, arrays of struct(start, end, kind)."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    kept = [c for c in docs.columns if c not in ("base_spans", "spans")]
    parts = F.struct(F.concat(*[base_spans(t, k) for k in BASE]).alias("base"), entropy_spans(t).alias("more"))

    def both(z: Column) -> Column:
        return F.struct(ordered(z["base"]).alias("base_spans"), F.when(F.size(z["base"]) + F.size(z["more"]) > 0, ordered(F.concat(z["base"], z["more"]))).otherwise(z["more"]).alias("spans"))

    found = docs.select(*[F.col(f"`{c}`") for c in kept], F.inline(F.array(_let(parts, both))))
    return found


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def count_kind(kind: str) -> Column:
    return F.size(F.filter("base_spans", lambda x: x["kind"] == kind)).cast("long")


def redact(scanned: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Put mark in place of every span of column spans; spans that overlap become one."""
    zero = F.struct(F.lit(0).alias("upto"), F.array().cast("array<string>").alias("out"))
    piece = lambda acc, x: F.substring(F.col(text), acc["upto"] + 1, x["start"] - acc["upto"])
    step = lambda acc, x: F.struct(F.greatest(acc["upto"], x["end"]).alias("upto"), F.when(x["start"] < acc["upto"], acc["out"]).otherwise(F.concat(acc["out"], F.array(piece(acc, x), F.lit(mark)))).alias("out"))
    clean = F.aggregate("spans", zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col(text), acc["upto"] + 1, F.length(F.col(text)))))
    return scanned.withColumn(text, F.when(F.size("spans") > 0, clean).otherwise(F.col(text)))
