"""Scanned files, order statistics by counting, and the reader's ladder, each against a plain version."""

import math
import random
import re

import pytest

from shelfspark.operators import citations, retrieval, scans, state


def test_order_statistics(spark):
    r = random.Random(2)
    rows = [(g, v) for g in ("a", "b", None, "c") for v in [*(r.lognormvariate(0, 9) * r.choice([-1, 1]) for _ in range(300)), *[7.5] * 200, None]]
    rows += [("one", 3.0), ("none", None), ("wide", -1.7e308), ("wide", 1.7e308), ("wide", 0.0), ("wide", 5e-324)]
    df = spark.createDataFrame(rows, "g string, v double")
    found = state.nearest_ranks(df, ["g"], "v", [0, 50, 95, 100])
    assert "collect_list" not in found._jdf.queryExecution().toString()
    want = {}
    for g in {g for g, _ in rows}:
        v = sorted(x for k, x in rows if k == g and x is not None)
        if v:
            want[g] = tuple(v[min(len(v) * s // 100, len(v) - 1)] for s in (0, 50, 95, 100))
    assert {x.g: tuple(x[1:]) for x in found.collect()} == want
    assert state.nearest_ranks(df.limit(0), ["g"], "v", [50]).collect() == []


def test_scans_and_heads(spark):
    blocks = [("a", p, "x" * n) for p, n in ((1, 60), (2, 30), (2, 30), (3, 49), (9, 500))] + [("b", 1, "y" * 50)]
    totals = [("a", 5), ("b", 1), ("c", 3), ("d", 0)]
    got = scans.looks_scanned(spark.createDataFrame(blocks, "f string, page long, text string"), spark.createDataFrame(totals, "f string, pages long"), "f").collect()
    assert {x.f: (x.thin, x.scanned) for x in got} == {"a": (3, True), "b": (0, False), "c": (3, True), "d": (0, True)}
    pages = [("f", p, f"The Ｂook  {p}\nown line {'abcdefghijklmnopqrstuvwxyz'[p]}\n{'often' if p < 6 else ''}\n") for p in range(20)] + [("short", p, "same") for p in range(4)]
    heads = scans.running_heads(spark.createDataFrame(pages, "f string, page long, text string"), "f").collect()
    assert {(x.f, x.line, x.pages) for x in heads} == {("f", "the book #", 20), ("f", "often", 6)}


@pytest.mark.parametrize("lines", [["a-", "b-", "c", "-", "d", "9-", "e"], ["über-", "Älter", "x - ", "y-", "1"], [""], ["-"], ["a-"]])
def test_hyphens(spark, lines):
    out = []
    for line in lines:
        if out and re.search(r"[^\W\d_]-$", out[-1]) and re.match(r"[^\W\d_]", line):
            out[-1] = out[-1][:-1] + line
        else:
            out.append(line)
    got = scans.dehyphenated(spark.createDataFrame([("k", i, x) for i, x in enumerate(lines)], "k string, i long, line string"), "k", "i", "line")
    assert [x.line for x in got.orderBy("i").collect()] == out


def test_ladder(spark):
    pages = spark.createDataFrame([("f", 1, "one two. three"), ("f", 2, "four\nFIVE six (seven) eight"), ("f", 3, "nine ten"), ("f", 4, "four five six other")], "path string, page long, text string")
    cites = [(1, 1, "one two."), (2, 3, "five six (seven)"), (3, 1, "four five"), (4, 4, "four five six other words"), (5, 9, "nine"), (6, 3, "missing"), (7, 2, "onetwo"), (8, 1, None), (9, 3, "four five six other")]
    df = spark.createDataFrame([(i, "f", p, None if w is None else w.split()) for i, p, w in cites], "id long, path string, page long, words array<string>")
    got = {x.id: (x.rung, x.found) for x in citations.ladder(df, pages).collect()}
    assert got == {1: ("page", 1), 2: ("page before", 2), 3: ("page behind", 2), 4: ("prefix", 4), 5: ("none", None), 6: ("none", None), 7: ("none", None), 8: ("none", None), 9: ("page behind", 4)}


def test_vectors_that_are_not_whole_are_passed_over(spark):
    v = [(1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, [1.0, None]), (5, [math.nan, 1.0]), (6, []), (7, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(v, "id long, v array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (9, None), (7, [1.0, 1.0, 1.0])], "qid long, v array<double>")
    assert sorted((x.qid, x.id) for x in retrieval.vector_search(q, df, 5).collect()) == [(1, 2)]
    assert sorted((x.qid, x.id) for x in retrieval.vector_search(q, df, 5, own=True).collect()) == [(1, 1), (1, 2), (7, 7)]


def word_pairs():
    r = random.Random(4)
    letters = "ab1é"
    words = {"".join(r.choice(letters) for _ in range(r.randint(1, 7))) for _ in range(150)}
    base = ["".join(r.choice("abcd") for _ in range(n)) for n in (22, 23, 24, 25, 26, 27, 40)]
    for w in base:
        words.add(w)
        for _ in range(6):
            x = list(w)
            for _ in range(r.randint(1, 3)):
                i = r.randrange(1, len(x))
                x[i : i + 1] = r.choice([[], [x[i], "z"], ["y"]])
            words.add("".join(x))
    return sorted(words)


def test_neighbourhoods_miss_nothing(spark):
    from pyspark.sql import functions as F

    words = word_pairs()
    known = spark.createDataFrame([(w,) for w in words], "term string")
    for d in (0, 1, 2):
        asked = known.select(F.col("term").alias("w")).withColumn("d", F.lit(d))
        got = {(x.w, x.term) for x in retrieval.meet(asked, retrieval.neighbourhoods(known, "term"), "w", "term", "d").collect()}
        both = asked.crossJoin(known).where((F.substring("w", 1, 1) == F.substring("term", 1, 1)) & (F.levenshtein("w", "term") <= d))
        assert got == {(x.w, x.term) for x in both.collect()}
