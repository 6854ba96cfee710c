import random

import pytest
from pyspark.sql import functions as F

from shelfspark.functions import formats as fm
from shelfspark.functions import text as tx
from shelfspark.operators import citations, planner, state
from shelfspark.operators.models import copy_key, dehyphenate, md_blocks, md_match, slices, trim_tail
from shelfspark.operators import sections


def one(spark, column, *values):
    names = [f"v{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names))
    return df.select(column(*[F.col(n) for n in names]).alias("x")).collect()[0].x


@pytest.mark.parametrize("f,value,want", [
    (fm.ext_of, "x.FB2.ZIP", "fb2.zip"), (fm.ext_of, "weird.pdf.txt", "txt"), (fm.ext_of, ".md", None), (fm.ext_of, "notes.tar.gz", None), (fm.ext_of, r"C:\books\a.docx", "docx"), (fm.ext_of, "", None),
    (tx.clean_text, "encyclo-\npedia", "encyclopedia"), (tx.clean_text, "a   b\t c", "a b c"), (tx.clean_text, "при-\nвет", "привет"),
    (tx.norm_text, "data-\n  base systems", "database systems"), (tx.norm_text, "при-\n вет", "при- вет"), (tx.norm_text, "so\u00adft", "soft"),
    (tx.norm_chapter, "Chapter 3: Sagas", "sagas"), (tx.norm_chapter, "Глава 12. Репликация", "репликация"), (tx.norm_chapter, "Part V. Appendixes", "appendixes"),
    (tx.slugify, "C++ & Rust: A Tale", "c-rust-a-tale"), (tx.slugify, "***", "artifact"), (tx.slugify, "ab " * 40, "-".join(["ab"] * 20)),
    (tx.script_of, "Чистый Python", "ru"), (tx.script_of, "Effective Kotlin", "en"), (tx.script_of, "123", "en"),
    (tx.strip_markers, "in [1984] it", "in  it"), (tx.strip_markers, "a[x] [ , ]", "a[x] [ , ]"),
    (tx.estimate_tokens, "a" * 40, 10), (tx.estimate_tokens, "", 0), (tx.estimate_tokens, "привет", 3),
    (tx.is_aggregative, "summarize this book", True), (tx.is_aggregative, "summarize chapter 3's argument", False),
    (tx.normalize_title, "Investing_for_Programmers_v7_MEAP (1)", "investing for programmers"),
    (tx.probe_of, "1 2 3 " + " ".join(["word"] * 9), " ".join(["word"] * 8)), (tx.probe_of, "1 2 3", "1 2 3"), (tx.probe_of, "", ""),
    (tx.pronoun_led, "«Why» not", True), (tx.pronoun_led, "", False), (tx.group_letter, "ёж", "Ё"), (tx.group_letter, "9", "#"),
    (tx.script_mix, "абв abc aбв", 1 / 3), (tx.json_array, "x [1,\n2] y", "[1, 2]"), (tx.json_array, "none", None),
    (fm.title_of, "/a/b.c.pdf", "b.c"), (fm.title_of, "/a/", "Untitled"), (fm.cloud_marker, "/x/Dropbox/y", "Dropbox"), (fm.cloud_marker, "/x", None),
])
def test_scalar(spark, f, value, want):
    assert one(spark, f, value) == (pytest.approx(want) if isinstance(want, float) else want)


def test_two_arguments(spark):
    assert one(spark, lambda a, b: F.levenshtein(a, b), "investmenet", "investment") == 1
    assert one(spark, tx.cer, "abcd", "abxd") == 0.25
    assert one(spark, tx.word_recall, "database systems of old", "systems database") == 1.0
    assert one(spark, lambda a, b: fm.under_root(a, b), "/lib/src1/x", "/lib/src1/") and not one(spark, lambda a, b: fm.under_root(a, b), "/lib/src19", "/lib/src1")


@pytest.mark.parametrize("author,chapter,page,family,want", [("Ada", "Intro", 42, "pdf", "The Book — Ada · Ch. Intro, p.42"), (None, "Deep Dive", 3, "epub", "The Book · Ch. Deep Dive"), ("", None, None, "epub", "The Book · ~loc 1234"), (None, "", 5, "txt", "The Book"), (None, None, 7, "pdf", "The Book · p.7")])
def test_citation(spark, author, chapter, page, family, want):
    df = spark.createDataFrame([("The Book", author, chapter, page, family, 1234)], "t string, a string, c string, p int, f string, l long")
    assert df.select(tx.citation(*map(F.col, "tacpfl")).alias("x")).collect()[0].x == want


@pytest.mark.parametrize("question,cosine,want", [("", 0.9, False), ("why so", 0.0, True), ("and then how does it work", 0.0, True), ("tell me of the planner here", 0.32, False), ("tell me of the planner here", 0.33, True), ("tell me of the planner here", None, False), ("why " + "w " * 12, 0.1, False)])
def test_fuse(spark, question, cosine, want):
    df = spark.createDataFrame([(question, cosine)], "q string, c double")
    assert df.select(tx.fuse_followup(F.col("q"), F.col("c")).alias("x")).collect()[0].x == want


def test_find_label(spark):
    labels = ["Intro", "Part 2: Storage", "Chapter 3: Appendixes", "Part 1 Simplify Your Projects"]
    for stored, want in (("Part 5: Appendixes", 2), ("Pa rt 1 Simplify Your Projects", 3), ("unrelated", None)):
        df = spark.createDataFrame([(i, l, stored) for i, l in enumerate(labels)], "i int, l string, s string")
        tier, score = citations.label_tier(tx.norm_chapter(F.col("s")), tx.norm_chapter(F.col("l")))
        best = df.select("i", tier.alias("t"), score.alias("c")).where("t IS NOT NULL").orderBy("t", F.desc("c"), "i").collect()
        assert (best[0].i if best else None) == want


def test_planner_branches_without_rows_in_the_tables(spark):
    c = spark.createDataFrame([(0, "/a.pdf", "A", "1:1", "missing"), (1, "/b.pdf", "B", "2:2", "s"), (2, "/c.pdf", "C", "3:3", "s"), (3, "/d.pdf", "D", "4:4", ""), (4, "/e.pdf", "E", "", "t")], "pos long, path string, book_id string, fp string, csig string")
    kinds = "collection_id string, book_id string, fingerprint string, content_sig string, chunker_ver long, source_path string"
    s = spark.createDataFrame([("c", "A", "old", "", 0, "/a.pdf"), ("c", "Z", "4:4", "x", 1, "/z.pdf")], kinds)
    k = spark.createDataFrame([], "collection_id string, source_path string, pipeline string, fingerprint string, reason string, caps_ver string")
    got = lambda rechunk: {r.pos: r.action for r in planner.plan(c, s, k, spark.createDataFrame([], "book_id string, source_path string"), "cpu", "v", rechunk).collect()}
    assert got(False) == got(True) == {0: "unreadable", 1: "embed", 2: "duplicate", 3: "unreadable", 4: "unreadable"}


def test_upsert_is_idempotent(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    r = spark.createDataFrame([(2, "c"), (3, None)], "k int, v string")
    once = state.upsert(t, r, ["k"])
    assert sorted(once.collect(), key=str) == sorted(state.upsert(once, r, ["k"]).collect(), key=str) == [(1, "a"), (2, "c"), (3, None)]


def pack(tokens: list[int], target: int, overlap: int, least: int) -> list[tuple[int, int]]:
    """Runs of units, of about target tokens, each going back over about overlap tokens; a short last run joins the one before."""
    runs: list[tuple[int, int]] = []
    i, n = 0, len(tokens)
    while i < n:
        j, total = i, 0
        while j < n and (j == i or total + tokens[j] <= target):
            total += tokens[j]
            j += 1
        runs.append((i, j))
        if j >= n:
            break
        back, held = 0, 0
        while back < j - i and held < overlap:
            back += 1
            held += tokens[j - back]
        i = max(i + 1, j - back)
    if len(runs) > 1 and sum(tokens[slice(*runs[-1])]) < least:
        runs[-2:] = [(runs[-2][0], runs[-1][1])]
    return runs


@pytest.mark.parametrize("tokens,want", [([], []), ([5], [(0, 1)]), ([4, 4, 4], [(0, 2), (1, 3)]), ([20, 1], [(0, 2)]), ([6, 6, 6, 1], [(0, 1), (1, 2), (2, 4)])])
def test_pack(tokens, want):
    assert pack(tokens, 10, 3, 3) == want


def test_keys_and_hyphens():
    assert copy_key(bytes(i % 251 for i in range(200_000))) == "cfc6243be73dcb78"
    assert dehyphenate(["пере-", "нос", "1-", "x", "a-", "1"]) == ["перенос", "1-", "x", "a-", "1"]


def test_markdown_matching():
    blocks = md_blocks("# Head\n\ntext **bold** and [1, 2] `code`\ngoes on\n\n- item\n1. one\n```\nx = 1\n```")
    assert blocks == ["Head", "text bold and  code goes on", "item", "one", "x = 1"]
    assert md_match("Head\ntext bold and  code", blocks) and not md_match("elsewhere", blocks)
    assert slices("ab\n\ncd\n\nef", 3) == [0, 8] and trim_tail("aéé", 3) == "é"


@pytest.mark.parametrize("segment,long", [(5, 0), (40, 300), (10**6, 0), (10**6, 10**6)])
def test_chunks_do_not_depend_on_segments(spark, monkeypatch, segment, long):
    monkeypatch.setattr(sections, "SEGMENT", segment)
    monkeypatch.setattr(sections, "LONG_BOOK", long)
    r = random.Random(3)
    blocks = []
    for book in ("a", "b", None, "c"):
        for pos in range(120 if book == "b" else 12):
            text = r.choice([None, "", " ", "w " * r.randint(1, 9), " word" * r.randint(1, 30) + "\n \n" + "x " * r.randint(0, 4)])
            blocks.append((book, pos, None if pos < 3 else f"c{pos // (90 if book == 'b' else 5)}", None, text))
    got = sections.chunk_books(spark.createDataFrame(blocks, "book_id string, pos long, chapter string, page long, text string"), 10, 3, 4).collect()
    want = []
    for book in ("a", "b", "c"):
        units, offset, k = [], 0, 0
        for _, _, chapter, _, text in (x for x in blocks if x[0] == book):
            text, at = text or "", 0
            for part in text.split("\n \n"):
                words, start = part.split(), offset + at + len(part) - len(part.lstrip())
                for j in range(0, len(words), 10):
                    piece = part.strip() if len(words) <= 10 else " ".join(words[j : j + 10])
                    units.append((chapter, start, piece, len(words[j : j + 10])))
                    start += len(piece) + 1
                at += len(part) + 3
            offset += len(text) + 2
        i = 0
        while i < len(units):
            j = i
            while j < len(units) and units[j][0] == units[i][0]:
                j += 1
            for a, z in pack([u[3] for u in units[i:j]], 10, 3, 4):
                some = units[i + a : i + z]
                want.append((f"{book}:{k}", book, some[0][0], None, some[0][1], some[-1][1] + len(some[-1][2]), "\n\n".join(u[2] for u in some)))
                k += 1
            i = j
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
