import random

from shelfspark.llm import substring_dedup as s

from . import nasty


def test_passages_are_caught_and_clean_documents_left_alone(spark):
    r = random.Random(12)
    passages = [nasty.prose(r, n) for n in (51, 55, 60, 80, 150)]
    data, holds = [], {}
    for i in range(150):
        text = nasty.prose(r, r.randint(60, 200))
        if i % 3 == 0:
            p = passages[i // 3 % len(passages)]
            holds.setdefault(i // 3 % len(passages), []).append(i)
            text = f"{text} {p}{r.choice([' ', chr(10), chr(10) * 2])}{nasty.prose(r, 40)}"
        if i % 5 == 0:
            text = "A common line of ten words that many texts begin with.\n" + text
        data.append((i, text, "en", "s", 0, *nasty.EXTRA))
    rows = s.repeats(nasty.table(spark, data)).collect()
    assert {x.doc_id for x in rows} == {i for v in holds.values() for i in v}
    text = {x[0]: x[1] for x in data}
    for k, docs in holds.items():
        for d in docs:
            # the passage itself; besides, a stretch that reaches a word or two beyond it may be near another
            at = text[d].index(passages[k])
            spans = [x for x in rows if x.doc_id == d]
            main = max(spans, key=lambda x: x.n_words)
            assert main.removed == (d != min(docs)) and main.first_doc == min(docs) and main.n_docs == len(docs)
            assert at - 20 <= main.start and main.end <= at + len(passages[k]) + 20 and main.end - main.start >= 0.6 * len(passages[k])
            assert all(x.end > at and x.start < at + len(passages[k]) for x in spans)


def test_near_lines_of_long_paragraphs(spark):
    r = random.Random(3)
    words = nasty.prose(r, 120).split()
    near = " ".join([*words[:60], "other", *words[61:]])
    data = [(1, nasty.prose(r, 50) + "\n" + " ".join(words)), (2, near + "\n" + nasty.prose(r, 50)), (3, nasty.prose(r, 200))]
    rows = s.repeats(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert {(x.doc_id, x.removed) for x in rows} == {(1, False), (2, True)}
    assert max(x.n_words for x in rows if x.doc_id == 2) == 120


def test_nasty_rows(spark):
    rows = s.repeats(nasty.table(spark)).collect()
    base = {6, 7, 8, 9, 11}
    # the row without an id that has the same text is one more document
    assert {x.doc_id for x in rows} == base | {None} and {x.doc_id for x in rows if not x.removed} == {6}
    assert all(x.first_doc == 6 for x in rows) and max(x.n_docs for x in rows) == 6
    assert s.repeats(nasty.table(spark, [])).collect() == []


def test_passages_of_few_distinct_shingles(spark):
    r = random.Random(8)
    passages = [" ".join((nasty.prose(r, period).split() * 60)[:60]) for period in range(1, 10)]
    data = [(i, f"{nasty.prose(r, 80)} {passages[i % 9]} {nasty.prose(r, 80)}") for i in range(18)]
    data += [(20 + i, f"{nasty.prose(r, 80)}\n{passages[i % 2 + 3]}\n{nasty.prose(r, 80)}") for i in range(4)] + [(30, nasty.prose(r, 300))]
    rows = s.repeats(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert {x.doc_id for x in rows} == {x[0] for x in data} - {30}
    text = dict(data)
    for i in range(18):
        at = text[i].index(passages[i % 9])
        main = max((x for x in rows if x.doc_id == i), key=lambda x: x.n_words)
        assert main.removed == (i >= 9) and main.first_doc == i % 9 and main.n_docs == (4 if i % 9 in (3, 4) else 2)
        # a stretch may reach up to three words beyond the passage
        assert main.n_words >= 36 and at - 30 <= main.start and main.end <= at + len(passages[i % 9]) + 30


def test_documents_without_ids(spark):
    r = random.Random(19)
    p = nasty.prose(r, 70)
    data = [(None, f"{nasty.prose(r, 60)} {p}"), (None, f"{nasty.prose(r, 60)} {p}"), (None, nasty.prose(r, 90))]
    rows = s.repeats(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.first_doc, x.removed) for x in rows) == [(None, None, False), (None, None, True)] and all(x.n_docs == 2 for x in rows)
    alone = [(None, data[0][1]), (None, data[0][1])]  # one document, given twice
    assert s.repeats(spark.createDataFrame(alone, "doc_id long, text string")).collect() == []
