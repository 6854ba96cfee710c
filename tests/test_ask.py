"""Prompts, answers as streams, and the search behind them."""

import json
import time

import pytest
from pyspark.sql import functions as F

from shelfspark.config import Settings
from shelfspark.functions import text as tx
from shelfspark.operators import ask, models, prompt
from shelfspark.sources import sinks

SOURCES = [(1, "Book — Ann", "First sentence. Second."), (2, "Other", "Text.")]


def test_estimates_agree(spark):
    texts = ["", "a", "abcde" * 7, "Привет мир", "abcd" * 9 + "Привет", "x" * 401]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.estimate_tokens(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in rows} == {t: prompt.estimate(t) for t in texts}


def test_a_prompt_holds_what_fits():
    p = prompt.assemble("Why?", SOURCES, [("user", f"q{i}") if i % 2 == 0 else ("assistant", f"a{i} [1, 2] end") for i in range(10)], "  my notes  ")
    assert p.text.index("my notes") < p.text.index("q0") < p.text.index("q4") < p.text.index("[1] Book — Ann\nFirst") < p.text.index("Question: Why?")
    assert "- Assistant: a1 end" in p.text and "Assistant: a9  end" in p.text and "[1, 2]" not in p.text
    assert (p.digest_lines, p.recent_turns, p.dropped_turns, p.notes_injected, p.notes_truncated) == (4, 6, 0, True, False)
    assert p.prompt_tokens == prompt.estimate(p.text)
    bare = prompt.assemble("Q", [])
    assert not bare.notes_injected and bare.text.endswith("used:") and "turns" not in bare.text


def test_shares_and_shedding():
    s = Settings(context_tokens=3000, answer_tokens=500)
    long = "word " * 2000
    p = prompt.assemble("Q", SOURCES, [("user", f"{i} {long}") for i in range(30)], long, s)
    assert p.notes_truncated and p.notes_tokens <= s.note_tokens < prompt.estimate(long)
    assert p.prompt_tokens <= s.prompt_budget and p.digest_lines == 0 and 0 < p.recent_turns < 6 and p.dropped_turns == 30 - p.recent_turns
    assert "29 word" in p.text and "23 word" not in p.text and "[2] Other" in p.text
    digest = prompt.assemble("Q", [], [("assistant", "x" * 300)] * 60, None, Settings())
    assert digest.digest_lines == 12 and digest.dropped_turns == 42  # 66 tokens a line of 800
    full = prompt.assemble("Q" * 9000, [(1, "c", "y" * 50_000)], [("user", "u")], None, s)  # sources and question stay whatever the budget
    assert full.recent_turns == 0 and "y" * 50_000 in full.text


def test_prompts_of_a_table(spark):
    asks = spark.createDataFrame([(1, "One?"), (2, "Two?"), (3, None)], "qid long, question string")
    sources = spark.createDataFrame([(1, 2, "c2", "t2"), (1, 1, "c1", "t1"), (2, 1, None, None)], "qid long, rank int, citation string, text string")
    history = spark.createDataFrame([(1, 1, "assistant", "before [1]"), (1, 0, "user", "asked")], "qid long, turn long, role string, text string")
    notes = spark.createDataFrame([(2, "note")], "qid long, note string")
    rows = {r.qid: r for r in prompt.prompts(asks, sources, history, notes).collect()}
    assert len(rows) == 3 and rows[1].prompt == prompt.assemble("One?", [(1, "c1", "t1"), (2, "c2", "t2")], [("user", "asked"), ("assistant", "before [1]")]).text
    assert rows[2].notes_injected and rows[3].recent_turns == 0 and rows[1].recent_turns == 2
    assert prompt.prompts(asks.limit(0), sources).collect() == []


def slow():
    yield "one"
    time.sleep(3)
    yield "two"


def test_lines_within():
    assert list(ask.lines_within(["a", "b"])) == ["a", "b"]
    with pytest.raises(ask.Idle):
        list(ask.lines_within(slow(), 0.2))
    with pytest.raises(KeyError):
        list(ask.lines_within({}[k] for k in ["x"]))
    seen = []
    for line in ask.lines_within(map(str, range(10**9)), stopped=lambda: len(seen) >= 3):
        seen.append(line)
    assert seen == ["0", "1", "2"]


def test_answers_and_usage(spark):
    prompts = spark.createDataFrame([(1, prompt.assemble("Q", SOURCES).text), (2, prompt.assemble("Q", []).text)], "qid long, prompt string")
    rows = {r.qid: r for r in ask.answers(ask.answer_lines(prompts, ask.extractive), "ollama").collect()}
    assert rows[1].said == "First sentence. [1]" and rows[1].in_tokens > 0 and rows[1].out_tokens == 4 and rows[1].error is None
    assert rows[2].said == "The sources hold no answer."
    failing = {r.qid: r for r in ask.answers(ask.answer_lines(prompts, lambda: lambda p: (_ for _ in ()).throw(ValueError("down"))), "ollama").collect()}
    assert failing[1].error == "ValueError: down" and failing[1].said == ""
    lines = [(7, 0, json.dumps({"choices": [{"delta": {"content": "<think>hm</think>yes"}}], "usage": {"prompt_tokens": 5, "completion_tokens": 1}})), (7, 1, json.dumps({"usage": {"prompt_tokens": 5, "completion_tokens": 9}})), (7, 2, "[DONE]")]
    df = spark.createDataFrame([(q, s, f"data: {x}", None) for q, s, x in lines], "qid long, seq long, line string, error string")
    r = ask.answers(df, "openai").first()
    assert (r.said, r.thought, r.in_tokens, r.out_tokens) == ("yes", "hm", 5, 9)  # the last, not the sum


def test_retrieval_repairs_and_widens(spark):
    rows = [("a", "the lighthouse keeper walks along the northern harbour at night"), ("b", "bread recipes with rye flour and patience"), ("c", "the harbour master counts ships"), ("d", "painting walls in winter")]
    chunks = models.embed(spark.createDataFrame(rows, "id string, text string"), models.hashed_words).cache()
    asked = spark.createDataFrame([(1, "lighthousee keeper"), (2, "and when?")], "qid long, q string")
    s = Settings(min_relevance=0.01)
    got = ask.retrieve(asked, chunks, s, models.hashed_words).where("rank = 1 and qid = 1").collect()
    assert [r.id for r in got] == ["a"]
    prior = spark.createDataFrame([(2, "rye bread recipes"), (1, None)], "qid long, prior string")
    wide = ask.widened(asked, prior, models.hashed_words).collect()
    assert [(r.qid, r.q) for r in wide] == [(2, "rye bread recipes\nand when?")]
    pool = ask.retrieve(asked, chunks, Settings(min_relevance=0.0), models.hashed_words, prior).where("qid = 2").collect()
    assert "b" in {r.id for r in pool}


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = [("My: \"Title\"", 2, ["x"], "Later", ["s1", "s2"]), ("My title", 1, None, "Earlier", None), ("!!", 1, [], "None", [])]
    df = spark.createDataFrame(rows, "title string, created long, tags array<string>, text string, sources array<string>")
    named = {r.name: r.body for r in sinks.artifacts(df).collect()}
    assert len(named) == 3 and any(n.endswith("-2.md") for n in named) == ("my-title-2.md" in named)
    later = next(b for b in named.values() if "Later" in b)
    assert later.startswith('---\ntitle: "My: \\"Title\\""\n') and "- [1] s1\n- [2] s2" in later and "## Sources" not in next(b for b in named.values() if "Earlier" in b)
    first = sinks.write_artifacts(df, path)
    second = sinks.write_artifacts(df, path)
    assert len(set(first + second)) == 6 and (tmp_path / "out" / first[0]).read_text() == named[first[0]]
    sinks.write_notebook(spark, path, "é notes")
    sinks.write_notebook(spark, path, "é notes 2")
    assert sinks.read_notebook(spark, path) == "é notes 2" and sinks.read_notebook(spark, path + "x") == ""
    themes = [{"title": "T", "sub": [{"title": "S"}]}]
    sinks.write_themes(spark, path, ["b", "a"], themes)
    assert sinks.read_themes(spark, path, ["a", "b", "a"]) == themes and sinks.read_themes(spark, path, ["a"]) is None
    sinks.write_settings(spark, path, Settings(final_k=3))
    assert sinks.read_settings(spark, path) == Settings(final_k=3) and sinks.read_settings(spark, path + "x") == Settings()
