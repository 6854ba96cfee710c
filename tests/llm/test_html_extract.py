import re
import time
from html import unescape
from pathlib import Path

import pyarrow.parquet as pq
import pytest

from shelfspark.llm import html_extract as h

TREE = list(h.trained())
PAGES_TABLE = Path("/root/testdata/sf0.01/pages.parquet")

PAGES = [
    ("<html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body><nav><a href=/>Home</a></nav><header><p>Site name</p></header><article><h1>Head &amp; line</h1><p>One\n  two<br>three <b>fo</b>ur.</p><p>5 &lt; 6&nbsp;7</p><div class='comments'><p>Nice post, thanks a lot!</p></div></article><aside>More to read here</aside><footer>&copy; 2024</footer></body>", "Head & line One two three four. 5 < 6 7"),
    ("<body><div class='cookie-notice'>We use cookies</div><main><h2>A</h2><p>Text of the page that goes on for some words.</p><form><label>Mail</label><input></form><div id=sidebar><ul><li>x</li></ul></div></main></body>", "A Text of the page that goes on for some words."),
    ("<article><header><h1>Title here</h1></header><p>First words.<p>Second <i>words</i><ul><li>item</li></ul></article><p>not the article", "Title here First words. Second words item"),
    ("<article><p>cut off in the mid", "cut off in the mid"),
    ("<article><p>a tag is cut <a href='", "a tag is cut"),
    ("<article><!-- <p>no</p> --><p>yes<script>if (a < b) {}</script></p><template><p>no</p></template></article>", "yes"),
    ("<ARTICLE><P>Upper</P><DIV HIDDEN>no</DIV><div style='display:none'>no</div></ARTICLE>", "Upper"),
    ("", ""), (None, ""), ("<nav><a>x</a></nav>", ""),
]


@pytest.mark.parametrize("page,want", PAGES)
def test_main_text(page, want):
    assert h.extract_texts([page], TREE) == [want]


def test_held_out_blocks():
    x, y = h.label_table(200, seed=99)
    assert len(y) > 1000 and (h.judge(TREE, x) == (y > 0.5)).mean() >= 0.98
    # without any names: laid out without them, and with what they say taken away
    x, y = h.label_table(200, seed=98, named=0.0)
    assert (h.judge(TREE, x) == (y > 0.5)).mean() >= 0.98
    x[:, h.FEATURES.index("names")] = 0
    assert (h.judge(TREE, x) == (y > 0.5)).mean() >= 0.88


def test_the_tree_sees_the_text():
    used = {h.FEATURES[f] for f, *_ in TREE if f >= 0}
    assert used & {"words", "words_before", "words_after"} and used & {"links", "links_before", "links_after"} and used & {"page_rest", "page_prose", "page_longest"}


@pytest.mark.parametrize("name", ["response-body", "legal", "contact", "notice", "share", "reply", "x"])
def test_no_article_is_dropped_for_a_word_in_a_name(name):
    text = "Some words of the article that goes on. " * 10
    page = f"<body><nav><a href=/>Home</a><a href=/b>Away</a></nav><div class='{name}'><h1>The head line</h1><p>{text}</p><p>{text}</p></div><footer>c 2024</footer></body>"
    assert h.extract_texts([page], TREE) == [f"The head line {text * 2}".strip()]


NAV, FOOT = "<nav><ul><li><a href=/>Home</a></li><li><a href=/b>News of today</a></li></ul></nav>", "<footer>Copyright 2024 all rights reserved</footer>"
#: Layouts that the label table does not write, by hand: {n} is a text of n words, [n] one that is not the article's.
LAYOUTS = {
    "divisions in an article": "@<article><div>{80}</div><div>{60}</div></article>#",
    "lines between breaks": "@<main>{60}<br><br>{60}</main>#",
    "lines in a division": "@<div>{60}<br>{9}<br>{50}</div>#",
    "divisions under a name": "@<div class='post-content'><div>{60}</div><div>{60}</div></div>#",
    "divisions alone": "<div>{80}</div><div>{90}</div>",
    "spans": "@<div><span>{60}</span><br><span>{40}</span></div>#",
    "a division between paragraphs": "@<article><p>{60}</p><div>{40}</div><p>{60}</p></article>#",
    "links that the article lists": "@<article><p>{60}</p><ul><li><a href=/1>{5}</a></li><li><a href=/2>{5}</a></li></ul><p>{60}</p></article>#",
    "a table for the layout": "<table><tr><td><a href=/>[1]</a></td><td>{90}</td></tr><tr><td></td><td>{40}</td></tr></table>",
    "sections in sections": "@<section><section><h2>{4}</h2><div>{70}</div></section><section><div>{20}</div></section></section>#",
    "fixed type": "@<article><pre>{60}</pre><p>{30}</p></article>#",
    "comments without a name inside": "@<article><p>{80}</p><p>{60}</p><div><h3>Comments</h3><p>[12]</p><p>[20]</p></div></article>#",
    "comments without a name behind": "@<article><p>{80}</p></article><div><h3>3 Comments</h3><div>[12]</div><div>[40]</div></div>#",
    "related links inside": "@<article><p>{80}</p><p>{60}</p><h3>Related</h3><ul><li><a href=/1>[4]</a></li><li><a href=/2>[5]</a></li></ul></article>#",
    "text in the body": "{60}<br>{60}",
    "a list of definitions": "@<main><dl><dt>{1}</dt><dd>{30}</dd></dl><div>{80}</div></main>#",
    "text right in an article": "@<article>{40}</article>#",
    "links without a name beside": "@<div><div>{70}</div><div>{70}</div></div><div><ul><li><a href=/>[3]</a></li><li><a href=/>[2]</a></li></ul></div>#",
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_layouts_that_the_label_table_lacks(layout):
    mine = []

    def put(m):
        words = " ".join(f"{'word' if m[1] == '{' else 'other'}{len(mine)}" for _ in range(int(m[2])))
        mine.append((m[1] == "{", words))
        return words

    page = re.sub(r"([{\[])(\d+)[}\]]", put, LAYOUTS[layout]).replace("@", NAV).replace("#", FOOT)
    assert h.extract_texts([f"<html><body>{page}</body></html>"], TREE) == [" ".join(w for good, w in mine if good)]


def test_addresses_that_end_in_a_slash_close_nothing():
    assert [b.linked for b in h.blocks("<p><a href=/>four</a></p><p><a name='x'/>five<br/>six</p>")] == [4, 0, 0]


def brute(page):
    """The article of a page of the tables, by cutting the string."""
    if "<article>" not in (page or ""):
        return ""
    part = page.split("<article>", 1)[1].split("</article>", 1)[0]
    part = re.sub(r"(?s)<!--.*?-->|<(script|style)\b.*?</\1>", "", part)
    return " ".join(unescape(re.sub(r"<[^>]*>", "\n", re.sub(r"</?(?:b|i|em|strong|a|span)\b[^>]*>", "", part))).split())


@pytest.mark.skipif(not PAGES_TABLE.exists(), reason="no test tables here")
def test_pages_of_the_tables_against_brute_force():
    pages = [x or "" for x in pq.read_table(PAGES_TABLE).column("html").to_pylist()]
    want = [brute(x) for x in pages]
    assert sum(map(bool, want)) > 100 and h.extract_texts(pages, TREE) == want
    bare = [re.sub(r"""\s(?:class|id|role)=(?:"[^"]*"|'[^']*'|[^\s>]+)""", "", x) for x in pages]
    assert h.extract_texts(bare, TREE) == want


def test_deep_nesting_takes_time_in_proportion():
    def seconds(n):
        began = time.perf_counter()
        h.blocks("<div>x" * n)
        return time.perf_counter() - began

    assert seconds(40_000) < 12 * max(seconds(8_000), 0.05)
    assert len(h.blocks("<div>x</span></p>" * 5000 + "</div>" * 5000)) == 5000


def test_all_rows_come_back(spark):
    rows = [(i, "u", p, "clash", 1) for i, (p, _) in enumerate(PAGES)] + [(None, None, "<article>x y</article>" * 3000, None, None), (0, "u", PAGES[0][0], "clash", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n int")
    got = h.extract(df).collect()
    assert len(got) == len(rows) and {x.page_id: x.text for x in got if x.page_id is not None} == {i: w for i, (_, w) in enumerate(PAGES)}
    assert h.extract(df.limit(0)).collect() == []
