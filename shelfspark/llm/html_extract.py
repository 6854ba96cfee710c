"""Main text of web pages from flat text blocks and a decision tree.

A page is read once into text blocks, in order, without building a tree of its elements. A
block is described by its words and link density, those of the blocks before and
behind it, what the rest of the page holds, the kind of its element, the landmarks of HTML
around it (article and main, or nav, aside, footer, form and the like), whether it stands under a short heading
that names comments, related pages and the like, and, as one weak feature, whether class names, ids and roles of the nearest container that says anything speak more for or
against an article. A small decision tree, trained on a labelled table of blocks, says which blocks
are the article's. The table is laid out by rule (label_table): pages of several
layouts whose blocks are labelled as they are written; articles are written in paragraphs, divisions, spans,
cells, or lines between breaks; many have no names at all, and in some the article itself stands under a name that speaks against it, so that no name decides alone.

Character references are decoded, white space inside a block becomes one space,
and the blocks kept are joined by one space. Null and empty pages give an empty
text. Damaged markup is read as far as it makes sense: an unclosed element ends
with the container around it, an unfinished tag at the end is dropped; the work grows with
the length of the page, however deep it is nested. Rows are read each for itself.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import pieces, small_batches

# Element names of HTML.
BLOCKS = frozenset("address article aside blockquote body br button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
UNSEEN = frozenset("script style noscript template svg head title textarea select option button iframe object canvas math audio video datalist".split())
RAW = frozenset("script style title textarea noscript iframe template svg".split())
CONTAINERS = frozenset("a address article aside blockquote body dd details dialog div dl fieldset figure footer form head header li main menu nav ol section select button svg table td th tr ul object video audio canvas datalist math".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words in class names, ids and roles that speak for and against an article.
GOOD_WORDS = frozenset("article body content entry main post story text".split())
BAD_WORDS = frozenset(
    "ad ads adbox advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent contentinfo complementary cookie cookies copyright disqus footer gdpr login masthead menu menubar modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination popup promo promoted promotion recommended related replies reply share sharing shoutbox sidebar signup skyscraper social sponsor sponsored subscribe subscription taboola teaser toolbar topbar widget".split()
)
# Words in a heading of three words at most that say what follows is not the article.
HEADING_WORDS = frozenset("advertisement comment comments discussion newsletter popular recommended related replies responses share sponsored subscribe trending".split())
GOOD_TAGS, BAD_TAGS = frozenset(["article", "main"]), frozenset(["nav", "footer", "aside", "form", "fieldset", "dialog", "menu", "header"])

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*(?=>|$)|[^>]*)(?:>|$)", re.S)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
# an element that closes itself; the last character of an address without quotes is none
_CLOSED = re.compile(r"(?:^|[\s\"'])/$")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "heading", "paragraph", "article", "page_article", "landmark", "names", "under", "page_rest", "page_longest", "page_prose")


def _names(attributes: str) -> int:
    """1 where names of a container speak more for an article than against it, -1 where less, else 0."""
    if "=" not in attributes:
        return 0
    words = {x.lower() for m in _NAMES.finditer(attributes) for x in _SPLIT.split(next(filter(None, m.groups()), ""))}
    good, bad = len(words & GOOD_WORDS), len(words & BAD_WORDS)
    return (good > bad) - (good < bad)


@dataclass(frozen=True)
class Block:
    text: str
    linked: int  #: characters in links
    heading: int
    paragraph: int  #: the nearest block element is p, li, pre, blockquote or the like
    article: int  #: inside article or main
    landmark: int  #: inside a landmark that is no article, or a hidden element
    names: int  #: what names of the nearest container that says anything speak for
    under: int = 0  #: behind a heading that says that what follows is not the article, in the same container


@dataclass(frozen=True)
class _Open:
    """An open container, with what holds inside it."""

    tag: str
    article: int = 0
    landmark: int = 0
    names: int = 0
    links: int = 0
    unseen: int = 0


PROSE = frozenset("p li pre blockquote dd dt td th figcaption".split())


def blocks(page: str) -> list[Block]:
    """The text blocks of a page, in order."""
    out: list[Block] = []
    stack, many = [_Open("")], Counter()
    held: list[str] = []
    linked = heading = paragraph = under = 0

    def flush() -> None:
        nonlocal linked, held, under
        if held:
            text = " ".join("".join(held).split())
            if text:
                top = stack[-1]
                if under > len(stack):
                    under = 0
                if heading:
                    words = _SPLIT.sub(" ", text).lower().split() if len(text) < 60 else []
                    under = len(stack) if len(words) <= 3 and not HEADING_WORDS.isdisjoint(words) else 0
                out.append(Block(text, linked, heading, paragraph, int(top.article > 0), int(top.landmark > 0), top.names, int(under > 0)))
        held, linked = [], 0

    def take(lo: int, hi: int) -> None:
        nonlocal linked
        if lo < hi and not stack[-1].unseen:
            text = html.unescape(page[lo:hi])
            held.append(text)
            if stack[-1].links:
                linked += len(text.strip())

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            take(at, size)
            break
        take(at, m.start())
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in BLOCKS:
            flush()
            if tag != "br":
                paragraph = int(not m[1] and tag in PROSE)
        if not m[1]:
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|$)", re.I).search(page, at)
                at = end.end() if end else size
                continue
            if tag in HEADINGS:
                heading = 1
            if tag in CONTAINERS and not _CLOSED.search(m[3]):
                top = stack[-1]
                good, hidden = tag in GOOD_TAGS, bool(_HIDDEN.search(m[3]))
                # a header inside an article is the article's own
                bad = hidden or tag in BAD_TAGS and not (tag == "header" and top.article and not top.landmark)
                names = 0 if tag in ("a", "body") else _names(m[3])
                stack.append(_Open(tag, top.article + good, 0 if good and not hidden else top.landmark + bad, names or (0 if good else top.names), top.links + (tag == "a"), top.unseen + (tag in UNSEEN)))
                many[tag] += 1
        else:
            if tag in HEADINGS:
                heading = 0
            if many[tag]:
                while True:
                    top = stack.pop()
                    many[top.tag] -= 1
                    if top.tag == tag:
                        break
                if under > len(stack):
                    under = 0
    flush()
    return out


def describe(found: list[Block]) -> np.ndarray:
    """FEATURES of the blocks of a page.

    page_rest counts the words of other blocks that nothing speaks against; page_prose those outside links and landmarks.
    """
    n = len(found)
    if not n:
        return np.zeros((0, len(FEATURES)))
    words = np.array([len(x.text.split()) for x in found], float)
    links = np.array([min(1.0, x.linked / max(len(x.text), 1)) for x in found])
    heading, paragraph, article, landmark, names, under = (np.array([getattr(x, c) for x in found], float) for c in ("heading", "paragraph", "article", "landmark", "names", "under"))
    before, after = (lambda v: np.concatenate([[0.0], v[:-1]])), (lambda v: np.concatenate([v[1:], [0.0]]))
    plain = (landmark == 0) & (links < 0.5) & (under == 0)
    fine = plain & (names >= 0)
    rest = (words * fine).sum() - words * fine
    every = np.ones(n)
    return np.stack([words, links, before(words), before(links), after(words), after(links), heading, paragraph, article, every * article.max(), landmark, names, under, rest, every * words.max(), every * (words * plain).sum()], axis=1)


# ------------------------------------------------------------ decision tree


def grow(x: np.ndarray, y: np.ndarray, depth: int = 10, least: int = 4) -> list[tuple]:
    """A binary tree as rows (feature, limit, left, right, share); feature -1 at leaves. Splits by Gini impurity."""
    tree: list[tuple] = []

    def node(rows: np.ndarray, left: int) -> int:
        share = float(y[rows].mean())
        at = len(tree)
        tree.append((-1, 0.0, -1, -1, share))
        if left == 0 or len(rows) < 2 * least or share in (0.0, 1.0):
            return at
        best = (share * (1 - share) * len(rows) - 1e-9, -1, 0.0)
        for f in range(x.shape[1]):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, t = x[order, f], np.cumsum(y[order])
            k = np.arange(1, len(order))
            cut = (v[1:] > v[:-1]) & (k >= least) & (len(order) - k >= least)
            if cut.any():
                p, q = t[:-1] / k, (t[-1] - t[:-1]) / (len(order) - k)
                cost = np.where(cut, k * p * (1 - p) + (len(order) - k) * q * (1 - q), np.inf)
                i = int(cost.argmin())
                if cost[i] < best[0]:
                    best = (cost[i], f, (v[i] + v[i + 1]) / 2)
        if best[1] >= 0:
            side = x[rows, best[1]] <= best[2]
            a, b = node(rows[side], left - 1), node(rows[~side], left - 1)
            tree[at] = (best[1], best[2], a, b, share)
        return at

    node(np.arange(len(y)), depth)
    return tree


def judge(tree: list[tuple], x: np.ndarray) -> np.ndarray:
    """Whether each row is the article's."""
    feature, limit, left, right, share = (np.array(c) for c in zip(*tree, strict=True))
    at = np.zeros(len(x), np.int64)
    while len(open_ := np.flatnonzero(feature[at] >= 0)):
        a = at[open_]
        at[open_] = np.where(x[open_, feature[a]] <= limit[a], left[a], right[a])
    return share[at] >= 0.5


# ----------------------------------------------------------- labelled table


def label_table(pages: int = 3000, seed: int = 11, named: float = 0.6) -> tuple[np.ndarray, np.ndarray]:
    """Described blocks and their labels, from pages laid out by rule; named: the share of containers with class names.

    A block's text starts with its label, which is dropped before it is described.
    """
    r = random.Random(seed)
    text = lambda label, lo, hi: " ".join([label, *("w" * r.randint(2, 9) for _ in range(r.randint(lo, hi)))])
    p = lambda label, lo, hi: f"<p>{text(label, lo, hi)}</p>"
    links = lambda n: "".join(f"<li><a href='/'>{text('N', 1, r.choice([4, 4, 12]))}</a></li>" for _ in range(n))

    def name(*choice: str) -> str:
        return f" {r.choice(['class', 'class', 'id'])}='{r.choice(choice)}{r.choice(['', '', '-1', ' x9'])}'" if r.random() < named else ""

    def para(style: str, lo: int, hi: int) -> str:
        """A paragraph of an article as a page of that style writes it."""
        inner = text("Y", lo, hi)
        return {"p": f"<p>{inner}</p>", "div": f"<div>{inner}</div>", "br": f"{inner}<br><br>", "span": f"<span>{inner}</span><br>", "deep": f"<div><div><span>{inner}</span></div></div>", "section": f"<section><div>{inner}</div></section>", "td": f"<tr><td>{inner}</td></tr>", "pre": f"<pre>{inner}</pre>"}[style]

    def article(short: bool, marked: bool) -> str:
        style = r.choice(["p", "p", "p", "div", "div", "br", "span", "deep", "section", "td", "pre"])
        own = lambda lo, hi: para(style if r.random() < 0.9 else r.choice(["p", "div"]), lo, hi)
        table = f"<table><tr><td>{text('Y', 1, 5)}</td><td>{text('Y', 1, 5)}</td></tr><tr><td>{text('Y', 1, 5)}</td><td>{text('Y', 1, 5)}</td></tr></table>"
        cited = f"<ul>{''.join(f'<li><a href="/">{text("Y", 2, 9)}</a></li>' for _ in range(r.randint(1, 3)))}</ul>"
        kinds = [own(1, 8), own(10, 90), own(10, 90), own(25, 120), f"<h2>{text('Y', 1, 6)}</h2>", f"<ul><li>{text('Y', 2, 15)}</li><li>{text('Y', 2, 15)}</li></ul>", f"<p>{text('Y', 5, 30)} <a href='/'>link</a> w w</p>", f"<p><b>{text('Y', 5, 30)}<br>{text('Y', 1, 9)}</b></p>", f"<div>{text('Y', 5, 40)}</div>", f"<blockquote>{text('Y', 5, 40)}</blockquote>", table, *[cited] * marked]  # without a mark, a list of links is a menu
        body = [own(3, 12)] if short else [own(20, 90), *(r.choice(kinds) for _ in range(r.randint(0, 8)))]
        r.shuffle(body)
        whole = r.choice(["", f"<h1>{text('Y', 2, 14)}</h1>"]) + "".join(body)
        return f"<table>{whole}</table>" if style == "td" else whole

    def headed(loose: bool = False) -> str:
        """Comments or related pages without any name, behind a heading that tells."""
        said = [f"<div><b>{text('N', 1, 2)}</b><p>{text('N', 3, 60)}</p></div>" for _ in range(r.randint(1, 4))] if r.random() < 0.6 else [f"<ul>{links(r.randint(2, 5))}</ul>"]
        size, word = r.choice(["h2", "h3", "h4"]), r.choice(["Comments", "Related", "Replies", "Discussion", "Newsletter", "Sponsored", "Popular"])
        inner = f"<{size}>N {word}</{size}>{''.join(said)}"
        return inner if loose else f"<div>{inner}</div>"

    def junk(inside: bool = False) -> str:
        kinds = [
            f"<div{name('ad', 'sponsor-box', 'promo')}>{text('N', 2, 12)}</div>", f"<div{name('cookie-bar', 'consent', 'notice')}>{text('N', 3, 12)}</div>", f"<aside>{p('N', 3, 30)}</aside>", f"<div{name('sidebar', 'widget')}><ul>{links(3)}</ul></div>",
            f"<form>{text('N', 1, 8)}<input></form>", f"<div{name('share', 'social')}><a href='/'>{text('N', 1, 3)}</a></div>", f"<ul>{links(4)}</ul>", headed(), headed(),
            f"<div><ul>{links(r.randint(1, 3))}</ul></div>", f"<table><tr><td><a href='/'>{text('N', 1, 3)}</a></td></tr></table>",
        ]
        if inside:  # what has no mark inside an article is the article's
            kinds = [f"<aside>{p('N', 3, 30)}</aside>", f"<form>{text('N', 1, 8)}<input></form>", headed(), headed(), headed()]
        if r.random() < 0.5:  # what only its place or its name tells apart has one
            kinds = [f"<section class='{r.choice(['comments', 'replies', 'reader-comments'])}'>{p('N', 3, 60)}{p('N', 3, 60)}</section>", f"<div class='{r.choice(['advert', 'newsletter', 'related'])}'>{p('N', 8, 40)}</div>", f"<div id='{r.choice(['sidebar', 'popup'])}'><h3>{text('N', 1, 4)}</h3>{p('N', 3, 30)}</div>", f"<div class='{r.choice(['ad', 'comments', 'share'])}'>{text('N', 2, 30)}</div>"]
        return r.choice(kinds)

    rows, labels = [], []
    for _ in range(pages):
        layout = r.choice(["article", "article", "main", "named", "bare", "bare", "misnamed"])
        alone = r.random() < 0.1  # a page of nothing else
        inner = para(r.choice(["p", "p", "div", "br"]), 0, 8) if alone and r.random() < 0.7 else article(layout == "article" and r.random() < 0.15, layout in ("article", "main"))
        if layout != "misnamed" and not alone:
            inner += "".join(junk(True) for _ in range(r.choice([0, 0, 0, 1, 2]))) + (headed(True) if r.random() < 0.3 else "")
        body = {"article": f"<article>{inner}</article>", "main": f"<main{name('content', 'page')}>{inner}</main>", "named": f"<div class='{r.choice(['post-content', 'entry', 'story', 'response-body'])}'>{inner}</div>", "bare": f"<div{name('c1', 'wrap', 'col')}>{inner}</div>", "misnamed": f"<div class='{r.choice(['notice', 'reply', 'related', 'widget', 'promo', 'share'])}'>{inner}</div>"}[layout]
        head = r.choice(["", f"<header>{p('N', 1, 10)}</header>"]) + (f"<nav><ul>{links(r.randint(2, 6))}</ul></nav>" if r.random() < 0.6 else f"<div{name('menu')}><ul>{links(r.randint(3, 7))}</ul></div>")
        foot = r.choice([f"<footer>{text('N', 3, 20)}</footer>"] * 3 + [f"<div class='{r.choice(['footer', 'copyright'])}'>{text('N', 2, 8)}</div>", ""])
        loose = [p("N", 2, 40) if layout in ("article", "main") and r.random() < 0.3 else "" for _ in range(2)]
        around = ["" if r.random() < 0.5 or layout == "misnamed" else junk() for _ in range(4)]
        page = body + loose[1] if alone else f"<body>{head}{around[0]}{around[1]}{loose[0]}{body}{loose[1]}{around[2]}{around[3]}{foot}</body>"
        found = [x for x in blocks(page) if x.text[:2] in ("Y ", "N ") or x.text in ("Y", "N")]
        rows.append(describe([replace(x, text=x.text[2:] or "w", linked=max(0, x.linked - 2)) for x in found]))
        labels += [float(x.text[0] == "Y") for x in found]
    return np.concatenate(rows), np.array(labels)


@functools.lru_cache(1)
def trained() -> tuple:
    return tuple(grow(*label_table()))


def extract_texts(pages: list[str | None], tree: list[tuple]) -> list[str]:
    found = [blocks(p or "") for p in pages]
    x = np.concatenate([np.zeros((0, len(FEATURES))), *map(describe, found)])
    keep = judge(tree, x)
    at = np.concatenate([[0], np.cumsum([len(f) for f in found])])
    return [" ".join(b.text for b, k in zip(f, keep[at[i] : at[i + 1]], strict=True) if k) for i, f in enumerate(found)]


def extract(pages: DataFrame, markup: str = "html", out: str = "text") -> DataFrame:
    """Put the main text, as column out, in place of the markup; other columns stay."""
    small_batches(pages.sparkSession)
    tree = list(trained())
    kept = [c for c in pages.columns if c not in (markup, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, markup):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(extract_texts(batch.column(markup).to_pylist(), tree), pa.string())], [*kept, out])

    part = pages.select(*kept, F.col(markup))
    return part.mapInArrow(run, part.select(*kept, F.lit("").alias(out)).schema)
