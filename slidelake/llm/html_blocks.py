"""Main text of web pages: flat text blocks, classified by a decision tree over what each holds and what lies around it.

A page becomes a list of blocks (text between block-level tags) with the words of each, the share of them in links and
the same for the blocks before and after; further features are where it stands by its tags (in or out of the page's
article, in a landmark such as a menu or a form) and whether an element about it has a class, id or role that speaks of
boilerplate. Such an element, or landmark, counts for nothing where it wraps the page: where it holds the main heading
and half of the words. An inline element that is hidden or named so goes with its text. Of several articles beside each
other, one with more than half of their words is the page's; one within another is a landmark, as comments and teasers
are written so. The tree is grown here from `labelled`, small pages whose wanted elements carry data-keep; in
pages without article or main it decides by words, links and neighbours.

Defined results: null and empty pages give an empty text of 0 characters. White space is what str.split takes for it.
A `br` is white space within its block. Unclosed comments and raw elements (scripts, styles) run to the end, a tag cut
off at the end is dropped. Rows that repeat an id are rows of their own; other columns are never read. An empty table
gives an empty result.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: names from the HTML standard, and words that class, id and role names use
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt rtc s samp small span strike strong sub sup time tt u var wbr math mi mn mo mrow ms mtext msub msup msubsup mfrac msqrt mroot mstyle munder mover munderover mpadded mphantom mspace semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg annotation iframe canvas audio video head title textarea select option button".split())
LANDMARK = frozenset("nav footer aside form menu dialog".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
HINTS = frozenset(
    "ad ads adv advert advertisement adverts advertising alert banner breadcrumb breadcrumbs comment commentlist comments consent contentinfo cookie cookies copyright dialog disclaimer "
    "discussion discussions disqus footer footnote gdpr hidden legal links login masthead menu menubar modal nav navbar navigation navigator newsletter notice notification overlay pager paginate pagination paywall "
    "popup popular print promo promoted promotion recommend recommended related replies reply respond search share sharing shop sidebar signup sitemap skip social sponsor sponsored subscribe "
    "subscription tagcloud teaser teasers toc toolbar topbar trending widget".split()
)

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']+|\"[^\"<]*\"|'[^'<]*')*+)[^<>]*(?:>|\Z)|<[!?/][^<>]*(?:>|\Z)", re.S)
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
UNSEEN = re.compile(r"\bhidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
SPLIT = re.compile(r"[^a-z0-9]+")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    #: 2 in an article, 1 in the main part, 0 else.
    within: int
    #: The landmarks, and the elements whose names speak of boilerplate, about the block, by number.
    landmarks: tuple[int, ...]
    hints: tuple[int, ...]
    #: 1 to 6 for headings, else 0.
    heading: int
    keep: bool
    #: The number of the outermost article about the block, else 0.
    article: int = 0


def hinted(attributes: str) -> bool:
    if not attributes:
        return False
    names = " ".join(a or b or c for a, b, c in NAMES.findall(attributes)).lower()
    return bool(names) and not HINTS.isdisjoint(SPLIT.split(names)) or UNSEEN.search(attributes) is not None


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order."""
    found: list[Block] = []
    #: open elements: name, within, landmarks, hints, keep, article
    stack: list[tuple[str, int, tuple[int, ...], tuple[int, ...], bool, int]] = [("", 0, (), (), False, 0)]
    text: list[str] = []
    linked: list[str] = []
    in_link = False
    #: the inline element whose text is left out, and how many of its name are open
    muted, open_muted = "", 0
    heading = number = pos = 0

    def close() -> None:
        nonlocal text, linked
        words = html.unescape("".join(text)).split()
        if words:
            _, within, landmarks, hints, keep, article = stack[-1]
            links = len(html.unescape(" ".join(linked)).split()) if linked else 0
            found.append(Block(" ".join(words), len(words), min(links, len(words)), within, landmarks, hints, heading, keep, article))
        text, linked = [], []

    while True:
        m = TOKEN.search(page, pos)
        piece = page[pos : m.start() if m else len(page)]
        if piece and not muted:
            text.append(piece)
            if in_link:
                linked.append(piece)
        if not m:
            break
        pos = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if name in RAW:
            if not m[1] and not m[0].endswith("/>"):
                end = re.compile(rf"</{name}\s*>|<body\b" if name == "head" else rf"</{name}\b[^<>]*(?:>|\Z)", re.I).search(page, pos)
                if end is None:
                    pos = len(page)
                else:
                    pos = end.start() if end[0][1] != "/" else end.end()
            if name not in ("svg", "math"):
                text.append(" ")
            continue
        if name in INLINE:
            if muted:
                if name == muted:
                    open_muted += -1 if m[1] else 1
                    muted = muted if open_muted else ""
            elif not m[1] and name not in VOID and hinted(m[3]) and not m[0].endswith("/>"):
                muted, open_muted = name, 1
            if name == "a":
                in_link = not m[1]
            elif name == "br":
                text.append(" ")
            continue
        # an inline element that is not closed ends with its block
        muted, open_muted = "", 0
        close()
        if m[1]:
            if name in HEADING:
                heading = 0
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            continue
        if name in VOID:
            continue
        if name in HEADING:
            heading = int(name[1])
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", *HEADING) and stack[-1][0] == name:
            stack.pop()
        _, within, landmarks, hints, keep, article = stack[-1]
        number += 1
        if name in LANDMARK or name == "header" and not within or name == "article" and article:
            landmarks = (*landmarks, number)
        if name not in ("html", "body", "main") and hinted(m[3]):
            hints = (*hints, number)
        stack.append((name, max(within, {"article": 2, "main": 1}.get(name, 0)), landmarks, hints, keep or "data-keep" in m[3], article or number * (name == "article")))
    close()
    return found


FEATURES = ("words", "link_density", "before_words", "before_density", "after_words", "after_density", "heading", "within", "landmark", "hint")


def wrappers(found: list[Block]) -> set[int]:
    """The landmarks and hinted elements that wrap the page: they hold its main heading (without one, four fifths of the words, and 40) and half of the words outside of links. Where there is an article or main part, its blocks alone count."""
    most = max((b.within for b in found), default=0)
    free = [(b.words - b.linked) * (b.within == most) for b in found]
    heads = [(b.heading, i) for i, b in enumerate(found) if b.heading and b.within == most]
    main = min(heads)[1] if heads else None
    held: dict[int, int] = {}
    for b, n in zip(found, free, strict=True):
        for k in {*b.landmarks, *b.hints}:
            held[k] = held.get(k, 0) + n
    least = sum(free) * 0.5 if main is not None else max(sum(free) * 0.8, 40)
    return {k for k, n in held.items() if n >= least and (main is None or k in found[main].landmarks or k in found[main].hints)}


def features(found: list[Block]) -> np.ndarray:
    """A row a block, columns as FEATURES. within: 2 in the page's article (main part, where it has no article), 0 outside of it, 1 where the page has neither."""
    n = len(found)
    words = np.array([b.words for b in found], dtype=np.float64)
    density = np.array([b.linked / b.words for b in found])
    about = wrappers(found)
    landmark = np.array([float(not about.issuperset(b.landmarks)) for b in found])
    hint = np.array([float(not about.issuperset(b.hints)) for b in found])
    plain = [b for b, a, h in zip(found, landmark, hint, strict=True) if not a and not h]
    most = max((b.within for b in plain), default=0)
    held: dict[int, int] = {}
    for b in plain:
        if b.article:
            held[b.article] = held.get(b.article, 0) + b.words - b.linked
    top = max(held, key=lambda k: (held[k], -k), default=0)
    other = held.keys() - {top} if top and 2 * held[top] > sum(held.values()) else set()
    within = np.array([0.0 if b.within < most or most == 2 and b.article in other else 2.0 if most else 1.0 for b in found])
    lead = lambda x: np.r_[x[1:], 0.0]
    lag = lambda x: np.r_[0.0, x[: n - 1]]
    return np.column_stack([words, density, lag(words), lag(density), lead(words), lead(density), [float(b.heading > 0) for b in found], within, landmark, hint])


@dataclass
class Tree:
    feature: int = -1
    cut: float = 0.0
    low: Tree | None = None
    high: Tree | None = None
    keep: bool = False

    def predict(self, rows: np.ndarray) -> np.ndarray:
        if self.low is None:
            return np.full(len(rows), self.keep)
        high = rows[:, self.feature] > self.cut
        out = np.empty(len(rows), dtype=bool)
        out[high], out[~high] = self.high.predict(rows[high]), self.low.predict(rows[~high])
        return out


def grow(rows: np.ndarray, keep: np.ndarray, depth: int = 8) -> Tree:
    """A classification tree by the Gini impurity; among equal splits the first feature and the lowest cut."""
    leaf = Tree(keep=bool(keep.mean() >= 0.5))
    if depth == 0 or len(keep) < 8 or keep.all() or not keep.any():
        return leaf
    best, n = (1e-9, -1, 0.0), len(keep)
    impurity = lambda k, m: 2 * k * (m - k) / m
    whole = impurity(keep.sum(), n)
    for f in range(rows.shape[1]):
        order = np.argsort(rows[:, f], kind="stable")
        x, k = rows[order, f], np.cumsum(keep[order])
        at = np.flatnonzero(x[1:] > x[:-1])
        if len(at):
            left = at + 1
            gain = whole - impurity(k[at], left) - impurity(k[-1] - k[at], n - left)
            i = int(np.argmax(gain))
            if gain[i] > best[0] + 1e-9:
                best = (gain[i], f, (x[at[i]] + x[at[i] + 1]) / 2)
    if best[1] < 0:
        return leaf
    high = rows[:, best[1]] > best[2]
    return Tree(best[1], best[2], grow(rows[~high], keep[~high], depth - 1), grow(rows[high], keep[high], depth - 1))


def _words(n: int, first: int = 0) -> str:
    return " ".join(f"word{(first + i) % 97}" for i in range(n))


def labelled(seed: int = 1, rounds: int = 12) -> list[str]:
    """The labelled table, as pages: elements with data-keep are wanted. Words are fillers; only counts, links and places teach.

    Lengths are drawn anew for each page. In articles and main parts anything may be short or linked, and what lies
    outside may be long; landmarks and elements whose names speak hold text of any length; in pages of plain divs menus,
    teasers and notes are told by their words, links and neighbours alone.
    """
    r = random.Random(seed)
    w, link = _words, lambda n: f'<a href="/x">{_words(n)}</a>'
    any_ = lambda: r.choice((1, 2, 3, 5, 8, 13, 30, 60, 120))
    menu = lambda: "<ul>" + "".join(f"<li>{link(r.randint(1, 4))}</li>" for _ in range(r.randint(3, 8))) + "</ul>"
    notes = lambda: "".join(f"<p>{w(any_())}</p>" for _ in range(r.randint(1, 5)))

    def text(low: int = 1) -> str:
        """A title and paragraphs; those of fewer than `low` words stand between others."""
        out = [f"<h1 data-keep>{w(r.randint(1, 9))}</h1>"]
        for _ in range(r.randint(2, 5)):
            out += [f"<p data-keep>{w(r.randint(max(low, 20), 110))}</p>", f"<p data-keep>{w(any_())}</p>", f"<p data-keep>{w(r.randint(8, 40))} {link(r.randint(1, 4))} {w(r.randint(5, 20))}</p>"]
            if r.random() < 0.3:
                out.append(f"<h2 data-keep>{w(r.randint(1, 6))}</h2>")
        return "".join([*out, f"<p data-keep>{w(r.randint(20, 90))}</p>"])

    def rich() -> str:
        """As it comes in an article: lists of links, single words."""
        odd = lambda: "".join(r.choice((f"<p data-keep>{w(any_())}</p>", f"<p data-keep>{link(any_())}</p>", f"<ul data-keep><li>{link(2)}</li><li>{w(any_())}</li></ul>")) for _ in range(r.randint(2, 9)))
        return f"<h1 data-keep>{w(any_())}</h1>{odd()}"

    def named() -> str:
        name = r.choice(("ad", "sidebar", "comments", "share", "related", "footer", "cookie-notice", "newsletter"))
        return f'<div class="{name}">{r.choice((notes(), w(any_()), menu(), link(any_())))}</div>'

    def landmark() -> str:
        name = r.choice(("nav", "footer", "aside", "form", "dialog"))
        return f"<{name}>{r.choice((notes(), w(any_()), menu()))}</{name}>"

    pages = []
    for _ in range(rounds):
        more = f"<h2>{w(r.randint(1, 3))}</h2>{menu()}"
        pages += [
            f"<nav>{menu()}</nav>{named()}<article>{rich()}{landmark()}{named()}<p data-keep>{w(any_())}</p></article><footer>{w(any_())}</footer>",
            f'{landmark()}{notes()}<article class="post has-social-links">{rich()}</article>{named()}{notes()}',
            r.choice(("", f"<nav>{menu()}</nav>")) + f"<article>{r.choice((rich(), '<p data-keep>' + w(any_()) + '</p>'))}</article>",
            f"<div>{link(2)} {link(3)}</div>{menu()}{text()}",
            f"<header><h1>{w(3)}</h1>{menu()}</header><main>{rich()}</main>{landmark()}{notes()}",
            f'<body class="home search">{named()}<div>{menu()}</div><div class="content">{text()}</div>{named()}{named()}{landmark()}</body>',
            f"<table><tr><td>{link(1)}</td><td>{link(2)}</td><td>{link(1)}</td></tr></table>{text()}{more}<div>{w(r.randint(2, 8))}</div>",
            f"<div>{link(2)} {link(1)} {link(2)}</div><div>{w(r.randint(1, 7))}</div>{menu()}{text()}<div>{link(3)}</div>{more}<div>{w(2)} {link(4)}</div>",
            f'<div>{w(r.randint(1, 7))}</div>{menu()}<div class="wrap menu">{text()}</div>{menu()}<div>{w(r.randint(1, 9))}</div><div>{link(5)}</div><div>{w(5)} {link(2)}</div>',
        ]
    return pages


def trained() -> Tree:
    pages = [blocks(p) for p in labelled()]
    return grow(np.vstack([features(p) for p in pages]), np.array([b.keep for p in pages for b in p]))


_tree: list[Tree] = []


def main_text(page: str | None) -> str:
    """The wanted blocks of a page, a line each."""
    if not _tree:
        _tree.append(trained())
    found = blocks(page) if page else []
    if not found:
        return ""
    return "\n".join(b.text for b, keep in zip(found, _tree[0].predict(features(found)), strict=True) if keep)


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """For every row: id, url, text, n_chars."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                lot = batch.slice(at, 1000)
                texts = [main_text(x) for x in lot.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([lot.column("id"), lot.column("url"), pa.array(texts, type=pa.string()), pa.array(map(len, texts), type=pa.int64())], names=["id", "url", "text", "n_chars"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("id", "url"))
    return rows.mapInArrow(run, f"{kinds}, text string, n_chars long").withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
