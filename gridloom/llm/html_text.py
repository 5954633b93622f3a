"""Main text of HTML pages from flat text blocks.

A page is cut into flat blocks at block-level tags. Each block has its words and link density,
those of the blocks before and after it, and its surroundings (the kinds of elements it lies in,
what their class and id names hint at). A decision tree, grown on a small labelled table, tells
article blocks from the rest; their texts are joined in page order. Where a page has no telling
elements or names, the words and link densities of a block and its neighbours decide.

Tags are read as HTML says: a quote only opens a value after an equals sign, names that HTML does
not know are inline, and what has no end tag ends with the page or its parent. Reading takes a
time that grows with the page, however broken it is.

Cases: a null or empty page has an empty text; broken or cut markup is read as far as it goes;
unknown character references stay as they are; repeated rows give the same text; clashing input
columns are replaced; an empty table stays empty.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_texts

# Elements that HTML shows as blocks or table parts; all others are inline.
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre search section summary table tbody td tfoot th thead tr ul xmp br".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = frozenset("script style noscript template iframe svg canvas audio video textarea select title annotation annotation-xml".split())
# Of these, what has no end tag goes on to the end of the page; of the others, only the tag is dropped.
_RAW = frozenset("script style iframe textarea title".split())
_IN_HEAD = frozenset("base link meta html head".split())
_CLOSED_BY_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_ASIDE = frozenset("nav footer aside form menu dialog button search".split())

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[=\"'])*+)(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([^\s=/>"'][^\s=/>]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?+""")
_NONE_SHOWN = re.compile(r"display\s*:\s*none")
_ENDS = {tag: re.compile(rf"</{tag}\s*>", re.IGNORECASE) for tag in (*_DROPPED, "head")}
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_NAME = re.compile(r"[a-z]+")
# Words in class and id names that hint at what an element holds.
_BAD = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs byline comment comments consent cookie cookies disclaimer discussion discussions disqus footer gdpr header hidden"
    " legal login masthead menu meta modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion recommended related"
    " replies reply respond responses share sharing sidebar signup skip social sponsor sponsored subscribe tags teaser thread threads toolbar tooltip widget".split()
)
# Words that say nothing beside one of these; a name with any other word, as in "social-history", is not bad.
_NEUTRAL = frozenset(
    "area bar block bottom box center col column container desktop fixed global group grid holder icons inner item items left link links list mobile module"
    " outer page panel posts primary region right row secondary section site slot sticky top unit us view wrap wrapper zone a b c x the".split()
)
# Names of what an element has beside its content, and of headers that belong to an article.
_BESIDE = re.compile(r"(?:has|no|with|without)[-_]")
_OWN_HEADER = re.compile(r"(?:entry|post|article)[-_]*header")
# Bad names of layout, which an article or main element inside lifts; one in comments or teasers stays bad.
_LAYOUT = frozenset("footer header menu nav navbar navigation overlay sidebar skip login signup cookie cookies consent".split())
_GOOD = frozenset("article body content entry main post story text".split())
_NAV_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

FEATURES = ["words", "link_density", "prev_words", "prev_density", "next_words", "next_density", "in_article", "in_boilerplate", "bad_name", "good_name", "heading", "list_item", "page_has_article", "page_blocks", "page_words", "after_cue"]
CLASSIFY_AT_ONCE = 4096
#: Short blocks that stand before readers' comments.
_CUE = re.compile(r"(?i)(?:\d+ )?(?:(?:reader|user|all|recent|latest) )?(?:comments?|responses?|replies|discussion|thoughts)(?: \(?\d+\)?)?:?|leave a (?:comment|reply):?|join the (?:discussion|conversation):?")


@dataclass
class Block:
    """A flat block: its text, linked characters that are no space, and what it lies in."""

    text: str
    linked: int = 0
    article: bool = False
    boilerplate: bool = False
    bad: bool = False
    good: bool = False
    heading: bool = False
    item: bool = False

    @property
    def words(self) -> int:
        return self.text.count(" ") + 1

    @property
    def density(self) -> float:
        return min(1.0, self.linked / max(1, len(self.text) - self.text.count(" ")))


@dataclass(slots=True)
class _Open:
    """An open element, with what it has of the elements around it; ``soft`` bad names can be lifted."""

    tag: str = ""
    boilerplate: bool = False
    article: bool = False
    bad: bool = False
    soft: bool = False
    good: bool = False
    heading: bool = False
    item: bool = False
    hidden: bool = False
    linked: bool = False


def _hints(name: str) -> tuple[bool, bool, bool, bool]:
    """What one class or id name hints at: bad, bad by layout only, good, an article's own header."""
    low = _HUMP.sub("-", name).lower()
    if _BESIDE.match(low):
        return False, True, False, False
    words = _NAME.findall(low)
    if _OWN_HEADER.fullmatch(low):
        return False, True, True, True
    marks = [w for w in words if w in _BAD]
    known = all(w in _BAD or w in _NEUTRAL or w in _GOOD for w in words)
    bad = bool(marks) and known and words != ["page", "header"]
    return bad, all(w in _LAYOUT for w in marks), not bad and any(w in _GOOD for w in words), False


@dataclass
class _Reader:
    blocks: list[Block] = field(default_factory=list)
    stack: list[_Open] = field(default_factory=lambda: [_Open()])
    counts: Counter = field(default_factory=Counter)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    link: bool = False

    def take(self, raw: str) -> None:
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            self.parts.append(text)
            if self.link:
                self.linked += sum(map(len, text.split()))

    def flush(self) -> None:
        if not self.parts:
            return
        text = " ".join("".join(self.parts).split())
        o = self.stack[-1]
        if text and not o.hidden:
            self.blocks.append(Block(text, self.linked, o.article, o.boilerplate, o.bad or o.soft, o.good, o.heading, o.item))
        self.parts, self.linked = [], 0

    def open(self, tag: str, attributes: str) -> None:
        if tag in _CLOSED_BY_P and any(o.tag == "p" for o in self.stack[-3:]):
            self.close("p")
        if tag == "li" and self.stack[-1].tag == "li":
            self.close("li")
        hints, hidden = [], False
        for m in _ATTRIBUTE.finditer(attributes):
            what, value = m[1].lower(), (m[2] or "").strip("\"'")
            if what in ("class", "id"):
                hints += map(_hints, value.split())
            elif what == "aria-label":
                hints.append(_hints(value))
            elif what == "role" and value.lower() in _NAV_ROLES:
                hints.append((True, True, False, False))
            elif what == "hidden" or (what == "style" and _NONE_SHOWN.search(value.lower())):
                hidden = True
        top, lifts = self.stack[-1], tag in ("article", "main")
        bad = tag not in ("body", "html", "article", "main") and any(h[0] for h in hints)
        layout = all(h[1] for h in hints if h[0])
        self.counts[tag] += 1
        self.stack.append(
            _Open(
                tag,
                boilerplate=top.boilerplate or tag in _ASIDE or (tag == "header" and not top.article and not any(h[3] for h in hints)),
                article=top.article or lifts,
                bad=top.bad or (bad and not layout),
                soft=(top.soft and not lifts) or (bad and layout),
                good=top.good or (not bad and any(h[2] for h in hints)),
                heading=top.heading or tag in ("h1", "h2", "h3", "h4", "h5", "h6"),
                item=top.item or tag in ("li", "td", "th", "dd", "dt"),
                hidden=top.hidden or hidden,
                linked=self.link,
            )
        )

    def close(self, tag: str) -> None:
        """Close the innermost element of this tag, with all inside it; links inside end with it."""
        while self.counts[tag]:
            o = self.stack.pop()
            self.counts[o.tag] -= 1
            if o.tag == tag:
                self.link = o.linked
                return


def _is_link(attributes: str) -> bool:
    """Whether an ``a`` element is a link: a mere anchor has a name or an id and no target."""
    names = {m[1].lower() for m in _ATTRIBUTE.finditer(attributes)}
    return "href" in names or not names & {"name", "id"}


def blocks(page: str | None) -> list[Block]:
    """The flat blocks of a page in page order."""
    if not page:
        return []
    r, at, in_head = _Reader(), 0, False
    unclosed: set[str] = set()

    def end_of(tag: str, start: int) -> int:
        """Where the end tag from ``start`` on ends, -1 if there is none; a tag that has none is sought once."""
        found = None if tag in unclosed else _ENDS[tag].search(page, start)
        if found is None:
            unclosed.add(tag)
        return found.end() if found else -1

    while m := _TOKEN.search(page, at):
        if m.start() > at and not in_head:
            r.take(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if not in_head and m[0].startswith("<![CDATA["):
                r.take(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if tag in _DROPPED:
            if not m[1] and not (tag == "svg" and m[0].endswith("/>")):
                end = end_of(tag, at)
                at = end if end >= 0 else len(page) if tag in _RAW else at
            continue
        if tag == "head":
            r.flush()
            # Without an end tag, the head ends with its last element, and text is of the body.
            in_head = not m[1] and (in_head or end_of(tag, at) >= 0)
            continue
        in_head = in_head and tag in _IN_HEAD
        if tag not in _BLOCK:
            if tag == "a":
                r.link = not m[1] and _is_link(m[3])
            continue
        r.flush()
        if tag in _VOID:
            continue
        if m[1]:
            r.close(tag)
        else:
            r.open(tag, m[3])
    r.take(page[at:])
    r.flush()
    return r.blocks


def features(page: list[Block]) -> np.ndarray:
    """A row of ``FEATURES`` for every block of one page."""
    n = len(page)
    out = np.zeros((n, len(FEATURES)))
    if not n:
        return out
    words, density = np.array([b.words for b in page], float), np.array([b.density for b in page])
    out[:, 0], out[:, 1] = words, density
    out[1:, 2], out[1:, 3] = words[:-1], density[:-1]
    out[:-1, 4], out[:-1, 5] = words[1:], density[1:]
    out[:, 6:12] = [[b.article, b.boilerplate, b.bad, b.good, b.heading, b.item] for b in page]
    out[:, 12] = out[:, 6].any()
    # What a page has besides menus and the like: short pages are articles of few words.
    own = (out[:, 7] == 0) & (out[:, 8] == 0) & (density < 0.5)
    out[:, 13], out[:, 14] = n, words[own].sum()
    cue = np.array([b.words <= 5 and _CUE.fullmatch(b.text) is not None for b in page])
    out[:, 15] = np.cumsum(cue) > 0
    return out


# --- the decision tree ---------------------------------------------------------------------------


@dataclass
class Tree:
    """A binary tree: a leaf's verdict, or a feature with its threshold and two subtrees."""

    verdict: bool
    feature: int = -1
    threshold: float = 0.0
    low: Tree | None = None
    high: Tree | None = None

    def classify(self, x: np.ndarray) -> np.ndarray:
        if self.low is None:
            return np.full(len(x), self.verdict)
        left = x[:, self.feature] <= self.threshold
        out = np.empty(len(x), bool)
        out[left], out[~left] = self.low.classify(x[left]), self.high.classify(x[~left])
        return out


def grow(x: np.ndarray, y: np.ndarray, depth: int = 12, least: int = 3) -> Tree:
    """A tree of least Gini impurity, split by split."""
    leaf = Tree(bool(y.mean() >= 0.5) if len(y) else False)
    if depth == 0 or len(y) < 2 * least or y.all() or not y.any():
        return leaf
    best = (y.mean() * (1 - y.mean()) * len(y) - 1e-9, -1, 0.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        xs, ys = x[order, f], y[order].astype(float)
        left = np.cumsum(ys)[:-1]
        k = np.arange(1, len(ys))
        cost = left * (1 - left / k) + (ys.sum() - left) * (1 - (ys.sum() - left) / (len(ys) - k))
        ok = (xs[1:] > xs[:-1]) & (k >= least) & (len(ys) - k >= least)
        if ok.any():
            at = int(np.where(ok, cost, np.inf).argmin())
            if cost[at] < best[0]:
                best = (float(cost[at]), f, float((xs[at] + xs[at + 1]) / 2))
    if best[1] < 0:
        return leaf
    low = x[:, best[1]] <= best[2]
    a, b = grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)
    # A split whose sides are leaves of one verdict decides nothing.
    return leaf if a.low is None and b.low is None and a.verdict == b.verdict else Tree(leaf.verdict, best[1], best[2], a, b)


def splits(tree: Tree) -> Counter:
    """How many splits each feature has in a tree."""
    if tree.low is None:
        return Counter()
    return Counter([FEATURES[tree.feature]]) + splits(tree.low) + splits(tree.high)


_LONG = "It is a long sentence of running prose, as articles have it, with enough words in a row to be read and a full stop at its end."

#: Labelled pages written by hand: article blocks are marked by a leading ``+``.
WRITTEN = [
    f"<nav><ul><li><a>Home</a></li><li><a>News today</a></li></ul></nav><div class='ad'>{_LONG}</div><article><h1>+A title of it</h1><p>+{_LONG}<br>+Short.<p>+Yes.</article><footer>(c) site, all rights. {_LONG}</footer>",
    f"<header><h1>Site name</h1><p>{_LONG}</p></header><main><h1>+Title</h1><p>+{_LONG}</p><ul><li>+one item</li><li>+another item of it</li></ul><p>+{_LONG}</p></main><aside><h3>Related</h3><p>{_LONG}</p></aside>",
    f"<div id='menu'><a>One</a> <a>Two</a></div><div id='content'><h2>+Title of the page</h2><p>+{_LONG}</p><p>+{_LONG}</p><p>+Short one.</p></div><div id='sidebar'><p>{_LONG}</p></div><div class='footer'>Legal</div>",
    f"<article><h1>+T</h1><p>+{_LONG}</p><div class='ad'>{_LONG}</div><p>+{_LONG}</p><div class='share'><a>Share</a></div><section class='comments'><h3>Comments</h3><p>{_LONG}</p><p>Nice</p></section></article>",
    f"<div class='cookie-notice'><p>{_LONG}</p><button>Accept all</button></div><div class='post'><h1>+Heading here</h1><p>+{_LONG}</p><blockquote>+{_LONG}</blockquote></div><form><p>{_LONG}</p><label>Mail</label></form>",
    f"<table><tr><td><a>Link one</a></td><td><a>Link two</a></td></tr></table><p>+{_LONG}</p><p>+{_LONG} {_LONG}</p><p><a>next page</a> <a>previous page</a></p><p>Copyright</p>",
    f"<article><p>+{_LONG}</p><p>+{_LONG} <a>with a link in it</a></p><nav><a>1</a><a>2</a></nav><aside>{_LONG}</aside><form>{_LONG}</form></article><div class='related'><p>{_LONG}</p></div>",
    f"<nav><a>The</a><a>and</a></nav><article><h1>+One</h1><p>+Yes.</p></article><footer>(c) {_LONG}</footer><div class='comments'><p>{_LONG}</p></div>",
    f"<body><article><p>+<a>A paragraph that is one link as a whole, long as it is, in the article</a></p><p>+{_LONG}</p><table><tr><td>+a cell</td><td>+4</td></tr></table></article><div class='newsletter'><p>{_LONG}</p></div></body>",
    f"<nav><a>Home</a><a>World</a></nav><article><h1>+<a>A title that is a link</a></h1><p>+<a>Linked line</a></p><p>+{_LONG}</p></article><footer>{_LONG}</footer>",
    f"<p><a>Top stories</a></p><p><a>More of them</a></p><div><p>+{_LONG}</p><p>+{_LONG}</p></div><p><a>Back to the top</a></p>",
    "<p>+Hello</p>",
    "+Just text",
    "<h1>+Title</h1><p>+Short words here</p>",
    "<p>+A few words of it.</p><p>+And some more.</p>",
    f"<article><h1>+T</h1><p>+{_LONG}</p><ul><li>+<a>One link here</a></li><li>+<a>Two</a></li></ul></article>",
    f"<article><p>+{_LONG}</p><ul><li>+<a>One</a></li><li>+<a>Two links to it</a></li><li>+<a>Three</a></li></ul><p>+{_LONG}</p><p>+Yes.</p></article><footer>{_LONG}</footer>",
    f"<article><p>+{_LONG}</p></article><div class='xq'><h3>3 responses</h3><p>Anna, 3 days ago</p><p>{_LONG}</p><p><a>Reply</a></p></div>",
    f"<div class='header'><p>Name of site</p></div><div class='nav'><p>{_LONG}</p></div><p>+{_LONG}</p><p>+{_LONG}</p><p>+{_LONG}</p><div class='footer'><p>{_LONG}</p></div>",
]


def labelled_pages(pages: int = 2400) -> list[str]:
    """The labelled table: pages written by hand, and pages of many layouts made from a fixed seed.

    A third of the layouts has telling elements, a third telling names, and a third neither: there, menus are
    runs of links, short lines between links are theirs, and short lines between paragraphs are the article's.
    """
    rng = random.Random(17)
    prose = _LONG.lower().replace(",", "").replace(".", "").split()

    def words(low: int, high: int, link: float = 0.0) -> str:
        out = [rng.choice(prose) for _ in range(rng.randint(low, high))]
        k = int(len(out) * link)
        return f"<a href='/x'>{' '.join(out[:k])}</a> {' '.join(out[k:])}".strip() if k else " ".join(out)

    def links(n: int, wrap: str) -> str:
        return "".join(wrap.format(f"<a href='/x'>{words(1, rng.choice([2, 4, 9]))}</a>") for _ in range(n))

    def article(told: bool) -> str:
        """An article's blocks; where elements or names tell it, any of them may be short."""
        title = words(1, 12)
        out = [f"<h1>+{title}</h1>" if not told or rng.random() < 0.8 else f"<h1>+<a href='/x'>{title}</a></h1>"] if rng.random() < 0.75 else []
        short = told and rng.random() < 0.6
        for _ in range(rng.randint(1, 7)):
            out.append(f"<p>+{words(*(1, 12) if short and rng.random() < 0.7 else (15, 90), rng.choice([0, 0, 0, 0.1, 0.25]))}</p>")
            kind = rng.random()
            if kind < 0.3:
                out.append(f"<p>+{words(1, 9)}</p><p>+{words(14, 60)}</p>")
            elif kind < 0.4:
                out.append(f"<h2>+{words(1, 7)}</h2><p>+{words(14, 60)}</p>")
            elif kind < 0.5:
                out.append("<ul>" + "".join(f"<li>+{words(2, 14)}</li>" for _ in range(rng.randint(2, 5))) + f"</ul><p>+{words(14, 60)}</p>")
            elif kind < 0.55 and told:
                out.append("<ul>" + "".join(f"<li>+<a href='/x'>{words(1, 6)}</a></li>" for _ in range(rng.randint(2, 4))) + "</ul>")
            elif kind < 0.62:
                out.append(f"<p>+<a href='/x'>{words(2, 12)}</a></p><p>+{words(*(1, 9) if short else (14, 60))}</p>")
            elif kind < 0.67:
                out.append("<table>" + "".join(f"<tr><td>+{words(1, 3)}</td><td>+{words(1, 2)}</td></tr>" for _ in range(3)) + f"</table><p>+{words(14, 60)}</p>")
        if short and rng.random() < 0.5:
            out.append(f"<p>+{words(1, 9)}</p>")
        return "".join(out)

    def bare(n: int) -> str:
        """A menu without names: links, with short lines between them."""
        wrap = rng.choice(["<p>{}</p>", "<div>{}</div>", "<ul><li>{}</li></ul>", "<td>{}</td>"])
        lone = f"<p>{words(1, 5)}</p>"
        return rng.choice(["", lone]) + links(n, wrap) + (lone + links(rng.randint(1, 3), wrap) if rng.random() < 0.6 else "") + rng.choice(["", "", lone])

    def aside() -> str:
        return rng.choice([f"<p>{words(10, 50)}</p>", f"<p>{words(1, 8)}</p>", links(rng.randint(2, 5), "<p>{}</p>"), f"<h3>{words(1, 3)}</h3><p>{words(5, 40)}</p>"])

    def remarks() -> str:
        """What readers say, in an element of any name, behind a line that says so."""
        cue = rng.choice(["Comments", "3 comments", "Responses", "12 Replies", "Leave a reply", "Discussion", "Comments (4)", "Reader comments", "Join the discussion"])
        said = "".join(f"<p>{words(2, 5)}</p><p>{words(4, 60)}</p>" + rng.choice(["", "<p><a href='#r'>Reply</a></p>"]) for _ in range(rng.randint(1, 4)))
        return f"<div class='{rng.choice(['xq', 'fb', 'talk', 'p2', 'area'])}'><h{rng.choice('234')}>{cue}</h3>{said}</div>"

    made = []
    for k in range(pages):
        if k % 24 == 23:
            # Short pages: a few words, and nothing else or a menu.
            inner = rng.choice([f"+{words(1, 8)}", f"<p>+{words(1, 9)}</p>", f"<h1>+{words(1, 5)}</h1><p>+{words(1, 9)}</p>", f"<div><p>+{words(1, 9)}</p><p>+{words(1, 9)}</p></div>"])
            made.append(rng.choice(["", "", f"<nav>{bare(2)}</nav>"]) + inner + rng.choice(["", "", f"<footer>{words(1, 9)}</footer>"]))
            continue
        if k % 3 == 0:
            inner = article(True)
            if rng.random() < 0.5:
                inner += rng.choice([f"<aside>{aside()}</aside>", f"<nav>{bare(3)}</nav>", f"<form>{aside()}</form>", f"<div class='{rng.choice(['comments', 'share', 'ad', 'related', 'newsletter'])}'>{aside()}</div>"])
            tag = rng.choice(["article", "article", "main"])
            before = rng.choice([f"<nav>{bare(4)}</nav>", f"<header>{aside()}</header><nav>{bare(3)}</nav>", f"<nav>{bare(5)}</nav><div class='ad'>{aside()}</div>", f"<div>{aside()}</div>"])
            after = rng.choice([f"<footer>{aside()}</footer>", f"<aside>{aside()}</aside><footer>{words(1, 12)}</footer>", f"<p>{words(3, 40)}</p>"])
            middle = f"<{tag}>{inner}</{tag}>"
        elif k % 3 == 1:
            name = lambda names: f"<div {rng.choice(['id', 'class'])}='{rng.choice(names)}'>"
            before = name(["menu", "nav", "navbar", "header", "site-header", "cookie-notice"]) + rng.choice([aside(), bare(4)]) + "</div>"
            after = name(["footer", "comments", "sidebar", "related-posts", "share-bar", "newsletter"]) + rng.choice([aside(), bare(3)]) + "</div>"
            told = rng.random() < 0.6
            middle = name(["content", "post", "entry-content", "story"] if told else ["page", "col", "wrap"]) + article(told) + "</div>"
        else:
            before, after = bare(rng.randint(2, 6)), bare(rng.randint(2, 5)) + rng.choice(["", f"<p>{words(2, 6)}</p>"])
            middle = f"<div>{article(False)}</div>"
        after = remarks() + after if rng.random() < 0.2 else after
        # Some pages begin or end with the article.
        made.append((before if rng.random() < (0.7 if k % 3 else 0.5) else "") + middle + (after if rng.random() < 0.6 else ""))
    return [*WRITTEN, *made]


@functools.cache
def fitted() -> Tree:
    """The tree grown on the labelled pages."""
    rows, ys = [], []
    for page in labelled_pages():
        marked = blocks(page)
        ys += [b.text.startswith("+") for b in marked]
        for b in marked:
            b.text = b.text.removeprefix("+")
        rows.append(features(marked))
    return grow(np.concatenate(rows), np.array(ys))


def main_texts(pages: list[str | None], tree: Tree) -> list[str]:
    """The main text of each page; blocks of all pages are classified together."""
    cut = [blocks(p) for p in pages]
    rows = np.concatenate([features(b) for b in cut]) if cut else np.zeros((0, len(FEATURES)))
    keep = np.concatenate([tree.classify(rows[a : a + CLASSIFY_AT_ONCE]) for a in range(0, len(rows), CLASSIFY_AT_ONCE)]).tolist() if len(rows) else []
    out, at = [], 0
    for b in cut:
        out.append(" ".join(x.text for x, yes in zip(b, keep[at : at + len(b)]) if yes))
        at += len(b)
    return out


def extract(df: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Add ``text``, the main text, and ``n_chars``, its code points, to every page."""
    tree = fitted()

    def compute(pages: list[str | None]) -> dict[str, list]:
        texts = main_texts(pages, tree)
        return {"text": texts, "n_chars": [len(t) for t in texts]}

    return map_texts(df, html_col, compute, [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], keep)
