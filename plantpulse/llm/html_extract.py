"""Main text of web pages: boosted trees over DOM nodes, decoded from the root so that no choice contradicts an ancestor's.

Nodes are block elements and inline elements with a class, id or role. Features of a node are its tag, its attribute tokens, depth,
the density of text and links in its subtree, its siblings and what stands above it. The trees give each node the log-odds of holding
main text; decoding picks the labelling of highest total in which every node of main text has a parent of main text. A block's text
is what its kept nodes hold.

The trees are fitted on a bounded sample of pages (``SAMPLE_PAGES`` with the smallest hash of the id). Their labels come from markup
that says what it is (``article``, ``nav`` and the like), and from pages rebuilt around the same text with other markup: wrappers known
by their class only, side bars, notices, forms, reader comments.

Defined results: null, empty and text-free html give an empty text; broken or cut-off markup is read as far as it goes; html without any
markup is one block. Repeated rows give equal results; an empty table gives no rows. Scripts, styles, templates and the head hold no
text. All white space counts, including no-break spaces. A line break is white space.
"""

from __future__ import annotations

import random
import re
from html import escape
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting
from .common import with_computed

SAMPLE_PAGES = 240
#: pages rebuilt from each sampled page
REBUILT = 4

# Elements by kind, from the HTML standard.
BLOCKS = frozenset((
    "html", "body", "address", "article", "aside", "blockquote", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "legend", "li", "main",
    "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead",
    "tr", "ul", "head", "title", "script", "style", "template", "noscript", "iframe", "svg", "select", "textarea", "button", "canvas", "object",
))
SILENT = frozenset(("head", "title", "script", "style", "template", "noscript", "iframe", "svg", "select", "textarea", "button", "canvas", "object"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
CLOSED_BY_SELF = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

#: tags and attribute tokens that are features
TAGS = ("p", "div", "li", "ul", "ol", "a", "span", "nav", "header", "footer", "aside", "article", "main", "section", "form", "h1", "h2", "h3", "h4",
        "table", "td", "tr", "blockquote", "pre", "figure", "figcaption", "dl", "dd", "body", "html", "menu", "dialog", "search")
TOKENS = (
    "nav", "navbar", "navigation", "menu", "header", "masthead", "top", "footer", "bottom", "sidebar", "aside", "side", "widget", "ad", "ads", "adv", "advert",
    "advertisement", "sponsor", "sponsored", "promo", "banner", "cookie", "cookies", "consent", "notice", "alert", "popup", "modal", "overlay", "newsletter",
    "subscribe", "signup", "login", "form", "search", "share", "social", "related", "recommended", "comment", "comments", "reply", "replies",
    "discussion", "respond", "breadcrumb", "breadcrumbs", "pagination", "pager", "toolbar", "copyright", "legal", "disclaimer", "skip", "contentinfo",
    "article", "content", "main", "post", "entry", "body", "story", "text", "prose", "page", "title", "headline",
)
_TAG_AT, _TOKEN_AT = {t: i for i, t in enumerate(TAGS)}, {t: i for i, t in enumerate(TOKENS)}
_LETTERS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_NUMBERS = 16
N_FEATURES = len(TAGS) + len(TOKENS) + _NUMBERS
#: what tags and tokens by themselves speak for
_OUTSIDE_TAGS = frozenset(("nav", "header", "footer", "aside", "form", "menu", "dialog", "search"))
_OUTSIDE_TOKENS = frozenset(TOKENS[:TOKENS.index("article")]) - {"top", "bottom", "side", "form", "header"}
_MAIN_TAGS = frozenset(("article", "main"))
_MAIN_TOKENS = frozenset(TOKENS[TOKENS.index("article"):])
#: mark of the label in rebuilt pages; never a feature
_LABEL = "data-main"


class Dom(HTMLParser):
    """Nodes in document order, and the text segments between block borders."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.tokens, self.silent, self.label = ["html"], [-1], [()], [False], [None]
        self.stack, self.names = [0], ["html"]
        self.segments: list[tuple[int, str] | None] = []
        self.anchors = 0
        self.linked: list[bool] = []
        self.feed(html)
        self.close()

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """A marked section is a comment that ends with the next ``>``, as in HTML; the parser's own rule may raise."""
        return self.parse_bogus_comment(i)

    def _open(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        above = self.stack[-1]
        words = [w.lower() for name, value in attributes if value and name in ("class", "id", "role") for w in _LETTERS.findall(value)]
        mark = next((value for name, value in attributes if name == _LABEL), None)
        self.tag.append(tag)
        self.parent.append(above)
        self.tokens.append(tuple(words))
        self.silent.append(self.silent[above] or tag in SILENT)
        self.label.append(self.label[above] if mark is None else mark == "1")
        if tag not in VOID:
            self.stack.append(len(self.tag) - 1)
            self.names.append(tag)

    def _close_to(self, depth: int) -> None:
        del self.stack[depth:], self.names[depth:]

    def _shut(self, tag: str, barriers: tuple[str, ...]) -> None:
        for depth in range(len(self.names) - 1, 0, -1):
            if self.names[depth] == tag:
                return self._close_to(depth)
            if self.names[depth] in barriers:
                return None
        return None

    def handle_starttag(self, tag, attrs):
        if tag == "html":
            return
        if tag in BLOCKS:
            if tag == "body":
                self._close_to(1)
            elif tag in CLOSED_BY_SELF:
                self._shut(tag, CLOSED_BY_SELF[tag])
            else:
                self._shut("p", ("td", "th", "li", "blockquote", "button", "table"))
            self.segments.append(None)
            self._open(tag, attrs)
        elif tag == "br":
            self.segments.append((self.stack[-1], " "))
            self.linked.append(False)
        else:
            self.anchors += tag == "a"
            if tag not in VOID and any(name in ("class", "id", "role", _LABEL) for name, _ in attrs):
                self._open(tag, attrs)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in BLOCKS and tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag == "a":
            self.anchors = max(0, self.anchors - 1)
        if tag in BLOCKS:
            self.segments.append(None)
        if tag != "html" and tag in self.names:
            self._close_to(len(self.names) - 1 - self.names[::-1].index(tag))

    def handle_data(self, data):
        if not self.silent[self.stack[-1]]:
            self.segments.append((self.stack[-1], data))
            self.linked.append(self.anchors > 0)


def node_features(dom: Dom) -> np.ndarray:
    """One row per node: its tag and tokens, and numbers of its subtree, its siblings and what stands above it."""
    n = len(dom.tag)
    out = np.zeros((n, N_FEATURES), dtype=np.float32)
    parent = dom.parent
    own, links, stops, blocks, before = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    seen, anchored = 0, iter(dom.linked)
    first = [None] * n
    for segment in dom.segments:
        if segment is not None:
            node, text = segment
            size = len(text) - text.count(" ") if text.isspace() else len(text)
            if first[node] is None:
                first[node] = seen
            own[node] += size
            seen += size
            stops[node] += text.count(".") + text.count(",")
            if next(anchored):
                links[node] += size
    whole, below_links, below_stops, children, kinds = own[:], links[:], stops[:], [0] * n, [{} for _ in range(n)]
    place = [0] * n
    for i in range(1, n):
        up = parent[i]
        place[i] = children[up]
        children[up] += 1
        kinds[up][dom.tag[i]] = kinds[up].get(dom.tag[i], 0) + 1
    for i in range(n - 1, 0, -1):
        up = parent[i]
        whole[up] += whole[i]
        below_links[up] += below_links[i]
        below_stops[up] += below_stops[i]
        blocks[up] += blocks[i] + 1
        if first[i] is not None and (first[up] is None or first[i] < first[up]):
            first[up] = first[i]
    depth, total = [0] * n, max(1, whole[0])
    tokens_at, numbers = len(TAGS), out[:, -_NUMBERS:]
    says, nearest = [0] * n, [0] * n  # -1: outside, 1: main text; of the node, and of the nearest node above that says anything
    for i in range(n):
        up = parent[i]
        if (t := _TAG_AT.get(dom.tag[i])) is not None:
            out[i, t] = 1
        for word in dom.tokens[i]:
            if (t := _TOKEN_AT.get(word)) is not None:
                out[i, tokens_at + t] = 1
        words = set(dom.tokens[i])
        if dom.tag[i] in _OUTSIDE_TAGS or not _OUTSIDE_TOKENS.isdisjoint(words):
            says[i] = -1
        elif dom.tag[i] in _MAIN_TAGS or not _MAIN_TOKENS.isdisjoint(words):
            says[i] = 1
        if up >= 0:
            depth[i] = depth[up] + 1
            nearest[i] = says[up] or nearest[up]
        size = max(1, whole[i])
        siblings = children[up] if up >= 0 else 1
        numbers[i] = (
            depth[i], np.log1p(whole[i]), np.log1p(own[i]), below_links[i] / size, below_stops[i] / size, whole[i] / total,
            (first[i] if first[i] is not None else before[i]) / total, np.log1p(blocks[i]), whole[i] / (1 + blocks[i]), place[i], siblings,
            kinds[up].get(dom.tag[i], 0) / siblings if up >= 0 else 1, children[i],
            says[i], nearest[i],
            whole[i] / max(1, whole[up]) if up >= 0 else 1)
    return out


def decode(parent: list[int], odds: np.ndarray) -> list[bool]:
    """The labelling of highest total odds in which a kept node has a kept parent."""
    n = len(parent)
    keep, drop = odds.tolist(), (-odds).tolist()
    for i in range(n - 1, 0, -1):
        keep[parent[i]] += max(keep[i], drop[i])
        drop[parent[i]] += drop[i]
    kept = [False] * n
    for i in range(n):
        kept[i] = keep[i] > drop[i] and (i == 0 or kept[parent[i]])
    return kept


def block_texts(dom: Dom, kept: list[bool]) -> str:
    """The text of the kept nodes: one line per block, white space collapsed."""
    lines, held = [], []
    for segment in [*dom.segments, None]:
        if segment is not None:
            if kept[segment[0]]:
                held.append(segment[1])
        elif held:
            if line := " ".join("".join(held).split()):
                lines.append(line)
            held = []
    return "\n".join(lines)


# -- training pages ---------------------------------------------------------------------------------------------------

def own_labels(dom: Dom) -> list[bool] | None:
    """Labels that a page's own markup states, or None for a page without an article or main element."""
    if not {"article", "main"} & set(dom.tag):
        return None
    inside, barred = [False] * len(dom.tag), [False] * len(dom.tag)
    for i in range(1, len(dom.tag)):
        up = dom.parent[i]
        barred[i] = barred[up] or dom.tag[i] in _OUTSIDE_TAGS or bool(_OUTSIDE_TOKENS & set(dom.tokens[i])) or dom.silent[i]
        inside[i] = inside[up] or dom.tag[i] in _MAIN_TAGS
    return _with_ancestors(dom, [a and not b for a, b in zip(inside, barred)])


def _with_ancestors(dom: Dom, label: list[bool]) -> list[bool]:
    out = list(label)
    for i in range(len(out) - 1, 0, -1):
        out[dom.parent[i]] |= out[i]
    return out


_WRAPPERS = ("<article>", "<main>", '<div class="content">', '<div id="main-content">', '<section class="post-body">', '<div class="entry">', "<div>",
             '<div class="story text">', '<article class="post">', '<main><article>', '<div id="page"><div class="article-body">', '<td class="content">',
             '<div role="main">', '<section>')
_ASIDES = ("<nav>", '<div class="menu">', '<ul class="nav">', '<div id="navbar">', '<div class="breadcrumbs">', '<div role="navigation">', '<div class="pagination">')
_NOTES = ("<header>", '<div id="header">', "<footer>", '<div class="footer">', '<div id="footer" role="contentinfo">', "<aside>", '<div class="sidebar">', '<aside class="widget">',
          '<div class="ad">', '<div class="advert banner">', '<div class="sponsored">', '<div class="cookie-notice">', '<div role="alert">', '<div class="notice">',
          '<div class="popup">', '<div class="newsletter">', '<div class="share social">', '<div class="related">', '<div class="copyright">',
          '<div class="promo">', '<section class="recommended">', '<div class="modal overlay">', '<p class="disclaimer">', '<span class="ad">')
_REPLIES = ('<section class="comments">', '<div id="comments">', '<div class="discussion">', '<ol class="comment-list">', '<div class="replies">', '<div class="comment">')


def _shut(opened: str) -> str:
    return "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", opened)))


def rebuilt_page(paragraphs: list[str], foreign: list[str], rng: random.Random) -> str:
    """A page with the given main text in random markup, among texts of other pages that are not main text."""
    def marked(opened: str, inner: str, main: str) -> str:
        return re.sub(r"<(\w+)", rf'<\1 {_LABEL}="{main}"', opened, count=1) + inner + _shut(opened)

    def words(most: int) -> str:
        found = rng.choice(foreign).split()
        at = rng.randrange(max(1, len(found)))
        return escape(" ".join(found[at:at + rng.randrange(1, most)]))

    def outside() -> str:
        kind = rng.random()
        if kind < 0.3:
            return marked(rng.choice(_ASIDES), "<ul>" * (k := rng.randrange(2)) + "".join(f'<li><a href="#">{words(4)}</a></li>' for _ in range(rng.randrange(1, 9))) + "</ul>" * k, "0")
        if kind < 0.75:
            inner = rng.choice((words(30), f"<p>{words(60)}</p>", f"<h3>{words(5)}</h3><ul><li><a href='#'>{words(8)}</a></li><li><a href='#'>{words(8)}</a></li></ul>", f"&copy; {words(20)}"))
            return marked(rng.choice(_NOTES), inner, "0")
        if kind < 0.85:
            return marked("<form>", f"<label>{words(4)}</label><input><p>{words(15)}</p><button>{words(3)}</button>", "0")
        return marked(rng.choice(_REPLIES), "".join(f'<div class="comment"><b>{words(3)}</b><p>{escape(rng.choice(foreign))}</p></div>' if rng.random() < 0.5
                                                    else f"<p>{escape(rng.choice(foreign))}</p>" for _ in range(rng.randrange(1, 6))), "0")

    parts = []
    for k, text in enumerate(paragraphs):
        text = escape(text)
        tag = rng.choices(("p", "div", "li", "blockquote", "h2"), (20, 2, 1, 1, 1))[0] if k else rng.choice(("h1", "h2", "p", "header"))
        body = f"<ul><li>{text}</li></ul>" if tag == "li" else f"<header><h1>{text}</h1></header>" if tag == "header" else f"<{tag}>{text}</{tag}>"
        if k and rng.random() < 0.15:
            body = f"<p><b>{text}<br>"
        parts.append(body)
        if rng.random() < 0.06:
            parts.append(outside())
    wrapper = rng.choice(_WRAPPERS)
    if "<td" in wrapper:
        wrapper = f"<table><tr>{wrapper}"
    before, after = ("".join(outside() for _ in range(rng.randrange(4))) for _ in range(2))
    tail = outside() if rng.random() < 0.2 else ""
    return f"<html><head><title>{words(5)}</title></head><body>{before}{marked(wrapper, ''.join(parts) + tail, '1')}{after}</body></html>"


def training_rows(pages: list[str], seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the nodes of the sampled pages and of the pages rebuilt around their texts."""
    rng = random.Random(seed)
    doms = [Dom(page) for page in pages]
    x, y, texts = [], [], []
    for dom in doms:
        if (labels := own_labels(dom)) is not None:
            x.append(node_features(dom))
            y.append(labels)
            if found := [line for line in block_texts(dom, labels).split("\n") if line]:
                texts.append(found)
    texts = texts or [["The quick brown fox jumps over the lazy dog, again and again.", "It does so every day."]]
    foreign = [line for found in texts for line in found]
    for found in texts:
        for bare in (escape(found[-1]), "".join(f"<p>{escape(line)}" for line in found)):  # pages that are nothing but main text
            dom = Dom(bare)
            x.append(node_features(dom))
            y.append([True] * len(dom.tag))
        for _ in range(REBUILT):
            taken = found[:rng.randrange(1, len(found) + 1)] if rng.random() < 0.5 else found
            dom = Dom(rebuilt_page(taken, foreign, rng))
            x.append(node_features(dom))
            y.append(_with_ancestors(dom, [bool(v) and not s for v, s in zip(dom.label, dom.silent)]))
    return np.concatenate(x), np.concatenate([np.array(v, dtype=float) for v in y])


def fit(pages: DataFrame, id_column: str = "page_id", html_column: str = "html", sample: int = SAMPLE_PAGES) -> boosting.BoostedTrees:
    """The trees, fitted on the ``sample`` pages with the smallest hash of their id."""
    ids = pages.select(F.col(id_column).alias("page_id")).filter("page_id IS NOT NULL").distinct()
    chosen = ids.withColumn("_order", F.xxhash64("page_id")).orderBy("_order", "page_id").limit(sample)
    found = pages.select(F.col(id_column).alias("page_id"), F.col(html_column).alias("html")).join(F.broadcast(chosen), "page_id")
    taken = found.filter("html IS NOT NULL").orderBy("_order", "page_id", "html").limit(sample).collect()
    return boosting.fit(*training_rows([row["html"] for row in taken]))


def extracted(pages: DataFrame, model: boosting.BoostedTrees, html_column: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``pages`` with text and n_chars (code points)."""
    def make():
        def compute(part):
            doms = [Dom(html or "") for html in part.column(html_column).to_pylist()]
            odds = np.clip(model.logits(np.concatenate([node_features(dom) for dom in doms])), -8, 8)
            texts, at = [], 0
            for dom in doms:
                texts.append(block_texts(dom, decode(dom.parent, odds[at:at + len(dom.tag)])))
                at += len(dom.tag)
            return {"text": texts, "n_chars": [len(t) for t in texts]}

        return compute

    return with_computed(pages, "text string, n_chars long", make, rows=64, keep=keep)
