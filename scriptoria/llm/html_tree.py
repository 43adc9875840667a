"""Main-text extraction by a tree-structured graphical model over the DOM.

A page becomes a tree of its block elements, with a leaf for every run of text between block tags.
Each node is content or not. Unary potentials weigh the node's features (tag, words of class, id and
role, amount of text, links in it); pairwise potentials join each node to its parent, by the kind of
child. One upward and one downward sum-product pass over the levels of the tree give exact marginals;
leaves whose content marginal passes the threshold are the text. Weights maximise the conditional
likelihood of labelled pages, by gradient ascent on exact marginals. The labelled pages are TRAIN_PAGES
pages of a seeded generator in this module, so the model does not depend on the table it is used on.

Text: character references decoded, runs of white space inside a block made one space, trimmed, blocks
joined in page order by one line feed. <br> is white space.

Defined cases: null and empty pages, and pages without content, give the empty text; truncated pages and
unclosed or stray tags are read as far as they go; very long pages are whole; repeated rows give repeated
results; an empty table gives no rows; other columns are not read. Attribute values may have any length; a tag with a quote that is never
closed ends at the next '>'. Scanning is linear, whatever the nesting.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from scriptoria.llm.common import arrow_map

TRAIN_PAGES = 800
_TAG = re.compile(r"<(?:!--|(/?)([a-zA-Z][a-zA-Z0-9:-]*+)|[!?/])")
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_SKIPPED = frozenset("script style template noscript svg math head title iframe object select option button textarea canvas audio video".split())
_RAW = frozenset("script style textarea title noscript iframe".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What a start tag closes without an end tag: tag -> (tags it closes, tags at which the search ends).
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
#: Tags with a weight of their own; the others share one.
_TAGS = "html body article main section div p h1 h2 h3 h4 ul ol li table tr td nav header footer aside form fieldset blockquote pre figure figcaption dl address hr".split()
#: Beginnings of words in class, id and role that hint at a part of a page (fixed values).
_HINTS = {
    "menu": ("nav", "menu", "breadcrumb", "toolbar", "tabs", "topbar"), "header": ("header", "masthead", "banner", "branding", "logo", "tagline"), "footer": ("footer", "copyright", "colophon", "legal", "contentinfo", "bottom"),
    "side": ("side", "aside", "widget", "rail", "complementary", "blogroll"), "advert": ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promoted", "promotion", "banner-ad", "adsense"),
    "comment": ("comment", "comments", "reply", "replies", "respond", "responses", "discussion", "disqus", "thread"), "notice": ("cookie", "notice", "consent", "alert", "popup", "modal", "gdpr", "privacy", "newsletter", "subscribe", "signup", "paywall"),
    "share": ("share", "social", "follow", "related", "recommend", "more", "tags", "trending", "popular", "teaser", "pagination", "pager"), "content": ("content", "article", "post", "entry", "story", "main", "text", "prose", "body"),
}
_EXACT = frozenset(("ad", "ads", "more", "tags", "main", "side", "text", "body", "post"))
_GROUPS = list(_HINTS)
#: Where a node stands: nothing said, in an article, in a part hinted as content, in a part that is not content (it stays so below).
_PLAIN, _ARTICLE, _HINTED, _APART = range(4)
_ZONE = len(_TAGS) + 1 + len(_GROUPS) + 1  # first feature of zones, of elements and then of leaves
_LEAF = _ZONE + 8  # first feature of leaves
FEATURES = _LEAF + 14
_KINDS = 3  # edges to leaves, to plain children, to children with a hint or a landmark tag
_LANDMARK = frozenset("nav header footer aside form article main".split())
_CONTENT = _GROUPS.index("content")
_TAG_PLACE = {t: k for k, t in enumerate(_TAGS)}


def _hints(attributes: str) -> list[int]:
    """Hint groups of class, id and role, and len(_GROUPS) for hidden elements."""
    out: set[int] = set()
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "style":
            if "display:none" in value.replace(" ", ""):
                out.add(len(_GROUPS))
        elif name in ("hidden", "aria-hidden"):
            if value != "false":
                out.add(len(_GROUPS))
        else:
            words = re.findall("[a-z]+", value)
            for k, g in enumerate(_GROUPS):
                if any(w == h if h in _EXACT else w.startswith(h) for w in words for h in _HINTS[g]):
                    out.add(k)
    return sorted(out)


def _tag_end(source: str, at: int, dead: set[int]) -> int:
    """Place of the '>' that ends the tag whose attributes begin at `at`, or -1.

    `dead` keeps, for one page, the opening quotes after which no tag ends, so that none is followed twice.
    """
    passed = []
    while (m := _STOP.search(source, at)) and m[0] != ">":
        passed.append(m.start())
        close = -1 if m.start() in dead else source.find(m[0], m.end())
        if close < 0:
            m = None
            break
        at = close + 1
    if m is None:
        dead.update(passed)
        return -1
    return m.start()


class Forest:
    """Trees of many pages: parents before children; leaves hold text."""

    def __init__(self):
        self.parent, self.depth, self.kind, self.page, self.text = [], [], [], [], []
        self.rows, self.columns = [], []
        self.labels: list[int] = []
        self.zone: list[int] = []
        self._known: dict[str, tuple[int, list[int]]] = {}

    def _node(self, parent: int, kind: int, page: int, text: str | None, features: list[int]) -> int:
        n = len(self.parent)
        self.parent.append(parent)
        self.depth.append(0 if parent < 0 else self.depth[parent] + 1)
        self.kind.append(kind)
        self.page.append(page)
        self.text.append(text)
        self.zone.append(_PLAIN)
        self.rows += [n] * len(features)
        self.columns += features
        return n

    def _element(self, tag: str, attributes: str, parent: int, page: int) -> int:
        above = self.zone[parent]
        key = f"{above}{tag} {attributes}"
        zone, features = self._known.get(key, (0, None))
        if features is None:
            hints = _hints(attributes) if attributes else []
            if above == _APART or tag in ("nav", "header", "footer", "aside", "form") or any(k != _CONTENT for k in hints):
                zone = _APART
            else:
                zone = _ARTICLE if tag in ("article", "main") else _HINTED if hints and tag != "body" else above
            features = [_TAG_PLACE.get(tag, len(_TAGS)), *(len(_TAGS) + 1 + k for k in hints), _ZONE + zone]
            if len(self._known) < 20_000 and len(key) <= 4096:
                self._known[key] = zone, features
        node = self._node(parent, 2 if len(features) > 2 or tag in _LANDMARK else 1, page, None, features)
        self.zone[node] = zone
        return node

    def _leaf(self, pieces: list[str], linked: int, parent: int, tag: str, page: int) -> None:
        text = " ".join(html.unescape("".join(pieces)).split())
        if not text:
            return
        size = len(text)
        share = linked / max(size, 1)
        features = [_ZONE + 4 + self.zone[parent], _LEAF, _LEAF + 1 + min(4, size.bit_length() // 2 - 1 if size > 3 else 0)]
        features.append(_LEAF + 6 + (0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.8 else 3))
        if text[-1] in ".!?\"»”…":
            features.append(_LEAF + 10)
        if "©" in text:
            features.append(_LEAF + 11)
        if tag in ("li", "td"):
            features.append(_LEAF + 12)
        if tag in ("p", "blockquote", "pre") or tag in ("h1", "h2", "h3", "h4"):
            features.append(_LEAF + 13)
        self._node(parent, 0, page, text, features)

    def add(self, source: str, page: int, label=None) -> None:
        """Parse a page. `label(tag, attributes, parent's label)` labels elements in training; leaves follow their parent."""
        stack: list[tuple[str, int]] = [("", self._node(-1, 1, page, None, [len(_TAGS)]))]
        if label:
            self.labels.append(0)
        open_at: defaultdict[str, list[int]] = defaultdict(list)  # places in the stack of each open tag
        skipped: list[str] = []
        inside: Counter[str] = Counter()  # how often each tag is in `skipped`
        pieces: list[str] = []
        dead: set[int] = set()
        linked, anchors, at, n = 0, 0, 0, len(source)

        def shorten(length: int) -> None:
            while len(stack) > length:
                open_at[stack.pop()[0]].pop()

        def nearest_open(tags: set[str]) -> int:
            return max((open_at[t][-1] for t in tags if open_at[t]), default=-1)

        def flush() -> None:
            nonlocal linked
            if pieces:
                before = len(self.parent)
                self._leaf(pieces, linked, stack[-1][1], stack[-1][0], page)
                if label and len(self.parent) > before:
                    self.labels.append(self.labels[stack[-1][1]])
                pieces.clear()
            linked = 0

        while at < n:
            open_ = source.find("<", at)
            if open_ < 0:
                open_ = n
            if open_ > at and not skipped:
                pieces.append(source[at:open_])
                if anchors:
                    linked += open_ - at
            if open_ == n:
                break
            m = _TAG.match(source, open_)
            if m is None:
                if not skipped:
                    pieces.append("&lt;")
                at = open_ + 1
                continue
            if m[2] is None:
                end = source.find("-->", open_ + 4) + 2 if m[0] == "<!--" else source.find(">", open_ + 1)
                if end < 2:
                    break
                at = end + 1
                continue
            end = _tag_end(source, m.end(), dead)
            if end < 0:  # a quote without its end, or cut off inside a tag
                end = source.find(">", open_)
                if end < 0:
                    break
                at = end + 1
                continue
            closing, tag, attributes, at = m[1], m[2].lower(), source[m.end() : end], end + 1
            if tag in _SKIPPED or skipped:
                if closing:
                    while inside[tag]:
                        inside[last := skipped.pop()] -= 1
                        if last == tag:
                            break
                elif tag in _RAW:
                    m = re.compile(f"</{tag}\\b[^>]*>", re.I).search(source, at)
                    if m is None:
                        break
                    at = m.end()
                    if not skipped:
                        pieces.append(" ")
                elif tag in _SKIPPED and not attributes.rstrip().endswith("/"):
                    skipped.append(tag)
                    inside[tag] += 1
                elif closing == "" and tag == "body":
                    skipped.clear()
                    inside.clear()
                if tag != "body" or closing or skipped:
                    continue
            if tag in _INLINE:
                if tag == "a":
                    anchors = max(0, anchors + (-1 if closing else 1))
                elif tag in ("br", "input"):
                    pieces.append(" ")
                continue
            flush()
            anchors = 0
            if closing:
                if open_at[tag]:
                    shorten(open_at[tag][-1])
                continue
            if any(t == "p" for t, _ in stack[-3:]):
                while any(t == "p" for t, _ in stack[-3:]):
                    shorten(len(stack) - 1)
            elif tag in _CLOSES:
                closes, ends = _CLOSES[tag]
                if (at_ := nearest_open(closes)) > nearest_open(ends):
                    shorten(at_)
            if tag in ("html", "body") and open_at[tag]:
                continue
            node = self._element(tag, attributes, stack[-1][1], page)
            if label:
                self.labels.append(label(tag, attributes, self.labels[stack[-1][1]]))
            if tag not in _VOID and not (attributes.endswith("/") and tag == "hr"):
                open_at[tag].append(len(stack))
                stack.append((tag, node))
        flush()

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return tuple(np.array(x, np.int64) for x in (self.parent, self.depth, self.kind, self.rows, self.columns))


class Model:
    """Unary weights of the features, and for each kind of edge a table over (parent, child)."""

    def __init__(self, unary: np.ndarray, edge: np.ndarray):
        self.unary, self.edge = unary, edge

    def marginals(self, parent, depth, kind, rows, columns) -> tuple[np.ndarray, np.ndarray]:
        """P(content) of every node, and for each node P(parent, node) as (n, 2, 2)."""
        n = len(parent)
        local = np.zeros((n, 2))
        local[:, 1] = np.bincount(rows, self.unary[columns], n)
        by_depth = np.argsort(depth, kind="stable")
        levels = np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1)
        up, below = np.zeros((n, 2)), local.copy()  # message to the parent; local and messages from the children
        for at in reversed(levels[1:]):
            m = np.logaddexp(self.edge[kind[at], :, 0] + below[at, 0, None], self.edge[kind[at], :, 1] + below[at, 1, None])
            up[at] = m - m.max(axis=1, keepdims=True)
            np.add.at(below, parent[at], up[at])
        belief, pair = below.copy(), np.zeros((n, 2, 2))
        for at in levels[1:]:
            outside = belief[parent[at]] - up[at]  # all the parent knows but from this child
            joint = outside[:, :, None] + self.edge[kind[at]] + below[at, None, :]
            joint -= joint.max(axis=(1, 2), keepdims=True)
            p = np.exp(joint)
            pair[at] = p / p.sum(axis=(1, 2), keepdims=True)
            belief[at] = np.log(np.maximum(pair[at].sum(axis=1), 1e-300))
        top = belief - belief.max(axis=1, keepdims=True)
        p = np.exp(top)
        return p[:, 1] / p.sum(axis=1), pair


def fit(forest: Forest, rounds: int = 250, rate: float = 0.08, penalty: float = 1e-3) -> Model:
    """Gradient ascent (Adam) on the conditional log-likelihood of the forest's labels."""
    parent, depth, kind, rows, columns = forest.arrays()
    y = np.array(forest.labels, np.int64)
    n = len(y)
    model = Model(np.zeros(FEATURES), np.zeros((_KINDS, 2, 2)))
    inner = np.flatnonzero(parent >= 0)
    truth_unary = np.bincount(columns, y[rows], FEATURES)
    truth_edge = np.zeros((_KINDS, 2, 2))
    np.add.at(truth_edge, (kind[inner], y[parent[inner]], y[inner]), 1)
    state = [[np.zeros_like(w), np.zeros_like(w)] for w in (model.unary, model.edge)]
    for step in range(1, rounds + 1):
        p, pair = model.marginals(parent, depth, kind, rows, columns)
        expected = np.zeros((_KINDS, 2, 2))
        np.add.at(expected, kind[inner], pair[inner])
        gradients = ((truth_unary - np.bincount(columns, p[rows], FEATURES)) / n - penalty * model.unary, (truth_edge - expected) / n - penalty * model.edge)
        for w, g, s in zip((model.unary, model.edge), gradients, state, strict=True):
            s[0] = 0.9 * s[0] + 0.1 * g
            s[1] = 0.99 * s[1] + 0.01 * g * g
            w += rate * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.99**step)) + 1e-8)
    return model


# ---------------------------------------------------------------- labelled pages


def labelled_page(rng: random.Random) -> str:
    """A made-up page; elements that begin or end the content carry data-c="1" or "0"."""
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9)))
    words = lambda lo, hi: " ".join(word() for _ in range(rng.randint(lo, hi)))
    prose = lambda lo, hi: ". ".join(words(3, 14).capitalize() for _ in range(rng.randint(lo, hi))) + "."
    links = lambda lo, hi: "".join(f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(rng.randint(lo, hi)))
    pick = rng.choice

    def boxed(tags: tuple, names: tuple, body: str, landmark: str = "") -> str:
        if landmark and rng.random() < 0.5:
            named = f' class="{pick(names)}"' if rng.random() < 0.3 else ""
            return f'<{landmark}{named} data-c="0">{body}</{landmark}>'
        tag = pick(tags)
        return f'<{tag} {pick(("class", "class", "id"))}="{pick(names)}" data-c="0">{body}</{tag}>'

    menu = lambda: boxed(("div", "ul"), ("nav", "menu", "main-menu", "navbar", "breadcrumbs", "topbar"), f"<ul>{links(2, 9)}</ul>" if rng.random() < 0.8 else words(2, 8), "nav")
    header = lambda: boxed(("div",), ("header", "site-header", "masthead", "banner", "page-header"), pick((f"<h1>{words(1, 4)}</h1>", f"<p>{words(2, 8)}</p>", f"<a href='/'>{word()}</a><p>{prose(1, 1)}</p>")), "header")
    footer = lambda: boxed(("div",), ("footer", "site-footer", "bottom", "legal", "colophon"), pick((f"&copy; {word()}.example {prose(1, 2)}", f"<p>{prose(1, 2)}</p>", f"<p>&copy; {words(2, 6)}</p><ul>{links(1, 5)}</ul>")), "footer")
    side = lambda: boxed(("div",), ("sidebar", "side", "widget", "right-rail", "sidebar-left"), f"<h3>{words(1, 3)}</h3>" + pick((f"<ul>{links(2, 6)}</ul>", f"<p>{prose(1, 3)}</p>")), "aside")
    advert = lambda: boxed(("div", "p", "section"), ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "ad banner"), pick((prose(1, 3), f"<p>{prose(1, 2)}</p>", f'<a href="http://{word()}.example">{words(2, 8)}</a>')))
    notice = lambda: boxed(("div", "section"), ("cookie-notice", "notice", "consent", "alert", "newsletter", "subscribe-box", "gdpr", "popup"), pick((f"<p>{prose(1, 3)}</p>", prose(1, 2))))
    form = lambda: f'<form action="/{word()}" data-c="0"><label>{words(1, 4)}</label><input name="q"><p>{words(2, 8)}</p><button>{word()}</button></form>'
    share = lambda: boxed(("div", "ul"), ("share", "social", "related", "related-posts", "tags", "recommended"), f"<ul>{links(2, 5)}</ul>" if rng.random() < 0.6 else f"<h3>{words(1, 3)}</h3><p>{prose(1, 1)}</p>")

    def remarks() -> str:
        one = lambda: pick((f'<div class="comment"><p>{prose(1, 4)}</p></div>', f"<li><b>{word()}</b><p>{prose(1, 3)}</p></li>", f"<p>{prose(1, 3)}</p>", f"<article><p>{prose(1, 3)}</p></article>"))
        return boxed(("div", "section", "ol"), ("comments", "comment-list", "discussion", "responses", "replies"), f"<h2>{words(1, 2)}</h2>" * (rng.random() < 0.6) + "".join(one() for _ in range(rng.randint(1, 6))))

    def block() -> str:
        x = rng.random()
        if x < 0.62:
            return f"<p>{pick(('', '', '<b>'))}{prose(1, 7)}{pick(('</p>', '</p>', '</p>', '<br>', ''))}"
        if x < 0.70:
            return f"<p>{words(1, 4)}.</p>"
        if x < 0.78:
            return f"<h2>{words(1, 6)}</h2>"
        if x < 0.85:
            return f"<{(t := pick(('ul', 'ol')))}>" + "".join(f"<li>{words(2, 12)}</li>" for _ in range(rng.randint(2, 5))) + f"</{t}>"
        if x < 0.90:
            return f"<blockquote><p>{prose(1, 3)}</p></blockquote>"
        if x < 0.94:
            return f'<p>{words(3, 9)} <a href="/{word()}">{words(1, 5)}</a> {prose(1, 2)}</p>'
        if x < 0.97:
            return f"<pre>{words(4, 20)}</pre>"
        return f"<table><tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr></table>"

    bare = rng.random() < 0.12  # content without an element of its own
    inside = [block() for _ in range(pick((1, 1, 2, 3, rng.randint(3, 14))))]
    if rng.random() < 0.85:
        inside.insert(0, f"<h1>{words(1, 10)}{pick(('', '.'))}</h1>")
    if bare:
        inside = [re.sub(r"^<([a-z0-9]+)", r'<\1 data-c="1"', b) for b in inside]
    for extra, chance in ((advert, 0.3), (share, 0.2), (side, 0.1), (form, 0.1), (notice, 0.1)):
        if rng.random() < chance:
            inside.insert(rng.randint(1, len(inside)), extra())
    if rng.random() < 0.15:
        inside.append(remarks())
    tag, names = pick((("article", ""), ("article", ""), ("article", ' class="post"'), ("main", ""), ("div", ' class="content"'), ("div", ' class="article-body"'), ("div", ' id="post-content"'), ("section", ' class="entry"'), ("div", ' class="story-text"')))
    content = f'<{tag}{names} data-c="1">{"".join(inside)}</{tag}>'
    if bare:
        content = "".join(inside)
    elif rng.random() < 0.25:
        content = f"<{(t := pick(('main', 'div')))}>{content}</{t}>"
    before = [f() for f, chance in ((menu, 0.8), (header, 0.5), (advert, 0.4), (notice, 0.3), (form, 0.15), (side, 0.2)) if rng.random() < chance]
    after = [f() for f, chance in ((remarks, 0.35), (share, 0.3), (side, 0.3), (advert, 0.25), (form, 0.15), (notice, 0.15), (footer, 0.85)) if rng.random() < chance]
    if rng.random() < 0.4:
        rng.shuffle(before)
    return f'<!DOCTYPE html><html lang="xx"><head><title>{words(2, 8)}</title><script>var t="</p>";</script></head><body>{"".join(before)}{content}{"".join(after)}' + pick(("</body></html>", ""))


_MARK = re.compile('data-c="([01])"')


def _label(tag: str, attributes: str, above: int) -> int:
    m = _MARK.search(attributes)
    return int(m[1]) if m else above


def labelled_forest(pages: int, seed: int) -> Forest:
    rng, forest = random.Random(seed), Forest()
    for k in range(pages):
        forest.add(labelled_page(rng), k, _label)
    return forest


@lru_cache(maxsize=2)
def trained(pages: int = TRAIN_PAGES, seed: int = 3) -> Model:
    return fit(labelled_forest(pages, seed))


# ---------------------------------------------------------------- extraction


def extract(sources: list[str | None], model: Model, threshold: float = 0.5) -> list[str]:
    """The main text of each page."""
    out: list[list[str]] = [[] for _ in sources]
    at = 0
    while at < len(sources):
        forest, chars = Forest(), 0
        while at < len(sources) and chars < 1_000_000:
            if sources[at]:
                forest.add(sources[at], at)
                chars += len(sources[at])
            at += 1
        if forest.parent:
            p, _ = model.marginals(*forest.arrays())
            for k, text in enumerate(forest.text):
                if text is not None and p[k] > threshold:
                    out[forest.page[k]].append(text)
    return ["\n".join(blocks) for blocks in out]


def main_text(df: DataFrame, key: str = "page_id", source: str = "html", carry: tuple[str, ...] = ("url",)) -> DataFrame:
    """key, the carried string columns, text and n_chars of every row."""
    shared = df.sparkSession.sparkContext.broadcast(trained())

    def each(part):
        texts = extract(part.column(source).to_pylist(), shared.value)
        return {key: part.column(key)} | {c: part.column(c) for c in carry} | {"text": texts, "n_chars": [len(t) for t in texts]}

    return arrow_map(df.select(key, *carry, source), each, ",".join([f"{key} long", *(f"{c} string" for c in carry), "text string", "n_chars long"]))
