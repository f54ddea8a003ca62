"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks of text. A classifier gives each block the cost of calling it content
and the cost of calling it boilerplate: a logistic regression over the block's text and place in
the tree (length, link share, punctuation, what its container holds), plus the evidence of the
elements around the block. It is fitted on a bounded sample of blocks that semantic elements label,
and sees neither these elements nor class, id or role, so it also judges pages that have none.
These costs are the capacities to the two terminals; smoothness edges join blocks that follow each
other, stronger the closer they are in the document tree, and blocks of one container across what
stands between them. The minimum cut separates content from boilerplate.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, deque
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The classifier is fitted on the blocks of at most so many pages, smallest hash of the url first.
FIT_PAGES = 256
#: Of their labelled blocks at most so many, smallest hash first, reach the driver.
FIT_BLOCKS = 16_384
#: Evidence of semantic elements and of boilerplate containers, and the classifier's limit, in log-odds.
IN_ARTICLE, IN_BOILERPLATE, TEXT_LIMIT = 4.0, -9.0, 4.0
#: Deeper elements count as children of the element at this depth, as browsers do.
MAX_DEPTH = 512
#: Inside an article, a word that names other things too takes the article's evidence back.
AMBIGUOUS_IN_ARTICLE = -4.0
#: Smoothness: same container, same grandparent, or only next to each other; siblings further apart.
SAME, NEAR, NEXT, SIBLING = 1.0, 0.5, 0.1, 0.3

# Elements of HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i",
          "img", "ins", "kbd", "label", "mark", "q", "ruby", "rp", "rt", "s", "samp", "small", "span", "strike",
          "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br"}
SKIPPED = {"script", "style", "noscript", "template", "iframe", "object", "svg", "math", "canvas", "audio", "video",
           "title", "textarea", "select", "button", "head"}
RAW = {"script", "style", "noscript", "template", "iframe", "title", "textarea"}
# What can stand in head; what ends an unclosed skipped element; what ends svg and math, and where not.
IN_HEAD = {"html", "head", "base", "basefont", "bgsound", "link", "meta", "title", "noscript", "noframes", "style", "script",
           "template"}
BLOCK_TAGS = {"body", "address", "article", "aside", "blockquote", "center", "dd", "details", "dialog", "div", "dl", "dt",
              "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup",
              "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot",
              "th", "thead", "tr", "ul"}
#: Elements that end a block of text; all others stand within a line, so removing them doesn't split it.
BREAKS = BLOCK_TAGS | {"html", "caption", "col", "colgroup", "dir", "legend", "listing", "optgroup", "option", "plaintext",
                       "search", "xmp"}
#: Elements that hold text of their own; text right inside another block element is bare.
TEXT_TAGS = {"p", "pre", "blockquote", "li", "dd", "dt", "td", "th", "figcaption", "caption", "summary"}
BREAKOUT = {"b", "big", "blockquote", "body", "br", "center", "code", "dd", "div", "dl", "dt", "em", "embed", "h1", "h2",
            "h3", "h4", "h5", "h6", "hr", "i", "img", "li", "listing", "menu", "meta", "nobr", "ol", "p", "pre", "ruby", "s",
            "small", "span", "strong", "strike", "sub", "sup", "table", "tt", "u", "ul", "var"}
FOREIGN = {"svg", "math"}
INTEGRATION = {"foreignobject", "desc", "annotation-xml", "mi", "mo", "mn", "ms", "mtext"}
#: Start tags that end an open element of the name.
ENDED_BY = {"button": {"button"}, "select": {"select", "input", "textarea"}}
SCOPE = {"table", "caption", "td", "th", "object", "marquee"}
ARTICLE = {"article", "main"}
BOILERPLATE = {"nav", "footer", "aside", "form", "menu", "dialog", "header"}
# Class, id and role names of boilerplate. A name counts as a whole, or as a compound of these
# words and of PARTS alone; AMBIGUOUS_WORDS are names, and ids made of headings, of other things too.
BOILERPLATE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "adsense", "banner", "banners", "sponsor", "sponsored", "promo",
    "promotion", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay",
    "sidebar", "rail", "widget", "widgets", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs",
    "footer", "masthead", "toolbar", "pagination", "pager", "comment", "comments", "commentlist", "respond", "reply",
    "replies", "disqus", "discussion", "share", "sharing", "social", "related", "recommended", "newsletter",
    "subscribe", "subscription", "login", "signup", "search", "copyright", "contentinfo", "complementary", "header",
}
AMBIGUOUS_WORDS = {"promotion", "consent", "notice", "notices", "alert", "overlay", "rail", "menu", "navigation", "banner",
                   "sponsor", "respond", "reply", "discussion", "share", "sharing", "social", "related", "recommended",
                   "subscription", "search", "copyright", "header"}
COMMENT_WORDS = {"comment", "comments", "commentlist", "replies", "disqus"}
PARTS = {"slot", "box", "bar", "container", "wrapper", "wrap", "area", "block", "list", "item", "items", "link", "links",
         "button", "buttons", "btn", "icon", "icons", "left", "right", "top", "bottom", "main", "primary", "secondary",
         "site", "page", "global", "inner", "outer", "section", "panel", "unit", "form", "posts", "articles", "stories",
         "recent", "entries", "popular", "leaderboard", "rectangle", "skyscraper", "placeholder", "toggle", "brand",
         "body", "author", "content", "meta", "title", "text", "media", "policy", "message", "thread", "reader", "user"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
_TAG_REST = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPLIT = re.compile(r"[-_:.0-9]+")


@dataclass
class Element:
    tag: str
    parent: int
    named: int = 0           # whether its class, id or role names boilerplate: 2 surely, 1 by an ambiguous word
    own_comment: bool = False  # they name reader comments
    comment: bool = False    # it, or an element around it, holds reader comments
    size: int = 0            # characters of the blocks in it
    has_article: bool = False
    skipped: bool = False
    breaks: bool = True      # ends blocks of text


class Tokens:
    """Tags, comments and the like of a page, in time linear in its length.

    What is not found after a place is not searched again. If the quotes of a tag don't close
    before the page ends, quotes count for nothing in that tag and all after it."""

    def __init__(self, page: str):
        self.page, self.none, self.quotes = page, {}, True

    def find(self, what: str, at: int) -> int:
        if self.none.get(what, len(self.page) + 1) <= at:
            return -1
        k = self.page.find(what, at)
        if k < 0:
            self.none[what] = at
        return k

    def after(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, name, "/" of an end tag, attributes) of the next token; comments, doctypes
        and instructions have no name, CDATA sections are named by their opening."""
        page = self.page
        while (start := self.find("<", at)) >= 0:
            if page.startswith("<!--", start):
                end = self.find("-->", start + 4)
                return start, len(page) if end < 0 else end + 3, "", "", ""
            close = self.find(">", start + 1)
            if close >= 0 and page[start + 1] in "!?":
                if page.startswith(CDATA, start) and (end := self.find("]]>", start + len(CDATA))) >= 0:
                    return start, end + 3, CDATA, "", ""
                return start, close + 1, "", "", ""
            if close >= 0 and (name := _NAME.match(page, start + 1)):
                rest = _TAG_REST.match(page, name.end()) if self.quotes else None
                if rest:
                    return start, rest.end(), name[2].lower(), name[1], rest[1]
                self.quotes = False
                close = self.find(">", name.end())
                return start, close + 1, name[2].lower(), name[1], page[name.end():close]
            at = start + 1
        return None


CDATA = "<![CDATA["


@dataclass
class Block:
    element: int             # nearest element that ends blocks
    parts: list = field(default_factory=list)
    linked: int = 0
    text: str = ""


def names_in(tag: str, attributes: str) -> tuple[int, bool]:
    """How surely class, id and role name boilerplate (0 to 2), and whether they name reader comments."""
    named, comment = 0, False
    for attribute, *values in _ATTRIBUTE.findall(attributes):
        attribute = attribute.lower()
        if attribute not in ("class", "id", "role") or (attribute == "id" and tag in HEADINGS):
            continue
        for name in "".join(values).lower().split():
            parts = [x for x in _SPLIT.split(name) if x]
            words = BOILERPLATE_WORDS.intersection(parts)
            if not words or not all(x in words or x in PARTS for x in parts):
                continue
            # an id may be a heading's text, so a compound of ambiguous words makes it no surer
            sure = not words <= AMBIGUOUS_WORDS or (len(parts) > 1 and attribute != "id")
            named = max(named, 1 + sure)
            comment = comment or not COMMENT_WORDS.isdisjoint(words)
    return named, comment


def blocks_of(page: str) -> tuple[list[Block], list[Element]]:
    """Blocks of text in page order, and the elements they stand in. Unclosed elements are closed
    as HTML does for paragraphs, list items, head, button, select, svg and math; end tags without
    a start are ignored. A skipped element without an end tag of its own ends at the first block
    in it, where a browser would show the rest of the page inside it; for that the page is read
    again, once."""
    out, elements, unclosed = _parse(page, frozenset())
    if unclosed:
        out, elements, _ = _parse(page, unclosed)
    _settle(out, elements)
    return out, elements


def _settle(blocks: list[Block], elements: list[Element]) -> None:
    """Which elements hold comments, and which hold an article. On a page without an article, names
    around most of its text count for nothing: they can't tell its parts from each other."""
    for b in blocks:
        elements[b.element].size += len(b.text)
    for e in reversed(elements[1:]):  # children come after their parents
        elements[e.parent].size += e.size
    articles = []
    for whole in (False, True):
        for e in elements[1:]:
            if whole and 2 * e.size > elements[0].size:
                e.named, e.own_comment = 0, False
            e.comment = e.own_comment or elements[e.parent].comment
        articles = [e for e in elements if e.tag in ARTICLE and e.size and not e.comment]
        if articles:
            break
    for e in articles:
        k = e.parent
        while k >= 0 and not elements[k].has_article:
            elements[k].has_article = True
            k = elements[k].parent


def _parse(page: str, unclosed: frozenset[int]) -> tuple[list[Block], list[Element], frozenset[int]]:
    """Blocks, elements, and the places of skipped start tags that have no end tag of their own;
    those at ``unclosed`` end at the first block in them."""
    elements = [Element("", -1)]
    stack, out = [0], []
    open_: Counter[str] = Counter()  # open elements by tag
    n_skipped = 0
    block: Block | None = None
    at, size, tokens = 0, len(page), Tokens(page)
    in_body = False
    places: dict[int, int] = {}  # where skipped elements start
    starts: dict[int, int] = {}  # the same, of those without an end tag so far

    def close(k: int) -> None:
        """Closes the open elements from the k-th on."""
        nonlocal n_skipped
        for e in stack[k:]:
            open_[elements[e].tag] -= 1
            n_skipped -= elements[e].skipped
        del stack[k:]

    def body_begins() -> None:
        nonlocal in_body
        in_body = True
        if open_["head"]:
            close(max(k for k in range(len(stack)) if elements[stack[k]].tag == "head"))

    def ends_skipped(tag: str) -> None:
        """Closes the skipped elements that a start tag ends."""
        if tag in BREAKOUT and any(open_[x] for x in FOREIGN):
            cut = 0
            for k in range(len(stack) - 1, 0, -1):
                if elements[stack[k]].tag in INTEGRATION:
                    break
                if elements[stack[k]].tag in FOREIGN:
                    cut = k
            if cut:
                for e in stack[cut:]:
                    if elements[e].tag in FOREIGN:
                        starts.pop(e, None)
                close(cut)
        if any(open_[x] and tag in by for x, by in ENDED_BY.items()):
            for k in range(len(stack) - 1, 0, -1):
                open_tag = elements[stack[k]].tag
                if tag in ENDED_BY.get(open_tag, ()):
                    close(k)
                    break
                if open_tag in SCOPE:
                    break
        if unclosed and tag in BLOCK_TAGS:
            cut = 0
            for k in range(len(stack) - 1, 0, -1):
                if elements[stack[k]].skipped:
                    if places.get(stack[k]) not in unclosed:
                        break
                    cut = k
            if cut:
                close(cut)

    def text(chunk: str) -> None:
        nonlocal block
        if not chunk:
            return
        if not in_body and not chunk.isspace():
            body_begins()
        if n_skipped:
            return
        chunk = entities.unescape(chunk) if "&" in chunk else chunk
        if block is None:
            if chunk.isspace():
                return
            block = Block(next(e for e in reversed(stack) if elements[e].breaks))
        block.parts.append(chunk)
        if open_["a"]:
            block.linked += len(chunk.strip())

    def flush() -> None:
        nonlocal block
        if block is not None:
            block.text = " ".join("".join(block.parts).split())
            if block.text:
                out.append(block)
            block = None

    while at < size:
        token = tokens.after(at)
        if token is None:
            text(page[at:])
            break
        start, end, tag, ends, attributes = token
        text(page[at:start])
        at = end
        if tag == CDATA:
            text(page[start + len(CDATA):end - 3])
            continue
        if not tag:
            continue
        if not ends:
            if tag == "head" and in_body:
                continue
            if not in_body and tag not in IN_HEAD:
                body_begins()
            if n_skipped:
                was = len(stack)
                ends_skipped(tag)
                if len(stack) < was:
                    flush()
        if tag == "br":
            if block is not None:
                block.parts.append(" ")
            continue
        if ends:
            if tag in BREAKS and not n_skipped:
                flush()
            for k in range(len(stack) - 1, 0, -1) if open_[tag] else ():
                e = elements[stack[k]]
                if e.tag == tag:
                    starts.pop(stack[k], None)
                    close(k)
                    if e.breaks and not n_skipped:
                        flush()
                    break
                # an inline end tag doesn't close the blocks around it
                if tag in INLINE and e.tag not in INLINE:
                    break
            continue
        if tag in BREAKS:
            if not n_skipped:
                flush()
            for k in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph, a list item the one before
                open_tag = elements[stack[k]].tag
                if open_tag == "p" or (open_tag == tag and tag in ("li", "option", "tr", "td", "th", "dt", "dd")):
                    close(k)
                    break
                if open_tag not in INLINE:
                    break
        if tag in VOID or attributes.endswith("/"):
            continue
        if len(stack) > MAX_DEPTH:
            close(MAX_DEPTH)
        e = Element(tag, stack[-1])
        if tag not in ("html", "body") and "=" in attributes:
            named, e.own_comment = names_in(tag, attributes)
            e.named = 0 if tag in ARTICLE else named
        e.skipped = tag in SKIPPED
        # an unknown element that surely names boilerplate is a box of its own
        e.breaks = tag in BREAKS or (e.named == 2 and not e.skipped and tag not in INLINE)
        if e.breaks and tag not in BREAKS and not n_skipped:
            flush()
        elements.append(e)
        if tag in RAW:
            found = re.compile(rf"</{tag}\b", re.I).search(page, at)
            stop = tokens.find(">", found.end()) if found else -1
            at = stop + 1 if stop >= 0 else size
            continue
        if e.skipped and tag != "head":
            starts[len(elements) - 1] = places[len(elements) - 1] = start
        stack.append(len(elements) - 1)
        open_[tag] += 1
        n_skipped += e.skipped
    flush()
    return out, elements, frozenset(starts.values())


def evidence(blocks: list[Block], elements: list[Element]) -> list[float]:
    """What the elements around each block say; containers that hold the article don't count. Inside an
    article, names only take from its evidence, so that text and neighbours have their say."""
    inside, in_article, in_boilerplate, named = ([0] * len(elements) for _ in range(4))
    for k, e in enumerate(elements[1:], 1):  # parents come before their children
        up = e.parent
        inside[k] = inside[up] or e.tag in ARTICLE
        in_article[k] = in_article[up] or (e.tag in ARTICLE and not e.comment)
        in_boilerplate[k], named[k] = in_boilerplate[up], named[up]
        if not e.has_article:
            in_boilerplate[k] |= e.tag in BOILERPLATE and not (e.tag == "header" and inside[k])
            named[k] = max(named[up], 2 if e.comment else e.named)
    out = []
    for k in (b.element for b in blocks):
        found = IN_ARTICLE if in_article[k] else 0.0
        if in_boilerplate[k] or (named[k] and not found):
            found = IN_BOILERPLATE
        elif named[k]:
            found += IN_BOILERPLATE if named[k] == 2 else AMBIGUOUS_IN_ARTICLE
        out.append(found)
    return out


N_FEATURES = 14


def features(blocks: list[Block], elements: list[Element]) -> np.ndarray:
    """Of each block, without any mark of article or boilerplate: constant, log length, link share,
    punctuation, heading, item, place, bare text, end of a sentence, its element's and container's
    share of the page's text, and the container's number of blocks, text per block and heading."""
    n, total = len(blocks), max(1, elements[0].size)
    boxes = [max(0, elements[b.element].parent) for b in blocks]
    tags = [elements[b.element].tag for b in blocks]
    held, lengths = Counter(boxes), Counter()
    for b, box in zip(blocks, boxes):
        lengths[box] += len(b.text)
    headed = {box for box, tag in zip(boxes, tags) if tag in HEADINGS}
    rows = []
    for k, (b, box, tag) in enumerate(zip(blocks, boxes, tags)):
        size = len(b.text)
        marks = sum(b.text.count(c) for c in ".,;:!?")
        rows.append((1.0, math.log1p(size) / 5, min(1.0, b.linked / size), min(1.0, 10 * marks / size),
                     float(tag in HEADINGS), float(tag == "li"), abs(2 * (k + 0.5) / n - 1),
                     float(tag not in TEXT_TAGS and tag not in HEADINGS), float(b.text[-1] in ".!?"),
                     elements[b.element].size / total, elements[box].size / total, math.log(held[box]) / 3,
                     math.log1p(lengths[box] / held[box]) / 5, float(box in headed)))
    return np.array(rows, np.float64).reshape(n, N_FEATURES)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Newton steps; zero weights if only one class is there."""
    w = np.zeros(x.shape[1])
    if not len(y) or y.min() == y.max():
        return w
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(h, x.T @ (p - y) + ridge * w)
    return w


def fit(pages: DataFrame, url: str = "url", html: str = "html", fit_pages: int = FIT_PAGES,
        fit_blocks: int = FIT_BLOCKS) -> np.ndarray:
    """Weights of the classifier. At most ``fit_pages`` pages (smallest hash of their url) are read;
    blocks inside article or main are content, those inside boilerplate are not, and the rest are
    left out. At most ``fit_blocks`` blocks, smallest hash first, reach the driver, as a few numbers
    each."""
    chosen = (pages.select(F.col(url).alias("u")).filter(F.col("u").isNotNull()).distinct()
              .orderBy(F.xxhash64("u"), "u").limit(fit_pages))
    urls = [r[0] for r in chosen.collect()]
    if not urls:
        return np.zeros(N_FEATURES)

    def run(batches):
        for batch in batches:
            for page in batch.column(0).to_pylist():
                blocks, elements = blocks_of(page)
                marks = evidence(blocks, elements)
                x = features(blocks, elements)
                chosen = [k for k, m in enumerate(marks) if m]
                yield pa.RecordBatch.from_pydict({
                    "x": pa.array([x[k].tolist() for k in chosen], pa.list_(pa.float64())),
                    "y": pa.array([float(marks[k] > 0) for k in chosen], pa.float64())})

    # repeated urls: one page each
    sample = (pages.filter(F.col(url).isin(urls) & F.col(html).isNotNull()).groupBy(F.col(url).alias("u"))
              .agg(F.min(html).alias("html")).select("html"))
    rows = (sample.mapInArrow(run, "x array<double>, y double")
            .orderBy(F.xxhash64("x", "y"), "x", "y").limit(fit_blocks).collect())
    x = np.array(sorted((*r.x, r.y) for r in rows)).reshape(-1, N_FEATURES + 1)
    return fit_logistic(x[:, :-1], x[:, -1])


def min_cut(costs: np.ndarray, edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: content) of the least cost: ``costs[i]`` is what calling block i boilerplate
    costs more than calling it content; an edge costs its weight if its ends differ.

    Blocks whose own cost outweighs all their edges have that label in a minimum cut, so they are
    settled first and their edges become costs of their neighbours; max-flow decides the rest.
    """
    n = len(costs)
    own = list(map(float, costs))
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        if i != j:
            near[i][j] = near[i].get(j, 0.0) + w
            near[j][i] = near[j].get(i, 0.0) + w
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is not None or abs(own[i]) < sum(near[i].values()):
            continue
        label[i] = own[i] >= 0
        for j, w in near[i].items():
            own[j] += w if label[i] else -w
            del near[j][i]
            queue.append(j)
        near[i] = {}
    left = [i for i in range(n) if label[i] is None]
    if left:
        reach = _max_flow(left, own, near)
        for i in left:
            label[i] = i in reach
    return label


def _max_flow(nodes: list[int], own: list[float], near: list[dict[int, float]]) -> set[int]:
    """Nodes on the source's side, ties included: shortest augmenting paths, by levels."""
    source, sink = -1, -2
    rest: dict[int, dict[int, float]] = {i: dict(near[i]) for i in nodes}
    rest[source], rest[sink] = {}, {}
    for i in nodes:
        if own[i] > 0:
            rest[source][i] = own[i]
            rest[i][source] = 0.0
        else:
            rest[i][sink] = -own[i]
            rest[sink][i] = 0.0
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            u = queue.popleft()
            for v, c in rest[u].items():
                if c > 1e-9 and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if sink not in level:
            break
        todo = {u: list(rest[u]) for u in level}
        path = [source]
        while path:
            u = path[-1]
            if u == sink:
                flow = min(rest[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    rest[a][b] -= flow
                    rest[b][a] = rest[b].get(a, 0.0) + flow
                path = [source]
                continue
            while todo[u] and not (rest[u].get(todo[u][-1], 0.0) > 1e-9 and level.get(todo[u][-1], -1) == level[u] + 1):
                todo[u].pop()  # full, or not one level down: no use in this round
            if todo[u]:
                path.append(todo[u][-1])
            else:
                path.pop()
                if path:
                    todo[path[-1]].pop()
    lost, queue = {sink}, deque([sink])  # what still reaches the sink is on its side
    while queue:
        v = queue.popleft()
        for u in rest[v]:
            if u not in lost and rest[u].get(v, 0.0) > 1e-9:
                lost.add(u)
                queue.append(u)
    return {i for i in nodes if i not in lost}


def smoothness(blocks: list[Block], elements: list[Element]) -> list[tuple[int, int, float]]:
    parent = lambda k: elements[k].parent if k > 0 else 0
    edges, last = [], {}
    for i, b in enumerate(blocks):
        box = parent(b.element)
        if i:
            before = blocks[i - 1].element
            same = b.element == before or box == parent(before)
            edges.append((i - 1, i, SAME if same else NEAR if parent(box) == parent(parent(before)) else NEXT))
        if box in last and last[box] != i - 1:
            edges.append((last[box], i, SIBLING))
        last[box] = i
    return edges


def extract_text(page: str | None, weights: np.ndarray) -> str:
    """Content blocks of a page in page order, one line each; empty for null."""
    if not page:
        return ""
    blocks, elements = blocks_of(page)
    if not blocks:
        return ""
    z = np.clip(features(blocks, elements) @ weights, -TEXT_LIMIT, TEXT_LIMIT)
    z = z + np.array(evidence(blocks, elements))
    # logistic costs: -log(1 - p) for content called boilerplate, -log p for the other way round
    costs = np.logaddexp(0, z) - np.logaddexp(0, -z)
    keep = min_cut(costs, smoothness(blocks, elements))
    return "\n".join([b.text for b, k in zip(blocks, keep) if k])


def extract(pages: DataFrame, weights: np.ndarray | None = None, html: str = "html",
            keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep``, text, n_chars: one row per row of ``pages``, from the whole html.

    Null and empty pages have an empty text; repeated rows give repeated results; ``weights``
    None fits them on a bounded sample of ``pages`` (which then needs a url).
    """
    weights = fit(pages, html=html) if weights is None else weights
    n = len(keep)
    schema = ", ".join([*(f"`{c}` {t}" for c, t in pages.select(*keep).dtypes), "text string", "n_chars bigint"])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = [extract_text(x, weights) for x in part.column(n).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(n)]
                    + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    [*keep, "text", "n_chars"])

    return pages.select(*keep, F.col(html).alias("_html")).mapInArrow(run, schema)
