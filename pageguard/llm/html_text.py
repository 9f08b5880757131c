"""Operator 11: main text of HTML pages from flat text blocks and a decision tree.

1. blocks: a page is read once, tag by tag, into a flat list of text blocks: what stands between two block-level tags, with
   character references decoded and white space as single spaces. Scripts, styles, comments, heads and the like give none.
2. Each block has a few numbers: its words, its link density (share of words inside links), the same of the block before
   and after it, whether the names around it (tags, class, id, role) speak of an article, or of something beside one, and
   whether it is a heading.
3. A decision tree says which blocks are main text. It is grown on LABELLED, a small table of blocks of made-up pages.
4. Main blocks are joined in page order.

Defined results: null and empty html, and pages without main blocks, have an empty text and 0 characters; tags that are
not closed end with the element around them, or the page; a script that is not closed takes the rest of the page; `<br>` is
white space; repeated rows repeat; other columns do not matter.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import tidy

# Fixed values of HTML: elements that begin a block of text, that have no end tag, and whose content is no text of the page.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style title textarea iframe noembed noframes xmp".split())
DROPPED_TAGS = frozenset("head noscript template svg math object audio video canvas map select button datalist".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Tags, and words in class, id and role, around what is not main text.
BESIDE_TAGS = frozenset("nav footer aside form menu dialog search".split())
BESIDE = re.compile(
    r"(?:^|[^a-z])(?:ad|ads|adv|advert\w*|sponsor\w*|promo\w*|banner|cookie\w*|consent|gdpr|notice|notification|alert|popup|modal|overlay|paywall"
    r"|nav|navbar|navigation|menu|breadcrumbs?|pager|pagination|toolbar|topbar|masthead|header|footer|copyright|legal|sidebar|side|aside|widgets?|rail"
    r"|comments?|commentlist|respond|replies|reply|disqus|discussion|feedback|share|sharing|social|follow|related|recommend\w*|trending|popular|teasers?|more"
    r"|newsletter|subscribe|signup|login|search|skip|meta|byline|tags?|tagcloud|hidden|complementary|contentinfo|dialog)(?:[^a-z]|$)"
)
ARTICLE_TAGS = frozenset("article main".split())
ARTICLE = re.compile(r"(?:^|[^a-z])(?:article|main|post|entry|story|content|articlebody|text|prose)(?:[^a-z]|$)")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=/]|$)|display\s*:\s*none|visibility\s*:\s*hidden|aria-hidden\s*=\s*[\"']?true", re.I)

_MARKUP = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+>", re.S)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    article: int
    beside: int
    heading: int


class _Open:
    """An open element and what it says about the text in it."""

    __slots__ = ("tag", "article", "beside", "dropped")

    def __init__(self, tag: str, article: int, beside: int, dropped: bool):
        self.tag, self.article, self.beside, self.dropped = tag, article, beside, dropped


def _opened(tag: str, attrs: str, around: _Open) -> _Open:
    named = " ".join("".join(m) for m in _NAMES.findall(attrs)) if attrs else ""
    named = _CAMEL.sub("-", named).lower()
    # A header inside an article holds its title; its class may still speak of something else.
    beside = tag in BESIDE_TAGS or tag == "header" and not around.article or named and BESIDE.search(named) and tag not in ("body", "html", *ARTICLE_TAGS)
    beside = beside or tag in ARTICLE_TAGS and re.search(r"(?:^|[^a-z])(?:comments?|reply|teasers?|related|promo|ad)(?:[^a-z]|$)", named)
    article = tag in ARTICLE_TAGS or bool(named and ARTICLE.search(named) and tag not in ("body", "html"))
    dropped = around.dropped or tag in DROPPED_TAGS or bool(attrs and _HIDDEN.search(attrs))
    return _Open(tag, max(around.article, int(article)), around.beside + int(bool(beside)), dropped)


def blocks(page: str | None) -> list[Block]:
    """The text blocks of a page in page order."""
    page = page or ""
    out: list[Block] = []
    root = _Open("", 0, 0, False)
    stack = [root]
    links = heading = 0
    parts: list[str] = []  # text of the block so far
    linked: list[str] = []  # of it, what is inside links

    def close() -> None:
        nonlocal parts, linked
        words = "".join(parts).split()
        if words:
            top = stack[-1]
            out.append(Block(" ".join(words), len(words), min(len(" ".join(linked).split()), len(words)), top.article, top.beside, int(heading > 0)))
        parts, linked = [], []

    def pop_to(tag: str) -> None:
        nonlocal links, heading
        while stack[-1].tag != tag:
            links, heading = links - (stack[-1].tag == "a"), heading - (stack[-1].tag in HEADINGS)
            stack.pop()
        links, heading = links - (tag == "a"), heading - (tag in HEADINGS)
        stack.pop()

    def add(raw: str) -> None:
        if raw and not stack[-1].dropped:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if links:
                linked.append(text)

    at = 0
    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            add(page[at:])
            break
        add(page[at:start])
        m = _MARKUP.match(page, start)
        if m is None:
            if re.compile(r"</?[a-zA-Z]").match(page, start):  # a tag that never ends
                end = page.find(">", start)
                at = end + 1 if end >= 0 else len(page)
            else:
                add("<")
                at = start + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                add(" ")
            elif any(o.tag == tag for o in stack):
                if tag in BLOCK_TAGS:
                    close()
                pop_to(tag)
            elif tag in BLOCK_TAGS:
                close()
            continue
        if tag in RAW_TAGS:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag == "br" or tag == "wbr":
            add(" " if tag == "br" else "")
            continue
        if tag in BLOCK_TAGS:
            close()
            # An open paragraph ends where a block begins, an item where the next one does.
            ends = ("p",) if tag not in ("li", "dd", "dt", "td", "th", "tr", "option") else (tag, "p")
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ends:
                    while len(stack) > i:
                        pop_to(stack[-1].tag)
                    break
                if stack[i].tag in BLOCK_TAGS and stack[i].tag != "p":
                    break
        if tag not in VOID_TAGS and not (m[3].endswith("/") and tag not in BLOCK_TAGS and tag != "a"):
            stack.append(_opened(tag, m[3], stack[-1]))
            links, heading = links + (tag == "a"), heading + (tag in HEADINGS)
    close()
    return out


#: Numbers of a block that the tree may ask for.
FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "article", "beside", "heading")


def features(words: np.ndarray, linked: np.ndarray, article: np.ndarray, beside: np.ndarray, heading: np.ndarray) -> np.ndarray:
    """blocks x FEATURES of one page; before the first and after the last block there are no words."""
    density = linked / np.maximum(words, 1)
    shifted = lambda x, by: np.concatenate(([0.0], x[:-1])) if by > 0 else np.concatenate((x[1:], [0.0]))
    return np.stack((words, density, shifted(words, 1), shifted(density, 1), shifted(words, -1), shifted(density, -1), article, beside, heading), axis=1).astype(float)


# Labelled blocks of made-up pages, one page a line, blocks in page order. A block is
# words/linked words, then letters: a inside an article, b beside one, h heading; + main text or - not.
LABELLED = """
1/1b- 1/1b- 2/2b- 7/0b- 9/0ah+ 60/0a+ 3/0a+ 41/2a+ 1/0a+ 88/0a+ 10/0b-
1/1b- 1/1b- 1/1b- 6/0a+ 2/0a+ 120/5a+ 2/0a+ 4/0a+ 8/0b-
12/0b- 8/0ah+ 14/0a+ 1/0a+ 33/1a+ 30/0ab- 22/0ab- 9/9ab- 11/0b-
3/3b- 4/4b- 25/25b- 11/0ah+ 52/0a+ 3/3a+ 47/0a+ 2/2ab- 3/3ab- 6/1b-
2/2a- 2/2a- 3/3a- 10/0ah+ 70/1a+ 55/0a+ 5/5a- 6/6a- 4/4a- 18/0b-
4/0b- 40/0b- 35/0b- 9/0ah+ 5/0a+ 18/0a+ 64/0ab- 2/0ab- 50/3ab- 28/0b-
1/1- 1/1- 2/2- 1/1- 9/0h+ 45/0+ 38/3+ 5/0h+ 51/0+ 12/0+ 80/1+ 1/1- 1/1- 4/4- 6/1-
2/2- 2/2- 12/0h+ 66/2+ 59/0+ 72/4+ 3/3- 5/5- 5/5- 8/2-
3/0- 1/1- 1/1- 30/0+ 27/0+ 90/6+ 4/0- 7/7- 2/1-
5/5- 4/4- 6/6- 8/0h+ 33/0+ 41/0+ 2/0h+ 29/1+ 77/0+ 6/3- 1/1-
1/1- 8/8- 7/7- 9/9- 10/10- 3/2- 2/2- 5/2-
1/0- 3/3- 6/0- 2/2- 4/1- 3/3- 2/0-
3/0b- 60/0b- 75/2b- 44/0b- 6/0ah+ 20/0a+ 2/0a+ 1/0a+ 31/0b- 45/0b-
7/0h+ 22/0+ 26/1+ 19/0+ 35/0+ 40/2+ 2/2- 3/3-
9/0ah+ 300/12a+ 1/0a+ 250/0a+ 2/0a+ 7/0b-
5/5b- 5/0ah+ 2/0a+ 3/0a+ 4/1a+ 20/0b- 90/0b- 15/0b-
2/2b- 3/3b- 8/0ah+ 20/4a+ 3/0a+ 15/5a+ 2/0a+ 10/4a+ 1/0a+ 12/2b- 30/8b- 44/9b- 60/12b-
40/9b- 30/6b- 25/5b- 9/1ah+ 25/6a+ 6/2a+ 4/0a+ 12/4a+ 50/10b- 3/1b- 28/7b- 9/2b-
6/1b- 22/4b- 5/0ah+ 16/3a+ 2/1a+ 35/9a+ 7/2a+ 3/0a+ 18/4b- 41/8b- 36/6b- 2/1b-
1/1- 2/2- 9/0h+ 48/9+ 33/8+ 52/10+ 40/6+ 2/2- 3/3- 4/3-
14/2b- 31/5b- 4/0ah+ 9/3a+ 1/0a+ 21/6a+ 1/1a+ 40/0a+ 17/5b- 33/9b-
22/0+
2/0+
9/0+
3/1ah+ 25/0a+
1/0ah+ 4/0a+
6/0h+ 2/0+
8/0ah+ 60/0a+ 2/0a+ 6/6b- 3/3b-
5/0ah+ 12/0a+ 4/0a+ 5/5b- 4/4b-
7/0h+ 31/1a+ 5/1a+ 8/8- 9/9-
2/2- 3/3- 50/0+ 60/2+
4/4- 90/3+ 2/2- 70/0+
5/5- 6/6- 1/1- 44/2+ 3/3- 58/0+
"""


def labelled_blocks(table: str = LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels (1: main) of the blocks of the table."""
    x, y = [], []
    for line in table.split("\n"):
        found = re.findall(r"(\d+)/(\d+)(a?)(b?)(h?)([+-])", line)
        if found:
            words, linked = (np.array([int(f[i]) for f in found]) for i in (0, 1))
            article, beside, heading = (np.array([len(f[i]) for f in found]) for i in (2, 3, 4))
            x.append(features(words, linked, article, beside, heading))
            y += [int(f[5] == "+") for f in found]
    return np.concatenate(x), np.array(y)


class Tree:
    """A binary decision tree: for each node a feature and its bound (go left if less), or a leaf's class."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 2):
        self.nodes: list[tuple[int, float, int, int]] = []  # feature or -1, bound or class, left, right
        self._grow(x, y, depth, least)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, least: int) -> int:
        """The split that leaves the least Gini impurity, as long as there is one; returns the node's number."""
        at = len(self.nodes)
        self.nodes.append((-1, float(y.mean() >= 0.5) if len(y) else 0.0, 0, 0))
        if depth == 0 or len(y) < 2 * least or y.min() == y.max():
            return at
        best = (len(y) * 2 * y.mean() * (1 - y.mean()) - 1e-9, -1, 0.0)
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, ones = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(y))
            left, right = ones[:-1] / n, (ones[-1] - ones[:-1]) / (len(y) - n)
            cost = np.where(v[1:] > v[:-1], 2 * n * left * (1 - left) + 2 * (len(y) - n) * right * (1 - right), np.inf)
            cost[: least - 1] = cost[len(cost) - least + 1 :] = np.inf
            i = int(cost.argmin())
            if cost[i] < best[0]:
                best = (float(cost[i]), f, float((v[i] + v[i + 1]) / 2))
        if best[1] >= 0:
            less = x[:, best[1]] < best[2]
            left = self._grow(x[less], y[less], depth - 1, least)
            right = self._grow(x[~less], y[~less], depth - 1, least)
            self.nodes[at] = (best[1], best[2], left, right)
        return at

    def classes(self, x: np.ndarray) -> np.ndarray:
        feature, bound, left, right = (np.array(c) for c in zip(*self.nodes))
        at = np.zeros(len(x), int)
        while (inner := feature[at] >= 0).any():
            i = np.flatnonzero(inner)
            less = x[i, feature[at[i]]] < bound[at[i]]
            at[i] = np.where(less, left[at[i]], right[at[i]])
        return bound[at] > 0.5


def main_text(page: str | None, tree: Tree) -> str:
    found = blocks(page)
    if not found:
        return ""
    cols = (np.array([getattr(b, c) for b in found]) for c in ("words", "linked", "article", "beside", "heading"))
    return "\n".join(b.text for b, main in zip(found, tree.classes(features(*cols))) if main)


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    tree = Tree(*labelled_blocks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, tree) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(tidy(run), f"page_id {kind}, url string, text string, n_chars long")
