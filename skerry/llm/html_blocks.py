"""Main text of web pages: flat text blocks, described by their own and their neighbours' words and links and by where they stand, and classified by a decision tree.

A page is cut into blocks at every tag that isn't inline. Blocks aren't nested; each knows its words, the share of them in links, the same of
the blocks before and after it, and what the elements around it say. The tree is grown from a small table of labelled pages.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# elements whose content is never text of a page's blocks
RAW = frozenset("script style title textarea noscript iframe xmp template".split())
SILENT = frozenset("head svg math object audio video canvas select datalist button".split())
# a start tag that ends an open element of the same group
CLOSES = {t: g for g in (("p",), ("li",), ("dt", "dd"), ("td", "th"), ("tr",), ("option",)) for t in g}
OUTSIDE = frozenset("nav footer aside form fieldset menu dialog".split())
MAIN = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# words in class, id and role that say what an element is for
OUTSIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox sponsor sponsored promo promotion banner nav navbar navigation menu topbar masthead breadcrumb breadcrumbs pager pagination footer contentinfo"
    " copyright sidebar aside complementary widget widgets related recommended share sharing social toolbar comment comments commentlist reply replies respond disqus cookie cookies consent gdpr notice alert popup modal"
    " dialog overlay newsletter subscribe subscription login signin signup register search searchbox form disclaimer".split()
)
MAIN_NAMES = frozenset("article content main post entry story prose body text".split())
SPARED = frozenset(("has", "with", "no", "without"))

_TOKEN = re.compile(r"""<(?:!--(?:.*?--!?>|.*\Z)|[!?][^>]*+>?|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)[^>]*+>?)""", re.S)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class Block(NamedTuple):
    text: str
    words: int
    linked: int
    outside: int  # within an element that isn't part of the article
    hint: int  # what the nearest telling element says: 1 article, -1 not, 0 none
    heading: int


def _says(tag: str, attributes: str) -> int:
    """What an element's names say of it: 1 article, -1 not part of it, 0 nothing. A page's frame and its article are only taken at whole names."""
    said = 0
    for _, a, b, c in _NAMES.findall(attributes):
        for name in (a or b or c).split():
            if tag in ("html", "body", "main", "article"):
                words = [name.lower()]
            else:
                words = [w.lower() for w in _WORDS.findall(name)]
                if SPARED.intersection(words):
                    continue
            if OUTSIDE_NAMES.intersection(words):
                return -1
            if MAIN_NAMES.intersection(words):
                said = 1
            elif "header" in words and tag not in ("html", "body"):
                said = said or -2  # a header is one of the page unless it stands in the article
    return said


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in their order. Unclosed and stray tags are taken as they come; what can't be a tag is text."""
    out: list[Block] = []
    pieces: list[str] = []
    links: list[str] = []
    # tag, outside, hint, in a link, silent, heading
    stack: list[tuple] = [("", 0, 0, False, False, 0)]
    open_tags: Counter = Counter()
    low = None

    def text(s: str) -> None:
        if s and not stack[-1][4]:
            s = unescape(s)
            pieces.append(s)
            if stack[-1][3]:
                links.append(s)
                links.append(" ")

    def end_block() -> None:
        words = "".join(pieces).split()
        if words:
            _, outside, hint, _, _, heading = stack[-1]
            out.append(Block(" ".join(words), len(words), min(len("".join(links).split()), len(words)), outside, hint, heading))
        pieces.clear()
        links.clear()

    def close(tag: str) -> None:
        while stack[-1][0] != tag:
            open_tags[stack.pop()[0]] -= 1
        open_tags[stack.pop()[0]] -= 1

    at = 0
    while m := _TOKEN.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag not in INLINE and tag not in RAW:
            end_block()
        elif tag == "br":
            text(" ")
        if m[1]:
            if open_tags[tag] > 0:
                close(tag)
            continue
        if tag in RAW:
            low = page.lower() if low is None else low
            end = low.find(f"</{tag}", at) if len(low) == len(page) else page.find(f"</{tag}", at)
            at = len(page) if end < 0 else end
            continue
        if tag in VOID or m[3].endswith("/") and tag not in INLINE and tag not in MAIN | OUTSIDE | {"div", "p", "section"}:
            continue
        for other in CLOSES.get(tag, ()):
            if open_tags[other] > 0 and stack[-1][0] in (other, *INLINE):
                close(other)
        _, outside, hint, link, silent, heading = stack[-1]
        if tag == "body":
            silent = False  # a head that wasn't closed
        said = _says(tag, m[3])
        if tag in OUTSIDE or said == -1:
            outside, hint = 1, -1
        elif tag == "header" or said == -2:
            outside, hint = (outside, hint) if hint == 1 else (1, -1)
        elif tag in MAIN or said == 1:
            hint = 1
        stack.append((tag, outside, hint, link or tag == "a", silent or tag in SILENT, heading or int(tag in HEADINGS)))
        open_tags[tag] += 1
    text(page[at:])
    end_block()
    return out


# The labelled table: pages as runs of blocks, each as (1 for the article, words, words in links, outside, hint, heading).
LABELLED = (
    # an article element between menus, an advert and a footer
    ((0, 1, 1, 1, -1, 0), (0, 1, 1, 1, -1, 0), (0, 8, 0, 1, -1, 0), (1, 9, 0, 0, 1, 1), (1, 80, 0, 0, 1, 0), (1, 2, 0, 0, 1, 0), (1, 45, 3, 0, 1, 0), (0, 7, 0, 1, -1, 0)),
    # one of a single short paragraph
    ((0, 2, 2, 1, -1, 0), (0, 12, 0, 1, -1, 0), (1, 3, 0, 0, 1, 1), (1, 1, 0, 0, 1, 0), (0, 20, 0, 1, -1, 0)),
    # links and short lines within an article, comments and a long notice beside it
    ((0, 30, 0, 1, -1, 0), (1, 6, 0, 0, 1, 1), (1, 5, 5, 0, 1, 0), (1, 60, 20, 0, 1, 0), (1, 4, 0, 0, 1, 1), (1, 12, 12, 0, 1, 0), (1, 33, 0, 0, 1, 0), (0, 70, 0, 1, -1, 0), (0, 25, 2, 1, -1, 0)),
    # comments and adverts that stand inside the article
    ((1, 7, 0, 0, 1, 1), (1, 40, 0, 0, 1, 0), (0, 18, 0, 1, 1, 0), (1, 55, 4, 0, 1, 0), (0, 3, 3, 1, 1, 0), (0, 90, 0, 1, 1, 0), (0, 45, 0, 1, -1, 0)),
    # plain pages: nothing says what is what but words and links
    ((0, 1, 1, 0, 0, 0), (0, 2, 2, 0, 0, 0), (0, 1, 1, 0, 0, 0), (1, 8, 0, 0, 0, 1), (1, 64, 2, 0, 0, 0), (1, 38, 0, 0, 0, 0), (1, 6, 0, 0, 0, 0), (1, 51, 0, 0, 0, 0), (0, 4, 2, 0, 0, 0), (0, 3, 3, 0, 0, 0)),
    ((0, 4, 4, 0, 0, 0), (0, 6, 3, 0, 0, 0), (1, 5, 0, 0, 0, 1), (1, 22, 0, 0, 0, 0), (1, 17, 1, 0, 0, 0), (1, 90, 9, 0, 0, 0), (0, 5, 5, 0, 0, 0), (0, 8, 6, 0, 0, 0), (0, 3, 0, 0, 0, 0)),
    ((1, 120, 0, 0, 0, 0), (1, 75, 4, 0, 0, 0), (1, 30, 0, 0, 0, 0), (1, 14, 0, 0, 0, 0)),
    ((1, 16, 0, 0, 0, 0),),
    ((0, 2, 2, 0, 0, 0), (0, 14, 14, 0, 0, 0), (0, 25, 24, 0, 0, 0), (0, 9, 8, 0, 0, 0), (0, 2, 0, 0, 0, 0)),
    ((0, 3, 3, 0, 0, 0), (1, 4, 0, 0, 0, 1), (1, 13, 0, 0, 0, 0), (1, 28, 2, 0, 0, 0), (1, 9, 0, 0, 0, 0), (1, 19, 0, 0, 0, 0), (0, 6, 4, 0, 0, 0)),
    # short lines between paragraphs of plain pages, and lists of links at the end of articles
    ((0, 2, 2, 0, 0, 0), (1, 7, 0, 0, 0, 1), (1, 40, 0, 0, 0, 0), (1, 2, 0, 0, 0, 0), (1, 52, 1, 0, 0, 0), (1, 1, 0, 0, 0, 0), (1, 35, 0, 0, 0, 0), (1, 3, 0, 0, 0, 0), (1, 28, 0, 0, 0, 0), (0, 3, 0, 0, 0, 0), (0, 4, 4, 0, 0, 0)),
    ((0, 3, 3, 1, -1, 0), (1, 5, 0, 0, 1, 1), (1, 25, 0, 0, 1, 0), (1, 3, 3, 0, 1, 0), (1, 6, 6, 0, 1, 0), (1, 4, 2, 0, 1, 0), (0, 2, 2, 1, -1, 0), (0, 6, 1, 1, -1, 0)),
    ((1, 4, 4, 0, 1, 1), (1, 2, 2, 0, 1, 0), (1, 8, 5, 0, 1, 0), (1, 1, 1, 0, 1, 0), (0, 30, 30, 0, 0, 0), (0, 40, 33, 0, 0, 0), (0, 5, 5, 0, 0, 0)),
    # plain paragraphs between a marked menu and footer
    ((0, 1, 1, 1, -1, 0), (0, 2, 2, 1, -1, 0), (1, 6, 0, 0, 0, 1), (1, 42, 0, 0, 0, 0), (1, 11, 0, 0, 0, 0), (1, 37, 6, 0, 0, 0), (0, 9, 0, 1, -1, 0)),
    # neutral frames around marked content
    ((0, 3, 1, 0, 0, 0), (0, 2, 2, 0, 0, 0), (1, 10, 0, 0, 1, 1), (1, 3, 0, 0, 1, 0), (1, 66, 8, 0, 1, 0), (0, 2, 0, 0, 0, 0), (0, 4, 4, 0, 0, 0)),
)
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "outside", "hint", "heading")
LEVELS = 7


def features(blocks: list[Block] | list[tuple]) -> np.ndarray:
    """A row of FEATURES for each block (words, linked, outside, hint, heading last); before the first and after the last block there are no words and no links."""
    given = np.array([b[-5:] for b in blocks], float).reshape(-1, 5)
    own = np.column_stack([given[:, 0], given[:, 1] / np.maximum(given[:, 0], 1)])
    none = np.zeros((1, 2))
    before, after = np.vstack([none, own[:-1]]), np.vstack([own[1:], none])
    return np.hstack([own, before, after, given[:, 2:]]) if len(own) else np.zeros((0, len(FEATURES)))


def grow(x: np.ndarray, y: np.ndarray, levels: int = LEVELS) -> dict | int:
    """A decision tree by Gini impurity: {feature, bound, low, high} or a class. Equal splits go by the feature's place and the smaller bound."""
    if levels == 0 or len(set(y.tolist())) == 1:
        return int(2 * y.sum() >= len(y))

    def impurity(part: np.ndarray) -> float:
        return len(part) * (p := part.mean()) * (1 - p)

    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for bound in ((values[1:] + values[:-1]) / 2).tolist():
            low = x[:, f] <= bound
            cost = impurity(y[low]) + impurity(y[~low])
            if best is None or cost < best[0] - 1e-12:
                best = cost, f, bound
    if best is None:
        return int(2 * y.sum() >= len(y))
    _, f, bound = best
    low = x[:, f] <= bound
    return {"feature": f, "bound": bound, "low": grow(x[low], y[low], levels - 1), "high": grow(x[~low], y[~low], levels - 1)}


def predict(tree: dict | int, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, int):
        return np.full(len(x), tree)
    low = x[:, tree["feature"]] <= tree["bound"]
    out = np.empty(len(x), int)
    out[low], out[~low] = predict(tree["low"], x[low]), predict(tree["high"], x[~low])
    return out


@lru_cache(maxsize=1)
def trained() -> dict | int:
    """The tree grown from LABELLED."""
    x = np.vstack([features([b[1:] for b in page]) for page in LABELLED])
    return grow(x, np.array([b[0] for page in LABELLED for b in page]))


def article(page: str, tree: dict | int) -> str:
    blocks = blocks_of(page)
    return "\n".join(b.text for b, y in zip(blocks, predict(tree, features(blocks)).tolist()) if y)


def _extracted(tree: dict | int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            part = batch.slice(at, 128)
            texts = [article(h or "", tree) for h in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame, tree: dict | int | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page (page_id, url, html): the blocks that the tree takes for the article, joined by line ends, and their code points.

    Null and empty pages and pages without an article give an empty text. Pages of any length are taken whole, each by itself, so equal pages give equal texts, repeated rows repeated
    ones; null ids and urls stay. Other columns are not looked at; an empty table gives an empty one. There is no shuffle.
    """
    ship(pages.sparkSession)
    tree = trained() if tree is None else tree
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(lambda b: _extracted(tree, b), "page_id long, url string, text string, n_chars long")
