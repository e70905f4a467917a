"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut at block tags into flat blocks of text. A block's features are its word
count, its link density (the share of its words inside links), the same of the blocks
before and after it, and the kind of place it stands in. A decision tree, grown by
Gini impurity on the small labelled table below, says which blocks are the article. Where a page
marks its article and what is beside it, the kind of place decides; words and links decide elsewhere.

Scripts, styles and other content that is never shown are no text. What is kept has
its character references decoded and white space inside a block made one space, is
trimmed, and the blocks are joined by one space in page order; nothing is cut off.

Defined results: a null or empty page, and one without an article block, gives the
empty string; markup that is cut off or not closed is read as far as it goes. Extra
columns pass through, but those named like results are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# HTML's own element names, by what they do to text.
HIDDEN = ("script", "style", "noscript", "template", "head", "svg", "math", "iframe", "object", "canvas", "audio", "video", "select", "textarea", "title")
INLINE = ("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr")
ASIDE = ("nav", "aside", "footer", "header", "form", "menu", "dialog", "button", "fieldset")
BODY = ("article", "main")
EMPTY = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
RAW = ("script", "style", "textarea", "title")
# Words in class, id and role attributes by which sites name what is not the article.
NAMES = ("ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "contentinfo", "cookie", "cookies", "discussion", "disqus", "footer", "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "popup", "promo", "promotion", "related", "replies", "responses", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget")

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
NAME = re.compile(r"[a-z]+")
HAVING = re.compile(r"(?:has|have|no|not|with|without|is|show|hide|hidden|above|below|after|before|hasnt|wp-has)[-_]")
SPACE = re.compile(r"\s+")
UNQUOTED = re.compile(r"=\s*[^\s\"'=]+/\Z")

# A small labelled table: words, link density, words and link density of the block before and after, place (0 none, 1 in an
# article or main, 2 in what is named or made for something else), heading, and whether it is of the article.
LABELLED = (
    (60, 0.0, 50, 0.0, 55, 0.0, 1, 0, 1), (25, 0.05, 60, 0.0, 40, 0.0, 1, 0, 1), (4, 0.0, 0, 0.0, 70, 0.0, 1, 1, 1), (1, 0.0, 30, 0.0, 30, 0.0, 1, 0, 1), (9, 0.0, 3, 0.0, 2, 0.0, 1, 0, 1),
    (3, 1.0, 40, 0.0, 40, 0.0, 1, 0, 1), (6, 0.5, 20, 0.1, 35, 0.0, 1, 0, 1), (120, 0.02, 8, 0.0, 5, 0.8, 1, 0, 1), (2, 0.0, 0, 0.0, 0, 0.0, 1, 0, 1), (14, 0.2, 2, 0.0, 90, 0.0, 1, 0, 1),
    (2, 1.0, 3, 1.0, 1, 1.0, 1, 0, 1), (6, 0.9, 4, 0.8, 5, 1.0, 1, 0, 1), (4, 0.0, 0, 0.0, 1, 0.0, 1, 0, 1), (3, 0.0, 5, 0.0, 2, 0.9, 1, 0, 1), (5, 0.4, 60, 0.0, 3, 0.8, 1, 0, 1),
    (30, 0.75, 6, 0.8, 9, 0.9, 1, 0, 1), (2, 0.5, 1, 1.0, 35, 0.0, 1, 0, 1), (1, 0.0, 1, 0.0, 1, 0.0, 1, 0, 1), (12, 0.8, 50, 0.1, 0, 0.0, 1, 0, 1), (3, 0.0, 2, 1.0, 4, 1.0, 1, 1, 1),
    (1, 1.0, 1, 1.0, 1, 1.0, 2, 0, 0), (2, 1.0, 0, 0.0, 1, 1.0, 2, 0, 0), (30, 0.0, 5, 0.0, 12, 0.0, 2, 0, 0), (12, 0.0, 1, 1.0, 60, 0.0, 2, 0, 0), (8, 0.3, 60, 0.0, 0, 0.0, 2, 0, 0),
    (80, 0.0, 70, 0.0, 60, 0.0, 2, 0, 0), (5, 0.0, 40, 0.0, 0, 0.0, 2, 0, 0), (3, 0.0, 6, 0.5, 30, 0.0, 2, 1, 0), (45, 0.1, 20, 0.0, 33, 0.0, 2, 0, 0), (1, 0.0, 1, 0.0, 1, 0.0, 2, 0, 0),
    (40, 0.0, 35, 0.0, 50, 0.0, 0, 0, 1), (22, 0.05, 40, 0.0, 18, 0.1, 0, 0, 1), (90, 0.1, 3, 0.0, 45, 0.0, 0, 0, 1), (16, 0.0, 25, 0.0, 40, 0.0, 0, 0, 1), (6, 0.0, 30, 0.0, 42, 0.0, 0, 0, 1),
    (5, 0.0, 2, 0.9, 50, 0.0, 0, 1, 1), (7, 0.0, 45, 0.05, 60, 0.0, 0, 1, 1), (13, 0.15, 12, 0.0, 20, 0.0, 0, 0, 1), (34, 0.0, 1, 1.0, 2, 1.0, 0, 0, 1), (19, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1),
    (1, 1.0, 1, 1.0, 2, 1.0, 0, 0, 0), (3, 1.0, 2, 1.0, 1, 1.0, 0, 0, 0), (6, 0.9, 3, 1.0, 4, 1.0, 0, 0, 0), (15, 0.8, 5, 0.9, 7, 0.7, 0, 0, 0), (2, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0),
    (4, 0.0, 3, 0.6, 0, 0.0, 0, 0, 0), (3, 0.0, 4, 0.0, 2, 0.9, 0, 0, 0), (30, 0.75, 6, 0.8, 9, 0.9, 0, 0, 0), (5, 0.4, 60, 0.0, 3, 0.8, 0, 0, 0), (2, 0.5, 1, 1.0, 35, 0.0, 0, 0, 0),
)
FEATURES = 8


class Tree:
    """A decision tree of axis-parallel splits."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 1):
        self.value = int(2 * y.sum() >= len(y))
        self.split: tuple[int, float, Tree, Tree] | None = None
        if depth == 0 or len(set(y.tolist())) == 1:
            return
        best = None
        for f in range(x.shape[1]):
            found = np.unique(x[:, f])
            for cut in (found[1:] + found[:-1]) / 2:
                low = x[:, f] <= cut
                if min(low.sum(), (~low).sum()) < least:
                    continue
                impurity = sum(len(p) * 2 * p.mean() * (1 - p.mean()) for p in (y[low], y[~low]))
                if best is None or impurity < best[0] - 1e-12:
                    best = (impurity, f, float(cut))
        if best:
            _, f, cut = best
            low = x[:, f] <= cut
            self.split = (f, cut, Tree(x[low], y[low], depth - 1, least), Tree(x[~low], y[~low], depth - 1, least))

    def says(self, row: tuple) -> int:
        node = self
        while node.split:
            f, cut, low, high = node.split
            node = low if row[f] <= cut else high
        return node.value


@lru_cache(maxsize=1)
def trained() -> Tree:
    table = np.array(LABELLED, float)
    return Tree(table[:, :FEATURES], table[:, FEATURES].astype(int))


def named_aside(attributes: str, body: bool) -> bool:
    """Whether a class, id or role is a name of something aside, or for other elements than those of the article begins or ends with one. What an element is said to have or lack, as in has-sidebar, is not what it is."""
    for found in ATTRIBUTE.findall(attributes):
        for token in "".join(found).lower().split():
            if token in NAMES_SET or not body and not HAVING.match(token) and any(w in NAMES_SET for w in NAME.findall(token)):
                return True
    return False


def self_closed(attributes: str) -> bool:
    """Whether a tag ends in a slash that is not of an unquoted value."""
    return attributes.endswith("/") and not UNQUOTED.search(attributes)


def after_raw(page: str, name: str, closed: bool, at: int) -> int:
    """Where the content of a raw element ends that begins at this place. Without an end tag it is empty, but for scripts and styles, which are no text."""
    for m in re.compile(rf"<(/?){name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).finditer(page, at):
        if m[1]:
            return m.end()
        if closed:  # the next one begins first: the end tag is not this one's
            return at
    return at if closed or name in ("textarea", "title") else len(page)


def after_hidden(page: str) -> dict[int, int]:
    """For each other hidden element that has an end tag of its own: the place after its start tag, and the one after its end tag."""
    out: dict[int, int] = {}
    open_: dict[str, list[int]] = {}
    at = 0
    while found := TOKEN.search(page, at):
        at = found.end()
        name = (found[2] or "").lower()
        if name not in HIDDEN_SET:
            continue
        if name in RAW_SET:
            if not found[1]:
                at = after_raw(page, name, self_closed(found[3]), at)
        elif found[1]:
            if open_.get(name):
                out[open_[name].pop()] = at
        elif not self_closed(found[3]):
            open_.setdefault(name, []).append(at)
    return out


def blocks(page: str) -> list[tuple[str, int, int, int, int]]:
    """Flat blocks in page order: text, words, words in links, place and whether it is a heading."""
    out: list[tuple[str, int, int, int, int]] = []
    text: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements that are not inline, with the place inside each
    place = links = heading = 0

    def flush() -> None:
        if text:
            whole = SPACE.sub(" ", unescape("".join(text))).strip()
            if whole:
                out.append((whole, whole.count(" ") + 1, len(unescape(" ".join(linked)).split()), place, heading))
            text.clear()
            linked.clear()

    def put(piece: str) -> None:
        if piece:
            text.append(piece)
            if links:
                linked.append(piece)

    at, size = 0, len(page)
    ends: dict[int, int] | None = None  # of hidden elements, once there is one
    while at < size:
        found = TOKEN.search(page, at)
        if not found:
            put(page[at:])
            break
        put(page[at : found.start()])
        at = found.end()
        name = (found[2] or "").lower()
        if not name:  # a comment, a declaration, or the end tag of nothing
            continue
        closing = bool(found[1])
        if name == "a":
            links = 0 if closing else 1
            continue
        if name in INLINE_SET:
            continue
        if name == "br":
            put(" ")
            continue
        if name in HIDDEN_SET and not closing:
            flush()
            if name in RAW_SET:  # its content is no markup
                at = after_raw(page, name, self_closed(found[3]), at)
            elif name != "head" and not self_closed(found[3]):  # what may stand in a head is hidden or empty by itself
                if ends is None:
                    ends = after_hidden(page)
                at = ends.get(at, at)
            continue
        flush()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    place = stack[k - 1][1] if k else 0
                    del stack[k:]
                    break
            heading = 0
            links = 0
            continue
        heading = int(len(name) == 2 and name[0] == "h" and name[1].isdigit())
        if name in EMPTY_SET or found[3].endswith("/"):
            continue
        if name in ("p", "li") and stack and stack[-1][0] == name:  # its end tag may be left out
            stack.pop()
            place = stack[-1][1] if stack else 0
        inside = place
        if place != 2:
            if name in ASIDE_SET and not (name == "header" and place == 1):
                inside = 2
            else:
                if name in BODY:
                    inside = 1
                if found[3] and name not in ("html", "body") and named_aside(found[3], name in BODY):
                    inside = 2
        stack.append((name, inside))
        place = inside
    flush()
    return out


INLINE_SET, HIDDEN_SET, RAW_SET, EMPTY_SET, ASIDE_SET, NAMES_SET = map(frozenset, (INLINE, HIDDEN, RAW, EMPTY, ASIDE, NAMES))


def extract(page: str | None, tree: Tree | None = None) -> str:
    """The page's main text."""
    if not page:
        return ""
    tree = tree or trained()
    found = blocks(page)
    whole = any(place == 1 for *_, place, _ in found)  # where the page marks its article, nothing outside it is the article
    none, kept = ("", 0, 0, 0, 0), []
    for k, (text, words, linked, place, heading) in enumerate(found):
        before, after = found[k - 1] if k else none, found[k + 1] if k + 1 < len(found) else none
        row = (words, linked / words, before[1], before[2] / max(before[1], 1), after[1], after[2] / max(after[1], 1), 2 if whole and place == 0 else place, heading)
        if tree.says(row):
            kept.append(text)
    return " ".join(kept)


RESULTS = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def extract_text(df: DataFrame, html: str = "html") -> DataFrame:
    """Add text and n_chars. One pass without a shuffle, a few pages in memory at a time."""
    keep = [c for c in df.columns if c not in RESULTS.names]
    place = keep.index(html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 128):
                part = b.slice(start, 128)
                found = [extract(x).encode("utf-8", "replace").decode() for x in part.column(place).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=[*keep, *RESULTS.names])

    return df.select(*keep).mapInArrow(run, T.StructType([*(df.schema[c] for c in keep), *RESULTS]))
