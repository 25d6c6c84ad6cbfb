"""Main text of web pages: flat blocks of text, classified by a decision tree.

A page is read once from left to right. Tags of block elements end a block; other tags and line
breaks don't. The tree sees the word count and link density of the block and its two neighbours.
Besides, it sees what kind of element the block is in, what the open elements around it say (menus,
headers, footers, sidebars, notices, adverts, forms, comments, or an article), and what their
classes, ids and roles do: plainly ("cookie-notice", "post-comments"), in passing ("has-sidebar",
"content share-box"), or outside of the innermost article; names of html and body say nothing. Of
the outermost box with a plain name it sees the share of the page's words, as a sidebar that holds
most of them is none. The tree is grown (Gini splits) on pages made of the labelled rows of
``html_table``, of which some have no names and some have names that mislead; its leaves say
whether a block is main text.

Scripts, styles, templates, form controls, comments and markup never become text. Scripts and other
raw elements end at their end tag only, or with the page; drawings, players and controls at theirs
or, if there is none, at the next block. Character references are decoded, white space in a block
becomes one space, blocks are joined by one line break in the page's order; nothing else is dropped
or cut off.

Defined results: null and empty pages, and pages without main text, give an empty text. Tags that
are never closed end with the page; stray end tags are skipped; a "<" that begins no tag is text.
Repeated rows get equal texts. Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bytesoup import trimmed
from tidemark.llm.common import lean
from tidemark.llm.html_table import pages

_TAG = re.compile(r"""<(?:!--|(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)*+)>|[!?][^>]*+>)""")
#: For pages in which a quoted value never ends: a tag ends at the next ">".
_LAX = re.compile(r"<(?:!--|(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|[!?][^>]*+>)")
#: Read as raw text up to their end tag, which alone ends them.
_RAW = frozenset("script style textarea iframe xmp noembed noframes".split())
#: Dropped up to their end tag, or, if there is none, up to the next block.
_DROPPED = frozenset("template select datalist button svg canvas audio video".split())
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol p pre search section summary table tbody tfoot thead title tr ul x-label".split())
_BOXES = frozenset("article aside body center div dl fieldset figure footer form head header html main nav noscript ol section table ul".split())
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HREF = re.compile(r"""(?:^|[\s"'])href\s*=""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_ANCHOR = re.compile(r"<(/?)a[\s>]", re.I)
#: What elements may say of the text in them.
_SAYS = ("menu", "header", "footer", "side", "notice", "advert", "form", "comment", "article", "head")
_BY_TAG = {"nav": "menu", "header": "header", "footer": "footer", "aside": "side", "form": "form", "article": "article", "main": "article", "head": "head", "noscript": "notice"}
_BY_NAME = {
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar tabs toc",
    "header": "header masthead topbar",
    "footer": "footer copyright colophon contentinfo",
    "side": "sidebar side aside related widget widgets recommended trending popular complementary share social",
    "notice": "notice notices cookie cookies consent gdpr banner alert disclaimer popup modal overlay paywall",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion adsense dfp",
    "form": "form newsletter subscribe signup login search searchbox",
    "comment": "comment comments reply replies respond disqus discussion reviews",
    "article": "article content post posts entry story main body maintext",
}
_NAMES = {name: says for says, names in _BY_NAME.items() for name in names.split()}
#: Parts of names that change nothing in what the others say.
_FILLER = frozenset("area bar block bottom box card col column container group holder inner item left link links list outer page panel region right row section site title top unit wrap wrapper".split())
_BIT = {s: 1 << k for k, s in enumerate(_SAYS)}
_ARTICLE, _COMMENT = _BIT["article"], _BIT["comment"]


def _named(attributes: str) -> tuple[int, int]:
    """What an element's names say plainly, and what they say in passing: in a name with other parts, or beside one that says article."""
    plain = passing = 0
    for m in _ATTRIBUTE.finditer(attributes):
        for name in (m[2] or m[3] or m[4] or "").split():
            parts = [p.lower() for p in _PARTS.findall(name)]
            says = [_NAMES[p] for p in parts if p in _NAMES]
            rest = [s for s in says if s != "article"] or says[:1]
            if all(p in _NAMES or p in _FILLER or p.isdigit() for p in parts):
                for s in rest:
                    plain |= _BIT[s]
            else:
                for s in rest:
                    passing |= _BIT[s]
    if plain & _ARTICLE and plain != _ARTICLE:
        passing |= plain & ~_ARTICLE
        plain = _ARTICLE
    return plain, passing


class _Box:
    """An open element. tags, names: what elements and plain names around say, the latter since the innermost article.

    passing: whether names say something in passing; around: what plain names outside of that
    article say; told: the outermost box of a plain name, or none.
    """

    __slots__ = ("tag", "tags", "names", "passing", "around", "told")

    def __init__(self, tag: str, tags: int = 0, names: int = 0, passing: int = 0, around: int = 0, told: int = -1) -> None:
        self.tag, self.tags, self.names, self.passing, self.around, self.told = tag, tags, names, passing, around, told

    def opened(self, tag: str, attributes: str, count: int) -> _Box:
        """The element within this one; count: boxes of plain names so far."""
        plain, passing = _named(attributes) if attributes and tag not in ("html", "body") else (0, 0)
        box = _Box(tag, self.tags, self.names, self.passing, self.around, self.told)
        if (own := _BY_TAG.get(tag)) and not (own == "header" and self.tags & _ARTICLE):  # a header in an article is its heading
            box.tags |= _BIT[own]
        if tag in ("article", "main"):
            box.around |= box.names
            box.names = box.passing = 0
        box.names |= plain & ~_ARTICLE
        box.passing |= passing & ~_ARTICLE
        if plain & ~_ARTICLE and box.told < 0:
            box.told = count
        return box


class Block:
    __slots__ = ("text", "words", "linked", "box", "kind", "label")

    def __init__(self, text: str, words: int, linked: int, box: _Box, kind: int, label: int) -> None:
        self.text, self.words, self.linked, self.box, self.kind, self.label = text, words, linked, box, kind, label


def _ends(page: str, name: str) -> dict[int, int]:
    """For each opening tag of that name that is closed, where its end tag ends, by where it begins; nested ones pair up."""
    out, opened = {}, []
    for m in re.compile(rf"<(/?){name}(?=[\s/>])[^>]*>", re.I).finditer(page):
        if not m[1]:
            opened.append(m.start())
        elif opened:
            out[opened.pop()] = m.end()
    return out


def blocks(page: str, labelled: bool = False) -> list[Block]:
    """Blocks in order. labelled: <x-label 0> and <x-label 1> tell the label of what follows (training pages only)."""
    out: list[Block] = []
    parts: list[str] = []
    linked = label = told = 0
    in_link, in_linked = False, 0  # in_linked: blocks opened within the link
    stack: list[_Box] = []
    opened: Counter[str] = Counter()
    box = base = _Box("")
    head = _Box("", _BIT["head"])
    kind, dropping = "body", ""
    ends: dict[str, dict[int, int]] = {}
    anchors: list[tuple[int, bool]] | None = None

    def end() -> None:
        nonlocal linked
        if parts:
            words = "".join(parts).split()
            if words:
                k = 1 if kind == "p" else 2 if kind in ("h1", "h2", "h3", "h4", "h5", "h6") else 3 if kind == "li" else 0
                out.append(Block(" ".join(words), len(words), min(linked, len(words)), box, k, label))
            parts.clear()
        linked = 0

    def text(a: int, b: int) -> None:
        nonlocal linked
        if a < b and not dropping:
            t = page[a:b]
            if "&" in t:
                t = html.unescape(t)
            parts.append(t)
            if in_link:
                linked += len(t.split())

    at, last, tag = 0, page.rfind(">"), _TAG
    while True:
        m = None
        look = page.find("<", at)
        while 0 <= look < last and not (m := tag.match(page, look)):
            if tag is _TAG and _LAX.match(page, look):
                tag = _LAX
            else:
                look = page.find("<", look + 1)
        if m is None:
            text(at, len(page))
            break
        text(at, look)
        at = m.end()
        if m[0] == "<!--":
            stop = page.find("-->", at)
            at = len(page) if stop < 0 else stop + 3
            continue
        name = (m[2] or "").lower()
        closes, attributes = bool(m[1]), m[3] or ""
        if not name:
            continue
        if name in _RAW:
            if not closes:
                stop = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = stop.end() if stop else len(page)
            parts.append(" ")
            continue
        if name in _DROPPED:
            if not closes and not (name == "svg" and attributes.endswith("/")):
                if name not in ends:
                    ends[name] = _ends(page, name)
                stop = ends[name].get(look)
                at, dropping = (stop, dropping) if stop else (at, name)
            elif name == dropping:
                dropping = ""
            parts.append(" ")
            continue
        if name == "a":
            in_link, in_linked = not closes and bool(_HREF.search(attributes)), 0
        if name not in _BLOCKS:
            if name in ("br", "td", "th", "input", "img"):
                parts.append(" ")
            continue
        if labelled and name == "x-label":
            end()
            label = int(attributes)
            continue
        end()
        dropping = ""
        if closes:
            if in_link and in_linked:
                in_linked -= 1
            else:
                in_link = False
        elif in_link:
            # a link goes on into a block only if it is closed before the next one
            if anchors is None:
                anchors = [(x.start(), x[1] == "/") for x in _ANCHOR.finditer(page)]
            after = bisect.bisect_left(anchors, (at, False))
            in_link = after < len(anchors) and anchors[after][1]
            in_linked += 1
        if closes:
            kind = "body"
            if name in _BOXES and opened[name]:
                top = ""
                while top != name:
                    top = stack.pop().tag
                    opened[top] -= 1
                box = stack[-1] if stack else base
        else:
            kind = name
            if name in _BOXES:
                if name == "body":
                    while opened["head"]:
                        opened[stack.pop().tag] -= 1
                    box = stack[-1] if stack else base
                box = box.opened(name, attributes, told)
                told += box.told == told
                stack.append(box)
                opened[name] += 1
            elif name == "title":
                box = head
        if name == "title" and closes:
            box = stack[-1] if stack else base
    end()
    return out


#: Features in their order: words and link density of the block and its neighbours first.
FEATURES = ["words", "density", "words before", "density before", "words after", "density after", "p", "h", "li", *(f"<{s}>" for s in _SAYS), *(f".{s}" for s in _SAYS[:8]), "named", "named in passing", "named around", "comments around", "share", "words in box", "article elsewhere"]


def table(found: list[Block]) -> np.ndarray:
    """Words and link density of the block, the one before and the one after; the kind; what elements and names around say.

    The last: how many of the page's words out of links, and which share of them, are in the outermost box of a plain
    name around the block; whether an article (by element) has words, and the block isn't in one.
    """
    n = len(found)
    words = np.array([0, *(b.words for b in found), 0], float)
    linked = np.array([0, *(b.linked for b in found), 0], float)
    density = linked / np.maximum(words, 1)
    told = np.array([b.box.told for b in found], np.int64)
    plain = (words - linked)[1:-1]
    inside = np.bincount(told + 1, plain, max(told.max(initial=0) + 2, 1))
    boxed = np.where(told < 0, 0, inside[told + 1])
    tags = np.array([b.box.tags for b in found], np.int64)
    elsewhere = (tags & _ARTICLE == 0) & bool((tags & _ARTICLE > 0).any())
    bits = lambda values, k: (np.array(values, np.int64).reshape(n, 1) >> np.arange(k)) & 1
    rest = np.array([[bool(b.box.names), bool(b.box.passing), bool(b.box.around), bool(b.box.around & _COMMENT)] for b in found], float).reshape(n, 4)
    kind = np.array([b.kind for b in found])[:, None] == np.arange(1, 4)
    return np.column_stack([words[1:-1], density[1:-1], words[:-2], density[:-2], words[2:], density[2:], kind, bits(tags, len(_SAYS)), bits([b.box.names for b in found], 8), rest, boxed / max(1.0, plain.sum()), boxed, elsewhere])


class Tree:
    """A binary tree by Gini impurity: rows of (feature, cut, left, right) or (-1, answer, 0, 0)."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 12, least: int = 4) -> None:
        self.rows: list[list[float]] = []
        self._grow(x, y, depth, least)
        self.table = np.array(self.rows)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, least: int) -> int:
        at = len(self.rows)
        self.rows.append([-1, float(y.mean() > 0.5), 0, 0])
        best = (1e-9, -1, 0.0)
        if depth and 0 < y.mean() < 1:
            whole = len(y) * y.mean() * (1 - y.mean())
            for k in range(x.shape[1]):
                order = np.argsort(x[:, k], kind="stable")
                v, ones = x[order, k], np.cumsum(y[order])
                n = np.arange(1, len(y) + 1)
                left, right = ones * (1 - ones / n), (ones[-1] - ones) * (1 - (ones[-1] - ones) / np.maximum(len(y) - n, 1))
                ok = np.zeros(len(y), bool)
                ok[:-1] = v[1:] > v[:-1]
                ok &= (n >= least) & (len(y) - n >= least)
                if ok.any():
                    gain = np.where(ok, whole - left - right, -1)
                    i = int(gain.argmax())
                    if gain[i] > best[0]:
                        best = (float(gain[i]), k, float(v[i] + v[i + 1]) / 2)
        if best[1] >= 0:
            side = x[:, best[1]] <= best[2]
            left = self._grow(x[side], y[side], depth - 1, least)
            right = self._grow(x[~side], y[~side], depth - 1, least)
            self.rows[at] = [best[1], best[2], left, right]
        return at

    def __call__(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), int)
        while True:
            t = self.table[node]
            inner = t[:, 0] >= 0
            if not inner.any():
                return t[:, 1] > 0.5
            low = x[np.arange(len(x)), np.maximum(t[:, 0], 0).astype(int)] <= t[:, 1]
            node = np.where(inner, np.where(low, t[:, 2], t[:, 3]).astype(int), node)


def rows_of(made: list[list[tuple[int, str]]]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of all blocks of labelled pages."""
    x, y = [], []
    for page in made:
        found = blocks("".join(f"<x-label {label}>{fragment}" for label, fragment in page), labelled=True)
        x.append(table(found))
        y += [b.label for b in found]
    return np.concatenate(x), np.array(y, float)


@functools.cache
def model() -> Tree:
    return Tree(*rows_of(pages()))


def main_text(page: str, tree: Tree | None = None) -> str:
    found = blocks(page)
    if not found:
        return ""
    return "\n".join(b.text for b, main in zip(found, (tree or model())(table(found)), strict=True) if main)


def extract(web: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of web (page_id, url, html)."""
    tree = model()  # grown here; its table goes with the task

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(x or "", tree) for x in batch.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), texts], ["page_id", "url", "text"])

    out = lean(web).select("page_id", "url", "html").mapInArrow(trimmed(read), "page_id bigint, url string, text string")
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
