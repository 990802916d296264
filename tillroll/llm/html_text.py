"""Main text of web pages from flat text blocks.

A page is cut at its block elements into a flat list of text blocks. Each block has its
word count and link density, those of its neighbours, and whether it stands in the page's
main element or in a part such as navigation, by element or class name. A decision tree
trained on the small labelled table below tells content from the rest. One arrow_udf does
a whole page at a time; nothing is shuffled.

Markup that is broken off or never closed is read as far as it goes. A null or empty page
has an empty text. White space in a block becomes one space; blocks are joined by \\n in
page order; nothing is cut. A form that holds most of the page's text is no part of its own.
Equal pages give equal texts, other columns pass through.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of HTML: elements whose content is not text of the page, elements that
# don't interrupt a line of text, elements without content.
SILENT = (
    "script|style|textarea|title|noscript|template|svg|iframe|select|canvas|annotation-xml|annotation"
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark "
    "object param q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    # formulas
    "math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom "
    "mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder "
    "munderover none semantics".split()
)
HEAD = frozenset("html head base basefont bgsound link meta noframes".split())
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
MAIN = frozenset(["article", "main"])
SIDE = frozenset("nav footer aside dialog menu button head".split())
FORMS = frozenset(["form", "fieldset"])
# Elements that are text themselves: a name on them is an anchor or a style, not a part.
TEXT = frozenset("h1 h2 h3 h4 h5 h6 p figure figcaption blockquote pre".split())
# Names that sites give to parts around the text (in class, id or role).
SIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar masthead topbar "
    "header footer sidebar side aside widget related recommended share sharing social "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "newsletter subscribe subscription signup login search form copyright legal disclaimer "
    "comment comments disqus respond reply replies discussion complementary contentinfo".split()
)
# Of these, adverts, which a paragraph's class may mark as well.
ADVERTS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo".split())
# Of these, parts that hold the articles of others.
COMMENTS = frozenset("comment comments disqus respond reply replies discussion".split())
# Words beside a side word that leave it the name's meaning, and words that change it.
PLAIN = frozenset(
    "box wrap wrapper container area block section list item items inner outer slot unit bar "
    "panel group link links button buttons icon icons post posts article articles".split()
)
# Side words that are common words too: at the end of a name they count after these only.
COMMON = frozenset(
    "share sharing legal search form side notice notices alert comment discussion reply replies "
    "copyright banner promotion subscription related recommended disclaimer".split()
)
PLACES = frozenset("site page main top bottom left right user blog entry content js".split())
STATES = frozenset("no not non has have with without and or hide free long".split())

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)"
    r"""|<svg(?![^\s/>])(?:[^>"']++|"[^"]*+"|'[^']*+')*+(?<=/)>"""
    rf"|<(?P<silent>{SILENT})(?![^\s/>])[^>]*+>.*?(?:</(?P=silent)\s*+>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*+)"
    r"""(?P<attributes>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"|<[/!?a-z][^>]*+(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

FEATURES = (
    "words", "density", "words_before", "density_before", "words_after", "density_after",
    "in_main", "in_side", "page_has_main",
)
# Labelled blocks: the features, and whether the block is content.
LABELLED = (
    # parts around the text, whatever they hold
    (6, 1.0, 0, 0.0, 5, 1.0, 0, 1, 1, False), (1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 1, False),
    (40, 0.0, 6, 1.0, 12, 0.0, 0, 1, 1, False), (9, 0.0, 80, 0.0, 0, 0.0, 0, 1, 1, False),
    (30, 0.1, 90, 0.0, 40, 0.0, 1, 1, 1, False), (120, 0.0, 60, 0.0, 60, 0.0, 1, 1, 1, False),
    (3, 0.0, 0, 0.0, 70, 0.0, 1, 1, 1, False), (25, 0.3, 14, 0.5, 6, 1.0, 0, 1, 0, False),
    (90, 0.0, 30, 0.0, 80, 0.0, 0, 1, 0, False), (2, 1.0, 3, 1.0, 2, 1.0, 0, 1, 0, False),
    (15, 0.0, 60, 0.0, 1, 1.0, 1, 1, 1, False), (220, 0.02, 3, 0.0, 5, 0.4, 0, 1, 1, False),
    # text of the main element, long or short
    (8, 0.0, 5, 1.0, 60, 0.0, 1, 0, 1, True), (1, 0.0, 40, 0.0, 35, 0.0, 1, 0, 1, True),
    (1, 0.0, 0, 0.0, 0, 0.0, 1, 0, 1, True), (2, 0.0, 1, 0.0, 1, 0.0, 1, 0, 1, True),
    (80, 0.05, 60, 0.0, 90, 0.1, 1, 0, 1, True), (400, 0.0, 8, 0.0, 200, 0.0, 1, 0, 1, True),
    (30, 0.4, 50, 0.0, 45, 0.0, 1, 0, 1, True), (4, 0.0, 70, 0.0, 9, 0.0, 1, 0, 1, True),
    (12, 0.6, 80, 0.0, 60, 0.1, 1, 0, 1, True), (5, 0.0, 3, 0.0, 10, 1.0, 1, 0, 1, True),
    (5, 1.0, 80, 0.0, 70, 0.0, 1, 0, 1, True), (20, 0.0, 4, 1.0, 4, 1.0, 1, 0, 1, True),
    # lists of links in the main element
    (4, 1.0, 5, 1.0, 6, 1.0, 1, 0, 1, False), (9, 1.0, 6, 1.0, 8, 1.0, 1, 0, 1, False),
    (3, 0.9, 3, 0.9, 2, 0.9, 1, 0, 1, False), (12, 1.0, 9, 0.9, 11, 1.0, 1, 0, 1, False),
    # outside of the page's main element
    (6, 0.0, 5, 1.0, 60, 0.0, 0, 0, 1, False), (60, 0.0, 80, 0.0, 12, 0.0, 0, 0, 1, False),
    (3, 1.0, 3, 1.0, 3, 1.0, 0, 0, 1, False), (1, 0.0, 0, 0.0, 4, 0.0, 0, 0, 1, False),
    (200, 0.0, 6, 0.0, 6, 0.0, 0, 0, 1, False), (25, 0.2, 90, 0.0, 30, 0.0, 0, 0, 1, False),
    # pages without a main element: long text, or short text among long
    (60, 0.0, 6, 0.0, 80, 0.0, 0, 0, 0, True), (45, 0.1, 70, 0.0, 5, 1.0, 0, 0, 0, True),
    (20, 0.0, 3, 1.0, 4, 0.0, 0, 0, 0, True), (300, 0.0, 2, 1.0, 2, 1.0, 0, 0, 0, True),
    (4, 0.0, 60, 0.0, 40, 0.0, 0, 0, 0, True), (8, 0.0, 2, 1.0, 70, 0.0, 0, 0, 0, True),
    (6, 0.0, 55, 0.0, 4, 0.0, 0, 0, 0, True), (18, 0.1, 20, 0.0, 30, 0.0, 0, 0, 0, True),
    (2, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, True), (5, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, True),
    (9, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, True), (14, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, True),
    (35, 0.2, 4, 0.0, 25, 0.1, 0, 0, 0, True), (16, 0.0, 16, 0.0, 16, 0.0, 0, 0, 0, True),
    # ... and what surrounds it
    (5, 0.0, 4, 0.0, 3, 0.0, 0, 0, 0, False), (2, 1.0, 2, 1.0, 2, 1.0, 0, 0, 0, False),
    (9, 0.9, 60, 0.0, 8, 0.9, 0, 0, 0, False), (30, 0.8, 4, 1.0, 60, 0.0, 0, 0, 0, False),
    (7, 0.0, 3, 1.0, 5, 1.0, 0, 0, 0, False), (14, 0.6, 40, 0.0, 12, 0.7, 0, 0, 0, False),
    (1, 0.0, 0, 0.0, 2, 0.0, 0, 0, 0, False), (3, 1.0, 70, 0.0, 50, 0.0, 0, 0, 0, False),
)


@dataclass(frozen=True)
class Node:
    feature: int
    most: float
    low: Node | bool  # for values up to `most`
    high: Node | bool


def _impurity(labels: np.ndarray) -> float:
    share = labels.mean()
    return len(labels) * share * (1 - share)


def train_tree(rows: np.ndarray, labels: np.ndarray, depth: int = 12) -> Node | bool:
    """A tree that splits, each time, where the Gini impurity falls most."""
    if depth == 0 or labels.all() or not labels.any():
        return bool(labels.mean() >= 0.5)
    best = None
    for feature in range(rows.shape[1]):
        values = np.unique(rows[:, feature])
        for most in (values[1:] + values[:-1]) / 2:
            low = rows[:, feature] <= most
            score = _impurity(labels[low]) + _impurity(labels[~low])
            if best is None or score < best[0] - 1e-12:
                best = (score, feature, most, low)
    if best is None:
        return bool(labels.mean() >= 0.5)
    _, feature, most, low = best
    return Node(
        feature,
        float(most),
        train_tree(rows[low], labels[low], depth - 1),
        train_tree(rows[~low], labels[~low], depth - 1),
    )


@lru_cache(maxsize=1)
def block_tree() -> Node | bool:
    table = np.array(LABELLED, dtype=float)
    return train_tree(table[:, :-1], table[:, -1] > 0)


def is_content(tree: Node | bool, features: tuple) -> bool:
    while isinstance(tree, Node):
        tree = tree.low if features[tree.feature] <= tree.most else tree.high
    return tree


# How far a block is in a part around the text: in an article inside a part that only its name
# marks, which counts if the page has other main text; in a part marked by its name; in one
# marked otherwise, or under comments.
CLEAR, DOUBTFUL, NAMED, FIRM = range(4)


def _side_word(name: str, in_main: bool) -> str | None:
    """The side word that a class, id or role says it is: the whole name, its last part, or the
    first beside plain words. A header in the main part is a title, as the element is."""
    parts = [p.lower() for p in NAME_PARTS.findall(name)]
    if not parts or not STATES.isdisjoint(parts):
        return None
    word = parts[0] if PLAIN.issuperset(parts[1:]) else parts[-1]
    before = frozenset(parts[:-1])
    if word in COMMON and word != parts[0] and not before <= PLAIN | PLACES | SIDE_NAMES:
        return None
    return word if word in SIDE_NAMES and not (word == "header" and in_main) else None


def _marks(name: str, attributes: str, in_main: bool) -> tuple[bool, int]:
    """Does the element open the main part, or a part around it?"""
    side = FIRM if name in SIDE or (name == "header" and not in_main) else CLEAR
    main = name in MAIN
    if attributes:
        for key, value in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'")
            if key == "style":
                hidden = "display:none" in value.replace(" ", "").lower()
                side = FIRM if hidden else side
            elif key in ("hidden", "aria-hidden"):
                side = FIRM if value.lower() != "false" else side
            elif name not in ("html", "body"):
                main |= key == "role" and "main" in value.lower().split()
                anchor = key == "id" and name == "section" and in_main
                if name not in MAIN and name not in TEXT and not anchor:
                    words = {_side_word(v, in_main) for v in value.split()} - {None}
                    if words:
                        side = max(side, NAMED if COMMENTS.isdisjoint(words) else FIRM)
                elif name == "p" and key == "class":
                    words = {_side_word(v, in_main) for v in value.split()}
                    side = side if ADVERTS.isdisjoint(words) else max(side, NAMED)
    return main, CLEAR if main and side == NAMED else side


def blocks(page: str) -> list[tuple[str, float, bool, bool]]:
    """Text, link density, and whether it is in the main part or in one around it."""
    out: list[tuple[str, float, bool, int, int]] = []
    # element, in main, how far in a part around it, number of the outermost form (0: none)
    open_: list[tuple[str, bool, int, int]] = []
    pieces: list[str] = []
    linked = links = last = forms = buttons = 0

    def close_block():
        nonlocal linked
        words = html.unescape("".join(pieces)).split() if pieces else ()
        if words:
            _, main, side, form = open_[-1] if open_ else ("", False, CLEAR, 0)
            out.append((" ".join(words), min(1.0, linked / len(words)), main, side, form))
        pieces.clear()
        linked = 0

    def leave_head():
        if open_ and open_[-1][0] == "head":
            open_.pop()

    def add(text: str):
        nonlocal linked
        if text:
            if not text.isspace():
                leave_head()
            pieces.append(text)
            if links:
                linked += len(text.split())

    for token in TOKEN.finditer(page):
        add(page[last : token.start()])
        last = token.end()
        name = token["name"]
        if name is None:
            continue
        name = name.lower()
        if not token["end"] and name not in HEAD:
            leave_head()
        if name in INLINE:
            if name == "a":
                links = 0 if token["end"] else 1
            elif name == "br":
                pieces.append(" ")
            continue
        if name == "button" and (buttons if token["end"] else any(not p.isspace() for p in pieces)):
            buttons += -1 if token["end"] else 1  # within a line of text
            continue
        close_block()
        links = buttons = 0
        if name in VOID:
            continue
        if token["end"]:
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] == name:
                    del open_[i:]
                    break
            continue
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and open_ and open_[-1][0] == name:
            open_.pop()
        elif open_ and open_[-1][0] == "p":
            open_.pop()
        _, main, side, form = open_[-1] if open_ else ("", False, CLEAR, 0)
        if name in FORMS and not form:
            forms += 1
            form = forms
        opens_main, opens_side = _marks(name, token["attributes"], main)
        if opens_main and side < FIRM:
            side = min(side, DOUBTFUL) if name == "article" else CLEAR
        open_.append((name, main or opens_main, max(side, opens_side), form))
    add(page[last:])
    close_block()
    around = _around_the_page(out)
    out = [(*block, side if form in around else FIRM) for *block, side, form in out]
    clear = any(main and side == CLEAR for _, _, main, side in out)
    most = CLEAR if clear else DOUBTFUL
    return [(text, density, main, side > most) for text, density, main, side in out]


def _around_the_page(found: list[tuple[str, float, bool, int, int]]) -> set[int]:
    """Forms that are no part of the page but hold it: more than half of the words that are
    neither linked nor in a part around the text. 0 stands for no form."""
    words: dict[int, float] = {0: 0.0}
    for text, density, _, side, form in found:
        if side < NAMED:
            words[form] = words.get(form, 0.0) + (text.count(" ") + 1) * (1 - density)
    total = sum(words.values())
    return {0} | {form for form, n in words.items() if 2 * n > total}


def main_text(page: str | None, tree: Node | bool | None = None) -> str:
    found = blocks(page) if page else []
    if not found:
        return ""
    tree = block_tree() if tree is None else tree
    has_main = any(main and not side for _, _, main, side in found)
    sizes = [(t.count(" ") + 1, d) for t, d, _, _ in found]
    around = [(0, 0.0), *sizes, (0, 0.0)]
    return "\n".join(
        text
        for i, (text, density, main, side) in enumerate(found)
        if is_content(tree, (*sizes[i], *around[i], *around[i + 2], main, side, has_main))
    )


def extract(page: Column) -> Column:
    """The main text of each page."""

    def texts(pages: pa.Array) -> pa.Array:
        tree = block_tree()
        return pa.array([main_text(p, tree) for p in pages.to_pylist()], pa.string())

    return F.arrow_udf(texts, "string")(page)
