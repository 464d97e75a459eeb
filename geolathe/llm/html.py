"""Main text of web pages from flat text blocks, classified by a decision tree.

A page becomes a flat list of text blocks. A block has its word count and link density, those of its neighbours, and
whether the containers around it mark it as content or as trimmings. A decision tree, trained on the small labelled table
below, keeps or drops each block; kept blocks are joined by line breaks. Marks decide where a page has them; blocks
without a mark, and links in a marked article, are told apart by words and links of the block and its neighbours.

Marks come from elements and from whole class, id and role names: a compound counts only if all its parts are known, so
'cookie-banner' is a mark and 'with-sidebar' or 'share-price' is not. A named container that holds the page's article or
main element, or most of the words of a page without one, is a wrapper and marks nothing; main and article set the mark
back below a name, but not below an aside, a menu or comments. Reading takes time in proportion to the page: a tag that is
not closed before the next one is text, and end tags without an open element cost nothing.

Defined results: null or empty html has an empty text; broken markup is read as far as it goes; repeated rows are
extracted each; an empty table gives no rows; of a skipped element without an end only the tag is skipped, but for
raw text, which goes to the end of the page; a head's tags only end a block; other columns stay, but for ``text``, which is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Elements by what they do to the flow of text.
SKIPPED = "script style noscript template title svg button select textarea iframe object canvas audio video map".split()
RAW = "script style textarea".split()
NESTED = "template svg object".split()
BLOCKS = "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
CONTAINERS = "article aside blockquote body details dialog div dl fieldset figure footer form header main menu nav ol section table ul span p".split()
CONTENT = "article main".split()
TRIMMINGS = "nav aside footer form dialog menu".split()
# Parts of names.
CONTENT_NAMES = frozenset("article content post entry story main body text".split())
COMMENT_NAMES = frozenset("comment comments reply replies respond disqus".split())
TRIMMINGS_NAMES = frozenset("promo promos promotion sponsor sponsors banner cookie cookies consent gdpr notice notices alert popup modal overlay sidebar widget widgets nav navbar navigation breadcrumb breadcrumbs related recommended share sharing social subscribe subscription newsletter signup pagination pager menu dialog complementary contentinfo".split())
#: Names that in an article's own parts mean its subject or its head as often.
WEAK_NAMES = frozenset("header footer masthead side search login tags toolbar legal copyright discussion discussions".split())
ADVERT_NAMES = frozenset("ad ads advert adverts advertisement advertisements advertising sponsored".split())
#: What may stand beside them in a compound.
NEUTRAL_NAMES = frozenset("site page top bottom left right box block wrap wrapper container inner outer list section area bar button buttons link links item items group panel col column row unit slot module form icon icons media primary secondary global local mobile desktop user users posts articles stories news blog more count thread reader readers feed policy message fixed sticky small large first last js".split())

_ATTRS = r"(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^<>]*+>|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>{_ATTRS})>|(?P<text>[^<]++|<)",
    re.S | re.I,
)
# the tags of one element, past comments and raw text
_TAGS = {
    n: re.compile(rf"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|textarea)(?=[\s/>]){_ATTRS}>.*?(?:</(?P=raw)(?=[\s/>])|\Z)|<(?P<end>/?){n}(?=[\s/>])(?P<attrs>{_ATTRS})>", re.S | re.I)
    for n in SKIPPED if n not in RAW
}
_RAW_END = {n: re.compile(rf"</{n}(?=[\s/>])[^<>]*+>", re.I) for n in RAW}
_NAMES = re.compile(r"(?<![\w-])(class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++))", re.I)
_PARTS = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")
_BLOCK, _BOX = frozenset(BLOCKS), frozenset(CONTAINERS)
#: What a container says of its inside: content or trimmings by its element or by its name.
NONE, ARTICLE, MAIN, CONTENT_NAME, TRIMMINGS_ELEMENT, HEADER, FORM, NAMED, WEAKLY_NAMED, COMMENTS = range(10)


@lru_cache(4096)
def kind_of(token: str) -> int:
    """What one class, id or role name says."""
    parts = [x.lower() for x in _PARTS.split(token) if x and not x.isdigit()]
    if not parts:
        return NONE
    if parts[0] in ADVERT_NAMES or parts[-1] in ADVERT_NAMES:
        return NAMED
    known = {k for k, names in ((CONTENT_NAME, CONTENT_NAMES), (COMMENTS, COMMENT_NAMES), (NAMED, TRIMMINGS_NAMES), (WEAKLY_NAMED, WEAK_NAMES)) for x in parts if x in names}
    if any(x not in NEUTRAL_NAMES and x not in CONTENT_NAMES and x not in COMMENT_NAMES and x not in TRIMMINGS_NAMES and x not in WEAK_NAMES for x in parts):
        return NONE
    return max(known - {CONTENT_NAME}, default=CONTENT_NAME if known else NONE)


def _said(name: str, attrs: str) -> int:
    """What a container's tag says."""
    kinds = set()
    for key, a, b, c in _NAMES.findall(attrs) if attrs else ():
        kinds |= {k if key.lower() != "id" or k in (COMMENTS, CONTENT_NAME, NONE) else WEAKLY_NAMED for k in map(kind_of, (a or b or c).split())}
    if name in ("body", "html"):
        return NONE
    if COMMENTS in kinds and name != "main":
        return COMMENTS
    if name in TRIMMINGS:
        return FORM if name == "form" else TRIMMINGS_ELEMENT
    if name in CONTENT:
        return MAIN if name == "main" else ARTICLE
    if NAMED in kinds:
        return NAMED
    if name == "header":
        return HEADER
    return WEAKLY_NAMED if WEAKLY_NAMED in kinds and name not in ("p", "span") else CONTENT_NAME if CONTENT_NAME in kinds else NONE


COLUMNS = ["words", "words_before", "words_after", "links", "links_before", "links_after", "inside", "outside", "heading", "page_inside"]
# The labelled table. COLUMNS and 1 for main text, 0 for trimmings.
LABELLED = [
    # paragraphs, headings and short lines of a marked article
    (80, 9, 65, 0.0, 0.0, 0.0, 1, 0, 0, 1, 1), (9, 14, 80, 0.0, 0.0, 0.0, 1, 0, 1, 1, 1), (3, 80, 41, 0.0, 0.0, 0.0, 1, 0, 0, 1, 1), (1, 30, 120, 0.0, 0.0, 0.0, 1, 0, 0, 1, 1),
    (140, 3, 2, 0.05, 0.0, 0.0, 1, 0, 0, 1, 1), (2, 140, 12, 0.0, 0.05, 1.0, 1, 0, 0, 1, 1), (25, 12, 0, 0.4, 0.0, 0.0, 1, 0, 0, 1, 1), (6, 5, 7, 0.0, 0.0, 0.0, 1, 0, 0, 1, 1),
    (4, 60, 60, 1.0, 0.0, 0.0, 1, 0, 0, 1, 1), (12, 1, 1, 0.0, 1.0, 1.0, 1, 0, 1, 1, 1), (55, 1, 11, 0.1, 1.0, 1.0, 1, 0, 0, 1, 1), (5, 0, 33, 0.0, 0.0, 0.0, 1, 0, 1, 1, 1),
    # menus, headers, footers, sidebars, notices, adverts, forms and comments in marked containers
    (1, 1, 1, 1.0, 1.0, 1.0, 0, 1, 0, 1, 0), (2, 0, 1, 1.0, 0.0, 1.0, 0, 1, 0, 1, 0), (11, 1, 9, 0.0, 1.0, 0.0, 0, 1, 0, 1, 0), (14, 60, 0, 0.2, 0.0, 0.0, 0, 1, 0, 1, 0),
    (38, 75, 20, 0.0, 0.0, 0.0, 0, 1, 0, 1, 0), (90, 12, 44, 0.0, 0.0, 0.0, 0, 1, 0, 1, 0), (5, 90, 30, 0.0, 0.0, 0.0, 0, 1, 1, 1, 0), (3, 3, 3, 0.0, 0.0, 0.0, 0, 1, 0, 1, 0),
    (22, 4, 4, 0.5, 1.0, 1.0, 0, 1, 0, 0, 0), (7, 70, 0, 0.0, 0.0, 0.0, 0, 1, 0, 0, 0), (60, 8, 9, 0.0, 0.0, 0.0, 0, 1, 0, 0, 0), (4, 2, 2, 1.0, 1.0, 1.0, 0, 1, 0, 0, 0),
    # the same before and after long blocks: menus above an article, a notice, a single reply, a form, a footer below
    (1, 0, 80, 1.0, 0.0, 0.0, 0, 1, 0, 1, 0), (1, 1, 120, 1.0, 1.0, 0.0, 0, 1, 0, 1, 0), (4, 2, 95, 0.0, 1.0, 0.0, 0, 1, 0, 1, 0), (5, 0, 60, 0.0, 0.0, 0.0, 0, 1, 0, 1, 0),
    (2, 110, 75, 0.0, 0.0, 0.0, 0, 1, 0, 1, 0), (17, 45, 90, 0.1, 0.0, 0.0, 0, 1, 0, 1, 0), (60, 80, 70, 0.0, 0.0, 0.0, 0, 1, 0, 1, 0), (33, 3, 140, 0.0, 0.0, 0.0, 0, 1, 1, 1, 0),
    (1, 0, 70, 1.0, 0.0, 0.0, 0, 1, 0, 0, 0), (3, 1, 85, 0.0, 1.0, 0.0, 0, 1, 0, 0, 0), (12, 60, 65, 0.0, 0.0, 0.0, 0, 1, 0, 0, 0), (90, 70, 100, 0.0, 0.0, 0.0, 0, 1, 0, 0, 0),
    (6, 130, 55, 0.5, 0.0, 0.0, 0, 1, 1, 0, 0), (25, 0, 90, 0.0, 0.0, 0.0, 0, 1, 0, 0, 0), (150, 30, 20, 0.0, 0.0, 0.0, 0, 1, 0, 0, 0), (8, 9, 120, 1.0, 1.0, 0.0, 0, 1, 0, 0, 0),
    # lists of links in a marked article, and single links and short lines that belong to its text
    (3, 4, 3, 1.0, 1.0, 1.0, 1, 0, 0, 1, 0), (5, 3, 4, 1.0, 1.0, 1.0, 1, 0, 0, 1, 0), (2, 2, 2, 1.0, 1.0, 1.0, 1, 0, 0, 1, 0), (7, 6, 8, 1.0, 1.0, 1.0, 1, 0, 0, 1, 0),
    (3, 40, 35, 1.0, 0.0, 0.1, 1, 0, 0, 1, 1), (9, 22, 1, 0.8, 0.1, 0.0, 1, 0, 0, 1, 1), (2, 4, 70, 0.0, 0.0, 0.0, 1, 0, 0, 1, 1), (15, 14, 16, 0.3, 0.2, 0.4, 1, 0, 0, 1, 1),
    (4, 5, 6, 0.0, 0.0, 0.0, 1, 0, 0, 1, 1), (1, 1, 1, 0.0, 0.0, 0.0, 1, 0, 0, 1, 1), (8, 90, 0, 0.0, 0.0, 0.0, 1, 0, 0, 1, 1), (4, 1, 60, 1.0, 1.0, 0.0, 1, 0, 1, 1, 1),
    # unmarked blocks of a page that marks its content
    (12, 2, 40, 0.0, 1.0, 0.0, 0, 0, 0, 1, 0), (6, 70, 8, 0.3, 0.0, 0.0, 0, 0, 0, 1, 0), (30, 2, 2, 0.0, 1.0, 1.0, 0, 0, 0, 1, 0), (4, 1, 9, 0.0, 1.0, 0.0, 0, 0, 1, 1, 0),
    (45, 60, 10, 0.0, 0.0, 0.0, 0, 0, 0, 1, 0), (18, 40, 3, 0.9, 0.0, 1.0, 0, 0, 0, 1, 0),
    (4, 1, 90, 0.0, 1.0, 0.0, 0, 0, 0, 1, 0), (60, 10, 90, 0.0, 0.0, 0.0, 0, 0, 0, 1, 0), (2, 0, 110, 1.0, 0.0, 0.0, 0, 0, 0, 1, 0), (70, 80, 55, 0.0, 0.0, 0.0, 0, 0, 0, 1, 0),
    # unmarked blocks of a page without marks: word count and link density of the block and its neighbours
    (70, 8, 55, 0.0, 0.0, 0.0, 0, 0, 0, 0, 1), (55, 70, 30, 0.05, 0.0, 0.0, 0, 0, 0, 0, 1), (28, 55, 61, 0.1, 0.0, 0.0, 0, 0, 0, 0, 1), (8, 1, 70, 0.0, 1.0, 0.0, 0, 0, 1, 0, 1),
    (5, 62, 48, 0.0, 0.0, 0.1, 0, 0, 0, 0, 1), (19, 44, 3, 0.0, 0.0, 0.8, 0, 0, 0, 0, 1), (33, 2, 2, 0.2, 1.0, 1.0, 0, 0, 0, 0, 1), (7, 38, 90, 0.0, 0.0, 0.0, 0, 0, 1, 0, 1),
    (3, 0, 85, 1.0, 0.0, 0.0, 0, 0, 0, 0, 0), (1, 1, 60, 1.0, 1.0, 0.0, 0, 0, 0, 0, 0), (2, 1, 130, 1.0, 1.0, 0.0, 0, 0, 0, 0, 0), (8, 2, 75, 0.9, 1.0, 0.0, 0, 0, 0, 0, 0),
    (48, 80, 4, 0.0, 0.0, 0.5, 0, 0, 0, 0, 1), (12, 66, 71, 0.3, 0.0, 0.0, 0, 0, 0, 0, 1), (90, 2, 4, 0.0, 1.0, 1.0, 0, 0, 0, 0, 1), (26, 30, 28, 0.1, 0.1, 0.0, 0, 0, 0, 0, 1),
    (2, 1, 2, 1.0, 1.0, 1.0, 0, 0, 0, 0, 0), (6, 3, 5, 0.8, 1.0, 1.0, 0, 0, 0, 0, 0), (40, 5, 6, 0.9, 1.0, 1.0, 0, 0, 0, 0, 0), (3, 2, 4, 0.0, 1.0, 1.0, 0, 0, 0, 0, 0),
    # headings and leads below a menu, and closing lines below links
    (5, 2, 66, 0.0, 1.0, 0.0, 0, 0, 1, 0, 1), (4, 1, 35, 0.0, 1.0, 0.0, 0, 0, 1, 0, 1), (7, 2, 48, 0.0, 1.0, 0.0, 0, 0, 1, 0, 1), (9, 1, 81, 0.0, 1.0, 0.0, 0, 0, 1, 0, 1), (3, 2, 27, 0.0, 1.0, 0.0, 0, 0, 1, 0, 1), (6, 3, 90, 0.0, 1.0, 0.0, 0, 0, 0, 0, 1),
    (8, 4, 0, 0.0, 1.0, 0.0, 0, 0, 0, 0, 0), (11, 5, 0, 0.0, 1.0, 0.0, 0, 0, 0, 0, 0), (17, 3, 0, 0.0, 1.0, 0.0, 0, 0, 0, 0, 0), (9, 6, 2, 0.0, 1.0, 0.0, 0, 0, 0, 0, 0),
    (5, 4, 3, 0.0, 0.0, 0.0, 0, 0, 0, 0, 0), (9, 3, 2, 0.5, 0.0, 1.0, 0, 0, 0, 0, 0), (4, 35, 2, 0.6, 0.0, 1.0, 0, 0, 0, 0, 0), (7, 2, 0, 0.0, 1.0, 0.0, 0, 0, 0, 0, 0),
]


def _closed(html: str, name: str) -> dict[int, int]:
    """Where the elements of a name end, by where their tags start: of those that do."""
    out: dict[int, int] = {}
    opened: list[int] = []
    for m in _TAGS[name].finditer(html):
        if m["end"] is None:
            continue
        if m["end"]:
            if opened:
                out[opened.pop()] = m.end()
        elif m["attrs"].endswith("/"):
            out[m.start()] = m.end()
        else:
            if name not in NESTED:
                opened.clear()  # an element that cannot hold its like has been left open
            opened.append(m.start())
    return out


def blocks(html: str) -> tuple[list[str], list[tuple]]:
    """The text blocks of a page, and (words, links, inside, outside, heading) of each."""
    texts: list[str] = []
    facts: list[tuple] = []
    own: list[int] = []  # each block's container
    boxes = [[0, NONE, 0, False, 0, 0]]  # containers: the one around, what it says, articles and mains so far, whether it holds any, words, blocks
    stack: list[tuple[str, int]] = [("", 0)]
    opened: dict[str, int] = {}  # how many of a name are open
    parts: list[str] = []
    linked, anchors, heading, contents = 0, 0, 0, 0

    def close() -> None:
        nonlocal linked
        if parts:
            words = unescape("".join(parts)).split()
            if words:
                box = boxes[stack[-1][1]]
                box[4] += len(words)
                box[5] += 1
                own.append(stack[-1][1])
                texts.append(" ".join(words))
                facts.append((len(words), min(1.0, linked / len(words)), heading))
            parts.clear()
        linked = 0

    def leave() -> None:
        name, box = stack.pop()
        opened[name] -= 1
        boxes[box][3] = contents > boxes[box][2]

    at = 0
    ends_of: dict[str, dict[int, int]] = {}
    while m := _TOKEN.match(html, at):
        at = m.end()
        text = m["text"]
        if text is not None:
            parts.append(text)
            if anchors:
                linked += len(unescape(text).split())
            continue
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        ends = bool(m["end"])
        if name == "head":
            close()
            continue
        if name in RAW and not ends:
            end = _RAW_END[name].search(html, at)
            at = end.end() if end else len(html)
            continue
        if name in SKIPPED and not ends:
            if name not in ends_of:
                ends_of[name] = _closed(html, name)
            at = ends_of[name].get(m.start(), at)
            if name == "title":
                close()
            continue
        if name == "br":
            parts.append("\n")
            continue
        if name == "a":
            anchors = max(0, anchors + (-1 if ends else 1))
            continue
        if name not in _BLOCK and name != "span":
            continue
        said = _said(name, m["attrs"]) if name in _BOX and not ends else NONE
        boxed = name in _BOX and not ends and (name not in ("span", "p") or said in (NAMED, COMMENTS))
        if name in _BLOCK or boxed:
            close()
            anchors = 0
        elif ends and opened.get(name):
            close()
        heading = int(not ends and len(name) == 2 and name[0] == "h" and name[1].isdigit()) if name in _BLOCK else heading
        if name not in _BOX:
            continue
        if ends:
            if opened.get(name):
                while stack[-1][0] != name:
                    leave()
                leave()
        elif boxed:
            if said in (ARTICLE, MAIN):
                contents += 1
            boxes.append([stack[-1][1], said, contents, False, 0, 0])
            opened[name] = opened.get(name, 0) + 1
            stack.append((name, len(boxes) - 1))
    close()
    while len(stack) > 1:
        leave()
    marks = _marks(boxes, contents)
    return texts, [(words, links, int(marks[box] > 0), int(marks[box] < 0), head) for (words, links, head), box in zip(facts, own)]


def _marks(boxes: list[list], contents: int) -> list[int]:
    """The mark that holds in each container: 1 content, 0 none, -1 trimmings by name, -2 by element or as comments."""
    for around, _, _, _, words, n in reversed(boxes[1:]):  # what is inside comes later
        boxes[around][4] += words
        boxes[around][5] += n
    total = boxes[0][4]
    marks = [0]
    for around, said, _, holds, words, n in boxes[1:]:
        mark = marks[around]
        wraps = holds or (not contents and n > 3 and 2 * words > total)
        if said == TRIMMINGS_ELEMENT or (said == COMMENTS and not (holds and mark < 1 and 2 * words > total and contents == 1)):
            mark = -2
        elif said == FORM:
            mark = mark if wraps else -2
        elif said == HEADER:
            mark = mark if mark > 0 or holds else -2
        elif said == NAMED or (said == WEAKLY_NAMED and mark <= 0):
            mark = mark if wraps and mark <= 0 else min(mark, -1)
        elif said in (ARTICLE, MAIN):
            mark = 1 if mark > -2 or said == MAIN else mark
        elif said == CONTENT_NAME:
            mark = 1 if mark >= 0 else mark
        marks.append(mark)
    return marks


def table_of(facts: list[tuple]) -> np.ndarray:
    """COLUMNS of a page's blocks."""
    own = np.array(facts, float).reshape(-1, 5)
    n = len(own)
    out = np.zeros((n, len(COLUMNS)))
    out[:, 0], out[:, 3] = own[:, 0], own[:, 1]
    out[1:, 1], out[1:, 4] = own[:-1, 0], own[:-1, 1]
    out[:-1, 2], out[:-1, 5] = own[1:, 0], own[1:, 1]
    out[:, 6:9] = own[:, 2:5]
    out[:, 9] = own[:, 2].max() if n else 0
    return out


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8) -> tuple:
    """A tree by Gini impurity: (column, threshold, below, above) or (share of 1s,)."""
    if depth == 0 or len(set(y.tolist())) < 2:
        return (float(y.mean()),)
    best = None
    for c in range(x.shape[1]):
        values = np.unique(x[:, c])
        for t in (values[1:] + values[:-1]) / 2:
            low = x[:, c] <= t
            a, b = y[low], y[~low]
            impurity = len(a) * a.mean() * (1 - a.mean()) + len(b) * b.mean() * (1 - b.mean())
            if best is None or impurity < best[0] - 1e-12:
                best = impurity, c, float(t)
    if best is None:
        return (float(y.mean()),)
    _, c, t = best
    low = x[:, c] <= t
    return c, t, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


def predict(tree: tuple, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    c, t, below, above = tree
    out = np.empty(len(x))
    low = x[:, c] <= t
    out[low], out[~low] = predict(below, x[low]), predict(above, x[~low])
    return out


@lru_cache(1)
def trained() -> tuple:
    rows = np.array(LABELLED, float)
    return grow(rows[:, :-1], rows[:, -1])


def main_text(html: str | None, tree: tuple | None = None) -> str:
    texts, facts = blocks(html or "")
    if not texts:
        return ""
    keep = predict(tree or trained(), table_of(facts)) >= 0.5
    return "\n".join(t for t, k in zip(texts, keep) if k)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without ``html``, with ``text``."""
    rest = [c for c in pages.columns if c not in (html, "text")]
    wanted = pages.select(*rest, html)
    tree = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(x, tree) for x in batch.column(len(rest)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names=[*rest, "text"])

    return wanted.mapInArrow(run, wanted.select(*rest).schema.add("text", "string"))
