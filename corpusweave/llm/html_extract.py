"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into flat text blocks at block-level tags.  Each block has its number of words and its
link density, those of the block before and after it, its kind, and a hint of the elements around it.
A decision tree, trained on the small labelled table below, keeps or drops each block.  All features compete for
each of its splits; ``without_hint`` is the tree that words, links and kind alone give.  White space is what
Python's ``str.split`` takes for it, a no-break space included.

Defined results: null or empty html and pages without kept blocks give an empty text; unclosed and
stray end tags are tolerated, and elements may be nested as deep as the page is long; scripts, styles, templates, comments and form controls never give text;
a page may be of any length.  Equal rows give equal results; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Elements of the HTML standard by their role here, and words that class and id names use.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template iframe svg math canvas object select textarea button head title option datalist audio video map".split())
RAW = frozenset("script style textarea title iframe noscript template".split())
BOILER = frozenset("nav footer aside form menu dialog".split())
ARTICLE = frozenset("article main".split())
CLOSES_P = BLOCK - frozenset("body caption html li td th tr dd dt tbody thead tfoot option optgroup legend summary figcaption title".split())
CLUTTER = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adsense|banner|sponsor\w*|promo\w*|comment\w*|disqus|respond|reply|replies|cookie\w*|consent|gdpr|notice\w*|alert|popup|modal|overlay|newsletter|subscribe|signup|login|share\w*|social\w*|sidebar\w*|side-bar|widget\w*|related|recommend\w*|breadcrumb\w*|menu\w*|nav\w*|navbar|footer\w*|(?:site|page|top|global)-?header|masthead|copyright|pagination|pager|toolbar|skip\w*|disclaimer|outbrain|taboola|tags?)(?=$|[\s_-])",
    re.I,
)
HEADER = re.compile(r"(?:^|[\s_-])header(?=$|[\s_-])", re.I)
CONTENT = re.compile(r"(?:^|[\s_-])(?:article\w*|post|post-?body|post-?content|entry\w*|content|main\w*|story\w*|body-?text|articlebody|prose)(?=$|[\s_-])", re.I)
ROLES = {"navigation": 1, "banner": 1, "contentinfo": 1, "complementary": 1, "search": 1, "form": 1, "dialog": 1, "alert": 1, "alertdialog": 1, "menu": 1, "menubar": 1, "main": -1, "article": -1}

#: What counts as a link, a heading and so on while it is open.
KINDS = {"a": "a", "p": "p"} | dict.fromkeys(SILENT, "silent") | dict.fromkeys(HEADING, "heading") | dict.fromkeys(("li", "dd", "dt", "td", "th"), "item")
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTR = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

FEATURES = ("words", "link", "words_before", "link_before", "words_after", "link_after", "heading", "item", "hint")
#: The labelled table: one row for each block, its FEATURES and whether an editor counted it as main text.  hint: 1
#: in an element of the article, -1 in one of clutter, else 0.  Invented after pages of news sites, blogs and forums.
LABELLED = (
    (120, 0.0, 9, 0.0, 80, 0.0, 0, 0, 1, 1), (80, 0.02, 120, 0.0, 60, 0.0, 0, 0, 1, 1), (35, 0.1, 80, 0.0, 42, 0.0, 0, 0, 1, 1),
    (1, 0.0, 40, 0.0, 3, 0.0, 0, 0, 1, 1), (3, 0.0, 1, 0.0, 0, 0.0, 0, 0, 1, 1), (2, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1, 1),
    (8, 0.0, 4, 0.0, 90, 0.0, 1, 0, 1, 1), (4, 0.0, 60, 0.1, 55, 0.0, 1, 0, 1, 1), (5, 1.0, 60, 0.0, 70, 0.0, 0, 0, 1, 1),
    (12, 0.2, 30, 0.0, 14, 0.1, 0, 1, 1, 1), (6, 0.0, 12, 0.0, 9, 0.0, 0, 1, 1, 1), (9, 1.0, 12, 1.0, 9, 1.0, 0, 1, 1, 0),
    (4000, 0.0, 7, 0.0, 12, 0.0, 0, 0, 1, 1), (7, 0.0, 1, 1.0, 3000, 0.0, 1, 0, 1, 1), (15, 0.0, 5, 0.0, 8, 0.0, 0, 0, 1, 1),
    (10, 0.0, 90, 0.0, 0, 0.0, 0, 0, 1, 1), (15, 0.0, 40, 0.0, 1, 1.0, 0, 0, 1, 1), (18, 0.0, 3, 0.0, 0, 0.0, 0, 0, 1, 1),
    (21, 0.0, 70, 0.0, 1, 0.0, 0, 0, 1, 1), (5, 0.0, 0, 0.0, 1, 1.0, 0, 0, 1, 1), (30, 0.0, 5, 1.0, 2, 1.0, 0, 0, 1, 1),
    (8, 0.5, 1, 1.0, 1, 1.0, 0, 0, 1, 1), (2, 1.0, 1, 1.0, 1, 1.0, 0, 0, 1, 1), (12, 0.0, 1, 1.0, 2, 1.0, 1, 0, 1, 1),
    (60, 0.0, 1, 1.0, 1, 1.0, 0, 0, 1, 1), (4, 0.0, 2, 1.0, 3, 0.9, 1, 0, 1, 1), (7, 0.4, 0, 0.0, 3, 1.0, 0, 0, 1, 1),
    (6, 0.9, 3, 1.0, 5, 0.8, 0, 0, 1, 1), (20, 0.9, 18, 0.9, 22, 0.8, 0, 1, 1, 1), (3, 0.0, 2, 0.0, 1, 1.0, 0, 0, 1, 1),
    (20, 0.0, 1, 1.0, 1, 1.0, 0, 0, -1, 0), (50, 0.0, 3, 0.0, 0, 0.0, 0, 0, -1, 0), (9, 0.0, 3, 1.0, 0, 0.0, 0, 0, 0, 0),
    (6, 0.0, 90, 0.0, 11, 0.0, 0, 0, -1, 0), (60, 0.0, 80, 0.0, 45, 0.0, 0, 0, -1, 0), (25, 0.1, 60, 0.0, 20, 0.0, 0, 0, -1, 0),
    (2, 1.0, 90, 0.0, 2, 1.0, 0, 1, -1, 0), (4, 0.0, 60, 0.0, 30, 0.0, 1, 0, -1, 0), (110, 0.0, 4, 0.0, 90, 0.0, 0, 0, -1, 0),
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 1, -1, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0, 1, -1, 0), (2, 1.0, 1, 1.0, 7, 0.0, 0, 1, -1, 0),
    (7, 0.0, 1, 1.0, 8, 0.0, 0, 0, -1, 0), (12, 0.0, 200, 0.0, 0, 0.0, 0, 0, -1, 0), (9, 0.3, 40, 0.0, 0, 0.0, 0, 0, -1, 0),
    (45, 0.0, 90, 0.0, 50, 0.0, 0, 0, -1, 0), (60, 0.0, 12, 0.0, 50, 0.0, 0, 0, -1, 0), (100, 0.0, 12, 0.0, 90, 0.0, 0, 0, -1, 0),
    (30, 0.1, 20, 0.2, 20, 0.2, 0, 0, -1, 0), (3, 0.0, 0, 0.0, 20, 0.0, 1, 0, -1, 0), (400, 0.0, 12, 0.0, 30, 0.0, 0, 0, -1, 0),
    (90, 0.0, 10, 0.0, 85, 0.0, 0, 0, 0, 1), (60, 0.05, 90, 0.0, 70, 0.0, 0, 0, 0, 1), (25, 0.1, 70, 0.0, 60, 0.0, 0, 0, 0, 1),
    (18, 0.0, 60, 0.0, 20, 0.0, 0, 0, 0, 1), (14, 0.0, 70, 0.0, 3, 1.0, 0, 0, 0, 1), (6, 0.0, 70, 0.0, 80, 0.0, 0, 0, 0, 1),
    (8, 0.0, 2, 1.0, 90, 0.0, 1, 0, 0, 1), (5, 0.0, 60, 0.0, 55, 0.0, 1, 0, 0, 1), (11, 0.0, 70, 0.0, 12, 0.0, 0, 1, 0, 1),
    (40, 0.0, 3, 1.0, 0, 0.0, 0, 0, 0, 1), (2000, 0.0, 2, 1.0, 6, 0.0, 0, 0, 0, 1), (16, 0.1, 60, 0.0, 18, 0.2, 0, 1, 0, 1),
    (16, 0.0, 20, 0.0, 1, 1.0, 0, 0, 0, 1), (25, 0.0, 18, 0.0, 2, 1.0, 0, 0, 0, 1), (40, 0.0, 30, 0.1, 1, 1.0, 0, 0, 0, 1),
    (13, 0.0, 35, 0.0, 3, 1.0, 0, 0, 0, 1), (22, 0.1, 2, 1.0, 1, 1.0, 0, 0, 0, 1), (70, 0.0, 1, 1.0, 2, 1.0, 0, 0, 0, 1),
    (28, 0.0, 5, 0.0, 4, 0.9, 0, 0, 0, 1), (19, 0.05, 25, 0.0, 0, 0.0, 0, 0, 0, 1), (15, 0.9, 20, 0.0, 1, 1.0, 0, 0, 0, 0),
    (24, 0.7, 30, 0.1, 2, 0.9, 0, 0, 0, 0), (35, 0.8, 40, 0.0, 30, 0.0, 0, 0, 0, 0), (4, 0.0, 25, 0.0, 1, 1.0, 0, 0, 0, 0),
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 0, 0), (3, 1.0, 2, 1.0, 4, 1.0, 0, 0, 0, 0), (6, 0.9, 3, 1.0, 5, 0.8, 0, 0, 0, 0),
    (20, 0.9, 18, 0.9, 22, 0.8, 0, 1, 0, 0), (30, 0.8, 4, 1.0, 25, 0.9, 0, 0, 0, 0), (2, 0.0, 1, 1.0, 2, 1.0, 0, 0, 0, 0),
    (4, 0.0, 3, 1.0, 0, 0.0, 0, 0, 0, 0), (3, 0.0, 2, 0.0, 1, 1.0, 0, 0, 0, 0), (5, 0.5, 4, 1.0, 3, 0.7, 0, 0, 0, 0),
    (2, 0.0, 1, 1.0, 3, 1.0, 1, 0, 0, 0), (3, 0.0, 2, 1.0, 4, 0.9, 1, 0, 0, 0), (7, 0.4, 0, 0.0, 3, 1.0, 0, 0, 0, 0),
    (10, 1.0, 50, 0.0, 60, 0.0, 0, 0, 1, 1), (12, 0.9, 5, 0.0, 30, 0.1, 0, 0, 1, 1), (11, 0.8, 40, 0.0, 0, 0.0, 0, 0, 1, 1), (13, 1.0, 30, 0.1, 25, 0.0, 0, 1, 1, 1),
    (7, 1.0, 6, 1.0, 8, 1.0, 0, 1, 1, 0), (5, 1.0, 7, 1.0, 4, 1.0, 0, 1, 1, 0), (11, 0.0, 1, 1.0, 6, 0.0, 0, 0, 0, 0), (14, 0.0, 2, 1.0, 9, 0.0, 0, 0, 0, 0),
)


def train(table: np.ndarray, depth: int = 8, features: int = len(FEATURES)) -> tuple:
    """A CART tree by Gini impurity over the first ``features``: a leaf (keep,) or (feature, threshold, below, above).
    Ties go to the first split."""
    x, y = table[:, :-1], table[:, -1]
    share = y.mean()
    if depth == 0 or share in (0.0, 1.0):
        return (bool(share >= 0.5),)
    best = None
    for f in range(features):
        values = np.unique(x[:, f])
        for t in (values[:-1] + values[1:]) / 2:
            low = x[:, f] <= t
            n = low.sum()
            p, q = y[low].mean(), y[~low].mean()
            gini = n * p * (1 - p) + (len(y) - n) * q * (1 - q)
            if best is None or gini < best[0] - 1e-12:
                best = (gini, f, float(t), low)
    if best is None:
        return (bool(share >= 0.5),)
    _, f, t, low = best
    return (f, t, train(table[low], depth - 1, features), train(table[~low], depth - 1, features))


def written(tree: tuple, indent: str = "") -> str:
    """The tree in words."""
    if len(tree) == 1:
        return f"{indent}{'keep' if tree[0] else 'drop'}\n"
    name = FEATURES[tree[0]]
    return f"{indent}{name} <= {tree[1]:g}:\n{written(tree[2], indent + '  ')}{indent}{name} > {tree[1]:g}:\n{written(tree[3], indent + '  ')}"


@cache
def default_tree() -> tuple:
    return train(np.array(LABELLED, float))


@cache
def without_hint() -> tuple:
    """The tree of all features but the hint of the markup."""
    return train(np.array(LABELLED, float), features=FEATURES.index("hint"))


def keeps(tree: tuple, row: tuple) -> bool:
    while len(tree) > 1:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[0]


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTR.finditer(text)} if text and not text.isspace() else {}


def _mark(name: str, attrs: dict[str, str]) -> int:
    """1 for an element of clutter, -1 for one of the main text, 0 else; 2 for a hidden one; 3 for a header,
    which is clutter unless it is an article's."""
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", "")):
        return 2
    if role := ROLES.get(attrs.get("role", "").lower()):
        return role
    names = f"{attrs.get('class', '')} {attrs.get('id', '')}"
    if name not in ("html", "body") and CLUTTER.search(names):
        return 1
    if name in BOILER:
        return 1
    if name == "header" or HEADER.search(names):
        return 3
    return -1 if name in ARTICLE or CONTENT.search(names) else 0


@dataclass(slots=True, eq=False)
class Open:
    """An open element; ``serial`` grows from the outermost inwards."""

    name: str
    mark: int
    serial: int
    alive: bool = True


def blocks(page: str) -> list[list]:
    """Flat text blocks in page order: [text, words, linked words, heading, item, hint]."""
    out: list[list] = []
    text: list[str] = []
    linked: list[str] = []
    stack: list[Open] = []  # closed elements among them go when they come to the top
    of_name: dict[str, list[Open]] = defaultdict(list)
    of_blocks: list[Open] = []
    depth = {"a": 0, "clutter": 0, "article": 0, "silent": 0, "heading": 0, "item": 0, "p": 0}
    state: list[int] = [0, 0, 0]

    def flush() -> None:
        if text:
            words = "".join(text).split()
            if words:
                out.append([" ".join(words), len(words), len(" ".join(linked).split()), *state])
            text.clear()
            linked.clear()

    def open_(name: str, mark: int) -> None:
        if mark == 3:
            mark = 0 if depth["article"] else 1
        e = Open(name, mark, stack[-1].serial + 1 if stack else 0)
        stack.append(e)
        of_name[name].append(e)
        if name in BLOCK:
            of_blocks.append(e)
        count(e, 1)

    def count(e: Open, by: int) -> None:
        if e.mark:
            depth[{1: "clutter", 2: "silent", -1: "article"}[e.mark]] += by
        if kind := KINDS.get(e.name):
            depth[kind] += by

    def top(some: list[Open]) -> Open | None:
        while some and not some[-1].alive:
            some.pop()
        return some[-1] if some else None

    def shut(e: Open) -> None:
        e.alive = False
        count(e, -1)

    def close(upto: Open) -> None:
        """Closes an element and what is open inside it."""
        while (e := stack.pop()) is not upto:
            if e.alive:
                shut(e)
        shut(upto)

    def take(raw: str) -> None:
        if raw and not depth["silent"]:
            if not text:
                state[:] = [min(depth["heading"], 1), min(depth["item"], 1), -1 if depth["clutter"] else min(depth["article"], 1)]
            piece = entities.unescape(raw) if "&" in raw else raw
            text.append(piece)
            if depth["a"]:
                linked.append(piece)

    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        if not m:
            take(page[at:])
            break
        take(page[at : m.start()])
        at = max(m.end(), m.start() + 1)
        name = m[2] or m[5]
        if not name:
            continue
        name, end = name.lower(), bool(m[1] or m[4])
        if name == "br":
            take(" ")
            continue
        if name in BLOCK:
            flush()
        if end:
            if e := top(of_name[name]):
                block = top(of_blocks)
                if name in BLOCK or not block or block.serial < e.serial:
                    close(e)
                else:  # formatting that ends outside of its block: it alone ends
                    shut(e)
            continue
        raw = m[3] if m[2] else m[6]
        if name in VOID or raw.endswith("/") and name not in BLOCK:
            continue
        if depth["p"] and name in CLOSES_P:
            close(top(of_name["p"]))
        last = top(stack)
        if last and name == last.name and name in ("li", "dd", "dt", "td", "th", "tr", "option"):
            close(last)
        if name in RAW:
            stop = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = stop.end() if stop else n
            continue
        open_(name, _mark(name, _attributes(raw)))
    flush()
    return out


def main_text(page: str | None, tree: tuple | None = None) -> str:
    if not page:
        return ""
    tree, found = tree or default_tree(), blocks(page)
    edge = ["", 0, 0]
    kept = []
    for i, b in enumerate(found):
        before, after = found[i - 1] if i else edge, found[i + 1] if i + 1 < len(found) else edge
        density = [x[2] / x[1] if x[1] else 0.0 for x in (b, before, after)]
        if keeps(tree, (b[1], density[0], before[1], density[1], after[1], density[2], b[3], b[4], b[5])):
            kept.append(b[0])
    return " ".join(kept)


def extract(pages: DataFrame, tree: tuple | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html)."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x, tree) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(part, f"page_id {kind}, url string, text string, n_chars long")
