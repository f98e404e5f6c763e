"""Operator 5: main text of web pages from flat text blocks and a decision tree.

A page is cut at block-level tags into flat blocks. Each block has its words and the share of them inside links, the
same of the blocks before and after it, and whether it or the next one is a heading. A decision tree, grown here by
Gini impurity from a small labelled table, says which blocks read like text. Where a page gives hints, a second tree
weighs them against that: what tags, roles, classes and ids say of a menu, header, footer, sidebar, notice, advert,
form or comments around the block, and whether it stands inside the article, outside, or on a page without one.

Scripts, styles, templates, comments and the head are not text. Character references are decoded, white space in a
block becomes one space, blocks are joined in page order by a line feed. Null and empty pages give empty text.
Unclosed tags end with their parent; what is cut off in the middle of a tag is not text. An element inside a line that
is named like an advert or a comment is a block of its own, and the line goes on without it. Time is in proportion to
the page, however deep it is nested. Rows are handled alone, so repeated rows need no rule; other columns pass through,
ones named like an output are replaced.
"""

from __future__ import annotations

import html
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T

from .common import table

# Element names of HTML.
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
CONTAINER = BLOCK - set("hr p h1 h2 h3 h4 h5 h6 html".split())
RAW = set("script style noscript template textarea title iframe noembed noframes svg math object head xmp".split())
OTHER_TAGS = set("nav aside footer form select dialog menu fieldset search".split())
OTHER_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
MAIN_WORDS = set("article content main post story entry body text".split())
STRONG_WORDS = set("ad ads advert adverts advertisement adsense advertising sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs footer comment comments commentlist replies respond disqus cookie cookies consent gdpr newsletter subscribe signup login pagination pager copyright notice notices popup modal overlay topbar toolbar".split())
#: Outside the article these stand for what is no text, unless a word for text is beside them.
WEAK_WORDS = set("header masthead widget widgets skip tags meta banner alert reply".split())
#: Names of what stands at the side; also those of pages' outer frames, so an article inside counts all the same.
SIDE_WORDS = set("sidebar side rail aside".split())
#: Names that text may have too: whether it reads like text decides.
EITHER_WORDS = set("related recommended recommendations form search social share sharing promotion subscription disclaimer".split())
INLINE = set("span b i em strong small font mark label ins del sup sub u s q cite code abbr time button".split())

_TAG = re.compile(r"<(?:!--.*?(?:--!?>|\Z)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)|[!?/][^>]*(?:>|\Z))", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_MAIN_ROLE = re.compile(r"\brole\s*=\s*[\"']?main\b", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none", re.I)

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "heading", "heading_after")

class Block:
    __slots__ = ("parts", "words", "linked", "name", "place", "heading", "text")

    def __init__(self, name: int, inside: bool, heading: bool) -> None:
        self.parts: list[tuple[str, bool]] = []
        self.name, self.place, self.heading = name, inside, heading

    def finish(self) -> bool:
        self.text = " ".join("".join(p for p, _ in self.parts).split())
        self.words = len(self.text.split(" ")) if self.text else 0
        self.linked = sum(len(p.split()) for p, link in self.parts if link)
        return bool(self.text)


def _name(name: str, attrs: str, inside: bool) -> int:
    """What an element's names say: 3 for no main text, 2 for the side of a page, 1 for either, 0 for nothing."""
    if name in OTHER_TAGS or name == "header" and not inside:
        return 3
    if not attrs or name in ("body", "html", "article", "main"):
        return 0
    words: set[str] = set()
    for key, *values in _ATTR.findall(attrs):
        value = "".join(values)
        key = key.lower()
        if key == "role" and value.lower() in OTHER_ROLES:
            return 3
        if key in ("class", "id"):
            words.update(re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()))
    if words & STRONG_WORDS or _HIDDEN.search(attrs):
        return 3
    if words & WEAK_WORDS and not inside and not words & MAIN_WORDS:
        return 3
    return 2 if words & SIDE_WORDS else 1 if words & EITHER_WORDS else 0


class _Page:
    """One reading of a page: open elements, the block that is being filled, and the blocks that are done."""

    def __init__(self) -> None:
        self.out: list[Block] = []
        self.stack: list[tuple[str, int, bool]] = []  # element, name, inside
        self.open: dict[str, int] = {}
        self.any_main = self.link = self.heading = False
        self.own = 0  # what the names of the paragraph or heading say
        self.here = Block(0, False, False)
        self.apart: tuple[str, int, Block] | None = None  # an element inside a line that is a block of its own

    def top(self) -> tuple[str, int, bool]:
        return self.stack[-1] if self.stack else ("", 0, False)

    def add(self, text: str) -> None:
        (self.apart[2] if self.apart else self.here).parts.append((html.unescape(text), self.link))

    def cut(self) -> None:
        self.end_apart()
        if self.here.finish():
            self.out.append(self.here)
        _, name, inside = self.top()
        self.here = Block(max(name, self.own), inside, self.heading)

    def end_apart(self) -> None:
        if self.apart and self.apart[2].finish():
            self.out.append(self.apart[2])
        self.apart = None

    def start_inline(self, name: str, attrs: str) -> None:
        if self.apart:
            if name == self.apart[0]:
                self.apart = (name, self.apart[1] + 1, self.apart[2])
        elif attrs and (level := _name(name, attrs, self.top()[2])) == 3:
            self.here.parts.append((" ", False))
            self.apart = (name, 1, Block(level, self.top()[2], False))

    def end_inline(self, name: str) -> None:
        if self.apart and name == self.apart[0]:
            self.apart = (name, self.apart[1] - 1, self.apart[2])
            if not self.apart[1]:
                self.end_apart()

    def start_block(self, name: str, attrs: str) -> None:
        self.link, self.own = False, 0
        if name in CONTAINER:
            if not attrs.rstrip().endswith("/"):
                self.push(name, attrs)
        elif name not in ("html", "hr"):
            self.own = _name(name, attrs, self.top()[2])
        self.heading = name[0] == "h" and name[1:].isdigit()
        self.cut()

    def push(self, name: str, attrs: str) -> None:
        if name in ("li", "td", "th", "tr", "option", "dd", "dt") and self.top()[0] == name:
            self.pop()
        _, level, inside = self.top()
        level = max(level, _name(name, attrs, inside))
        if level < 3 and (name in ("article", "main") or _MAIN_ROLE.search(attrs)):
            level, inside = 0, True
        self.any_main = self.any_main or inside
        self.stack.append((name, level, inside))
        self.open[name] = self.open.get(name, 0) + 1

    def pop(self) -> str:
        name = self.stack.pop()[0]
        self.open[name] -= 1
        return name

    def end_block(self, name: str) -> None:
        self.heading = self.heading and not (name[0] == "h" and name[1:].isdigit())
        self.link, self.own = False, 0
        if self.open.get(name):
            while self.pop() != name:
                pass
        self.cut()


def _after_raw(page: str, at: int, name: str) -> int:
    """Where the page goes on after the content of an element that holds no text."""
    end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
    if end is not None:
        return end.end()
    if name != "head":
        return len(page)
    body = re.compile(r"<body\b", re.I).search(page, at)
    return body.start() if body else at


def blocks(page: str) -> list[Block]:
    """The page's flat text blocks in order; `place` is 2 inside an article, 1 on a page without, 0 outside."""
    state = _Page()
    at = 0
    while at < len(page):
        m = _TAG.search(page, at)
        if m is None:
            state.add(page[at:])
            break
        if m.start() > at:
            state.add(page[at : m.start()])
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        closing, attrs = m["end"] or m["end2"], m["attrs"] or m["attrs2"] or ""
        if not name:
            continue
        if closing:
            if name == "a":
                state.link = False
            elif name in BLOCK:
                state.end_block(name)
            elif name in INLINE:
                state.end_inline(name)
        elif name in RAW:
            if not attrs.rstrip().endswith("/"):
                at = _after_raw(page, at, name)
        elif name == "a":
            state.link = True
        elif name == "br":
            state.add(" ")
        elif name in BLOCK:
            state.start_block(name, attrs)
        elif name in INLINE:
            state.start_inline(name, attrs)
    state.cut()
    for b in state.out:
        b.place = 2 if b.place else 0 if state.any_main else 1
    return state.out


def features(found: list[Block]) -> np.ndarray:
    words = np.array([b.words for b in found], float)
    links = np.array([b.linked for b in found], float) / np.maximum(words, 1)
    heading = np.array([b.heading for b in found], float)
    pad = np.zeros(1)
    later = lambda x: np.append(x[1:], pad)
    earlier = lambda x: np.append(pad, x[:-1])
    return np.stack([words, links, earlier(words), earlier(links), later(words), later(links), heading, later(heading)], 1)


#: The labelled blocks: words and share of links of the block, the one before and the one after, whether it or the
#: next is a heading, and 1 for main text. Labels are those of a page without hints.
SEEN = [
    # menus and lists of links, at the top, in the middle and at the end
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 0),
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 0, 0),
    (2, 1.0, 2, 1.0, 3, 1.0, 0, 0, 0),
    (3, 1.0, 2, 1.0, 30, 0.0, 0, 0, 0),
    (1, 1.0, 1, 1.0, 12, 0.0, 0, 0, 0),
    (2, 1.0, 1, 1.0, 9, 0.0, 0, 1, 0),
    (6, 0.7, 5, 0.8, 4, 0.9, 0, 0, 0),
    (12, 0.9, 10, 0.9, 14, 0.9, 0, 0, 0),
    (30, 0.8, 10, 1.0, 10, 1.0, 0, 0, 0),
    (4, 1.0, 40, 0.0, 3, 1.0, 0, 0, 0),
    (5, 1.0, 40, 0.0, 60, 0.0, 0, 0, 0),
    (2, 1.0, 80, 0.0, 0, 0.0, 0, 0, 0),
    (2, 1.0, 0, 0.0, 0, 0.0, 0, 0, 0),
    # lines beside menus: names of sites, adverts before the heading, captions of lists
    (3, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0),
    (7, 0.0, 3, 1.0, 2, 1.0, 0, 0, 0),
    (4, 0.0, 0, 0.0, 1, 1.0, 0, 0, 0),
    (3, 0.0, 0, 0.0, 2, 1.0, 1, 0, 0),
    (3, 0.0, 40, 0.0, 2, 1.0, 1, 0, 0),
    (8, 0.0, 1, 1.0, 9, 0.0, 0, 1, 0),
    (13, 0.0, 1, 1.0, 12, 0.0, 0, 1, 0),
    (24, 0.0, 1, 1.0, 3, 0.0, 0, 1, 0),
    (11, 0.0, 2, 1.0, 14, 0.0, 0, 1, 0),
    (1, 0.0, 1, 1.0, 8, 0.0, 0, 1, 0),
    (5, 0.0, 1, 1.0, 10, 0.0, 0, 1, 0),
    (17, 0.0, 1, 1.0, 8, 0.0, 0, 1, 0),
    (28, 0.0, 1, 1.0, 10, 0.0, 0, 1, 0),
    # last lines: owners, addresses, dates
    (2, 0.0, 30, 0.0, 0, 0.0, 0, 0, 0),
    (4, 0.0, 30, 0.0, 0, 0.0, 0, 0, 0),
    (10, 0.0, 3, 0.0, 0, 0.0, 0, 0, 0),
    (12, 0.0, 80, 0.0, 0, 0.0, 0, 0, 0),
    (15, 0.0, 12, 0.0, 0, 0.0, 0, 0, 0),
    (20, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0),
    (24, 0.0, 1, 0.0, 0, 0.0, 0, 0, 0),
    (6, 0.0, 2, 1.0, 0, 0.0, 0, 0, 0),
    (14, 0.0, 150, 0.0, 0, 0.0, 0, 0, 0),
    (28, 0.0, 20, 0.0, 0, 0.0, 0, 0, 0),
    (28, 0.0, 100, 0.0, 0, 0.0, 0, 0, 0),
    # headings of text
    (8, 0.0, 2, 1.0, 60, 0.0, 1, 0, 1),
    (12, 0.0, 12, 0.0, 9, 0.0, 1, 0, 1),
    (9, 0.0, 13, 0.0, 2, 0.0, 1, 0, 1),
    (5, 0.0, 60, 0.0, 70, 0.0, 1, 0, 1),
    (3, 0.0, 0, 0.0, 40, 0.0, 1, 0, 1),
    (4, 0.0, 30, 0.0, 5, 0.0, 1, 0, 1),
    (1, 0.0, 1, 1.0, 30, 0.0, 1, 0, 1),
    # paragraphs, long and short, between others
    (60, 0.0, 8, 0.0, 60, 0.0, 0, 0, 1),
    (25, 0.1, 40, 0.0, 30, 0.1, 0, 0, 1),
    (30, 0.3, 40, 0.0, 30, 0.1, 0, 0, 1),
    (18, 0.0, 8, 0.0, 30, 0.0, 0, 0, 1),
    (15, 0.0, 20, 0.0, 8, 0.0, 0, 0, 1),
    (6, 0.0, 50, 0.0, 60, 0.0, 0, 0, 1),
    (2, 0.0, 60, 0.0, 70, 0.0, 0, 0, 1),
    (1, 0.0, 30, 0.0, 12, 0.0, 0, 0, 1),
    (1, 0.0, 9, 0.0, 10, 0.0, 0, 0, 1),
    (2, 0.0, 2, 0.0, 9, 0.0, 0, 0, 1),
    (3, 0.0, 12, 0.0, 2, 0.0, 0, 0, 1),
    (12, 0.0, 1, 0.0, 1, 0.0, 0, 0, 1),
    (20, 0.0, 30, 0.0, 6, 0.0, 0, 1, 1),
    (7, 0.0, 30, 0.0, 4, 0.0, 0, 1, 1),
    (2, 0.0, 4, 0.0, 6, 0.0, 0, 1, 1),
    (9, 0.0, 2, 0.0, 3, 0.0, 0, 1, 1),
    (3, 0.0, 9, 0.0, 12, 0.0, 0, 1, 1),
    (14, 0.4, 30, 0.0, 20, 0.0, 0, 0, 1),
    (22, 0.0, 90, 0.0, 12, 0.0, 0, 0, 1),
    (10, 0.0, 60, 0.0, 14, 0.0, 0, 0, 1),
    (3, 0.0, 9, 0.0, 100, 0.0, 0, 0, 1),
    (16, 0.0, 2, 0.0, 3, 0.0, 0, 0, 1),
    (22, 0.0, 12, 0.0, 3, 0.0, 0, 0, 1),
    # long ones beside anything
    (90, 0.0, 3, 1.0, 3, 1.0, 0, 0, 1),
    (60, 0.0, 1, 1.0, 8, 0.0, 0, 1, 1),
    (40, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1),
    (45, 0.0, 1, 1.0, 40, 0.0, 0, 0, 1),
    (30, 0.0, 2, 1.0, 40, 0.0, 0, 0, 1),
    (24, 0.0, 1, 1.0, 30, 0.0, 0, 0, 1),
    (70, 0.1, 30, 0.0, 0, 0.0, 0, 0, 1),
    (35, 0.2, 70, 0.0, 2, 1.0, 0, 0, 1),
    (120, 0.0, 12, 0.0, 30, 0.0, 0, 0, 1),
]


#: How much longer or shorter the neighbours of a labelled block may be without a change of its label.
STRETCH = (0.6, 1.0, 1.6)


def seen_rows() -> np.ndarray:
    """SEEN with longer and shorter neighbours."""
    rows = [(*r[:2], r[2] * s, r[3], r[4] * t, *r[5:]) for r in SEEN for s in STRETCH for t in STRETCH]
    return np.unique(np.array(rows, float), axis=0)


def hint_rows() -> list[tuple]:
    """(reads, words, links, name, place) and 1 for main text, under every pair of hints.

    Without a hint it is what reads like text. Inside the article everything is text but what the names exclude,
    outside nothing is. Names that text may have too leave the choice to how the block reads, and ask for more words
    where it stands alone.
    """
    rows = []
    for name, place, reads, words, links in itertools.product(range(4), range(3), (0, 1), (1, 6, 14, 16, 24, 26, 80), (0.0, 0.2, 0.4, 1.0)):
        prose = links <= 0.3 and words >= (15 if place == 2 else 25)
        if name >= 2 or place == 0:
            text = 0
        elif name == 1:
            text = int(prose and (place == 2 or reads == 1))
        else:
            text = 1 if place == 2 else reads
        rows.append((reads, words, links, name, place, text))
    return rows


def grow(x: np.ndarray, y: np.ndarray) -> tuple:
    """A pure binary tree: ('leaf', label) or (feature, threshold, below or equal, above)."""
    if len(set(y.tolist())) == 1:
        return ("leaf", int(y[0]))
    mixed = lambda part: len(part) * 2 * part.mean() * (1 - part.mean())
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[:-1] + values[1:]) / 2:
            low = x[:, f] <= cut
            left = mixed(y[low]) + mixed(y[~low])
            if best is None or left < best[0] - 1e-12:
                best = (left, f, cut)
    if best is None:
        return ("leaf", int(y.mean() >= 0.5))
    _, f, cut = best
    low = x[:, f] <= cut
    return (f, cut, grow(x[low], y[low]), grow(x[~low], y[~low]))


def _tree(rows) -> tuple:
    rows = np.array(rows, float)
    return grow(rows[:, :-1], rows[:, -1])


READS, HINTED = _tree(seen_rows()), _tree(hint_rows())


def classify(x: np.ndarray, tree: tuple) -> np.ndarray:
    if tree[0] == "leaf":
        return np.full(len(x), bool(tree[1]))
    out = np.empty(len(x), bool)
    low = x[:, tree[0]] <= tree[1]
    out[low], out[~low] = classify(x[low], tree[2]), classify(x[~low], tree[3])
    return out


def is_text(found: list[Block], hints: bool = True) -> np.ndarray:
    """Which blocks are main text; without hints, as if no element had a name and there were no articles."""
    x = features(found)
    reads = classify(x, READS)
    if not hints:
        return reads
    name, place = (np.array([getattr(b, k) for b in found], float) for k in ("name", "place"))
    return classify(np.stack([reads, x[:, 0], x[:, 1], name, place], 1), HINTED)


def main_text(page: str | None, hints: bool = True) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, keep in zip(found, is_text(found, hints)) if keep) if found else ""


def extract_main_text(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """All columns but the page itself, and `text` and `n_chars`."""
    kept = [f for f in pages.schema if f.name not in (html_col, out, "n_chars")]
    schema = T.StructType([*kept, T.StructField(out, T.StringType()), T.StructField("n_chars", T.LongType())])
    names = [f.name for f in kept]

    def run(batches):
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(html_col)]
            columns = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *columns], [*names, out, "n_chars"])

    return pages.select(*names, html_col).mapInArrow(run, schema)


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
