"""Main text of web pages from flat text blocks.

A page becomes a flat list of text blocks. Each block is described by its own and its neighbours' word
counts and link densities, by the elements and the class names that enclose it, and by whether the page marks
a main region at all; a decision tree that is trained here on a small labelled table says which blocks are
main text. Elements and names are hints: the table holds blocks of every hint that are main text and blocks
that are not, told apart by the block and its neighbours. decided_against() counts blocks that the tree
decides against their hints.

Defined results: null or empty html gives the empty text; unclosed or unmatched tags never fail; an
unclosed comment, script or style runs to the end of the page; rows with equal or null ids are each
answered on their own; extra columns of the input are ignored; an empty table gives an empty answer.
"""

from __future__ import annotations

import html as entities
import itertools
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_rows, per_row

TAG = re.compile(
    r"<(?:(script|style|textarea|title|iframe|noembed|noframes|xmp)\b[^<>]*>.*?(?:</\1\b[^>]*>|\Z)"
    r"|(/?)([A-Za-z][A-Za-z0-9:_-]*)((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+)>"
    r"|!--.*?(?:-->|\Z)"
    r"|(/?)([A-Za-z][A-Za-z0-9:_-]*)[^<>]*(?:>|\Z)"
    r"|[!?/][^>]*(?:>|\Z))",
    re.S | re.I,
)
ATTR = re.compile(r"""([A-Za-z_:][\w:.-]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(?<![\w="'])(hidden)(?![\w=])""", re.S)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr blink picture source track link meta input embed param area base col".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("head noscript template svg math object select button datalist canvas audio video applet".split())
BOILER_TAGS = frozenset("nav footer aside form menu dialog search".split())
MAIN_TAGS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FLOW = frozenset("p pre blockquote figcaption".split())
ENDS_P = frozenset("p div ul ol dl li table section article main nav header footer aside form h1 h2 h3 h4 h5 h6 hr pre blockquote figure address fieldset details menu dd dt tr td th".split())
#: Names of side matter, names that side matter and main text share, and names that say nothing beside others.
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar widget widgets footer comment comments commentlist reply replies respond disqus sharing social related recommended newsletter subscribe subscription signup login toolbar pagination pager copyright disclaimer masthead topbar toc teaser outbrain taboola".split()
)
WEAK_WORDS = frozenset("promo promotion banner notice notices alert side rail foot share search legal skip tags".split())
NEUTRAL_WORDS = frozenset("a b box block wrap wrapper container list item items inner outer section area bar panel unit slot top bottom left right main site page global primary secondary col column row group links link form author body text meta icon title header head date time name s".split())
MAIN_WORDS = frozenset("article content post entry story main body text maincontent articlebody".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
REPEATS = frozenset("li tr td th dd dt option".split())
#: Elements whose name says nothing about their region.
PLAIN = frozenset("p li ul ol div span h1 h2 h3 h4 h5 h6 table tbody tr td th section dl dt dd blockquote pre figure html body".split())
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

#: The labelled table. A line stands for blocks that are alike but for the values parted by bars: words, link
#: density, kind (0 other, 1 paragraph, 2 heading), enclosing element (1 main, 0 open, -1 side matter), name (1
#: main, 0 open, -1 weak or -2 strong hint of side matter), words/link density before and after, whether the page
#: marks a main region, and whether the block is main text. The sets that many lines share have letters.
SETS = {
    "few": "1|2|4",
    "some": "7|12|20|35|50",
    "many": "60|80|150",
    "line": "0/0|2/1|4/0",
    "text": "12/0|30/0|50/0",
    "long": "60/0|90/0|220/0",
}
LABELLED = """
few|some|many 0|0.2 1|2 1 0 line|text|long line|text|long 1 1
few|some|many 0|0.2 1|2 0 1 line|text|long line|text|long 1 1
some|many 0|0.2 0 1 0 line|text|long line|text|long 1 1
some|many 0|0.2 0 0 1 line|text|long line|text|long 1 1
few 0|0.2 0 1 0 text|long line|text|long 1 1
few 0|0.2 0 1 0 0/0|4/0 line|text|long 1 1
few 0|0.2 0 1 0 2/1 0/0|4/0|text|long 1 1
few 0|0.2 0 0 1 text|long line|text|long 1 1
few 0 0 1 0 2/1 2/1 1 0
7|12|25 0.5 1 1 0 40/0|3/1 30/0 1 1
5|8 1 1 1 0 60/0 40/0 1 1
2|4|8 1 0 1 0 line|text 2/1|0/0 1 0
2|4|8 1 0 0 1 line|text 2/1|0/0 1 0
3|6 0.9 0 1 0 40/0|3/1 5/1 1 0
few|some 0|0.5|1 0|1|2 1 -2 line|text|long line|text|long 1 0
many 0 0|1|2 1 -2 line|text line|text|long 1 0
many 0 0|1|2 1 -2 long line|text 1 0
many 0 0|1 1 -2 long long 1 1
some|many 0 0|1 1 -1 line|text|long text|long 1 1
some|many 0 0|1 1 -1 text|long line 1 1
some 0 0|1 1 -1 line line 1 0
few 0|0.5|1 0|1 1 -1 line|text|long line|text|long 1 0
2|4 0 2 1 -1 text|long text|long 1 1
some 0.6|1 0|1 1 -1 line|text line|text 1 0
few|some 0|0.2|1 0|1|2 -1 0|-1|-2 line|text|long line|text|long 0|1 0
many 0|0.1 0|1 -1 0|-1|-2 line|text line|text|long 0|1 0
many 0|0.1 0|1 -1 0|-1|-2 long line|text 0|1 0
many 0 0|1 -1 0|-1 long long 0|1 1
few|some 0|0.2|1 0|1|2 0 -2 line|text|long line|text|long 0|1 0
many 0|0.1 0|1 0 -2 line|text line|text|long 0|1 0
many 0|0.1 0|1 0 -2 long line|text 0|1 0
many 0 0|1 0 -2 long long 0|1 1
20|35|50|many 0 0|1 0 -1 line|text|long text|long 0 1
20|35|50|many 0 0|1 0 -1 text|long line 0 1
7|12 0 0|1 0 -1 text|long text|long 0 1
7|12 0 0|1 0 -1 line line|text|long 0 0
few 0|0.5|1 0|1 0 -1 line|text line|text 0 0
2|4|7 0 2 0 -1 0/0|2/1 text|long 0 1
2|4|7 0 2 0 -1 text|long text|long 0 1
some 0.6|1 0|1 0 -1 line|text line|text 0 0
few|some 0|0.2|1 0|1|2 0 -1 line|text|long line|text|long 1 0
many 0 0|1 0 -1 line|text line|text|long 1 0
many 0 0|1 0 -1 long long 1 1
few|some 0|0.2|1 0|1|2 0 0 line|text|long line|text|long 1 0
many 0|0.1 0|1 0 0 line|text line|text|long 1 0
many 0|0.1 0|1 0 0 long line|text 1 0
many 0 0|1 0 0 long long 1 1
7|12 0 2 0 0 0/0|2/1 12/0|30/0|50/0|long 0 1
2|4 0 2 0 0 12/0|30/0|50/0|long 12/0|30/0|50/0|long 0 1
20|35|50|many 0|0.1 0|1 0 0 line|text|long line|text|long 0 1
7|12 0|0.1 0|1 0 0 text|long text|long 0 1
7|12 0 1 0 0 text|long 0/0|2/1|4/0 0 1
7|12 0 1 0 0 0/0|2/1 text|long 0 1
few 0 1 0 0 text|long text|long 0 1
few 0 1 0 0 0/0|4/0 text|long 0 1
few 0 1 0 0 text|long 4/0 0 1
4 0 1 0 0 0/0 0/0 0 1
30 0.6 0 0 0 2/1 3/1 0 1
20 0.5 1 0 0 6/1 5/1 0 1
7|12 0|0.1 0 0 0 line line|text 0 0
7|12 0 1 0 0 2/0|4/0 2/0|4/0 0 0
7|12 0|0.1 0 0 0 text|long 0/0|2/1 0 0
few|7 1|0.9 0 0 0 line|text|long line|text|long 0 0
14 0.8 0 0 0 10/0.9 12/0.9 0 0
few 0 0 0 0 line|text|long line 0 0
few 0 0 0 0 line line|text|long 0 0
4 0 2 0 0 2/1 2/1 0 0
"""


@dataclass(frozen=True)
class Tree:
    """A binary tree as parallel tuples; feature -1 marks a leaf whose threshold is its class."""

    feature: tuple[int, ...]
    threshold: tuple[float, ...]
    left: tuple[int, ...]
    right: tuple[int, ...]

    def __call__(self, x) -> bool:
        i = 0
        while (f := self.feature[i]) >= 0:
            i = self.left[i] if x[f] <= self.threshold[i] else self.right[i]
        return self.threshold[i] > 0.5


def train_tree(rows: list[list[float]], depth: int = 24) -> Tree:
    """CART with Gini impurity; the last value of a row is its class. Ties go to the first feature and threshold."""
    feature: list[int] = []
    threshold: list[float] = []
    left: list[int] = []
    right: list[int] = []
    x, y = np.array([r[:-1] for r in rows]), np.array([r[-1] for r in rows])

    def gini(n, p):
        return 2 * p * (n - p) / np.maximum(n, 1)

    def grow(at: np.ndarray, d: int) -> int:
        here = len(feature)
        for col in (feature, threshold, left, right):
            col.append(-1)
        n, p = len(at), y[at].sum()
        best = None
        if d and 0 < p < n:
            for f in range(x.shape[1]):
                order = at[np.argsort(x[at, f], kind="stable")]
                values, ones = x[order, f], np.cumsum(y[order])
                cuts = np.flatnonzero(values[1:] > values[:-1])
                if not len(cuts):
                    continue
                gain = gini(n, p) - gini(cuts + 1, ones[cuts]) - gini(n - cuts - 1, p - ones[cuts])
                k = int(gain.argmax())
                if gain[k] > (best[0] if best else 1e-9) + 1e-12:
                    best = (gain[k], f, (values[cuts[k]] + values[cuts[k] + 1]) / 2)
        if best is None:
            threshold[here] = float(p * 2 >= n)
            return here
        _, f, cut = best
        feature[here], threshold[here] = f, float(cut)
        low = x[at, f] <= cut
        left[here], right[here] = grow(at[low], d - 1), grow(at[~low], d - 1)
        return here

    grow(np.arange(len(rows)), depth)
    return Tree(tuple(feature), tuple(threshold), tuple(left), tuple(right))


FEATURES = ("words", "links", "kind", "element", "name", "words_before", "links_before", "words_after", "links_after", "marked")


def labelled_rows() -> list[list[float]]:
    """Features and class of every block of the labelled table."""
    rows = []
    for line in LABELLED.split("\n"):
        named = re.sub("|".join(SETS), lambda m: SETS[m[0]], line)
        for one in itertools.product(*(v.split("|") for v in named.split())):
            if one:
                rows.append([float(v) for part in one for v in part.split("/")])
    return rows


def hint_of(value: str) -> int:
    """What a class or id says: a name counts as strong if it is made of side matter and neutral words only."""
    found = 0
    for name in value.split():
        words = [w.lower() for w in WORDS.findall(name)]
        side = [w for w in words if w in BOILER_WORDS]
        if side and all(w in BOILER_WORDS or w in NEUTRAL_WORDS for w in words):
            return -2
        if side or any(w in WEAK_WORDS for w in words):
            found = -1
        elif not found and any(w in MAIN_WORDS for w in words):
            found = 1
    return found


HIDDEN = (-2, 0)


def region_of(name: str, attrs: str, parent: tuple[int, int]) -> tuple[int, int]:
    """(element, name) hints inside an element; HIDDEN is never text. The nearest element that says something
    counts; one that marks main text takes back what the names around it say."""
    if parent == HIDDEN or name in NEVER:
        return HIDDEN
    element, named = parent
    if name in BOILER_TAGS or name == "header" and element < 1:
        element = -1
    elif name in MAIN_TAGS:
        element, named = 1, min(0, named) if parent[0] == 1 else 0
    if attrs and ("=" in attrs or "hidden" in attrs):
        hints = []
        for key, a, b, c, bare in ATTR.findall(attrs):
            key, value = (key or bare).lower(), a or b or c
            if key in ("class", "id"):
                hints.append(hint_of(value))
            elif key == "role":
                role = value.strip().lower()
                element = -1 if role in BOILER_ROLES else 1 if role in ("main", "article") else element
            elif key == "hidden" or key == "style" and "display:none" in value.replace(" ", "").lower() or key == "aria-hidden" and value == "true":
                return HIDDEN
        if hints and name not in ("html", "body"):
            own = min(hints) if min(hints) < 0 else max(hints)
            if own < 0:
                # a weak hint does not weaken a strong one around it
                named = min(named, own) if named < 0 else own
            elif own and name not in INLINE:
                named = own if named > -2 else named
    return element, named


def blocks_of(page: str) -> list[tuple[str, int, float, tuple[int, int], int]]:
    """(text, words, link density, region, kind) of each non-empty text block, in page order."""
    out: list[tuple[str, int, float, tuple[int, int], int]] = []
    stack: list[tuple[str, tuple[int, int], int]] = []  # name, region, kind
    region = (0, 0)
    kind = links = pos = 0
    parts: list[str] = []
    linked: list[str] = []
    unescape = entities.unescape

    def flush() -> None:
        if region != HIDDEN and (words := "".join(parts).split()):
            n = len(words)
            out.append((" ".join(words), n, min(1.0, len("".join(linked).split()) / n) if linked else 0.0, region, kind))
        parts.clear()
        linked.clear()

    def say(text: str) -> None:
        if "&" in text:
            text = unescape(text)
        parts.append(text)
        if links:
            linked.append(text)

    def close(i: int) -> None:
        nonlocal region, kind
        del stack[i:]
        region, kind = (stack[-1][1], stack[-1][2]) if stack else ((0, 0), 0)

    for m in TAG.finditer(page):
        if (at := m.start()) > pos:
            say(page[pos:at])
        pos = m.end()
        raw, slash, name, attrs, odd_slash, odd = m.groups()
        if raw:
            if raw.lower() != "title":
                flush()
            continue
        if name is None:
            if odd is None:
                continue
            name, slash, attrs = odd, odd_slash, ""
        name = name.lower()
        if name == "br":
            say(" ")
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        if name in INLINE:
            if name == "a":
                links = 0 if slash else 1
            if slash:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] not in INLINE:
                        break
                    if stack[i][0] == name:
                        flush()
                        close(i)
                        break
            elif attrs and (own := region_of(name, attrs, region)) != region and attrs[-1] != "/":
                flush()
                region = own
                stack.append((name, region, kind))
            continue
        if parts:
            flush()
        links = 0
        if slash:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    close(i)
                    break
            continue
        if name == "body":
            while stack and stack[-1][0] != "html":
                close(len(stack) - 1)
        while stack:
            top = stack[-1][0]
            if top in INLINE or top == "p" and name in ENDS_P or top in HEADINGS and name in HEADINGS or top == name and name in REPEATS:
                close(len(stack) - 1)
            else:
                break
        if attrs:
            if attrs[-1] == "/" and name not in ("p", "div"):
                continue
            region = region_of(name, attrs, region)
        elif name in PLAIN:
            pass
        else:
            region = region_of(name, "", region)
        kind = 2 if name in HEADINGS else 1 if name in FLOW else 0
        stack.append((name, region, kind))
    if pos < len(page):
        say(page[pos:])
    flush()
    return out


def described(page: str) -> list[tuple[str, tuple[float, ...]]]:
    """(text, FEATURES) of every block."""
    blocks = blocks_of(page)
    marked = float(any(1 in b[3] for b in blocks))
    out, last = [], len(blocks) - 1
    for i, (text, n, density, region, kind) in enumerate(blocks):
        before, after = blocks[i - 1][1:3] if i else (0, 0.0), blocks[i + 1][1:3] if i < last else (0, 0.0)
        out.append((text, (n, density, kind, *region, *before, *after, marked)))
    return out


def extract(page: str | None, tree: Tree) -> str:
    """Main text of one page."""
    return "\n".join(text for text, x in described(page) if tree(x)) if page else ""


def decided_against(page: str, tree: Tree) -> int:
    """Blocks whose decision is not what their hints alone say: main text inside a main element or name and
    outside of side matter, or anywhere outside of side matter if the page marks no main region."""
    return sum(tree(x) != (x[3] >= 0 and x[4] >= 0 and (1 in x[3:5] or not x[-1])) for _, x in described(page))


def extract_pages(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """keep columns, text and n_chars of every page."""
    tree = train_tree(labelled_rows())

    def one(page: str | None) -> tuple[str, int]:
        text = extract(page, tree)
        return text, len(text)

    df = pages.select(*keep, html_col)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema[: len(keep)])
    return arrow_rows(df, per_row(one, ["text", "n_chars"], list(keep)), f"{kinds}, text string, n_chars bigint")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
