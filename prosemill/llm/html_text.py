"""Main text of web pages: flat text blocks, classified by a decision tree over their own and their neighbours' numbers.

A page is read as a flat sequence of text blocks, cut at block-level tags. Each block has its word count and link density, those of
the blocks before and after it, and what it stands in: the article's element, or one that by name, class or role holds something
else. The tree is trained by Spark's DecisionTreeClassifier on the small labelled table below.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession

FEATURES = ("words", "words_before", "words_after", "links", "links_before", "links_after", "other", "root", "heading")
#: Labelled blocks. words: count; links: share of words in links; other: stands in an element that holds something else; root: 1 in
#: the article's element, 0 on a page without one, -1 outside of it; heading: is one; last, whether the block is main text.
LABELLED = """
words before after links before after other root heading main
9 0 120 0.0 0.0 0.0 0 1 1 1
120 9 80 0.0 0.0 0.0 0 1 0 1
80 120 3 0.0 0.0 0.0 0 1 0 1
2 80 60 0.0 0.0 0.0 0 1 0 1
1 2 40 0.0 0.0 0.0 0 1 0 1
40 1 0 0.05 0.0 0.0 0 1 0 1
25 60 30 0.4 0.0 0.0 0 1 0 1
12 30 44 0.6 0.0 0.1 0 1 0 1
6 40 50 1.0 0.0 0.0 0 1 0 1
5 70 35 0.0 0.1 0.0 0 1 1 1
1 1 1 0.0 0.0 0.0 0 1 0 1
3 1 200 0.0 1.0 0.0 0 1 1 1
300 1 1 0.0 1.0 1.0 0 1 0 1
15 4 90 0.2 0.0 0.0 0 1 0 1
7 6 5 0.0 0.0 0.0 0 1 0 1
1 1 1 1.0 1.0 1.0 1 1 0 0
30 40 12 0.1 0.0 1.0 1 1 0 0
60 20 15 0.0 0.0 0.0 1 1 0 0
4 60 30 0.0 0.0 0.0 1 1 1 0
12 80 8 0.0 0.0 1.0 1 1 0 0
8 5 9 0.9 1.0 1.0 1 -1 0 0
1 1 1 1.0 1.0 1.0 1 -1 0 0
40 1 9 0.0 1.0 0.0 1 -1 0 0
7 1 90 0.0 1.0 0.0 1 -1 0 0
15 60 0 0.0 0.0 0.0 1 -1 0 0
90 12 20 0.0 0.0 0.0 1 -1 0 0
3 4 50 0.0 0.0 0.0 1 -1 1 0
6 1 90 0.0 1.0 0.0 0 -1 0 0
10 80 5 0.3 0.0 0.0 0 -1 0 0
35 90 10 0.0 0.0 0.0 0 -1 0 0
60 90 30 0.1 0.0 0.0 0 -1 0 0
4 90 12 0.0 0.0 0.5 0 -1 1 0
2 1 2 1.0 1.0 1.0 0 -1 0 0
110 2 60 0.0 1.0 0.0 0 0 0 1
60 110 45 0.05 0.0 0.0 0 0 0 1
45 60 3 0.1 0.0 1.0 0 0 0 1
28 5 40 0.0 0.0 0.0 0 0 0 1
22 3 18 0.0 0.0 0.0 0 0 0 1
18 22 20 0.1 0.0 0.0 0 0 0 1
12 60 40 0.0 0.0 0.0 0 0 0 1
8 80 50 0.0 0.0 0.0 0 0 0 1
3 60 70 0.0 0.1 0.0 0 0 0 1
6 1 80 0.0 1.0 0.0 0 0 1 1
5 40 60 0.0 0.0 0.0 0 0 1 1
4 30 25 0.0 0.0 0.0 0 0 1 1
9 0 30 0.0 0.0 0.0 0 0 1 1
2 1 1 1.0 1.0 1.0 0 0 0 0
1 1 1 1.0 1.0 1.0 0 0 0 0
5 2 3 1.0 1.0 1.0 0 0 0 0
14 5 6 0.9 1.0 1.0 0 0 0 0
40 12 20 0.8 1.0 0.9 0 0 0 0
20 30 6 0.7 0.9 1.0 0 0 0 0
6 40 5 0.0 0.0 1.0 0 0 0 0
4 3 2 0.0 1.0 1.0 0 0 0 0
3 2 4 0.0 0.0 0.0 0 0 0 0
8 6 3 0.2 0.0 1.0 0 0 0 0
7 50 0 0.0 0.0 0.0 0 0 0 0
5 4 6 0.0 1.0 1.0 0 0 1 0
2 1 3 0.0 1.0 1.0 0 0 1 0
110 2 60 0.0 1.0 0.0 1 0 0 0
25 110 12 0.0 0.0 0.0 1 0 0 0
2 110 12 0.0 0.0 0.0 1 0 1 0
12 1 60 0.0 1.0 0.0 1 0 0 0
6 3 2 1.0 1.0 1.0 1 0 0 0
24 5 2 0.0 0.0 0.0 0 0 0 1
24 5 26 0.0 0.0 0.0 0 0 0 1
26 2 8 0.1 0.0 0.0 0 0 0 1
30 12 0 0.0 0.0 0.0 0 0 0 1
55 6 7 0.0 1.0 0.0 0 0 0 1
16 24 40 0.0 0.0 0.0 0 0 0 1
14 40 26 0.2 0.0 0.0 0 0 0 1
2 24 26 0.0 0.0 0.1 0 0 0 1
2 26 30 0.0 0.0 0.0 0 0 0 1
70 40 6 0.2 0.0 1.0 0 0 0 1
33 2 35 0.0 0.0 0.0 0 0 0 1
200 0 0 0.0 0.0 0.0 0 0 0 1
5 0 24 0.0 0.0 0.0 0 0 1 1
8 6 28 0.0 1.0 0.0 0 0 1 1
7 1 55 0.0 0.0 0.0 0 0 1 1
10 3 45 0.1 1.0 0.0 0 0 1 1
9 8 7 0.0 0.0 0.0 0 0 0 0
11 10 9 0.1 0.0 0.3 0 0 0 0
6 1 90 1.0 1.0 0.0 0 0 0 0
3 4 60 1.0 1.0 0.0 0 0 0 0
5 90 4 1.0 0.0 1.0 0 0 0 0
2 60 1 0.9 0.0 1.0 0 0 0 0
25 1 1 0.7 1.0 1.0 0 0 0 0
30 28 26 0.8 0.8 0.8 0 0 0 0
90 60 80 0.0 0.0 0.0 1 0 0 0
45 30 60 0.1 0.0 0.0 1 0 0 0
20 24 40 0.0 0.0 0.1 1 0 0 0
16 2 60 0.0 0.0 0.0 1 0 0 0
150 80 90 0.0 0.0 0.0 1 -1 0 0
60 70 44 0.1 0.0 0.0 1 1 0 0
150 120 90 0.0 0.0 0.0 1 1 0 0
22 150 70 0.0 0.0 0.0 1 1 0 0
5 22 70 0.0 0.0 0.0 1 1 1 0
10 0 30 0.0 0.0 0.0 1 0 1 0
2 3 50 0.0 0.0 0.0 1 -1 0 0
18 40 60 0.0 0.0 0.0 1 0 0 0
70 0 0 0.0 0.0 0.0 0 1 0 1
2 0 0 0.0 0.0 0.0 0 1 0 1
15 2 3 0.0 1.0 1.0 0 1 0 1
4 5 8 0.3 0.0 0.0 0 1 0 1
1 90 1 1.0 0.0 1.0 0 1 0 1
20 1 1 0.0 0.0 0.0 0 1 0 1
90 90 90 0.0 0.0 0.0 0 1 0 1
6 6 6 0.0 0.0 0.0 0 1 1 1
80 70 60 0.0 0.0 0.0 0 -1 0 0
25 0 24 0.0 0.0 0.0 0 -1 0 0
12 24 60 0.0 0.0 0.0 0 -1 1 0
8 8 8 0.0 0.0 0.0 0 -1 0 0
40 30 50 0.0 0.0 0.0 0 -1 0 0
16 90 90 0.0 0.0 0.0 0 -1 0 0
1 0 1 0.0 0.0 0.0 0 -1 0 0
"""
#: Elements whose text is never shown as text; void elements; elements that begin a block; and what isn't the article.
SILENT = "script style noscript template svg math iframe object title textarea select option canvas audio video map datalist".split()
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    """address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header
    hgroup hr html label legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul""".split()
)
OTHER = set("nav footer aside form menu dialog button fieldset search".split())
ROOTS = ("main", "article")
OTHER_WORDS = set(
    """ad ads advert adverts advertisement advertising adsense adslot adbox banner sponsor sponsored promo promotion promoted nav navbar navigation menu menubar
    breadcrumb breadcrumbs sidebar sidebars rail widget widgets footer foot footnav masthead topbar toolbar cookie cookies consent gdpr notice notices notification
    alert popup modal overlay newsletter subscribe subscription signup login signin register share sharing sharebar social follow related recommended recommendations
    recommendation teaser teasers outbrain taboola comment comments commentlist disqus discussion reply replies respond pagination pager paging tags taglist
    skip skiplink copyright legal disclaimer search searchbox""".split()
)
OTHER_ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist".split())
COMMENT_ROOTS = set("comment comments commentlist reply teaser related".split())

NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
#: The rest of a tag, whose quotes are closed.
REST = re.compile(r"(?:\"[^\"]*\"|'[^']*'|[^'\">])*+>")
CLOSING = {name: re.compile(rf"</{name}\s*>", re.I) for name in SILENT}
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass
class Block:
    text: str
    words: int
    links: float
    other: bool
    root: bool
    heading: bool


@dataclass
class Open:
    name: str
    other: bool
    root: bool
    hidden: bool


def scan(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """(text before, name, whether it is an end tag, rest) of each tag, with name "" for comments, declarations, elements without text
    and, last, the page's end.

    A tag ends at the first > outside of quotes. Where a quote is never closed, this one and all later tags end at their first >, and
    a < without any > after it is text: each character is looked at a few times, however broken the page is.
    """
    at = start = 0
    last, quoted = page.rfind(">"), True
    while 0 <= (i := page.find("<", start)) < last or 0 <= i and page.startswith("<!--", i):
        name, end, rest, start = "", False, "", i + 1
        if page.startswith("<!--", i):
            stop = page.find("-->", i + 4)
            stop = len(page) if stop < 0 else stop + 3
        elif page.startswith(("<!", "<?"), i):
            stop = page.find(">", i) + 1
        elif m := NAME.match(page, i):
            found = REST.match(page, m.end()) if quoted else None
            quoted = found is not None
            stop = found.end() if found else page.find(">", i) + 1
            name, end, rest = m[1].lower(), page[i + 1] == "/", page[m.end() : stop - 1]
            if name in CLOSING and not end:
                closing = CLOSING[name].search(page, stop)
                name, stop = "", closing.end() if closing else len(page)
        else:
            continue
        yield page[at:i], name, end, rest
        at = start = stop
    yield page[at:], "", False, ""


@dataclass
class Reader:
    """Reads a page into flat blocks."""

    blocks: list[Block] = field(default_factory=list)
    stack: list[Open] = field(default_factory=list)
    names: Counter = field(default_factory=Counter)
    parts: list[tuple[str, bool]] = field(default_factory=list)
    in_link: bool = False
    heading: bool = False

    def read(self, page: str) -> list[Block]:
        for text, name, end, rest in scan(page):
            if text:
                self.parts.append((text, self.in_link))
            if name:
                self.tag(name, end, rest)
        self.flush()
        return self.blocks

    def flush(self) -> None:
        if self.parts:
            top = self.stack[-1] if self.stack else Open("", False, False, False)
            # references are decoded in a piece's whole text, then white space is squeezed over the block
            texts = [(html.unescape(t) if "&" in t else t, a) for t, a in self.parts]
            text = " ".join("".join(t for t, _ in texts).split())
            self.parts = []
            if text and not top.hidden:
                words = len(text.split())
                linked = sum(len(t.split()) for t, a in texts if a)
                self.blocks.append(Block(text, words, min(1.0, linked / words), top.other, top.root, self.heading))

    def tag(self, name: str, end: bool, rest: str) -> None:
        if name == "a":
            self.in_link = not end
            return
        if name == "br" or name in VOID and name != "hr":
            self.parts.append((" ", self.in_link))
            return
        if name not in BLOCKS:
            return
        self.flush()
        self.heading = not end and name[0] == "h" and name[1:].isdigit()
        if name in ("p", "hr", "html") or self.heading or name[0] == "h" and name[1:].isdigit():
            return
        if end:
            if self.names[name]:  # what it closes, with all that is still open within
                self.in_link = False
                while (closed := self.stack.pop().name) != name:
                    self.names[closed] -= 1
                self.names[name] -= 1
        elif not rest.rstrip().endswith("/"):
            self.stack.append(self.opened(name, rest))
            self.names[name] += 1

    def opened(self, name: str, rest: str) -> Open:
        up = self.stack[-1] if self.stack else Open("", False, False, False)
        values = {a.lower(): x or y or z for a, x, y, z in ATTRIBUTE.findall(rest)} if rest.strip() else {}
        names = {p.lower() for k in ("class", "id") for p in PIECE.findall(values.get(k, ""))} | {x.lower() for x in values.get("class", "").split()}
        named = bool(names & OTHER_WORDS) and name != "body" and not (name in ROOTS and not names & COMMENT_ROOTS)
        header = (name == "header" or "header" in names) and not up.root
        other = up.other or name in OTHER or header or named or values.get("role", "").lower() in OTHER_ROLES
        style = values.get("style", "").replace(" ", "").lower()
        hidden = up.hidden or "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style
        root = up.root or not other and (name in ROOTS or values.get("role", "").lower() in ROOTS)
        return Open(name, other, root, hidden)


def read_blocks(page: str | None) -> list[Block]:
    return Reader().read(page) if page else []


def feature_rows(blocks: list[Block]) -> list[tuple[float, ...]]:
    """FEATURES of each block of a page; beyond its ends there is a block without words."""
    rooted = any(b.root and not b.other for b in blocks)
    w, l = [0, *[b.words for b in blocks], 0], [0.0, *[b.links for b in blocks], 0.0]  # noqa: E741
    return [(w[i], w[i - 1], w[i + 1], l[i], l[i - 1], l[i + 1], float(b.other), (1.0 if b.root else -1.0) if rooted else 0.0, float(b.heading)) for i, b in enumerate(blocks, 1)]


#: A tree's node: a class, or (feature, threshold, node for values up to it, node for larger ones).
Tree = float | tuple


def train(spark: SparkSession, labelled: str = LABELLED, depth: int = 7) -> Tree:
    rows = [list(map(float, x.split())) for x in labelled.strip().splitlines()[1:]]
    data = spark.createDataFrame([(Vectors.dense(r[:-1]), r[-1]) for r in rows], ["features", "label"]).coalesce(1)
    model = DecisionTreeClassifier(maxDepth=depth, maxBins=64, seed=1).fit(data)

    def node(j) -> Tree:
        if j.subtreeDepth() == 0:
            return float(j.prediction())
        return (int(j.split().featureIndex()), float(j.split().threshold()), node(j.leftChild()), node(j.rightChild()))

    return node(model._java_obj.rootNode())


def classify(tree: Tree, row: tuple[float, ...]) -> bool:
    while isinstance(tree, tuple):
        feature, threshold, low, high = tree
        tree = low if row[feature] <= threshold else high
    return tree > 0.5


def main_text(page: str | None, tree: Tree) -> str:
    blocks = read_blocks(page)
    return "\n".join(b.text for b, row in zip(blocks, feature_rows(blocks)) if classify(tree, row))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of pages (page_id, url, html, and any others).

    A head needs no end tag: what it shows nothing of has tags of its own. Null and empty html and pages without main text give an empty text; an unclosed comment or script hides the rest of its page. Very
    long and broken pages take time in proportion to their length. An empty table gives an empty result.
    Rows don't depend on each other, so repeated rows come back as often as they came.
    """
    tree = train(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [main_text(h, tree) for h in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": texts, "n_chars": list(map(len, texts))})

    return pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html").mapInPandas(run, "page_id long, url string, text string, n_chars long")
