"""Main-content blocks of pages: one vectorised helper over Arrow batches, one row a block."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Elements that are blocks, those whose content is skipped or ignored, and void ones.
BLOCKS = frozenset("p ul ol div dd blockquote".split())
SKIPPED = frozenset("nav header footer aside form pre code button select textarea figure table".split())
IGNORED = frozenset("script style svg noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MOST_DEPTH = 200


@dataclass
class Node:
    name: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)
    up: Node | None = None

    def elements(self) -> Iterator[Node]:
        """Its descendants in page order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    def above(self) -> Iterator[Node]:
        n = self.up
        while n is not None:
            yield n
            n = n.up


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("")
        self.depth = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("p", "li", "dd", "dt"):  # an open one of its kind ends here
            for n in [self.at, *self.at.above()]:
                if n.name == tag:
                    self.at = n.up or self.root
                    break
                if n.name in ("div", "ul", "ol", "article", "main", "section", "td", "body", "blockquote"):
                    break
        node = Node(tag, {k: v or "" for k, v in attrs}, [], self.at)
        self.at.children.append(node)
        if tag not in VOID and sum(1 for _ in zip(range(MOST_DEPTH + 1), node.above())) <= MOST_DEPTH:
            self.at = node

    def handle_endtag(self, tag: str) -> None:
        for n in [self.at, *self.at.above()]:
            if n.name == tag:
                self.at = n.up or self.root
                return

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def hidden(n: Node) -> bool:
    style = n.attrs.get("style", "").replace(" ", "").lower()
    return "hidden" in n.attrs or n.attrs.get("aria-hidden") == "true" or "display:none" in style or n.attrs.get("contenteditable", "false") in ("", "true")


def squeeze(text: str) -> str:
    return " ".join(text.split())


def serialise(nodes: list) -> str:
    """White space squeezed, list items as "- " lines, bold between double stars, br as a line break."""
    out: list[str] = []

    def walk(n) -> None:
        if isinstance(n, str):
            out.append(" ".join(n.split("\n")) if n.strip() else " ")
            return
        if n.name in IGNORED or hidden(n):
            return
        if n.name == "br":
            out.append("\n")
            return
        bold = n.name in ("b", "strong")
        if n.name == "li":
            out.append("\n- ")
        if bold:
            inner = squeeze(serialise(n.children))
            out.append(f"**{inner}**" if inner else "")
            return
        for c in n.children:
            walk(c)
        if n.name in ("p", "div", "li"):
            out.append("\n")

    for n in nodes:
        walk(n)
    return "\n".join(x for x in (squeeze(line) for line in "".join(out).split("\n")) if x)


def plain(nodes: list) -> str:
    parts: list[str] = []
    stack = list(reversed(nodes))
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            parts.append(n)
        elif n.name not in IGNORED and not hidden(n):
            stack += reversed(n.children)
    return squeeze(" ".join(parts))


def roots(tree: Node) -> list[Node]:
    """main; else the outermost articles; else the element that holds all long paragraphs; else the page."""
    for n in tree.elements():
        if n.name == "main" or n.attrs.get("role") == "main":
            return [n]
    articles = [n for n in tree.elements() if n.name == "article" and not any(a.name == "article" for a in n.above())]
    if articles:
        return articles
    long = [n for n in tree.elements() if n.name == "p" and len(plain([n]).split()) >= 25]
    if not long:
        return [tree]
    common = [long[0].up, *long[0].up.above()] if long[0].up else [tree]
    for n in long[1:]:
        above = {id(x) for x in n.above()}
        common = [x for x in common if id(x) in above]
    return common[:1] or [tree]


def link_share(n: Node) -> float:
    words = len(plain([n]).split())
    linked = sum(len(plain([a]).split()) for a in n.elements() if a.name == "a")
    return linked / words if words else 0.0


def runs(n: Node, min_words: int) -> list[str]:
    """Its text between double line breaks, where at least two runs are long enough and no block is inside."""
    parts, breaks = [[]], 0
    for c in n.children:
        if isinstance(c, Node) and c.name == "br":
            breaks += 1
            continue
        if isinstance(c, str) and not c.strip():
            continue
        if breaks >= 2:
            parts.append([])
        elif breaks:
            parts[-1].append(Node("br"))
        breaks = 0
        parts[-1].append(c)
    texts = [serialise(p) for p in parts]
    good = [t for t in texts if len(t.split()) >= min_words]
    return good if len(good) >= 2 else []


def blocks_of(html: str | None, min_words: int) -> list[tuple[str, str]]:
    """(kind, text) of each block of a page's main content."""
    if not html:
        return []
    parser = _Tree()
    parser.feed(html)
    parser.close()
    out: list[tuple[str, str]] = []

    def usable(n: Node) -> bool:
        return n.name not in SKIPPED | IGNORED and not hidden(n)

    for root in roots(parser.root):
        stack = [root]
        while stack:
            n = stack.pop()
            inside = [e for e in n.elements() if e.name in BLOCKS]
            if n is not root and n.name in BLOCKS and not (inside and n.name in ("div", "blockquote", "dd")):
                split = runs(n, min_words)
                for t in split:
                    out.append(("run", t))
                text = "" if split else serialise([n])
                if not split and len(text.split()) >= min_words and link_share(n) <= 0.5:
                    out.append((n.name, text))
                continue
            if not inside and (split := runs(n, min_words)):
                out += [("run", t) for t in split]
                continue
            stack += [c for c in reversed(n.children) if isinstance(c, Node) and usable(c)]
    return out


def content_blocks(df: DataFrame, html: str, keys: list[str], min_words: int = 25) -> DataFrame:
    """keys, pos, kind, text: blocks of the main content with enough words and at most half of them in links. Null pages have none."""
    schema = T.StructType([*df.select(*keys).schema.fields, *T.StructType.fromDDL("pos int, kind string, text string").fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [blocks_of(h, min_words) for h in b[html]]
            rows = [i for i, f in enumerate(found) for _ in f]
            if not rows:
                continue
            out = b[keys].iloc[rows].reset_index(drop=True)
            yield out.assign(pos=[j for f in found for j in range(len(f))], kind=[k for f in found for k, _ in f], text=[t for f in found for _, t in f])

    return df.select(*keys, html).mapInPandas(run, schema)
