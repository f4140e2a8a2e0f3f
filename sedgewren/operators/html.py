"""Main text and metadata of web pages: a small tree of elements, built by a forgiving parser, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from sedgewren.session import bound_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that an opening tag closes where they are open.
IMPLIED = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
BLOCKS = frozenset("p li h1 h2 h3 h4 blockquote pre dd td".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Page furniture by tag, by role, by class and by id.
STRIP_TAGS = frozenset("script style noscript template svg iframe form nav header footer aside button".split())
STRIP_ROLES = frozenset("navigation banner contentinfo".split())
STRIP_CLASSES = frozenset("sidebar nav navbar menu comments advertisement cookie newsletter related-posts share social".split())
STRIP_IDS = frozenset("sidebar comments".split())
#: Containers of main text, likeliest first: by tag, role, class or id.
CONTAINERS = (("tag", "article"), ("tag", "main"), ("role", "main"), ("class", "post-content"), ("class", "entry-content"), ("class", "article-body"), ("class", "markdown-body"), ("class", "prose"), ("id", "content"), ("class", "content"), ("abstract", "blockquote"), ("tag", "body"))
LEAST_BLOCK, ENOUGH = 24, 1200


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict, parent) -> None:
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def walk(self) -> Iterator["Node"]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                stack += reversed(x.children)
        return "".join(out)


class Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def _close(self, tags, until: frozenset = frozenset({"table", "ul", "ol", "dl"})) -> None:
        node = self.at
        while node.parent is not None and node.tag not in until:
            if node.tag in tags:
                self.at = node.parent
                return
            node = node.parent

    def handle_starttag(self, tag, attrs) -> None:
        if tag in CLOSES_P:
            self._close({"p"}, frozenset({"table", "td", "button"}))
        if tag in IMPLIED:
            self._close(IMPLIED[tag])
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag) -> None:
        node = self.at
        while node.parent is not None:
            if node.tag == tag:
                self.at = node.parent
                return
            node = node.parent

    def handle_data(self, data) -> None:
        self.at.children.append(data)


def collapse(text: str) -> str:
    return " ".join(text.replace("﻿", " ").split())


def meta(nodes: list[Node], *names: str) -> str | None:
    for name in names:
        for attr in ("property", "name"):
            hit = next((n for n in nodes if n.tag == "meta" and n.attrs.get(attr) == name), None)
            if hit is not None and "content" in hit.attrs:
                if value := collapse(hit.attrs["content"]):
                    return value
                break
    return None


def furniture(n: Node) -> bool:
    classes = n.attrs.get("class", "").split()
    in_figure = n.tag == "figcaption" and any(True for _ in _up(n, "figure"))
    return (n.tag in STRIP_TAGS or in_figure or n.attrs.get("aria-hidden") == "true" or n.attrs.get("role") in STRIP_ROLES or not STRIP_CLASSES.isdisjoint(classes) or n.attrs.get("id") in STRIP_IDS)


def _up(n: Node, tag: str) -> Iterator[Node]:
    while n.parent is not None:
        n = n.parent
        if n.tag == tag:
            yield n


def prune(n: Node) -> None:
    stack = [n]
    while stack:
        x = stack.pop()
        x.children = [c for c in x.children if isinstance(c, str) or not furniture(c)]
        stack += [c for c in x.children if isinstance(c, Node)]


def _is(n: Node, kind: str, value: str) -> bool:
    if kind == "tag":
        return n.tag == value
    if kind == "class":
        return value in n.attrs.get("class", "").split()
    if kind == "abstract":
        return n.tag == value and "abstract" in n.attrs.get("class", "").split()
    return n.attrs.get(kind) == value


def block_text(scope: Node) -> str:
    parts = [t for n in scope.walk() if n is not scope and n.tag in BLOCKS and len(t := collapse(n.text())) >= LEAST_BLOCK]
    return "\n\n".join(dict.fromkeys(parts)) if parts else collapse(scope.text())


def extract(html: str | None, most: int = 5000) -> dict:
    """title, description, site_name, byline, published_at, text, word_count of a page."""
    tree = Tree()
    tree.feed(html or "")
    tree.close()
    nodes = list(tree.root.walk())
    first = lambda test: next((collapse(n.text()) for n in nodes if test(n)), None)
    out = {
        "title": meta(nodes, "og:title", "twitter:title") or first(lambda n: n.tag == "title") or None,
        "description": meta(nodes, "og:description", "description", "twitter:description"),
        "site_name": meta(nodes, "og:site_name", "application-name"),
        "byline": meta(nodes, "author", "article:author") or first(lambda n: "author" in n.attrs.get("rel", "").split()) or None,
        "published_at": meta(nodes, "article:published_time", "date") or next((n.attrs["datetime"] for n in nodes if n.tag == "time" and n.attrs.get("datetime")), None),
    }
    prune(tree.root)
    kept, text = list(tree.root.walk()), ""
    for kind, value in CONTAINERS:
        scope = next((n for n in kept if _is(n, kind, value)), None)
        if scope is not None and len(found := block_text(scope)) > len(text):
            text = found
        if len(text) > ENOUGH:
            break
    text = (text or ("" if any(n.tag == "body" for n in kept) else block_text(tree.root)))[:most].strip()
    return out | {"text": text, "word_count": len(text.split())}


DDL = "title string, description string, site_name string, byline string, published_at string, text string, word_count long"


def extract_articles(pages: DataFrame, id_col: str, html_col: str, most: int = 5000) -> DataFrame:
    """The id and the extracted columns of every page, in one pass without a shuffle."""
    bound_batches(pages.sparkSession)
    schema = _parse_datatype_string(f"{id_col} long, {DDL}")
    arrow = to_arrow_schema(schema)
    names = arrow.names[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [extract(h, most) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array([f[n] for f in found], arrow.field(n).type) for n in names)], schema=arrow)

    return pages.select(id_col, html_col).mapInArrow(run, schema)


def content_status(text: Column, description: Column) -> Column:
    return F.when((F.length(text) > 120) | (F.length(description) > 0), "ok").otherwise("empty")
