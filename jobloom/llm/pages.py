"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree.  A node is an element's path of tags, with its class or
id; below it the pages differ in how they present it (the sequence of its children) and in what it says
(the text of its blocks).  A node that all pages present alike, or that says the same on all of them, is
furniture of the site; one that differs from page to page is content:

* presentation importance: the share of the child sequences, each counted once a page, that are not the same on
  nearly all pages that have the node (all but ``IMPORTANCE``), so it is between 0 (all alike) and 1;
* content importance: the same share of the block texts;
* importance of a node: the larger of the two; of a branch, that of its best node.

These shares do not depend on how many pages a host has.

The tree is a table with one row per host, node and feature, counted by a grouped aggregation; a page
gets back the importance of its own nodes only.  A branch goes when its importance is below
``IMPORTANCE`` and at least ``PAGES`` different pages have it, but not inside what the page marks as article or
main, nor where a block beside it is important, as a heading's are.  Two kinds of evidence need no other page: what
an element is by its tag, role or class (menus, adverts, forms, comments, ...), and where the page says
its article is.

Defined cases: null html counts as empty and gives an empty text; unclosed and misnested tags are closed
as browsers do, in simplified form; copies of a page count once in the tree of their host; a null or odd url has
the empty host.  Columns of the input with the name of a result column are replaced.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.llm.common import free_name
from jobloom.session import saved

IMPORTANCE = 0.2
BROADCAST_BYTES = 16_000_000   # of the low nodes of all hosts, sent to all tasks up to that size
PAGES = 8            # that have a node before it decides anything
SHAPE, TEXT, PAGE = range(3)   # kinds of features: child sequence, block text, that a page has the node

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template head title svg math iframe object canvas audio video".split())
#: elements that are never part of an article's text
FURNITURE = frozenset("nav header footer aside form button select textarea input label fieldset menu dialog".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table
    tbody td tfoot th thead tr ul""".split())
#: an open p ends where one of these begins
ENDS_P = BLOCKS - {"body", "html", "caption", "dd", "dt", "li", "tbody", "td", "tfoot", "th", "thead", "tr", "legend"}
#: elements that end an open element of the same kind beside them
ENDS_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
             "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
BARRIERS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"},
            "option": {"select"}, "tbody": {"table"}}
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alert".split())
FURNITURE_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|adsense|sponsor(?:ed|s)?|promo(?:tion|s)?|banner|cookies?|consent|gdpr|notice|popup|modal|"
    r"overlay|newsletter|subscribe|subscription|signup|login|sidebar|side-?bar|widget|related|recommend(?:ed|ations?)?|share|sharing|social|"
    r"nav|navbar|navigation|menu|breadcrumbs?|topbar|toolbar|header|footer|masthead|site-?(?:header|footer|nav)|comments?|respond|"
    r"replies|disqus|pagination|pager|copyright|legal|disclaimer|skip-?link|search)(?:$|[\s_-]|\d)", re.I)
CONTENT_NAME = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|content|main)(?:[\s_-]?(?:body|content|text))?(?:$|[\s_-])", re.I)
#: elements that no class or id makes furniture
NOT_BY_NAME = frozenset("article main h1 h2 h3 h4 h5 h6".split())
BLANKS = re.compile(r"\s+")


def digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


@dataclass
class Node:
    tag: str
    path: str            # hash of the tags, classes and ids from the root down
    name: str
    furniture: bool
    parent: Node | None = None
    article: bool = False
    children: list[Node | str] = field(default_factory=list)


class PageTree(HTMLParser):
    """The element tree of one page, without what is never shown."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html", "", "", False)
        self.top = self.root
        self.silent: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.silent:
            if tag == self.silent[-1] and tag not in VOID:
                self.silent.append(tag)
            elif self.silent[0] == "head" and tag == "body":
                self.silent = []
            return
        if tag in SILENT:
            self.silent.append(tag)
            return
        if tag in ("html", "body"):
            return
        self._close_for(tag)
        if tag in VOID:
            self.top.children.append(Node(tag, "", "", False, self.top))
            return
        given = {k: v or "" for k, v in attrs}
        names = f"{given.get('class', '')} {given.get('id', '')}".strip()
        role = given.get("role", "").lower()
        hidden = "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "").lower()
        is_article = tag in ("article", "main") or role in ("article", "main") or given.get("itemprop") == "articleBody"
        furniture = tag in FURNITURE or role in FURNITURE_ROLES or hidden or self._named_furniture(tag, given.get("class", ""), names)
        node = Node(tag, digest(f"{self.top.path}/{tag} {names}"), names, furniture, self.top, is_article)
        self.top.children.append(node)
        self.top = node

    def _named_furniture(self, tag: str, classes: str, names: str) -> bool:
        """Whether a container's class or id tells.  Within content ids are anchors, and in an article only whole classes count."""
        if not names or tag in NOT_BY_NAME:
            return False
        above = list(_ancestors(self.top))
        if any(n.article and n.tag != "main" for n in above):
            return any(FURNITURE_NAME.fullmatch(c) for c in classes.split())
        return bool(FURNITURE_NAME.search(classes if any(n.article or _named_content(n) for n in above) else names))

    def _close_for(self, tag: str) -> None:
        if tag in ENDS_P:
            self._close({"p"}, {"table", "td", "th", "button", "li", "article", "section", "div", "blockquote"})
        if tag in ENDS_SAME:
            self._close(ENDS_SAME[tag], BARRIERS[tag])

    def _close(self, tags: set[str], barriers: set[str]) -> None:
        node = self.top
        while node.parent is not None and node.tag not in barriers:
            if node.tag in tags:
                self.top = node.parent
                if tags == {"p"}:
                    return
            node = node.parent

    def handle_endtag(self, tag: str) -> None:
        if self.silent:
            if tag == self.silent[-1]:
                self.silent.pop()
            return
        node = self.top
        while node.parent is not None and node.tag != tag:
            # an inline end tag does not close blocks around it
            if node.tag in BLOCKS and tag not in BLOCKS:
                return
            node = node.parent
        if node.parent is not None:
            self.top = node.parent

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.top.children.append(data)


def parse(html: str) -> Node:
    tree = PageTree()
    try:
        tree.feed(html)
        tree.close()
    except (AssertionError, ValueError):    # a declaration the parser cannot read: keep what came before
        pass
    return tree.root


def walk(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        n = stack.pop()
        yield n
        stack.extend(c for c in reversed(n.children) if isinstance(c, Node))


def blocks_of(node: Node, skip) -> list[tuple[Node, str]]:
    """(element, text) of each block of text below ``node``, in page order, without skipped branches."""
    out: list[tuple[Node, str]] = []
    pieces: list[str] = []
    owner = node

    def flush() -> None:
        text = BLANKS.sub(" ", "".join(pieces)).strip()
        pieces.clear()
        if text:
            out.append((owner, text))

    stack: list[tuple[object, Node]] = [(c, node) for c in reversed(node.children)]
    while stack:
        item, inside = stack.pop()
        if item is None:                 # the end of a block
            flush()
            owner = inside
        elif isinstance(item, str):
            pieces.append(item)
        elif item.tag in ("br", "wbr"):
            pieces.append(" " if item.tag == "br" else "")
        elif item.tag == "hr":
            flush()
        elif not skip(item):
            if item.tag in BLOCKS:
                flush()
                stack.append((None, owner))
                owner = item
            stack.extend((c, item) for c in reversed(item.children))
    flush()
    return out


def style_features(html: str) -> Iterator[tuple[str, int, str]]:
    """(path, kind, hash of the feature) of each style node of a page, once per path and feature."""
    root = parse(html)
    seen = set()
    for node in walk(root):
        if node.path and node.tag in BLOCKS:
            shape = " ".join(c.tag for c in node.children if isinstance(c, Node))
            seen.add((node.path, SHAPE, shape))
    for owner, text in blocks_of(root, lambda n: False):
        seen.add((owner.path, TEXT, text))
    seen |= {(p, PAGE, "") for p, _, _ in seen}
    return ((p, k, digest(v)) for p, k, v in sorted(seen))


def main_blocks(html: str, importance: dict[str, float]) -> list[str]:
    """Texts of the main blocks of a page, given the importance of some of its nodes."""
    root = parse(html)
    # a branch is as important as its best node; nodes of unknown importance count fully
    best: dict[int, float] = {}
    order = list(walk(root))
    for node in reversed(order):
        own = importance.get(node.path, 1.0) if node.tag in BLOCKS else 0.0
        best[id(node)] = max([own, *(best[id(c)] for c in node.children if isinstance(c, Node))])

    # elements of which a block of text itself is important: what is beside it belongs to it
    telling = {id(n.parent) for n in order if n.path and n.tag in BLOCKS and n.parent is not None and n.parent.path and best[id(n)] >= IMPORTANCE
               and not n.furniture and not any(isinstance(c, Node) and c.tag in BLOCKS for c in n.children)}

    def low(node: Node) -> bool:
        return node.tag in BLOCKS and best[id(node)] < IMPORTANCE and not node.article and not _inside_article(node) \
            and id(node.parent) not in telling

    def skip(node: Node) -> bool:
        # a heading group inside an article belongs to it
        kept = node.tag == "header" and _inside_article(node)
        return (node.furniture and not kept) or low(node)

    articles = [n for n in order if n.article and not any(_above(n, lambda a: a.article or skip(a)))]
    places = articles or [n for n in order if _named_content(n) and not skip(n) and not any(_above(n, lambda a: _named_content(a) or skip(a)))] or [root]
    found = [text for place in places for _, text in blocks_of(place, skip)]
    return found if found or not importance else main_blocks(html, {})   # pages of a host that are all alike


def _ancestors(node: Node | None) -> Iterator[Node]:
    """The node and those above it, without the root."""
    while node is not None and node.parent is not None:
        yield node
        node = node.parent


def _above(node: Node, test) -> Iterator[bool]:
    return map(test, _ancestors(node.parent))


def _named_content(node: Node) -> bool:
    return node.tag in ("div", "section") and bool(CONTENT_NAME.search(node.name))


def _inside_article(node: Node) -> bool:
    return any(_above(node, lambda a: a.article))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def style_tree(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """(host, path, importance) of the nodes of all hosts with enough pages; hosts and paths by their hashes."""
    rows = pages.select(F.xxhash64(host_of(F.col(url))).alias("host"), F.coalesce(F.col(html), F.lit("")).alias("html")) \
        .withColumn("print", F.xxhash64("html"))
    number = lambda d: int(d or "0", 16) - (1 << 63)  # noqa: E731  the root has no hash

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(h, number(p), k, number(v), c) for h, page, c in zip(pdf["host"], pdf["html"], pdf["print"])
                     for p, k, v in style_features(page)]
            yield pd.DataFrame(found, columns=["host", "path", "kind", "feature", "print"])

    # copies of a page say nothing about what differs between pages: each different page counts once
    counted = rows.mapInPandas(features, "host long, path long, kind int, feature long, print long") \
        .groupBy("host", "path", "kind", "feature").agg(F.count_distinct("print").alias("count"))
    # how many features are on how many pages: at most about the root of their number for a node
    spread = counted.groupBy("host", "path", "kind", "count").agg(F.count("*").alias("n")) \
        .groupBy("host", "path").agg(F.collect_list(F.struct("kind", "count", "n")).alias("rows")) \
        .withColumn("having", F.array_max(F.transform(F.filter("rows", lambda r: r["kind"] == PAGE), lambda r: r["count"])))

    def share(kind: int) -> Column:
        total = lambda rows: F.aggregate(rows, F.lit(0).cast("long"), lambda acc, r: acc + r["count"] * r["n"])
        mine = F.filter("rows", lambda r: r["kind"] == kind)
        return F.coalesce(F.try_divide(total(F.filter(mine, lambda r: r["count"] < (1 - IMPORTANCE) * F.col("having"))), total(mine)), F.lit(0.0))

    return spread.where(F.col("having") >= PAGES).select("host", "path", F.greatest(share(SHAPE), share(TEXT)).alias("importance"))


def extract_main_text(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """The rows of ``pages`` with ``text`` and ``n_chars``."""
    # Only low nodes matter to a page.  They are few per host, as a host's templates are.
    low = style_tree(pages, html, url).where(F.col("importance") < IMPORTANCE) \
        .groupBy("host").agg(F.collect_list(F.struct("path", "importance")).alias("_low"))
    host, nodes, low_host = (free_name(pages, n) for n in ("_host", "_nodes", "_low_host"))
    low = saved(low.select(F.col("host").alias(low_host), F.to_json("_low").alias(nodes)))
    size = low.agg(F.coalesce(F.sum(F.length(nodes) + 16), F.lit(0)).alias("n")).first()["n"]
    low = F.broadcast(low) if size <= BROADCAST_BYTES else low
    joined = pages.withColumn(host, F.xxhash64(host_of(F.col(url)))).join(low, F.col(host) == F.col(low_host), "left")

    @F.pandas_udf("string")
    def extract(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict[str, dict[str, float]] = {}
        for pages_, lists in batches:
            out = []
            for page, listed in zip(pages_, lists):
                if listed not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[listed] = {f"{n['path'] + (1 << 63):016x}": n["importance"] for n in json.loads(listed)} if listed else {}
                out.append("\n".join(main_blocks(page, known[listed])))
            yield pd.Series(out)

    keep = [F.col(c) for c in pages.columns if c.lower() not in ("text", "n_chars")]
    return joined.withColumn("text", extract(F.coalesce(F.col(html), F.lit("")), F.coalesce(F.col(nodes), F.lit("")))) \
        .select(*keep, "text", F.length("text").cast("long").alias("n_chars"))
