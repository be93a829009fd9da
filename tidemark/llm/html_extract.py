"""Main text of web pages by a site style tree.

The DOMs of a host's pages are merged: nodes of the same path (tags with their classes and ids) are one node of the
tree, menus and footers included. A node's importance is made of the entropy of its presentation (the sequences of its
child blocks) and of its content over the pages that have it, each from 0 (the same on all pages) to 1 (another on
each). Tags and names are only a prior by which the importance is multiplied. A branch is removed from a page if its
importance is low, or low against that of the most important branch beside it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import forget, small_batches, stored
from tidemark.llm.url_filter import host_and_path

#: Elements that hold no text of a page.
TEXTLESS = frozenset("head script style noscript template iframe object embed svg math canvas audio video select option button input textarea datalist map".split())
#: Elements that mostly are furniture, and names (whole words of class, id and role) that mark it.
FURNITURE = frozenset("nav header footer aside form menu dialog label fieldset".split())
NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside header masthead footer foot cookie cookies consent notice notices gdpr popup modal overlay share sharing social related recommended newsletter subscribe subscription signup login search searchbox form comment comments commentlist disqus respond replies reply pagination pager widget toolbar contentinfo complementary skip".split())
MAIN = frozenset("article main".split())
#: Elements that hold running text; they aren't weighed against the branches beside them.
CONTENT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot caption tr td th blockquote pre figure figcaption address hr hgroup details summary".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
WORDS, TOKENS, NUMBER = re.compile(r"[a-z]+"), re.compile(r"[^\s]+"), re.compile(r"\d{3,}")
ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
SPACE = re.compile(r"\s+")
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}

#: Weight of content against presentation; the importance of what too few pages have to tell.
CONTENT, UNKNOWN, LEAST_PAGES = 0.4, 0.5, 4
#: A branch goes below LOW, and below AGAINST times the best branch beside it.
#: The tree is not asked about a node of low importance that is over ABOVE times that of the node above it.
LOW, AGAINST, ABOVE = 0.3, 0.7, 0.5
#: Priors: of an article, of furniture by tag or whole name, of a name with a furniture word among others.
ARTICLE, MARKED, HINTED = 2.0, 0.4, 0.7
#: Trees are broadcast up to so many nodes, beyond that joined by host.
BROADCAST = 50_000


class Node:
    """A block element of a page. path: a hash of the tags, classes and ids from the root to it."""

    __slots__ = ("above", "best", "children", "content", "filled", "gone", "has_heading", "has_main", "in_main", "inline", "main", "path", "prior", "tag", "value", "weighed", "wraps")

    def __init__(self, tag: str, signature: str, prior: float, main: bool, above: Node | None):
        self.tag, self.prior, self.main, self.above = tag, prior, main, above
        self.path = _hash(f"{above.path if above else 0}/{tag}{signature}")
        self.in_main = main or (above is not None and above.in_main)
        self.has_main, self.has_heading = main, tag == "h1"
        self.inline = self.filled = self.gone = False
        self.children = self.content = 0
        self.best = self.value = 0.0


def _hash(text: str) -> int:
    h = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def _names(attrs: str) -> tuple[str, float, bool]:
    """A signature of class, id and role, their prior, and whether they name the article."""
    if "=" not in attrs:
        return "", 1.0, False
    values = " ".join(m[2] or m[3] or m[4] or "" for m in ATTR.finditer(attrs)).lower()
    tokens = TOKENS.findall(NUMBER.sub("", values))  # long numbers name a page's own thing
    if not tokens:
        return "", 1.0, False
    hinted = not NAMES.isdisjoint(WORDS.findall(values))
    main = not hinted and "main" in tokens
    prior = MARKED if not NAMES.isdisjoint(tokens) else HINTED if hinted else ARTICLE if main else 1.0
    return "." + ".".join(sorted(set(tokens))), prior, main


def parsed(html: str) -> tuple[list[Node], list[tuple[str, Node]]]:
    """The nodes of a page, each after the one above it, and its blocks of text with the node that holds each, in page order.

    An inline element that its name marks is a node of its own, and its text is a block apart.
    """
    nodes = [Node("#", "", 1.0, False, None)]
    blocks: list[tuple[str, Node]] = []
    stack, held = [nodes[0]], []
    outer: list[list[str]] = []  # text around open inline nodes
    opened: Counter[str] = Counter()  # of each tag in stack
    endless: set[str] = set()  # tags that no more end tag follows
    at, n = 0, len(html)

    def block() -> None:
        if held:
            text = SPACE.sub(" ", unescape("".join(held))).strip()
            held.clear()
            if text:
                blocks.append((text, stack[-1]))

    def pop(k: int) -> None:
        """Close the nodes from k on; text around an inline node that is closed so is a block of its own."""
        while len(stack) > k:
            block()
            node = stack.pop()
            opened[node.tag] -= 1
            if node.inline:
                held[:] = outer.pop()
        block()

    def push(tag: str, signature: str, prior: float, main: bool) -> Node:
        node = Node(tag, signature, prior, main, stack[-1])
        nodes.append(node)
        stack.append(node)
        opened[tag] += 1
        return node

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            held.append(html[at:])
            break
        if lt > at:
            held.append(html[at:lt])
        after = html[lt + 1 : lt + 2]
        if after == "!" or after == "?":
            end = html.find("-->", lt + 4) + 2 if html.startswith("<!--", lt) else html.find(">", lt)
            if html.startswith(("<!-->", "<!--->"), lt):
                end = html.find(">", lt)
            at = end + 1 if end > 1 and end >= lt else n
            continue
        if not (after.isalpha() and after.isascii()) and not (after == "/" and html[lt + 2 : lt + 3].isalpha()):
            held.append("<")
            at = lt + 1
            continue
        m = TAG.match(html, lt)
        if m:
            tag, attrs, at = m[1].lower(), m[2], m.end()
        else:  # an unclosed quote or tag
            gt = html.find(">", lt)
            if gt < 0:
                break
            tag, attrs, at = re.match(r"/?([^\s/>]*)", html[lt + 1 : gt])[1].lower(), "", gt + 1
        if after == "/":
            if tag in INLINE:
                if stack[-1].inline and stack[-1].tag == f"~{tag}":
                    block()
                    stack.pop()
                    opened[f"~{tag}"] -= 1
                    held[:] = outer.pop()
                continue
            if opened[tag] > 0:
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                pop(k)
            else:
                block()
            continue
        if tag in INLINE and tag not in TEXTLESS:
            if tag == "br":
                held.append(" ")
            elif tag not in VOID and not attrs.endswith("/"):
                signature, prior, _ = _names(attrs)
                if prior == MARKED:  # what it holds is left out of the block around it
                    outer.append(held.copy())
                    held.clear()
                    push(f"~{tag}", signature, prior, False).inline = True
            continue
        block()
        if tag in VOID:
            continue
        # a block closes an open paragraph, an item the item before it
        closes = (*CLOSES.get(tag, ()), "p")
        for k in range(len(stack) - 1, 0, -1) if any(opened[c] > 0 for c in closes) else ():
            if stack[k].tag in closes:
                pop(k)
                break
            if stack[k].tag in ("ul", "ol", "dl", "table", "article", "section", "div", "main", "body"):
                break
        if tag in TEXTLESS or tag in RAW:
            close = None if attrs.endswith("/") or tag in endless else re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
            if close is not None:
                at = html.find(">", close.start()) + 1 or n
            elif tag in RAW and not attrs.endswith("/"):
                break
            elif not attrs.endswith("/"):
                endless.add(tag)
            continue
        signature, prior, main = _names(attrs)
        stack[-1].children = _hash(f"{stack[-1].children}{tag}{signature}")
        if tag in ("html", "body"):
            prior = 1.0
        elif tag in MAIN:
            prior, main = ARTICLE * min(prior, 1.0), True
        elif tag in FURNITURE:
            prior, main = min(prior, MARKED), False
        if not attrs.endswith("/"):
            push(tag, signature, prior, main)
    pop(1)
    return nodes, blocks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def page_nodes(html: str) -> list[tuple[int, int, int]]:
    """(path, presentation, content) of each path of a page with text; the last two are hashes over all its nodes."""
    nodes, blocks = parsed(html)
    for text, node in blocks:
        node.content = (node.content + (_hash(text) | 1)) & (1 << 64) - 1
    by_path: dict[int, list[int]] = {}
    for node in reversed(nodes):
        if node.content:
            if node.above is not None:
                node.above.content = (node.above.content + node.content) & (1 << 64) - 1
            held = by_path.setdefault(node.path, [0, 0])
            held[0] = (held[0] + node.children) & (1 << 64) - 1
            held[1] = (held[1] + node.content) & (1 << 64) - 1
    return [(path, _signed(p), _signed(c)) for path, (p, c) in by_path.items()]


def main_text(html: str, tree: dict[int, float] | None = None) -> str:
    """The blocks that are left of a page without the branches of low importance. tree: importance by path; UNKNOWN for others.

    Furniture tags and names don't count against what holds the article: an element with article or main below it, a
    form with a first heading, a header within the article. A node isn't low by its entropy alone where all around it
    is as low, nor is running text within a named article.
    """
    nodes, blocks = parsed(html)
    tree = tree or {}
    for _, node in blocks:
        node.filled = True
    for node in reversed(nodes):
        node.has_main &= node.filled
        if (above := node.above) is not None:
            above.filled |= node.filled
            above.has_main |= node.has_main
            above.has_heading |= node.has_heading
    for node in nodes[1:]:
        above, prior = node.above, node.prior
        node.wraps = node.has_main and not node.main
        if node.wraps or node.tag == "form" and node.has_heading or node.tag == "header" and above.in_main:
            prior = max(prior, 1.0)
        fixed = node.tag in ("html", "body")
        found = UNKNOWN if fixed else tree.get(node.path, UNKNOWN)
        node.value = min(1.0, found * prior)
        excused = found < LOW and (found >= ABOVE * tree.get(above.path, UNKNOWN) or above.in_main and node.tag in CONTENT_TAGS)
        node.gone = not node.wraps and (UNKNOWN if excused else found) * prior < LOW
        node.weighed = node.filled and not node.inline and node.tag not in CONTENT_TAGS
        if node.weighed:
            above.best = max(above.best, 1.0 if node.wraps else node.value)
    for node in nodes[1:]:
        beside = node.weighed and not node.wraps and not (node.in_main and node.has_heading)
        node.gone |= node.above.gone or beside and node.value < AGAINST * node.above.best
    left = [(text, node) for text, node in blocks if not node.gone]
    article = any(node.in_main for _, node in left)
    return "\n\n".join(text for text, node in left if node.in_main or not article)


def _nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for i in range(0, len(b), 500):
            part = b.iloc[i : i + 500]
            rows = [(h, *x) for h, html in zip(part["host"], part["html"], strict=True) for x in page_nodes(html)]
            yield pd.DataFrame(rows, columns=["host", "path", "presentation", "content"])


def style_tree(pages: DataFrame) -> DataFrame:
    """host, path, pages, importance of each node; pages has host and html.

    Counts meet before they are shuffled.
    """
    nodes = pages.select("host", "html").mapInPandas(_nodes, "host string, path long, presentation long, content long")
    kinds = nodes.select("host", "path", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("presentation").alias("value")), F.struct(F.lit(1).alias("kind"), F.col("content").alias("value")))).alias("v")).select("host", "path", "v.*")
    counts = kinds.groupBy("host", "path", "kind", "value").agg(F.count("*").alias("n"))
    per_kind = counts.groupBy("host", "path", "kind").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    entropy = F.when(F.col("pages") > 1, (F.log("pages") - F.col("nlogn") / F.col("pages")) / F.log("pages")).otherwise(1.0)
    weight = F.when(F.col("kind") == 1, CONTENT).otherwise(1 - CONTENT)
    return per_kind.groupBy("host", "path").agg(F.max("pages").alias("pages"), F.sum(weight * entropy).alias("importance"))


def known_nodes(tree: DataFrame) -> DataFrame:
    """host, paths, values: the importance of the nodes that enough pages of a host have."""
    known = tree.where(F.col("pages") >= LEAST_PAGES).groupBy("host").agg(F.array_sort(F.collect_list(F.struct("path", F.col("importance").cast("float").alias("value")))).alias("t"))
    return known.select("host", F.col("t.path").alias("paths"), F.col("t.value").alias("values"))


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    trees: dict[str, dict[int, float]] = {}
    for b in batches:
        for i in range(0, len(b), 500):
            part = b.iloc[i : i + 500]
            texts = []
            for host, html, paths, values in zip(part["host"], part["html"], part["paths"], part["values"], strict=True):
                if host not in trees:
                    if len(trees) > 100:
                        trees.clear()
                    trees[host] = {} if paths is None else dict(zip(np.asarray(paths).tolist(), np.asarray(values).tolist(), strict=True))
                texts.append(main_text(html, trees[host]))
            yield pd.DataFrame({"page_id": part["page_id"].astype("Int64"), "url": part["url"], "text": texts, "n_chars": [len(t) for t in texts]})


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html, ...).

    Null and empty html have an empty text. The tree of a host is made of all its rows, those without a host share one;
    repeated rows and null ids are pages of their own. An empty table gives an empty result; further columns are ignored.
    Time and memory are linear in a page, however deep its elements are nested.
    """
    small_batches(pages.sparkSession)
    host, _ = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    tree = stored(style_tree(rows), "style-tree")
    known = stored(known_nodes(tree), "known-nodes")
    forget(tree)
    if (known.select(F.sum(F.size("paths"))).first()[0] or 0) <= BROADCAST:
        known = F.broadcast(known)
    return rows.join(known, "host", "left").select("page_id", "url", "host", "html", "paths", "values").mapInPandas(_texts, "page_id long, url string, text string, n_chars long")
