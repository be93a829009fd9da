"""Pages as nodes: a tokenizer with a stack of open elements, over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import clean_ws

#: Fixed values of HTML: elements without content; what an opening tag ends that was left open; and elements that keep such an
#: end from reaching what is around them.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}, "a": {"a"}}
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
BARRIER = frozenset("article aside body div dl footer header main nav ol section select table ul".split())
RAW = frozenset({"script", "style"})

NODE = pa.struct([("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("last", pa.int32()), ("card", pa.int32()), ("text", pa.string())])
#: Nodes of one batch that tasks give out, beyond those of its last page.
BATCH_NODES = 20_000
NODES = "array<struct<tag:string,attrs:map<string,string>,last:int,card:int,text:string>>"


class Tokenizer(HTMLParser):
    """nodes in page order: [tag, attributes, position of the last node inside, position of its card, text]."""

    def __init__(self, cards: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.cards = cards
        self.nodes: list[list] = []
        self.open: list[int] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        ends = ENDS.get(tag, set()) | ({"p"} if tag in BLOCKS else set())
        left_open = None
        for depth in range(len(self.open) - 1, -1, -1) if ends else ():
            name = self.nodes[self.open[depth]][0]
            if name in ends:
                left_open = depth
            if name in BARRIER:
                break
        if left_open is not None:
            self._close(left_open)
        found: dict[str, str] = {}
        for name, value in attrs:
            found.setdefault(name, value or "")  # of repeated attributes the first counts
        card = next((i for i in reversed(self.open) if self._is_card(i)), None) if tag == "a" and self.cards else None
        self.nodes.append([tag, list(found.items()), len(self.nodes), card, None])
        if tag not in VOID:
            self.open.append(len(self.nodes) - 1)

    def _is_card(self, i: int) -> bool:
        tag, attrs = self.nodes[i][:2]
        return tag in self.cards or any(f".{c}" in self.cards for k, v in attrs if k == "class" for c in v.split())

    def _close(self, depth: int) -> None:
        for i in self.open[depth:]:
            self.nodes[i][2] = len(self.nodes) - 1
        del self.open[depth:]

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, -1, -1):
            if self.nodes[self.open[depth]][0] == tag:
                self._close(depth)
                return

    def handle_data(self, data: str) -> None:
        raw = self.open and self.nodes[self.open[-1]][0] in RAW
        self.nodes.append(["#raw" if raw else "#text", None, len(self.nodes), None, data])

    def finish(self) -> list[list]:
        self.close()
        self._close(0)
        return self.nodes


def tokenize(html: str | None, cards: frozenset[str] = frozenset()) -> list[list]:
    t = Tokenizer(cards)
    try:
        t.feed(html or "")
        return t.finish()
    except AssertionError:  # a declaration that the parser doesn't know: what came before it counts
        t.rawdata = ""
        return t.finish()


def elements(pages: DataFrame, key: str, cards: tuple[str, ...] = ()) -> DataFrame:
    """key, url, nodes: the elements and texts of each page in page order.

    last is the position of the last node inside an element, so that nodes[i..last] is its subtree. Attributes may be quoted
    either way, bare or without a value (empty); all character references are decoded. Texts are nodes ``#text``, those of
    scripts and styles ``#raw``. card is the position of the closest element around a link that is one of ``cards`` (tags, or
    classes with a dot before them). Elements left open end as HTML has it for lists, tables and paragraphs, else with
    what is around them. A null page has no nodes.
    """
    wanted = frozenset(cards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            begin, held, count = 0, [], 0
            for i, html in enumerate(b.column("html")):
                held.append(tokenize(html.as_py(), wanted))
                count += len(held[-1])
                if count >= BATCH_NODES or i == b.num_rows - 1:
                    rows = b.slice(begin, len(held))
                    yield pa.RecordBatch.from_arrays([rows.column(key), rows.column("url"), _as_arrow(held)], [key, "url", "nodes"])
                    begin, held, count = i + 1, [], 0

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, f"`{key}` {kind}, url string, nodes {NODES}")


def _as_arrow(pages: list[list[list]]) -> pa.ListArray:
    """The nodes of several pages as one column."""
    nodes = [n for page in pages for n in page]
    ends = np.cumsum([0, *[len(p) for p in pages]])
    attrs = [n[1] for n in nodes]
    sizes = np.cumsum([0, *[len(a or ()) for a in attrs]])
    offsets = pa.array(sizes, pa.int32(), mask=np.array([*[a is None for a in attrs], False]))
    pairs = [kv for a in attrs for kv in a or ()]
    maps = pa.MapArray.from_arrays(offsets, pa.array([k for k, _ in pairs], pa.string()), pa.array([v for _, v in pairs], pa.string()))
    columns = [pa.array([n[0] for n in nodes], pa.string()), maps, *[pa.array([n[i] for n in nodes], NODE[i].type) for i in (2, 3, 4)]]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(NODE)))


# -- columns over nodes ---------------------------------------------------------------------------------------------


def subtree(nodes: Column, position: Column) -> Column:
    """The element at a position (from 0) and all inside it."""
    return F.slice(nodes, position + 1, F.get(nodes, position)["last"] - position + 1)


def numbered(nodes: Column) -> Column:
    """nodes with their position as ``at``."""
    return F.transform(nodes, lambda n, i: F.struct(i.alias("at"), n.alias("n")))


def text_of(nodes: Column) -> Column:
    """The text of a subtree, white space collapsed."""
    return clean_ws(F.array_join(F.transform(F.filter(nodes, lambda n: n["tag"] == "#text"), lambda n: n["text"]), ""))


def has_class(node: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(F.arrays_overlap(F.split(F.coalesce(attr(node, "class"), F.lit("")), r"\s+"), F.array(*[F.lit(n) for n in names])), F.lit(False)) if names else F.lit(False)


def attr(node: Column, name: str) -> Column:
    """An attribute of a node; null if it hasn't any such or it is empty."""
    return F.nullif(F.try_element_at(node["attrs"], F.lit(name)), F.lit(""))


def first_attr(nodes: Column, name: str, fits: Callable[[Column], Column] = lambda n: F.lit(True)) -> Column:
    """The attribute of the first node that fits and has it."""
    return F.get(F.transform(F.filter(nodes, lambda n: fits(n) & attr(n, name).isNotNull()), lambda n: attr(n, name)), F.lit(0))


def first_text(nodes: Column, fits: Callable[[Column], Column]) -> Column:
    """The text of the first element of a subtree that fits, with all inside it; null if there is none."""
    # positions inside the subtree: an element's end less the subtree's own beginning
    begin = F.get(nodes, F.lit(0))["last"] - F.size(nodes) + 1
    hit = F.get(F.filter(numbered(nodes), lambda x: fits(x["n"])), F.lit(0))
    return F.when(hit.isNotNull(), text_of(F.slice(nodes, hit["at"] + 1, hit["n"]["last"] - begin - hit["at"] + 1)))
