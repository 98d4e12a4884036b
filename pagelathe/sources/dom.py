"""HTML pages as a relational table of elements.

One Python pass parses a page; everything after is DataFrame work on ``dom_nodes``.  Ancestry is kept
three ways: ``parent_id``; the interval [node_id, last_id] in pre-order, which turns "inside" into a
range; and ``tags``/``roles``, the chain above, which turns "nearest landmark" into an array lookup
without a join.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelathe.session import slices, spread

# Fixed values of HTML: elements without content, raw text elements, and tags that end an open one.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
BLOCKS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SIBLINGS = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead"), "td": ("tr",), "th": ("tr",), "option": ("select",)}
# Implicit roles of tags.
ROLES = {
    "header": "banner", "footer": "contentinfo", "nav": "navigation", "main": "main", "aside": "complementary", "form": "form", "section": "region",
    "article": "article", "ul": "list", "ol": "list", "li": "listitem", "table": "table",
} | {f"h{i}": "heading" for i in range(1, 7)}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][\w:-]*)([^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)>", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("at", "attrs", "children", "id", "last", "parent", "tag", "texts")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None, ident: int):
        self.tag, self.attrs, self.parent, self.id, self.last = tag, attrs, parent, ident, ident
        self.children: list[Node] = []
        self.at = len(parent.children) if parent is not None else 0  # its place among the children of its parent
        self.texts: list[tuple[int, str]] = []  # (number of children before it, text)

    @property
    def role(self) -> str | None:
        return self.attrs.get("role") or ROLES.get(self.tag)

    def own_text(self) -> str:
        return collapse(" ".join(t for _, t in self.texts))

    def text(self) -> str:
        """All text below, in document order."""
        out: list[str] = []
        stack: list[tuple[Node, int, int]] = [(self, 0, 0)]
        while stack:
            node, c, t = stack.pop()
            while t < len(node.texts) and node.texts[t][0] <= c:
                out.append(node.texts[t][1])
                t += 1
            if c < len(node.children):
                stack.append((node, c + 1, t))
                stack.append((node.children[c], 0, 0))
        return "".join(out)

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.children))

    def path(self) -> list[int]:
        """Child indexes from the body down."""
        out, node = [], self
        while node.parent is not None and node.tag not in ("body", "html"):
            out.append(node.at)
            node = node.parent
        return out[::-1]


def collapse(text: str) -> str:
    return _SPACE.sub(" ", text).strip()


def parse(source: str | None) -> Node:
    """The tree of a page under a root; of null and empty pages the bare root.  Unclosed and stray tags are tolerated."""
    root = Node("#root", {}, None, 0)
    if not source:
        return root
    count, here, at, end = 0, root, 0, len(source)
    nodes: list[Node] = []
    while at < end:
        m = _TAG.search(source, at)
        stop = m.start() if m else end
        if stop > at:
            here.texts.append((len(here.children), entities.unescape(source[at:stop])))
        if not m:
            break
        at = m.end()
        if m.group(2) is None:
            continue
        tag = m.group(2).lower()
        if m.group(1):
            node = here
            while node.parent is not None and node.tag != tag:
                node = node.parent
            if node.parent is not None:
                here = node.parent
            continue
        if tag in BLOCKS:  # a paragraph ends where a block begins
            node = here
            while node.parent is not None and node.tag not in ("p", "div", "td", "li", "article", "section", "body"):
                node = node.parent
            if node.tag == "p":
                here = node.parent
        if tag in SIBLINGS:
            node = here
            while node.parent is not None and node.tag not in SIBLINGS[tag] and node.tag not in ("table", "ul", "ol", "dl"):
                if node.tag == tag or (tag in ("dt", "dd") and node.tag in ("dt", "dd")) or (tag in ("td", "th") and node.tag in ("td", "th")):
                    here = node.parent
                    break
                node = node.parent
        count += 1
        raw = m.group(3)
        attrs: dict[str, str] = {}
        if raw.strip(" /\n\t\r"):
            for a in _ATTR.finditer(raw):
                attrs.setdefault(a.group(1).lower(), entities.unescape(next((g for g in a.groups()[1:] if g is not None), "")))
        node = Node(tag, attrs, here, count)
        here.children.append(node)
        nodes.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
            stop = close.start() if close else end
            node.texts.append((0, source[at:stop] if tag in ("script", "style") else entities.unescape(source[at:stop])))
            at = close.end() if close else end
        elif tag not in VOID and not raw.endswith("/"):
            here = node
    for node in reversed(nodes):  # what is below a node comes after it
        node.parent.last = max(node.parent.last, node.last)
    return root


SCHEMA = (
    "page_id long, node_id int, parent_id int, last_id int, depth int, child_idx int, tag string, role string, attrs map<string,string>, "
    "own_text string, text string, tags array<string>, roles array<string>"
)
#: Elements of which ``text`` is kept in full; of containers it would repeat all below.
TEXT_TAGS = frozenset("a h1 h2 h3 h4 h5 h6 p li title button time td th dt dd figcaption blockquote pre label option span b em strong i script style del ins address".split())


def dom_nodes(pages: DataFrame) -> DataFrame:
    """A row an element of ``page_id, html``.

    Null and empty pages have no rows; a page captured twice has rows under each id; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            columns: list[list] = [[] for _ in range(13)]
            for page, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                chains: dict[int, tuple[list[str], list[str]]] = {0: ([], [])}
                for n in parse(source).walk():
                    if n.parent is None:
                        continue
                    tags, roles = chains[n.parent.id]
                    chains[n.id] = ([*tags, n.tag], [*roles, n.role or ""])
                    row = (page, n.id, n.parent.id, n.last, len(tags) + 1, n.at, n.tag, n.role, list(n.attrs.items()), n.own_text(), collapse(n.text()) if n.tag in TEXT_TAGS else None, tags, roles)
                    for c, v in zip(columns, row):
                        c.append(v)
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
            names = [f.split()[0] for f in SCHEMA.replace("map<string,string>", "m").split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    return spread(slim).mapInArrow(run, SCHEMA)
