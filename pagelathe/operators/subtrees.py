"""Parts of pages: what is left without some elements, one element with what is around it, elements by place or handle.

Elements are rows of ``dom.dom_nodes``, where what is below an element is the interval [node_id, last_id]: leaving
subtrees out is a running maximum, and no element is paired with the roots.  PRJ5-8, STF21-22, HLP1, HLP6.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelathe.operators.page_tree import _schema, body_of, per_page, regions, selector
from pagelathe.sources.dom import Node, collapse


def without(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``nodes`` without the elements of ``roots`` (``page_id, node_id``) and all below them; roots that are not there leave all as it is."""
    marked = nodes.join(roots.select("page_id", "node_id").distinct().withColumn("_root", F.lit(True)), ["page_id", "node_id"], "left")
    w = Window.partitionBy("page_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    gone = F.coalesce(F.max(F.when(F.col("_root"), F.col("last_id"))).over(w) >= F.col("node_id"), F.lit(False))
    return marked.withColumn("_gone", gone).where(~F.col("_gone")).select(*nodes.columns)


def around(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """The elements above and below one root a page (``page_id, node_id``), and itself; pages without a root have none."""
    one = roots.groupBy("page_id").agg(F.min("node_id").alias("_root"))
    ends = nodes.join(one, "page_id").where(F.col("node_id") == F.col("_root")).select("page_id", "_root", F.col("last_id").alias("_last"))
    below, above = F.col("node_id").between(F.col("_root"), F.col("_last")), (F.col("node_id") < F.col("_root")) & (F.col("last_id") >= F.col("_root"))
    return nodes.join(ends, "page_id").where(below | above).select(*nodes.columns)


def matching(pages: DataFrame, css: str) -> DataFrame:
    """``page_id, node_id`` of the elements a selector finds; one that cannot be read raises BadSelector before anything runs."""
    find = selector(css)
    return per_page(pages, lambda root: [{"node_id": n.id} for n in find(root)], _schema("page_id long, node_id int"))


def css_path(n: Node) -> str:
    """A selector that finds this element alone: its id, else its place among the children from the body down."""
    if n.attrs.get("id"):
        return "#" + re.sub(r"([^\w-])", r"\\\1", n.attrs["id"])
    steps = []
    while n.parent is not None and n.tag not in ("body", "html"):
        steps.append(f"{n.tag}:nth-child({n.at + 1})")
        n = n.parent
    return " > ".join(reversed(steps)) or n.tag


def description(n: Node) -> str:
    """An element in short: its tag with its id, else with its first class."""
    names = n.attrs.get("class", "").split()
    return n.tag + (f"#{n.attrs['id']}" if n.attrs.get("id") else f".{names[0]}" if names else "")


def element_names(pages: DataFrame, css: str) -> DataFrame:
    """``page_id, node_id, path, css, description`` of the elements a selector finds."""
    find = selector(css)
    rows = lambda root: [{"node_id": n.id, "path": n.path(), "css": css_path(n), "description": description(n)} for n in find(root)]
    return per_page(pages, rows, _schema("page_id long, node_id int, path ints, css string, description string"))


def by_path(root: Node, path: list[int]) -> Node | None:
    """The element at child indexes from the body down; None where there is none."""
    n = body_of(root)
    for i in path:
        if not 0 <= i < len(n.children):
            return None
        n = n.children[i]
    return n


def handle_text(root: Node, handle: int) -> str | None:
    """What a handle stands for: a region's text, or the label of an action; None of an unknown handle."""
    for r in regions(root):
        if r.id == handle:
            return r.snippet
        for ident, _, label in r.actions:
            if ident == handle:
                return label
    return None


def read_handles(pages: DataFrame, handle: int) -> DataFrame:
    """``page_id, owner, text``: a handle of each page, with the region it is or stands in; pages without it have no row."""

    def rows(root: Node) -> list[dict]:
        found = ((r.id, r.snippet if r.id == handle else next(label for i, _, label in r.actions if i == handle)) for r in regions(root) if r.id == handle or any(i == handle for i, *_ in r.actions))
        return [{"owner": owner, "text": collapse(text)} for owner, text in found]

    return per_page(pages, rows, _schema("page_id long, owner int, text string"))
