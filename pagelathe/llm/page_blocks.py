"""Blocks of a page: one linear scan over its tags.

A page is packed into one string, a record a block, so that it passes between Python and Spark as a
plain column and is taken apart again by ``str.split``.
"""

from __future__ import annotations

import html as entities
import re
from typing import NamedTuple

BLOCK_TAGS = frozenset("h1 h2 h3 h4 h5 h6 p li pre blockquote dt dd figcaption".split())
CONTAINERS = frozenset("html body div section article main aside nav header footer form table tbody thead tr td th details dialog".split())
#: Raw text elements: nothing inside them is a tag.
RAW = frozenset("script style textarea title template noframes".split())
FIELD, RECORD = "\x1f", "\x1e"
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9]*)([^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)>", re.S)
_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
_LANG = re.compile(r"(?<![\w:-])lang\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_SPACE = re.compile(r"\s+")
#: What of the markup above a block is kept: landmarks, and what marks itself as a dialog.
LANDMARKS = {"nav": "n", "aside": "a", "footer": "f", "header": "h", "main": "m", "article": "r", "dialog": "d"}


class Block(NamedTuple):
    no: int
    tag: str
    zone: int  # runs of blocks without a container's start or end between them
    items: int  # number of the list it stands in, 0 outside lists
    marks: str  # landmarks above it, outermost first
    gap: int  # container tags since the block before
    linked: int  # characters inside anchors
    text: str


def html_lang(source: str | None) -> str | None:
    """The lang attribute of the html tag as written; None without one."""
    if not source:
        return None
    m = re.search(r"<html\b([^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)>", source, re.I)
    found = _LANG.search(m.group(1)) if m else None
    return next((g for g in found.groups() if g is not None), None) if found else None


def blocks_of(source: str | None) -> list[Block]:
    """The blocks in source order; [] for null and empty pages.  Unclosed and stray tags are tolerated."""
    if not source:
        return []
    out: list[Block] = []
    no, zone, lists, gap = -1, 0, 0, 0
    stack: list[tuple[str, str]] = []
    list_stack: list[int] = []
    marks = ""
    anchor = False
    open_blocks: list[list] = []  # [no, tag, zone, items, marks, gap, linked, parts]
    at = 0
    end = len(source)
    search = _TAG.search

    def close(upto: int) -> None:
        while len(open_blocks) > upto:
            n, tag, z, items, mk, g, linked, parts = open_blocks.pop()
            text = "".join(parts)
            if "&" in text:
                text = entities.unescape(text)
            text = text.strip("\n") if tag == "pre" else _SPACE.sub(" ", text).strip()
            if FIELD in text or RECORD in text:
                text = text.replace(FIELD, " ").replace(RECORD, " ")
            out.append(Block(n, tag, z, items, mk, g, linked, text))

    while at < end:
        m = search(source, at)
        stop = m.start() if m else end
        if stop > at and open_blocks:
            piece = source[at:stop]
            open_blocks[-1][7].append(piece)
            if anchor:
                open_blocks[-1][6] += len(piece.strip())
        if not m:
            break
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        closing = m.group(1)
        if name in RAW:
            if not closing:
                over = _END[name].search(source, at)
                at = over.end() if over else end
            continue
        if name in BLOCK_TAGS:
            if closing:
                for k in range(len(open_blocks) - 1, -1, -1):
                    if open_blocks[k][1] == name:
                        close(k)
                        break
            else:
                # a paragraph or item ends where the next one begins; a quote, or an item around a further list, may hold blocks
                keep, here = len(open_blocks), list_stack[-1] if list_stack else 0
                item = name in ("li", "dt", "dd")
                while keep:
                    above = open_blocks[keep - 1]
                    if above[1] == "blockquote" or (above[1] in ("li", "dd") and (above[3] != here if item else here)):
                        break
                    keep -= 1
                close(keep)
                no += 1
                open_blocks.append([no, name, zone, list_stack[-1] if list_stack else 0, marks, gap, 0, []])
                gap = 0
            anchor = False
        elif name == "a":
            anchor = not closing
        elif name in CONTAINERS:
            close(0)
            gap += 1
            zone += 1
            if closing:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        marks = stack[k][1]
                        del stack[k:]
                        break
            else:
                stack.append((name, marks))
                attrs = m.group(3)
                mark = LANDMARKS.get(name, "")
                if "dialog" in attrs or "cookie" in attrs or "consent" in attrs:
                    mark += "d"
                elif "navigation" in attrs:
                    mark += "n"
                marks += mark
            anchor = False
        elif name in ("ul", "ol", "dl"):
            if closing:
                close(0) if len(list_stack) < 2 else None
                if list_stack:
                    list_stack.pop()
            else:
                if open_blocks and open_blocks[-1][1] != "li":
                    close(0)
                lists += 1
                list_stack.append(lists)
        elif name in ("br", "hr") and open_blocks:
            open_blocks[-1][7].append("\n" if name == "br" else " ")
        elif name in ("figure", "button", "select", "label") and open_blocks and not closing:
            close(0)
    close(0)
    out.sort(key=lambda b: b.no)
    return out


def pack(blocks: list[Block]) -> str:
    return RECORD.join(FIELD.join((str(b.no), b.tag, str(b.zone), str(b.items), b.marks, str(b.gap), str(b.linked), b.text)) for b in blocks)


def unpack(packed: str | None) -> list[Block]:
    if not packed:
        return []
    out = []
    for record in packed.split(RECORD):
        no, tag, zone, items, marks, gap, linked, text = record.split(FIELD)
        out.append(Block(int(no), tag, int(zone), int(items), marks, int(gap), int(linked), text))
    return out


class BodyBlock(NamedTuple):
    no: int
    tag: str
    text: str


def pack_body(blocks: list[Block]) -> str:
    """The main blocks of a page as one string."""
    return RECORD.join(f"{b.no}{FIELD}{b.tag}{FIELD}{b.text}" for b in blocks)


def unpack_body(body: str | None) -> list[BodyBlock]:
    if not body:
        return []
    parts = (r.split(FIELD, 2) for r in body.split(RECORD))
    return [BodyBlock(int(no), tag, text) for no, tag, text in parts]
