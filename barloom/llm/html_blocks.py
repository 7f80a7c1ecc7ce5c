"""Leaf blocks of a page: runs of text between block tags, with the tags and names above them."""

from __future__ import annotations

import html
import re
from collections.abc import Container
from dataclasses import dataclass

# A quote that is never closed ends with its tag.
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*(?=>)|[^<>]*)>", re.S
)
NAMES = re.compile(r"""(?:^|\s)(class|id|role|aria-label|itemprop|hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Fixed lists of HTML: elements whose content is no text, without content, inside a line, and closed by a
# new element of the same kind.
RAW = frozenset("script style template noscript iframe object svg math canvas textarea".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var"
    " br wbr img".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SIBLINGS = {
    "li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr", "table"),
    "th": ("tr", "table"), "option": ("select",), "p": (),
}


@dataclass
class Block:
    text: str
    above: list[str]
    linked: int
    tag: str


def names_of(attributes: str) -> list[str]:
    out = []
    for name, *values in NAMES.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "hidden":
            out.append("hidden")
        elif name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                out.append("hidden")
        else:
            out += [w.lower() for w in WORDS.findall(value)]
    return out


def blocks_of(page: str, known: Container[str] | None = None) -> list[Block]:
    """Blocks with text in page order; unclosed and misplaced tags are met as browsers do, roughly.

    `above` holds each feature once, of all or only of those in `known`. So a block costs no more than these,
    however deep it lies, and open tags are found by their names.
    """
    out: list[Block] = []
    stack: list[tuple[str, list[str]]] = []
    held: dict[str, int] = {}
    open_at: dict[str, list[int]] = {}
    # Places of open elements that are no part of a line, and of those that hold others.
    blocks: list[int] = []
    walls: list[int] = []
    parts: list[str] = []
    linked = at = 0
    anchors = 0
    skip = ""

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                tag = stack[blocks[-1]][0] if blocks else ""
                out.append(Block(text, list(held), min(linked, len(text)), tag))
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if anchors:
                linked += len(text.strip())

    def open_tag(tag: str, names: list[str]) -> None:
        nonlocal anchors
        for places in (open_at.setdefault(tag, []), *([] if tag in INLINE else [blocks]), *([] if tag in INLINE | HEADINGS else [walls])):
            places.append(len(stack))
        stack.append((tag, names))
        anchors += tag == "a"
        for f in names:
            held[f] = held.get(f, 0) + 1

    def close(depth: int) -> None:
        nonlocal anchors
        while len(stack) > depth:
            tag, names = stack.pop()
            open_at[tag].pop()
            for places in (blocks, walls):
                if places and places[-1] == len(stack):
                    places.pop()
            anchors -= tag == "a"
            for f in names:
                held[f] -= 1
                if not held[f]:
                    del held[f]

    while at < len(page):
        m = TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag not in INLINE:
                flush()
            if open_at.get(tag):
                depth = open_at[tag][-1]
                # The end of a part of a line never closes a block.
                if tag not in INLINE or not blocks or blocks[-1] < depth:
                    close(depth)
            continue
        if tag in RAW:
            if tag not in INLINE:
                flush()
            # Only foreign elements are closed by their own tag.
            if tag in ("svg", "math") and m[0].endswith("/>"):
                continue
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag == "br" or tag in VOID:
            if tag == "hr":
                flush()
            add(" ")
            continue
        if tag not in INLINE:
            flush()
            # A block closes an open paragraph, and an item the one before it.
            own = open_at.get(tag) if tag in SIBLINGS else None
            last = max((places[-1] for places in (open_at.get("p"), own) if places), default=-1)
            if last >= 0 and (not walls or last >= walls[-1]):
                close(last)
        if page[m.end() - 2 : m.end()] == "/>" and tag not in INLINE and tag not in ("div", "p", "section"):
            continue
        names = [f"tag:{tag}", *(f"name:{w}" for w in dict.fromkeys(names_of(m[3])))]
        open_tag(tag, names if known is None else [f for f in names if f in known])
    flush()
    return out
