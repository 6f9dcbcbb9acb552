"""A page as a tree of elements and text runs, tolerant of what browsers tolerate."""

from __future__ import annotations

import html
import re

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<svg\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?<=/)>"  # an svg that ends in its own tag has no content
    r"|<(script|style|noscript|template|textarea|iframe|svg|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>", re.S | re.I)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|itemprop|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that stand in a line of text like a letter, whether or not they have content of their own.
FLOWING = INLINE | frozenset("img picture audio video canvas object map area input button select textarea meter progress".split())
#: Elements that a new one of these closes when they are open: tag -> (closed tags, tags that stop the search).
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}


class Node:
    """An element (``tag``) or a text run (``tag`` empty, ``text`` set); parents come before their children."""

    __slots__ = ("tag", "parent", "names", "text", "breaks")

    def __init__(self, tag: str, parent: int, names: str = "", text: str = "", breaks: bool = False):
        self.tag, self.parent, self.names, self.text, self.breaks = tag, parent, names, text, breaks


def parse(page: str) -> list[Node]:
    """The tree, root first. ``breaks`` on a text run: a block border or line break stands before it."""
    nodes, stack, place, breaks = [Node("#root", -1)], [0], 0, True

    def text(a: int, b: int) -> None:
        nonlocal breaks
        if a < b:
            run = html.unescape(page[a:b]) if "&" in page[a:b] else page[a:b]
            nodes.append(Node("", stack[-1], text=run, breaks=breaks))
            breaks = False

    for m in TOKEN.finditer(page):
        text(place, m.start())
        place = m.end()
        tag = m[3]
        if not tag:
            continue
        tag = tag.lower()
        if m[2]:
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].tag == tag:
                    del stack[k:]
                    break
            breaks |= tag not in FLOWING
            continue
        if tag not in FLOWING:
            breaks = True
            for k in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph, with the inline elements left open in it
                if nodes[stack[k]].tag == "p":
                    del stack[k:]
                    break
                if nodes[stack[k]].tag not in FLOWING:
                    break
        if tag in CLOSES:
            closed, stops = CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].tag in closed:
                    del stack[k:]
                    break
                if nodes[stack[k]].tag in stops:
                    break
        if tag in VOID:
            continue
        names = " ".join(f"{a[0]} {a[1] or a[2] or a[3]}" for a in ATTRIBUTE.findall(m[4])).lower() if m[4] else ""
        nodes.append(Node(tag, stack[-1], names))
        if not m[4].rstrip().endswith("/") or tag not in INLINE:
            stack.append(len(nodes) - 1)
    rest = page[place:]
    cut = re.search(r"<[a-zA-Z/!?][^>]*\Z", rest)  # a tag that the page's end cuts off
    text(place, place + cut.start() if cut else len(page))
    return nodes


def joined(nodes: list[Node], keep: list[bool]) -> str:
    """The kept runs in page order: white space is one space, and so is a block border or what was left out."""
    parts, gap = [], False
    for node, kept in zip(nodes, keep):
        if node.tag:
            continue
        if not kept:
            gap |= bool(node.text.strip()) or node.breaks
            if not node.text.strip():
                parts.append(" ")
            continue
        if gap or node.breaks:
            parts.append(" ")
        parts.append(node.text)
        gap = False
    return " ".join("".join(parts).split())
