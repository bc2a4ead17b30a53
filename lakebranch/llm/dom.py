"""A forgiving HTML parser that makes a tree of elements and of text blocks.

A block is the text between two boundaries of block-level elements; inline elements, line breaks among them, don't end one.
Character references are decoded and white space becomes single spaces. Scripts, styles, titles and the like, comments and
declarations have no text; what is in math, svg, object, noscript and media elements has, and one of those that isn't closed ends with
its block. A noscript is a block of its own but inside a paragraph or heading.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# Fixed values of the HTML standard: element names by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea template iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table "
    "tbody td tfoot th thead tr ul".split()
)
#: An element's start ends an open one of these, up to the nearest of the second set.
ENDS = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "tr": (frozenset("tr td th".split()), frozenset("table".split())),
    "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "option": (frozenset(["option"]), frozenset("select".split())),
    "body": (frozenset(["head"]), frozenset()),
}

_TOKEN = re.compile(
    r"<!--(?:.*?--!?>|.*\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)",
    re.S,
)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)


@dataclass
class Node:
    """An element, or with an empty tag a text block; parent is a place in the page's list, -1 for the root."""

    tag: str
    parent: int
    attrs: dict[str, str] = field(default_factory=dict)
    text: str = ""
    linked: int = 0  # characters inside links


def attributes(raw: str) -> dict[str, str]:
    if "=" not in raw and "hidden" not in raw.lower():
        return {}
    return {m[1].lower(): html.unescape((m[2] or "").strip("\"'")) for m in _NAMES.finditer(raw)}


def parse(page: str) -> list[Node]:
    """The nodes of a page in page order, the root first."""
    nodes = [Node("#root", -1)]
    stack: list[tuple[str, int]] = [("#root", 0)]  # open elements: tag, and whether a node
    parents = [0]  # the nodes among them
    held: list[str] = []
    links = linked = 0

    def put(raw: str) -> None:
        nonlocal linked
        text = html.unescape(raw) if "&" in raw else raw
        held.append(text)
        if links:
            linked += len(text)

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            if text:
                nodes.append(Node("", parents[-1], text=text, linked=min(linked, len(text))))
            held.clear()
            linked = 0

    def close(depth: int) -> None:
        nonlocal links
        for tag, is_node in stack[depth:]:
            links -= tag == "a"
            if is_node:
                parents.pop()
        del stack[depth:]

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            put(page[at:])
            break
        if m.start() > at:
            put(page[at : m.start()])
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        if m["end"] or m["end2"]:
            for depth in range(len(stack) - 1, 0, -1):
                tag = stack[depth][0]
                if tag == name:
                    if name in BLOCK or stack[depth][1]:
                        flush()
                    close(depth)
                    break
                if name not in BLOCK and name != "noscript" and tag in BLOCK:
                    break  # an inline element's end doesn't reach out of its block
            continue
        if name in RAW:
            if not (m["attrs"] or m["attrs2"] or "").endswith("/"):
                closing = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                at = closing.end() if closing else end
            continue
        if name == "xmp" and (closing := re.compile(r"</xmp(?=[\s/>])[^>]*>?", re.I).search(page, at)):
            flush()
            held.append(page[at : closing.start()])  # as it stands, without tags or references
            linked = len(held[-1]) if links else 0
            flush()
            at = closing.end()
            continue
        if name == "noscript" and not any(tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6") for tag, is_node in stack if is_node):
            flush()
            nodes.append(Node(name, parents[-1]))
            parents.append(len(nodes) - 1)
            stack.append((name, 1))
            continue
        if name in BLOCK:
            flush()
            ends, within = ENDS.get(name, (frozenset(), frozenset()))
            for depth in range(len(stack) - 1, 0, -1):
                tag = stack[depth][0]
                if tag in ends or tag == "p":
                    close(depth)
                    if tag == "p" and ends:
                        continue
                    if name not in ("tr", "tbody", "body"):
                        break
                elif tag in within or tag in BLOCK and not (ends and tag not in within and tag in ("tbody", "thead", "tfoot")):
                    break
        if name in VOID:
            if name == "br":
                held.append(" ")
            elif name == "hr":
                flush()
            continue
        if name in BLOCK:
            nodes.append(Node(name, parents[-1], attributes(m["attrs"] or m["attrs2"] or "")))
            parents.append(len(nodes) - 1)
            stack.append((name, 1))
        elif name == "a" or not (m["attrs"] or m["attrs2"] or "").endswith("/"):
            stack.append((name, 0))
            links += name == "a"
    flush()
    return nodes
