"""Leaf blocks of a web page: one pass over its markup, linear in its length whatever is left open in it."""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

# Names of elements as browsers treat them.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
HIDDEN = frozenset("template noscript svg select datalist canvas object audio video".split())
#: An element that a new one of the second kind ends, if it is the innermost block that is open.
ENDED_BY = {
    "p": BLOCK - {"body", "html"}, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}),
    "td": frozenset({"td", "th", "tr", "tbody", "tfoot"}), "th": frozenset({"td", "th", "tr", "tbody", "tfoot"}), "tr": frozenset({"tr", "tbody", "tfoot"}),
    "option": frozenset({"option", "optgroup"}),
}
CONTROLS = frozenset("a button label".split())
#: Open elements from which on a new one takes the place of the innermost, as in browsers.
DEEPEST = 512

_TAG = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
_MARKS = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAMES = re.compile(r"[a-z]+|[0-9]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}


class Block(NamedTuple):
    path: tuple[tuple[str, ...], ...]  #: of each open block element its name and the words of class, id and role
    text: str
    linked: int  #: characters inside links, buttons and labels


def marks(attributes: str) -> tuple[str, ...]:
    """Words of class, id and role; those that case joins come apart."""
    if "=" not in attributes:
        return ()
    found = " ".join(a or b or c for a, b, c in _MARKS.findall(attributes))
    return tuple(_NAMES.findall(re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", found).lower()))


def leaf_blocks(page: str | None) -> list[Block]:
    """The runs of text between the edges of block elements, white space turned into single blanks, in page order.

    Scripts, styles, comments, the head and hidden elements have no text.  Of a null or empty page there are none.
    """
    out: list[Block] = []
    if not page:
        return out
    stack: list[tuple[str, ...]] = []
    open_: Counter[str] = Counter()
    path: tuple[tuple[str, ...], ...] | None = ()
    parts: list[str] = []
    linked = controls = hidden = at = 0
    in_head = False

    def flush() -> None:
        nonlocal linked
        if parts:
            words = "".join(parts).split()
            parts.clear()
            if words:
                nonlocal path
                if path is None:
                    path = tuple(stack)
                out.append(Block(path, " ".join(words), linked))
            linked = 0

    def take(text: str) -> None:
        nonlocal linked
        text = html.unescape(text) if "&" in text else text
        parts.append(text)
        if controls:
            linked += len(text.strip())

    def pop_to(name: str) -> None:
        nonlocal path
        while stack:
            top = stack.pop()[0]
            open_[top] -= 1
            if top == name:
                break
        path = None

    size = len(page)
    while at < size:
        m = _TAG.search(page, at)
        if m is None:
            if not (hidden or in_head):
                take(page[at:])
            break
        start, end = m.span()
        if start > at and not (hidden or in_head):
            take(page[at:start])
        at, name = end, m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name == "head":
                in_head = False
            elif name in HIDDEN:
                hidden = max(0, hidden - 1)
            elif name in CONTROLS:
                controls = max(0, controls - 1)
            elif name in BLOCK:
                flush()
                controls = 0
                if open_[name]:
                    pop_to(name)
            continue
        if name in RAW:
            close = _RAW_END[name].search(page, at)
            at = close.start() if close else size
        elif name in HIDDEN:
            if not m[3].endswith("/"):
                hidden += 1
        elif name == "head":
            in_head = True
        elif name in BLOCK:
            in_head = in_head and name == "html"
            flush()
            controls = 0
            if stack and name in ENDED_BY.get(stack[-1][0], ()):
                pop_to(stack[-1][0])
            if len(stack) >= DEEPEST:
                pop_to(stack[-1][0])
            if name not in VOID:
                stack.append((name, *marks(m[3])))
                open_[name] += 1
            path = None
        elif name in CONTROLS:
            controls += 1
        elif name == "br" and not hidden:
            parts.append(" ")
    flush()
    return out
