"""A small tolerant HTML reader: blocks, their text, and what a classifier asks of them."""

from __future__ import annotations

import re
from html import unescape

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
_NAMED = re.compile(r"(class|id|role|style|hidden|aria-hidden|type|name|itemprop)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_TOKEN = re.compile(r"[a-z]+")
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "select", "xmp", "noembed", "noframes")}
#: Elements that do not end a block of text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label map mark picture q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr br input button audio video object embed param area track canvas meter progress output".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_ITEMS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
_SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
_CONTROLS = frozenset("input button select textarea".split())

TAGS = "p h1 h2 h3 li ul ol div section article main nav header footer aside form table tr td blockquote pre figure figcaption dl html body fieldset #text".split()
_TAG = {t: i for i, t in enumerate(TAGS)}


class Page:
    """Blocks in page order. ``own`` are pieces of text directly in a block."""

    def __init__(self) -> None:
        self.tag: list[int] = []
        self.parent: list[int] = []
        self.end: list[int] = []
        self.depth: list[int] = []
        self.tokens: list[tuple[str, ...]] = []  # words of class, id, role and itemprop, and "hidden"
        self.controls: list[int] = []
        self.link: list[int] = []  # characters of text within links
        self.own: list[list[str]] = []

    def open(self, tag: str, parent: int, depth: int, tokens: tuple[str, ...]) -> int:
        self.tag.append(_TAG.get(tag, len(TAGS)))
        self.parent.append(parent)
        self.end.append(-1)
        self.depth.append(depth)
        self.tokens.append(tokens)
        self.controls.append(0)
        self.link.append(0)
        self.own.append([])
        return len(self.tag) - 1


def _tokens(attributes: str) -> tuple[str, ...]:
    """The distinct words of an element's attributes that say what it is for."""
    found: dict[str, None] = {}
    for name, value in _NAMED.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            found["hidden"] = None
        elif name in ("class", "id", "role", "itemprop"):
            found.update(dict.fromkeys(_TOKEN.findall(value)))
    return tuple(found)


def parse(html: str) -> Page:
    """The page's blocks. Scripts, styles, titles and the like have no text."""
    page = Page()
    root = page.open("html", -1, 0, ())
    stack: list[tuple[str, int]] = [("html", root)]  # open elements, inline ones with their block's number
    at, n = 0, len(html)
    run: list[str] = []
    block = root
    links = 0

    def flush() -> None:
        nonlocal run
        if run:
            text = " ".join(unescape("".join(run)).split())
            if text:
                leaf = page.open("#text", block, page.depth[block] + 1, ())
                page.end[leaf] = leaf + 1
                page.own[leaf].append(text)
                page.link[leaf] = min(linked[0], len(text))
            run = []
        linked[0] = 0

    linked = [0]

    def close(to: int) -> None:
        """Pop elements until ``to`` are open."""
        nonlocal block, links
        while len(stack) > to:
            name, number = stack.pop()
            if name == "a":
                links -= 1
            if name not in INLINE:
                flush()
                page.end[number] = len(page.tag)
                block = page.parent[number]

    for m in _MARKUP.finditer(html):
        if m.start() < at:
            continue
        if m.start() > at:
            text = html[at : m.start()]
            run.append(text)
            if links:
                linked[0] += len(text)
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        name, attributes = name.lower(), (m[3] or m[6] or "")
        if m[1] or m[4]:
            if name == "br":
                run.append(" ")
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    close(i)
                    break
                if name in INLINE and stack[i][0] not in INLINE:
                    break
            continue
        if name in _RAW:
            stop = _RAW[name].search(html, at)
            at = stop.end() if stop else n
            page.controls[block] += name in _CONTROLS
            continue
        if name in VOID:
            if name in ("br", "wbr"):
                run.append(" " if name == "br" else "")
            elif name == "hr":
                flush()
            elif name == "input":
                page.controls[block] += 1
            continue
        if name in INLINE:
            page.controls[block] += name in _CONTROLS
            if not attributes.rstrip().endswith("/"):
                links += name == "a"
                stack.append((name, block))
            continue
        if name in ("html", "head"):
            if name == "head":
                flush()
            continue
        if name in _CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] not in INLINE:
                    break
        if name in _ITEMS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in _ITEMS[name]:
                    close(i)
                    if name != "tr" or stack[i - 1][0] not in ("tr", "td", "th"):
                        break
                if stack[min(i, len(stack) - 1)][0] in _SCOPES.get(name, ()):
                    break
        flush()
        block = page.open(name, block, page.depth[block] + 1, _tokens(attributes) if attributes else ())
        stack.append((name, block))
    if at < n:
        run.append(html[at:])
    flush()
    close(0)
    page.end[root] = len(page.tag)
    return page
