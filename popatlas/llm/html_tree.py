"""Pages as trees of block elements and texts, tolerant of broken markup."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

INLINE = frozenset(
    """a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark picture
    q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr""".split()
)
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg".split())
# Open elements that a start tag ends, up to the nearest of the elements that keep them apart.
_BLOCKS = frozenset(
    """address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2
    h3 h4 h5 h6 header hr main menu nav ol p pre section table ul""".split()
)
ENDS = {tag: ("p",) for tag in _BLOCKS} | {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "tbody": ("tr", "td", "th", "thead", "tbody"),
    "tfoot": ("tr", "td", "th", "thead", "tbody"),
    "option": ("option",),
    "body": ("head",),
}
KEEPS_APART = frozenset("ul ol dl table select article section div aside nav header footer main form body html".split())
TEXT = "#"
DEEPEST = 200

_MARKUP = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?"
    r"|<([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+)>|<([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
_NAMES = re.compile(r"\b(class|id|role|itemprop|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)", re.I)
_SHOWN = re.compile(r"(?:^|\s)(?:class|role|itemprop|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_ID = re.compile(r"(?:^|\s)id\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
# Elements whose ids name a place in the text, and those that no name but ``hidden`` tells about.
ANCHORS = frozenset("a section".split())
UNNAMED = frozenset("html body main article h1 h2 h3 h4 h5 h6".split())
HIDDEN = "[hidden]"
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_END_OF = {tag: re.compile(rf"</{tag}\b[^>]*>?", re.I) for tag in RAW}


class Node:
    """An element or a text. ``key`` is what nodes are aligned by, ``words`` the words of its
    names, ``names`` the whole names that may tell that it is left out."""

    __slots__ = ("key", "tag", "words", "names", "kids", "text", "many", "maybe")

    def __init__(self, tag: str, words: frozenset[str] = frozenset(), text: str | None = None):
        self.tag, self.words, self.text = tag, words, text
        self.key = f"{tag}.{'.'.join(sorted(words))}" if words else tag
        self.names: frozenset[str] = frozenset()
        self.kids: list[Node] = []
        self.many = self.maybe = False


def _words(attributes: str) -> frozenset[str]:
    if "=" not in attributes and "hidden" not in attributes:
        return frozenset()
    found = [w.lower() for _, v in _NAMES.findall(attributes) for w in _WORD.findall(v)]
    if _HIDDEN.search(re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes)):
        found.append("hidden")
    return frozenset(found)


def _names(tag: str, attributes: str) -> frozenset[str]:
    """Whole class, role and other names, in small letters, and ``HIDDEN`` if so marked."""
    if "=" not in attributes and "hidden" not in attributes:
        return frozenset()
    found = []
    if tag not in UNNAMED:
        found = [n for v in _SHOWN.findall(attributes) for n in v.strip("\"'").lower().split()]
        if tag not in ANCHORS:
            found += [n for v in _ID.findall(attributes) for n in v.strip("\"'").lower().split()]
    if _HIDDEN.search(re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes)):
        found.append(HIDDEN)
    return frozenset(found)


def parse(html: str, marked: frozenset[str] = frozenset()) -> Node:
    """The tree of a page. Inline elements dissolve into the text around them, unless one of
    their names is in ``marked``; a line break becomes a blank. End tags without a start are
    ignored, missing ones implied. Comments and raw content (scripts, say) are left out.
    Elements more than ``DEEPEST`` levels down do not nest; their texts join those around, and
    their end tags close only them."""
    root = Node("page")
    stack = [root]
    deeper: list[str] = []
    counts: Counter[str] = Counter()
    texts: list[str] = []

    def flush() -> None:
        if texts:
            text = " ".join(unescape("".join(texts)).split())
            texts.clear()
            if text:
                stack[-1].kids.append(Node(TEXT, text=text))

    at = 0
    while found := _MARKUP.search(html, at):
        if found.start() > at:
            texts.append(html[at : found.start()])
        at = found.end()
        end, start, attributes = found[1], found[2] or found[4], found[3] or found[5] or ""
        if end:
            tag = end.lower()
            if counts[tag]:
                flush()
                last = ""
                while last != tag:
                    last = deeper.pop()
                    counts[last] -= 1
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    flush()
                    del stack[depth:]
                    deeper.clear()
                    counts.clear()
                    break
            else:
                if tag == "p" or (tag not in INLINE and tag != "br"):
                    flush()
                elif tag == "br":
                    texts.append(" ")
            continue
        if not start:
            continue
        tag = start.lower()
        if tag in RAW:
            close = _END_OF[tag].search(html, at)
            at = close.end() if close else len(html)
            continue
        if tag == "br":
            texts.append(" ")
            continue
        words = _words(attributes)
        names = _names(tag, attributes) if words else words
        if tag in INLINE and not names & marked:
            continue
        flush()
        ended = () if deeper else ENDS.get(tag, ())
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in ended:
                del stack[depth:]
                # A start tag may end several, a cell and its row for one.
                if not any(n.tag in ended for n in stack[depth - 1 :]):
                    break
            elif stack[depth].tag in KEEPS_APART:
                break
        node = Node(tag, words)
        node.names = names
        stack[-1].kids.append(node)
        if tag not in VOID and not attributes.endswith("/"):
            if len(stack) < DEEPEST:
                stack.append(node)
            else:
                deeper.append(tag)
                counts[tag] += 1
    texts.append(html[at:])
    flush()
    return root
