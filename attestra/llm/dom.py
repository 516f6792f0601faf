"""Leaf blocks of a web page: a tolerant reader of tags that keeps open elements on a stack.

The reader takes time in proportion to the page, whatever it holds: a place is looked at
a fixed number of times, what is open is counted by kind, and the open element that a tag
ends is found by its kind's own stack. Rules for broken markup: a ``<`` that no ``>``
follows is text, as is one before anything but a letter, ``/``, ``!`` or ``?``. A tag whose
quotes never close ends at its first ``>``; from there on the page's quotes don't hide ``>``.
An unclosed comment or raw element (script, style, ...) reaches to the end of the page.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
#: Elements whose content is no text of the page.
RAW = frozenset("script style template noscript iframe svg canvas object math title textarea select".split())
#: An opening tag that ends an open element of its row.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Ends of elements don't reach beyond these.
WALLS = frozenset("article main section aside nav header footer div table ul ol body form".split())

_OPEN = re.compile(r"</?[a-zA-Z]|<[!?]")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile("[>\"']")
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"[a-z]+")
_RAW_END = {tag: re.compile(f"</{tag}", re.I) for tag in RAW}


class Block(NamedTuple):
    text: str
    #: Kinds of the open elements, and that of the innermost.
    tags: frozenset[str]
    inner: str
    #: What the words of their classes, ids and roles stand for.
    kinds: frozenset[str]
    #: Characters of the text inside links.
    linked: int


class _Tags:
    """Where the tags of a page end."""

    def __init__(self, page: str):
        self.page, self.quotes = page, True

    def end(self, at: int) -> int:
        """The place of the ``>`` that ends the tag at ``at``; -1 if no ``>`` follows."""
        plain = self.page.find(">", at)
        if plain < 0 or not self.quotes:
            return plain
        k = at
        while True:
            m = _STOP.search(self.page, k)
            if m and m[0] == ">":
                return m.start()
            k = self.page.find(m[0], m.end()) + 1 if m else 0
            if not k:
                self.quotes = False  # looked through to the end once; not again
                return plain


class _Stack:
    """The open elements: which kinds are open, and for each kind where its last one stands."""

    def __init__(self, tags: frozenset[str], kinds: dict[str, str]):
        self.known, self.kind_of = tags, kinds
        self.rows: list[tuple[str, frozenset[str]]] = []
        self.places: dict[str, list[int]] = {}
        self.walls: list[int] = []
        self.tags: Counter = Counter()
        self.kinds: Counter = Counter()

    def last(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def wall(self) -> int:
        return self.walls[-1] if self.walls else -1

    def push(self, tag: str, words: set[str]) -> None:
        kinds = frozenset(self.kind_of[w] for w in words if w in self.kind_of)
        self.places.setdefault(tag, []).append(len(self.rows))
        if tag in WALLS:
            self.walls.append(len(self.rows))
        if tag in self.known:
            self.tags[tag] += 1
        self.kinds.update(kinds)
        self.rows.append((tag, kinds))

    def cut(self, at: int) -> None:
        """Closes the element at ``at`` and all inside it."""
        while len(self.rows) > at:
            tag, kinds = self.rows.pop()
            self.places[tag].pop()
            if tag in WALLS:
                self.walls.pop()
            for counts, own in ((self.tags, (tag,) if tag in self.known else ()), (self.kinds, kinds)):
                for x in own:
                    counts[x] -= 1
                    if not counts[x]:
                        del counts[x]


def blocks(page: str | None, tags: frozenset[str] = frozenset(), kinds: dict[str, str] | None = None) -> list[Block]:
    """The non-empty leaf blocks in page order; character references decoded, white space as one space, trimmed.

    tags: kinds of elements that blocks name; kinds: what words of classes, ids and roles stand for."""
    page = page or ""
    out: list[Block] = []
    stack, ends = _Stack(tags, kinds or {}), _Tags(page)
    parts: list[str] = []
    linked = at = 0

    def flush():
        nonlocal linked
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            out.append(Block(text, frozenset(stack.tags), stack.rows[-1][0] if stack.rows else "", frozenset(stack.kinds), linked))
        linked = 0

    def say(piece: str):
        nonlocal linked
        if piece:
            piece = html.unescape(piece) if "&" in piece else piece
            parts.append(piece)
            if stack.places.get("a"):
                linked += len(piece.strip())

    while True:
        m = _OPEN.search(page, at)
        start = m.start() if m else len(page)
        if m and page.startswith("<!--", start):
            say(page[at:start])
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        end = ends.end(start + 1) if m and m[0] not in ("<!", "<?") else page.find(">", start) if m else -1
        if end < 0:  # no tag is left
            say(page[at:])
            break
        say(page[at:start])
        at = end + 1
        if m[0] in ("<!", "<?"):
            continue
        closing = m[0][1] == "/"
        name = _NAME.match(page, start + 1 + closing)
        tag, rest = name[0].lower(), page[min(name.end(), end) : end]
        if name.end() > end:
            tag = page[name.start() : end].lower()
        if tag in RAW:
            if not closing and not rest.endswith("/"):
                close = _RAW_END[tag].search(page, at)
                end = page.find(">", close.end()) if close else -1
                at = end + 1 if end >= 0 else len(page)
            if tag not in INLINE:
                parts.append(" ")
            continue
        if tag == "br":
            parts.append(" ")
            continue
        inline = tag in INLINE
        if not inline:
            flush()
        if closing:
            k = stack.last((tag,))
            # a wall that is no element of this kind holds back the ends of inline elements, paragraphs and rows
            if k >= 0 and (k >= stack.wall() or not (inline or tag == "p" or tag in CLOSES)):
                stack.cut(k)
            continue
        if not inline:
            k = stack.last(CLOSES.get(tag, set()) | {"p"})
            if k >= 0 and k > max(stack.wall(), stack.last(("tr",)) if tag in ("td", "th") else -1):
                stack.cut(k)
        if tag not in VOID and not rest.endswith("/"):
            stack.push(tag, set(_PARTS.findall(" ".join(x for g in _NAMES.findall(rest) for x in g).lower())) if rest else set())
    flush()
    return out
