"""Splits a web page into leaf blocks of text with the path of elements around each."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attr>(?:[^>\"'<]++|\"[^\"<]*+\"|'[^'<]*+'|[\"'])*+)(?:>|(?=<)|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
NAME = re.compile(r"[a-z]+")

#: Elements without content, elements whose content is not text of the page, elements inside a line of text,
#: and elements that end an open one of the same kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript textarea title iframe object svg math select canvas audio video".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br nobr".split()
)
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HOLDERS = frozenset("ul ol dl table tbody thead tfoot article section main div body nav aside header footer form blockquote".split())


@dataclass(frozen=True)
class Block:
    """Text with white space as single spaces; ``path`` has (tag, names) from the root; ``linked`` characters in links."""

    path: tuple
    text: str
    linked: int


def names(attributes: str) -> tuple[str, ...]:
    """Words of an element's class, id and role, and ``hidden`` if it is not shown."""
    out = []
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), (a or b or c).lower()
        if key in ("class", "id", "role"):
            out += [n for part in value.split() for n in {part[:40], *NAME.findall(part)}]
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
            out.append("hidden")
    return tuple(sorted(set(out)))


class _Reader:
    def __init__(self):
        self.path: list[tuple] = []
        self.parts: list[str] = []
        self.linked = 0
        self.blocks: list[Block] = []

    def end_block(self) -> None:
        text = " ".join(html.unescape("".join(self.parts)).split()) if self.parts else ""
        if text:
            at = tuple(p for p in self.path if p[0] not in INLINE)
            self.blocks.append(Block(at, text, min(len(text), self.linked)))
        self.parts, self.linked = [], 0

    def add(self, text: str) -> None:
        if text:
            self.parts.append(text)
            if any(p[0] == "a" for p in reversed(self.path)):
                self.linked += len(text)

    def open(self, tag: str, attributes: str) -> None:
        if tag not in INLINE:
            self.end_block()
            for i in range(len(self.path) - 1, -1, -1):
                if self.path[i][0] in CLOSES.get(tag, ()) or (tag not in ("li", "dt", "dd") and self.path[i][0] == "p"):
                    del self.path[i:]
                    break
                if self.path[i][0] in HOLDERS:
                    break
        if tag == "br":
            self.parts.append("\n")
        if tag not in VOID and not attributes.rstrip().endswith("/"):
            self.path.append((tag, names(attributes) if attributes else ()))

    def close(self, tag: str) -> None:
        if tag not in INLINE:
            self.end_block()
        for i in range(len(self.path) - 1, -1, -1):
            if self.path[i][0] == tag:
                del self.path[i:]
                return
            if tag in INLINE and self.path[i][0] not in INLINE:
                return


def read_blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order; markup may be broken or cut off.

    Scripts, styles, titles and other elements that show no text of the page give no block, comments neither.
    Character references are decoded and a line break counts as white space.
    """
    page = page or ""
    reader, at = _Reader(), 0
    while m := TAG.search(page, at):
        reader.add(page[at : m.start()])
        at = m.end()
        if m.end() == m.start():
            at += 1
        tag = (m.group("tag") or "").lower()
        if not tag:
            continue
        if m.group("end"):
            reader.close(tag)
        elif tag in RAW and not m.group("attr").rstrip().endswith("/"):
            if tag not in INLINE:
                reader.end_block()
            over = re.compile(rf"</{re.escape(tag)}\s*>?", re.I).search(page, at)
            at = over.end() if over else len(page)
        else:
            reader.open(tag, m.group("attr"))
    reader.add(page[at:])
    reader.end_block()
    return reader.blocks
